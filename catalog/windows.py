"""Ordering, prefix, join and set building blocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cardwatch.operators.evaluate import rank_scores
from cardwatch.operators.features import CARD_ORDER, MERCHANT_ORDER, keyed_history, prepare
from cardwatch.operators.knn import knn_join
from cardwatch.operators.running_median import median_of_sliced_histories, median_of_whole_histories
from cardwatch.operators.summaries import rank_page, top_k
from cardwatch.operators.versions import dedupe_first
from cardwatch.plans.history import before, lookback_counts
from cardwatch.plans.prefix import prefix_sum
from cardwatch.plans.slices import plan_slices, with_slice
from catalog.features import BASE, HISTORY
from catalog.registry import EVALUATED, LATEST, SCORED, TS, TX, add, as_double

ORDER = "ORDER BY us, trans_num"
PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def card():
    return Window.partitionBy("cc_num").orderBy(*CARD_ORDER)


add(
    "w_1",
    lambda t: dedupe_first(t.tx, "cc_num", [TS, "trans_num"]).select("cc_num", "trans_num", TS),
    f"SELECT cc_num, trans_num, {TS} FROM (SELECT *, row_number() OVER (PARTITION BY cc_num ORDER BY {TS}, trans_num) AS r FROM {TX} t) x WHERE r = 1",
)
add(
    "w_2",
    lambda t: prepare(t.tx).select("trans_num", F.lag("amt").over(card()).alias("prev_amt")),
    f"SELECT trans_num, lag(amt) OVER (PARTITION BY cc_num {ORDER}) AS prev_amt FROM ({BASE}) b",
)
add(
    "w_3",
    lambda t: keyed_history(prepare(t.tx), ["cc_num"], "amt", CARD_ORDER).select("trans_num", "prior_n", "prior_mean"),
    f"SELECT trans_num, n AS prior_n, u_mean AS prior_mean FROM {HISTORY} h",
    "prior_mean",
)
add(
    "w_4",
    lambda t: keyed_history(prepare(t.tx), ["cc_num"], "amt", CARD_ORDER).select("trans_num", "prior_std"),
    f"SELECT trans_num, u_std AS prior_std FROM {HISTORY} h",
    "prior_std",
)
add(
    "w_5",
    lambda t: median_of_whole_histories(prepare(t.tx), ["cc_num"], CARD_ORDER, "amt", "prior_median").select("trans_num", "prior_median"),
    f"SELECT trans_num, u_median AS prior_median FROM {HISTORY} h",
    "prior_median",
)


def sliced_median(t):
    rows = prepare(t.tx)
    plan = plan_slices(rows, CARD_ORDER, ["merchant"], rows_per_slice=100)
    rows = with_slice(rows, plan, "part")
    out = median_of_sliced_histories(rows, rows, ["merchant"], "part", CARD_ORDER, "amt", "prior_median", 100)
    return out.select("trans_num", "prior_median")


add(
    "w_5_sliced",
    sliced_median,
    f"SELECT trans_num, median(amt) OVER (PARTITION BY merchant {ORDER} {PRIOR}) AS prior_median FROM ({BASE}) b",
    "prior_median",
)
add(
    "w_6",
    lambda t: prepare(t.tx).join(lookback_counts(prepare(t.tx), ["cc_num"], {"n_2h": 7200}), ["cc_num", "__sec"]).select("trans_num", "n_2h"),
    f"SELECT trans_num, v_2h AS n_2h FROM {HISTORY} h",
)
add(
    "w_7",
    lambda t: prepare(t.tx)
    .withColumn("first", (F.count(F.lit(1)).over(before(["cc_num", "city"], CARD_ORDER)) == 0).cast("int"))
    .select("trans_num", "first", F.coalesce(F.sum("first").over(before(["cc_num"], CARD_ORDER)), F.lit(0)).alias("seen")),
    f"""SELECT trans_num, new_city AS first, coalesce(sum(new_city) OVER (PARTITION BY cc_num {ORDER} {PRIOR}), 0)::BIGINT AS seen FROM {HISTORY} h""",
)
add(
    "w_8",
    lambda t: keyed_history(prepare(t.tx), ["merchant"], "amt", MERCHANT_ORDER, rows_per_slice=50).select(
        "trans_num", "prior_n", "prior_mean", "prior_std"
    ),
    f"""SELECT trans_num, count(*) OVER m AS prior_n, avg(amt) OVER m AS prior_mean, stddev_samp(amt) OVER m AS prior_std FROM ({BASE}) b
 WINDOW m AS (PARTITION BY merchant ORDER BY us, cc_num, trans_num {PRIOR})""",
    "prior_mean prior_std",
)
add(
    "w_9",
    lambda t: prefix_sum(t.tx.withColumn("one", F.lit(1)), ["amt", "trans_num"], ["is_fraud", "one"], rows_per_slice=500).select(
        "trans_num", "pos", "cum_is_fraud", "cum_one"
    ),
    f"""SELECT trans_num, row_number() OVER w - 1 AS pos, (sum(is_fraud) OVER w)::BIGINT AS cum_is_fraud, (count(*) OVER w) AS cum_one
 FROM {TX} t WINDOW w AS (ORDER BY amt, trans_num)""",
)
add(
    "w_9_keyed",
    lambda t: prefix_sum(t.tx, ["amt", "trans_num"], ["is_fraud"], ["category"], rows_per_slice=500).select("trans_num", "pos", "cum_is_fraud"),
    f"""SELECT trans_num, row_number() OVER w - 1 AS pos, (sum(is_fraud) OVER w)::BIGINT AS cum_is_fraud
 FROM {TX} t WINDOW w AS (PARTITION BY category ORDER BY amt, trans_num)""",
)

add(
    "o_1",
    lambda t: top_k(t.tx, [F.desc("amt"), F.asc("trans_num")], 25).select("trans_num", "amt"),
    f"SELECT trans_num, amt FROM {TX} t ORDER BY amt DESC, trans_num LIMIT 25",
)
add(
    "o_2",
    lambda t: rank_page(t.tx, [F.desc("amt"), F.asc("trans_num")], 25, 50).select("trans_num", "amt", "rank"),
    f"""SELECT trans_num, amt, row_number() OVER (ORDER BY amt DESC, trans_num) AS rank FROM {TX} t
 ORDER BY amt DESC, trans_num LIMIT 25 OFFSET 50""",
)
add(
    "o_2_deep",
    lambda t: rank_page(t.tx, [F.desc("amt"), F.asc("trans_num")], 25, t.tx.count() // 10 * 9, rows_per_task=500).select("trans_num", "amt", "rank"),
    f"""SELECT trans_num, amt, row_number() OVER (ORDER BY amt DESC, trans_num) AS rank FROM {TX} t
 ORDER BY amt DESC, trans_num LIMIT 25 OFFSET (SELECT count(*) // 10 * 9 FROM {TX} u)""",
)
add(
    "o_3",
    lambda t: t.tx.orderBy(TS, "cc_num", "trans_num").select("trans_num", TS, "cc_num"),
    f"SELECT trans_num, {TS}, cc_num FROM {TX} t ORDER BY {TS}, cc_num, trans_num",
)
BATCHED = "floor(CAST(trans_num AS BIGINT) / 500)::BIGINT"


def batched(df):
    return df.withColumn("batch_id", F.floor(F.col("trans_num").cast("long") / 500).cast("long"))


add(
    "o_4",
    lambda t: rank_scores(batched(t.scored), by=["batch_id"]).select("batch_id", "trans_num", "rank"),
    f"""SELECT {BATCHED} AS batch_id, trans_num, row_number() OVER (PARTITION BY {BATCHED} ORDER BY risk_score DESC, trans_num) AS rank
 FROM {SCORED} s""",
)
add(
    "j_1",
    lambda t: as_double(t.evaluated, "risk_score").select("trans_num", "is_fraud", "prediction", "risk_score"),
    f"SELECT trans_num, is_fraud, prediction, risk_score::DOUBLE AS risk_score FROM {EVALUATED} e",
)


def share_of_known(t):
    quality = t.tx.groupBy("merchant").agg(F.count(F.lit(1)).alias("n"))
    risky = t.tx.where("is_fraud = 1").groupBy("merchant").agg(F.count(F.lit(1)).alias("frauds"))
    return quality.join(risky, "merchant", "left")


add(
    "j_2",
    share_of_known,
    f"""SELECT q.merchant, q.n, r.frauds FROM (SELECT merchant, count(*) AS n FROM {TX} t GROUP BY 1) q
 LEFT JOIN (SELECT merchant, count(*) AS frauds FROM {TX} t WHERE is_fraud = 1 GROUP BY 1) r ON r.merchant = q.merchant""",
)
add(
    "j_5",
    lambda t: knn_join(t.vectors.where("is_minority = 0"), t.vectors.where("is_minority = 1"), "embedding", 5).select(
        F.col("left_id").alias("vec_id"), "neighbour_id", "distance", F.col("rank").cast("long").alias("rank")
    ),
    """SELECT * FROM (SELECT a.vec_id, b.vec_id AS neighbour_id, a_b AS distance,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY a_b, b.vec_id) AS rank FROM
 (SELECT a.vec_id AS va, b.vec_id AS vb, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS a_b
  FROM embeddings a, embeddings b WHERE a.label <> 0 AND b.label = 0) d
 JOIN embeddings a ON a.vec_id = va JOIN embeddings b ON b.vec_id = vb) r WHERE rank <= 5""",
    "distance",
)
add(
    "d_1",
    lambda t: dedupe_first(t.pred, "trans_num", [F.col("created_at").asc(), F.col("id1").asc(), F.col("id2").asc(), F.col("id3").asc()]).select(
        "trans_num", "created_at", F.col("risk_score").cast("double").alias("risk_score")
    ),
    LATEST.replace("created_at DESC, id1 DESC, id2 DESC, id3 DESC", "created_at, id1, id2, id3").replace("(SELECT * EXCLUDE (rn)", "SELECT trans_num, created_at, risk_score::DOUBLE AS risk_score", 1)[:-1],
)
add(
    "d_2",
    lambda t: t.tx.select("trans_num", F.lit("a").alias("part")).unionByName(t.tx.where("is_fraud = 1").select(F.lit("b").alias("part"), "trans_num")),
    f"SELECT trans_num, 'a' AS part FROM {TX} t UNION ALL SELECT trans_num, 'b' AS part FROM {TX} t WHERE is_fraud = 1",
)
add("d_3", lambda t: t.tx.select("category", "merchant").distinct(), f"SELECT DISTINCT category, merchant FROM {TX} t")
