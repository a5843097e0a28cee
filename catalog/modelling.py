"""Splits, preprocessing, resampling, models and the run registry."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from cardwatch.operators import evaluate, ml
from cardwatch.operators.features import build_features
from catalog.ingestion import scratch
from catalog.profiling import GAPPY, gappy
from catalog.registry import ORACLE, SCORED, TS, TX, Tables, add, sample_sql, shuffled_sql

SPLIT = f"""(SELECT *, CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train' WHEN pos < floor(n * 0.85::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM
 (SELECT *, row_number() OVER (ORDER BY {TS}, trans_num) - 1 AS pos, count(*) OVER () AS n FROM {TX} t) x)"""
add("m_1", lambda t: ml.temporal_split(t.tx).select("trans_num", "split"), f"SELECT trans_num, split FROM {SPLIT} s")
add(
    "m_1_summary",
    lambda t: ml.split_summary(ml.temporal_split(t.tx)),
    f"""SELECT split, count(*) AS n, min({TS}) AS start, max({TS}) AS "end", sum(is_fraud)::BIGINT AS frauds, avg(is_fraud) AS fraud_rate
 FROM {SPLIT} s GROUP BY split""",
    "fraud_rate",
)
MIXED = shuffled_sql(42)
add(
    "m_2",
    lambda t: ml.stratified_split(t.tx).select("trans_num", "is_fraud", "split"),
    f"""SELECT trans_num, is_fraud, CASE WHEN pos < round(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM {MIXED} x""",
)
add(
    "m_3",
    lambda t: ml.stratified_folds(t.tx, k=4).select("trans_num", "is_fraud", "fold"),
    f"SELECT trans_num, is_fraud, (pos % 4)::INTEGER AS fold FROM {MIXED} x",
)


def subsample(t: Tables):
    from cardwatch.operators.selection import stratified_sample

    return stratified_sample(t.tx, "is_fraud", 5000, 7).select("trans_num", "is_fraud")


add("m_4", subsample, sample_sql(5000, 7))
add(
    "m_5",
    lambda t: ml.training_frame(t.tx.withColumn("is_fraud", F.when(F.col("category") != "view", F.col("is_fraud").cast("string")))),
    f"""SELECT trans_num, cc_num, amt, category, merchant, city, state, CASE WHEN category <> 'view' THEN is_fraud ELSE 0 END::INTEGER AS is_fraud FROM {TX} t""",
)
add(
    "m_7",
    lambda t: ml.impute_median(gappy(t), ["amt"]).select("trans_num", "amt"),
    f"SELECT trans_num, coalesce(amt, (SELECT median(amt) FROM {GAPPY} h)) AS amt FROM {GAPPY} g",
    "amt",
)
MODE_CITY = f"(SELECT city FROM {GAPPY} h WHERE city IS NOT NULL GROUP BY city ORDER BY count(*) DESC, city LIMIT 1)"
add(
    "m_8",
    lambda t: ml.impute_mode(gappy(t), ["city"]).select("trans_num", "city"),
    f"SELECT trans_num, coalesce(city, {MODE_CITY}) AS city FROM {GAPPY} g",
)
add(
    "m_9",
    lambda t: ml.ordinal_encode(gappy(t).where(F.col("city") != "c_3"), ["city", "category"], gappy(t)).select("trans_num", "city", "category"),
    f"""SELECT trans_num, coalesce(a.code, -1)::INTEGER AS city, coalesce(b.code, -1)::INTEGER AS category FROM {GAPPY} g
 LEFT JOIN (SELECT city, row_number() OVER (ORDER BY city) - 1 AS code FROM (SELECT DISTINCT city FROM {GAPPY} h WHERE city <> 'c_3') x) a ON a.city = g.city
 LEFT JOIN (SELECT category, row_number() OVER (ORDER BY category) - 1 AS code FROM (SELECT DISTINCT category FROM {GAPPY} h WHERE city <> 'c_3') x) b
 ON b.category = g.category""",
)
add(
    "m_10",
    lambda t: ml.standardize(t.tx, ["amt"]).select("trans_num", "amt"),
    f"SELECT trans_num, (amt - (SELECT avg(amt) FROM {TX} u)) / (SELECT stddev_pop(amt) FROM {TX} u) AS amt FROM {TX} t",
    "amt",
)
NEAR = """(SELECT va, avg(d) AS mean_distance FROM (SELECT a.vec_id AS va, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS r
 FROM embeddings a, embeddings b WHERE a.label <> 0 AND b.label = 0) x WHERE r <= 5 GROUP BY va)"""
LIMIT = f"(SELECT quantile_cont(mean_distance, 0.015) FROM {NEAR} q)"
add(
    "m_11",
    lambda t: ml.near_minority_filter(t.vectors, "embedding", "is_minority")[0].select("vec_id"),
    f"SELECT vec_id FROM embeddings e WHERE vec_id NOT IN (SELECT va FROM {NEAR} n WHERE mean_distance <= {LIMIT})",
)
add(
    "m_11_summary",
    lambda t: ml.near_minority_filter(t.vectors, "embedding", "is_minority")[1],
    f"""SELECT count(*) AS dropped_majority, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM embeddings) AS dropped_pct_over_train, {LIMIT} AS threshold,
 5::INTEGER AS k_neighbors FROM {NEAR} n WHERE mean_distance <= {LIMIT}""",
    "dropped_pct_over_train threshold",
)
add(
    "m_12",
    lambda t: ml.smote_nc(t.tx, ["amt"], ["category", "merchant", "city", "state"]).groupBy("is_fraud").agg(F.count(F.lit(1)).alias("n")),
    f"""SELECT is_fraud, CASE is_fraud WHEN 1 THEN greatest(n, (SELECT floor(count(*) * 0.15::DOUBLE)::BIGINT FROM {TX} u WHERE is_fraud = 0)) ELSE n END AS n
 FROM (SELECT is_fraud, count(*) AS n FROM {TX} t GROUP BY 1) c""",
)
NUMBERS, TEXTS = ["amt"], ["category", "merchant", "city", "state"]
add(
    "m_12_neighbours",
    lambda t: ml.mixed_neighbours(t.tx.where("is_fraud = 1"), NUMBERS, TEXTS, 3).select("left_id", "rank", "neighbour_id"),
    f"""SELECT left_id, rank::INTEGER AS rank, neighbour_id FROM (SELECT left_id, neighbour_id, row_number() OVER (PARTITION BY left_id ORDER BY d, neighbour_id) AS rank FROM
 (SELECT a.trans_num AS left_id, b.trans_num AS neighbour_id, (a.amt - b.amt) * (a.amt - b.amt) + s * s / 2 *
 ({" + ".join(f"(coalesce(a.{c}, '') <> coalesce(b.{c}, ''))::INTEGER" for c in TEXTS)}) AS d
 FROM {TX} a, {TX} b, (SELECT stddev_pop(amt) AS s FROM {TX} m WHERE is_fraud = 1) z
 WHERE a.is_fraud = 1 AND b.is_fraud = 1 AND a.trans_num <> b.trans_num) x) y WHERE rank <= 3""",
)


def synthetic_rows(t: Tables):
    """Old rows as they were; for each minority row the texts of its copies, if there are as many as due and all lie between it and its neighbours."""
    path = scratch(t)
    ml.smote_nc(t.tx, NUMBERS, TEXTS).write.parquet(path)
    rows = t.spark.read.parquet(path)
    made = rows.where("startswith(trans_num, 'syn_')").withColumn("base", F.regexp_extract("trans_num", "^syn_(.*)_[0-9]+$", 1))
    minority = t.tx.where("is_fraud = 1").select(F.col("trans_num").alias("base"), F.col("amt").alias("own"))
    pairs = ml.mixed_neighbours(t.tx.where("is_fraud = 1"), NUMBERS, TEXTS, 3)
    around = pairs.join(minority.toDF("neighbour_id", "other"), "neighbour_id").groupBy(F.col("left_id").alias("base"))
    reach = minority.join(around.agg(F.min("other").alias("low"), F.max("other").alias("high")), "base")
    few, many = (F.count_if(F.col("is_fraud") == y) for y in (1, 0))
    counts = t.tx.agg(few.alias("few"), (F.floor(many * 0.15) - few).alias("due"))
    groups = made.groupBy("base", *TEXTS).agg(F.count(F.lit(1)).alias("n"), F.min("amt").alias("least"), F.max("amt").alias("most"))
    checked = groups.join(reach, "base").join(F.broadcast(counts), (F.col("n") - F.floor(F.col("due") / F.col("few"))).between(0, 1), "left")
    inside = (F.col("least") >= F.least("own", "low") - 1e-9) & (F.col("most") <= F.greatest("own", "high") + 1e-9)
    new = checked.select(F.concat(F.lit("syn_"), "base").alias("id"), *TEXTS, (inside & F.col("due").isNotNull()).alias("ok"))
    old = rows.where("not startswith(trans_num, 'syn_')").select(F.col("trans_num").alias("id"), *TEXTS, F.lit(True).alias("ok"))
    return new.unionByName(old)


VOTES = ", ".join(
    f"(SELECT {c} FROM {TX} v WHERE v.trans_num IN (n.x, n.y, n.z) AND {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS {c}" for c in TEXTS
)
add(
    "m_12_rows",
    synthetic_rows,
    f"""SELECT trans_num AS id, {", ".join(TEXTS)}, true AS ok FROM {TX} t UNION ALL SELECT 'syn_' || left_id AS id, {VOTES}, true AS ok FROM
 (SELECT left_id, max(neighbour_id) FILTER (WHERE rank = 1) AS x, max(neighbour_id) FILTER (WHERE rank = 2) AS y, max(neighbour_id) FILTER (WHERE rank = 3) AS z
 FROM ({ORACLE["m_12_neighbours"]}) w GROUP BY left_id) n""",
)
add(
    "m_13",
    lambda t: ml.balanced_weight(t.tx).groupBy("is_fraud").agg(F.max("weight").alias("weight"), F.min("weight").alias("least")),
    f"""SELECT is_fraud, n / (2.0::DOUBLE * c) AS weight, n / (2.0::DOUBLE * c) AS least FROM
 (SELECT is_fraud, count(*) AS c, (SELECT count(*) FROM {TX} u) AS n FROM {TX} t GROUP BY 1) x""",
    "weight least",
)

def model_table(t: Tables):
    """All engineered and kept columns but dates; the id is excluded by the fits."""
    return ml.training_frame(build_features(t.tx, amt_prior=30.0))


def fitted(t: Tables, fit):
    """Hold-out scores of a model fitted on the training part."""
    data = ml.written_evenly(ml.stratified_split(model_table(t)))
    train, test = data.where("split = 'train'").drop("split"), data.where("split = 'test'").drop("split")
    return fit(train), test, train


def holdout_scores(t: Tables, fit):
    model, test, _ = fitted(t, fit)
    return ml.score_ranked(model, test).select("trans_num", "risk_score", "prediction", "rank")


add("m_14", lambda t: holdout_scores(t, ml.fit_gbt))
add("m_15", lambda t: holdout_scores(t, ml.fit_rf))
add("m_16", lambda t: ml.cv_benchmark(ml.stratified_folds(model_table(t), k=4), {"gbt": ml.gbt(), "rf": ml.rf()}))


def tuned(t: Tables):
    """Four draws from the whole search space of each model on two folds, ranked by average precision."""
    data = ml.stratified_folds(model_table(t), k=2)
    found = ml.search(data, n_iter=4)
    params = t.spark.createDataFrame([(name, str(d)) for name, d in found.draws.items()], "draw string, params string")
    return found.ranking().join(params, "draw").select("draw", "kind", "rank", "pr_auc_mean", "pr_auc_std", "params")


add("m_17", tuned)
add("m_18", lambda t: ml.score(*fitted(t, ml.fit_rf)[:2], threshold=0.3).select("trans_num", "risk_score", "prediction"))
add(
    "m_19",
    lambda t: ml.minmax_score(t.tx.withColumn("raw_score", F.col("amt") - 100)).select("trans_num", "risk_score"),
    f"SELECT trans_num, (amt - (SELECT min(amt) FROM {TX} u)) / (SELECT max(amt) - min(amt) FROM {TX} u) AS risk_score FROM {TX} t",
    "risk_score",
)


def features_of(df) -> list[str]:
    return [c for c in df.columns if c != "is_fraud"]


def saved_and_loaded(t: Tables):
    model, test, train = fitted(t, ml.fit_rf)
    path = scratch(t)
    ml.save_model(model, path, t.spark, rows=train.count(), features=features_of(train), seed=42)
    loaded, meta = ml.load_model(path, t.spark)
    return ml.score(loaded, test.select(*meta["features"], "is_fraud")).select("trans_num", "risk_score", "prediction")


def loaded_by_default_name(t: Tables):
    """The served family loaded under its default name; its expected columns are picked from a wider table in another order."""
    model, test, train = fitted(t, ml.fit_gbt)
    path = scratch(t)
    ml.save_model(model, path, t.spark, features=features_of(train))
    loaded, meta = ml.load_model(path, t.spark)
    wider = test.select(*reversed(test.columns), F.lit("not expected").alias("extra"))
    scored = ml.score(loaded, wider.select(*meta["features"], "is_fraud"))
    return scored.select(F.lit(meta["name"]).alias("model"), F.lit(len(meta["features"])).alias("n_features"), "trans_num", "risk_score", "prediction")


add("m_20", saved_and_loaded)
add("m_21", loaded_by_default_name)


def facts_of(ranked, threshold: float):
    """One row for each hold-out id (its score is a probability, its label follows from it) and for each rank (no better score comes after it)."""
    score = F.col("risk_score")
    ids = ranked.select(
        F.concat(F.lit("id:"), "trans_num").alias("item"), (score.between(0, 1) & (F.col("prediction") == (score >= threshold))).alias("ok")
    )
    following = ranked.select((F.col("rank") - 1).alias("rank"), score.alias("next"))
    ranks = ranked.join(following, "rank", "left").select(
        F.concat(F.lit("rank:"), F.col("rank").cast("string")).alias("item"), F.coalesce(score >= F.col("next"), F.lit(True)).alias("ok")
    )
    return ids.unionByName(ranks)


def proven(t: Tables, fit, threshold: float):
    """Facts of a fitted model: its ranked hold-out scores, the saved and loaded model's, and its report against the scored rows."""
    model, test, train = fitted(t, fit)
    path = scratch(t)
    ml.score_ranked(model, test, threshold).select("trans_num", "is_fraud", "risk_score", "prediction", "rank").write.parquet(f"{path}/scored")
    scored = t.spark.read.parquet(f"{path}/scored")
    ml.save_model(model, path, t.spark, features=features_of(train))
    loaded, meta = ml.load_model(path, t.spark)
    again = ml.score(loaded, test.select(*meta["features"], "is_fraud"), threshold)
    again = again.select("trans_num", F.col("risk_score").alias("again"), F.col("prediction").alias("label"))
    same = (F.col("risk_score") == F.col("again")) & (F.col("prediction") == F.col("label"))
    kept = scored.join(again, "trans_num").select(F.concat(F.lit("loaded:"), "trans_num").alias("item"), same.alias("ok"))

    # The report's numbers by their definitions, from sums over the scored rows.
    report = evaluate.evaluate_model(model, test, threshold)["metrics"]
    y, p = F.col("is_fraud") == 1, F.col("prediction")
    tp, fp, fn, tn = (F.count_if(c).cast("double") for c in (y & p, ~y & p, y & ~p, ~y & ~p))

    def share(a, b):
        return F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))

    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    sums = scored.agg(
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ((share(tp, tp + fn) + share(tn, tn + fp)) / 2).alias("balanced_acc"),
        share(tp * tn - fp * fn, spread).alias("mcc"),
    )
    names = ["precision", "recall", "f1", "balanced_acc", "mcc"]
    pairs = report.select(*names).crossJoin(sums.toDF(*[f"own_{c}" for c in names]))  # one row each
    agree = [F.struct(F.lit(f"metric:{c}").alias("item"), (F.abs(F.coalesce(c, F.lit(0.0)) - F.col(f"own_{c}")) < 1e-9).alias("ok")) for c in names]
    return facts_of(scored, threshold).unionByName(kept).unionByName(pairs.select(F.inline(F.array(*agree))))


HELD_OUT = f"(SELECT trans_num FROM {MIXED} x WHERE pos < round(n * 0.2::DOUBLE))"
FACTS = f"""SELECT 'id:' || trans_num AS item, true AS ok FROM {HELD_OUT} a UNION ALL SELECT 'loaded:' || trans_num, true FROM {HELD_OUT} b
 UNION ALL SELECT 'rank:' || row_number() OVER (ORDER BY trans_num), true FROM {HELD_OUT} c
 UNION ALL SELECT 'metric:' || m, true FROM (SELECT unnest(['precision', 'recall', 'f1', 'balanced_acc', 'mcc']) AS m) d"""
add("m_14_facts", lambda t: proven(t, ml.fit_gbt, 0.5), FACTS)
add("m_18_facts", lambda t: proven(t, ml.fit_rf, 0.3), FACTS)


def registry(t: Tables):
    path = scratch(t)
    metrics = t.scored.groupBy("category").agg(F.avg("is_fraud").alias("rate"), F.count(F.lit(1)).alias("n")).orderBy("category").collect()
    for i, r in enumerate(metrics):  # one row per run
        ml.append_run(
            t.spark, path, run_id=r["category"], experiment="cards", run_name="rule", start_time=datetime(2024, 2, 1 + i), pr_auc=r["rate"], row_count=r["n"]
        )
    return ml.best_runs(t.spark.read.parquet(path), 3).select("run_id", "pr_auc", "row_count")


add(
    "m_22",
    registry,
    f"SELECT category AS run_id, avg(is_fraud) AS pr_auc, count(*) AS row_count FROM {SCORED} s GROUP BY 1 ORDER BY 2 DESC LIMIT 3",
    "pr_auc",
)


def model_report(t: Tables):
    model, test, train = fitted(t, ml.fit_rf)
    return evaluate.evaluate_model(model, test, name="rf", fit_rows=train.count())["metrics"].drop("score_time_sec", "fit_time_sec")


add("x_10_model", model_report)
