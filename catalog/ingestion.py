"""Cleaning, validation, contracts and the predictions store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cardwatch.bindings import VERSION_ORDER
from cardwatch.operators import ingest, store
from cardwatch.operators.features import coerce_required
from cardwatch.operators.prediction_store import PredictionStore
from cardwatch.operators.versions import latest_predictions
from cardwatch.schemas import API_FIELDS, PREDICTION_BATCHES, PREDICTIONS
from cardwatch.session import ensure_checkpoint_dir
from cardwatch.sources import io
from catalog.registry import LATEST, PRED, TS, TX, Tables, add, as_double


def scratch(t: Tables) -> str:
    """A new folder below the session's shared one."""
    return f"{ensure_checkpoint_dir(t.spark)}/cardwatch-{uuid.uuid4().hex}"


TX_COLUMNS = f"trans_num, cc_num, {TS}, amt, category, merchant, city, state, is_fraud"
TX_LIST = TX_COLUMNS.split(", ")


def through_csv(t: Tables):
    path = scratch(t)
    io.write_csv(t.tx, path)
    return io.read_transactions_csv(t.spark, path).select(*TX_LIST)


def through_parquet(t: Tables, partitioned: bool):
    path = scratch(t)
    if partitioned:
        io.write_features(t.tx.withColumn("event_date", F.to_date(TS)), path, "event_date")
    else:
        io.write_features(t.tx, path)
    return io.read_parquet(t.spark, path).select(*TX_LIST)


def csv_then_parquet(t: Tables):
    source, target = scratch(t), scratch(t)
    io.write_csv(t.tx, source)
    io.csv_to_parquet(t.spark, source, target)
    return io.read_parquet(t.spark, target).select(*TX_LIST)


def details(t: Tables, fmt: str):
    path = scratch(t)
    io.write_details(t.scored.select("trans_num", "risk_score", "prediction"), path, fmt)
    reader = t.spark.read.schema("trans_num string, risk_score double, prediction boolean").option("header", True)
    return reader.json(path) if fmt == "json" else reader.csv(path)


def appended(t: Tables):
    path = scratch(t)
    for part in (t.tx.where("is_fraud = 1"), t.tx.where("is_fraud = 0")):
        io.append_table(part, path)
    return io.read_parquet(t.spark, path).select(*TX_LIST)


ALL_TX = f"SELECT {TX_COLUMNS} FROM {TX} t"
add("s_1", through_csv, ALL_TX)
add("s_2", lambda t: io.read_parquet(t.spark, f"{t.folder}/events.parquet"), "SELECT * FROM events")
add("s_3", lambda t: through_parquet(t, False), ALL_TX)
add("s_3_partitioned", lambda t: through_parquet(t, True), ALL_TX)
add("s_4", csv_then_parquet, ALL_TX)
add("s_5", through_csv, ALL_TX)
SCORED_ROWS = f"SELECT trans_num, amt / 500 AS risk_score, amt >= 150 AS prediction FROM {TX} t"
add("s_6", lambda t: details(t, "json"), SCORED_ROWS)
add("s_6_csv", lambda t: details(t, "csv"), SCORED_ROWS)
add(
    "s_6_fraud_only",
    lambda t: io.fraud_only(t.tx),
    f"SELECT {TS}, cc_num, merchant, category, amt, city, state, trans_num FROM {TX} t WHERE is_fraud = 1",
)
add("s_7", appended, ALL_TX)


def messy(t: Tables):
    """The card log as text with repeated ids, bad dates and gaps."""
    n = F.col("trans_num").cast("long")
    tx = t.tx.withColumn(TS, F.when(n % 11 == 0, "garbage").otherwise(F.date_format(TS, "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    tx = tx.withColumn("amt", F.when(n % 7 != 0, F.col("amt")))
    again = tx.withColumn("amt", F.col("amt") + 1000)
    return tx.withColumn("line", F.lit(1)).unionByName(again.withColumn("line", F.lit(2))).withColumn("long", F.lit(1.5))


add(
    "s_9",
    lambda t: ingest.clean_transactions(messy(t), ["line"]),
    f"""SELECT trans_num, CASE WHEN n % 11 <> 0 THEN {TS} END AS {TS}, cc_num, merchant, category,
 CASE WHEN n % 7 <> 0 THEN amt ELSE 0 END AS amt, city, state, 1.5::DOUBLE AS longitude, is_fraud = 1 AS is_fraud
 FROM (SELECT *, CAST(trans_num AS BIGINT) AS n FROM {TX} t) x""",
)
add(
    "s_10",
    lambda t: coerce_required(messy(t)).select("trans_num", TS, "amt", "line"),
    f"""SELECT trans_num, {TS}, amt + CASE WHEN line = 2 THEN 1000 ELSE 0 END AS amt, line
 FROM (SELECT *, CAST(trans_num AS BIGINT) AS n FROM {TX} t) x, (VALUES (1), (2)) v(line) WHERE n % 11 <> 0 AND n % 7 <> 0""",
)
add(
    "s_11",
    lambda t: ingest.clean_transactions(t.tx.withColumn("Unnamed: 0", F.lit(1)), ["cc_num"]),
    f"SELECT {TX_COLUMNS.replace('is_fraud', 'is_fraud = 1 AS is_fraud')} FROM {TX} t",
)


def old_predictions(t: Tables):
    """Stored predictions of an older table: no payload."""
    return latest_predictions(t.pred, VERSION_ORDER).select("trans_num", "risk_score", "prediction", "created_at")


add(
    "s_12",
    lambda t: as_double(store.evolve_predictions(old_predictions(t)), "risk_score").select(
        "trans_num", "risk_score", "amt", F.coalesce("city_pop", F.lit(-1)).alias("city_pop"), "job", TS
    ),
    f"""SELECT trans_num, risk_score::DOUBLE AS risk_score, NULL::DOUBLE AS amt, -1::INTEGER AS city_pop, NULL::VARCHAR AS job,
 NULL::TIMESTAMP AS {TS} FROM {LATEST} lp""",
)
add(
    "s_13",
    lambda t: store.backfill_predictions(
        old_predictions(t).withColumn("merchant", F.lit("old")),
        latest_predictions(t.pred, VERSION_ORDER).where("risk_score >= 0.5").select("trans_num", TS, "cc_num", "merchant", "amt"),
    ).select("trans_num", TS, F.coalesce("cc_num", F.lit(-1)).alias("cc_num"), "merchant", "amt", "city"),
    f"""SELECT trans_num, CASE WHEN risk_score >= 0.5 THEN {TS} END AS {TS}, CASE WHEN risk_score >= 0.5 THEN cc_num ELSE -1 END AS cc_num,
 CASE WHEN risk_score >= 0.5 THEN merchant ELSE 'old' END AS merchant, CASE WHEN risk_score >= 0.5 THEN amt END AS amt,
 NULL::VARCHAR AS city FROM {LATEST} lp""",
)


def stored_twice(t: Tables):
    """One batch stored twice: the second time changes nothing."""
    batches = t.spark.createDataFrame([], PREDICTION_BATCHES)
    preds = t.spark.createDataFrame([], PREDICTIONS)
    for _ in range(2):
        batches, preds = store.persist_batch(batches, preds, t.scored, "rule", 0.3, "2024-02-01 00:00:00")
    return as_double(preds, "risk_score").select("trans_num", "risk_score", "prediction", "amt", "created_at")


add(
    "s_14",
    stored_twice,
    f"""SELECT trans_num, (amt / 500)::DECIMAL(12,6)::DOUBLE AS risk_score, amt >= 150 AS prediction, amt,
 TIMESTAMP '2024-02-01' AS created_at FROM {TX} t""",
)



def grown_store(t: Tables):
    """A store after two batches that share transactions, the second scored later and lower, and a repeat of the first."""
    grown = PredictionStore(t.spark, scratch(t), buckets=8)
    again = t.scored.where("amt >= 100").withColumn("risk_score", F.col("amt") / 1000)
    for rows, day in ((t.scored, "2024-02-01"), (again, "2024-02-02"), (t.scored, "2024-02-03")):
        grown.persist(rows, "rule", 0.3, f"{day} 00:00:00")
        grown.merge()
    return grown


STORED = ("trans_num", "risk_score", "prediction", "amt", "created_at")
RULE = f"""SELECT trans_num, (amt / {{}})::DECIMAL(12,6)::DOUBLE AS risk_score, amt >= 150 AS prediction, amt,
 TIMESTAMP '2024-02-0{{}}' AS created_at FROM {TX} t WHERE {{}}"""
add(
    "s_14_grown",
    lambda t: as_double(grown_store(t).versions(), "risk_score").select(*STORED),
    f"{RULE.format(500, 1, 'true')} UNION ALL {RULE.format(1000, 2, 'amt >= 100')}",
)
add(
    "q_1_newest",
    lambda t: as_double(grown_store(t).newest(), "risk_score").select(*STORED),
    f"{RULE.format(500, 1, 'amt < 100')} UNION ALL {RULE.format(1000, 2, 'amt >= 100')}",
)

BATCH = "floor(CAST(trans_num AS BIGINT) / 500)::BIGINT"
HASHED = ["amt", "category", "cc_num", "merchant", "trans_num"]
ROW_HASH = "sha256(concat_ws('|', " + ", ".join(f"coalesce('=' || {c}::VARCHAR, '-')" for c in HASHED) + "))"
WORDS = ", ".join(f"sum(('0x' || substr(h, {1 + i * 15}, 15))::UBIGINT)::VARCHAR" for i in range(4))
add(
    "s_15",
    lambda t: store.batch_hash(
        t.tx.select(*HASHED).withColumn("batch_id", F.floor(F.col("trans_num").cast("long") / 500).cast("long")), "rule", 0.3, ["batch_id"]
    ),
    f"""SELECT batch_id, sha256(concat_ws('|', 'rule', '0.300000', count(*)::VARCHAR, {WORDS})) AS batch_hash, count(*) AS total_transactions
 FROM (SELECT {BATCH} AS batch_id, {ROW_HASH} AS h FROM {TX} t) r GROUP BY batch_id""",
)


def requests(t: Tables):
    """Complete scoring requests built from the card log."""
    n = F.col("trans_num").cast("long")
    return t.placed.withColumns(
        {
            "first": F.lit("A"),
            "last": F.lit("B"),
            "gender": F.when(n % 17 == 0, "FF").otherwise("F"),
            "street": F.lit("x"),
            "state": F.lit("NC"),
            "job": F.lit("y"),
            "dob": F.lit("1988-03-09").cast("date"),
            "unix_time": F.unix_seconds(TS),
            "merch_zipcode": F.when(n % 3 == 0, "").when(n % 3 == 1, "28,705.0").otherwise("-1"),
            "lat": F.when(n % 19 == 0, 91.0).otherwise(F.col("lat")),
        }
    ).drop("is_fraud")


add(
    "s_16",
    lambda t: ingest.select_api_fields(requests(t).withColumnRenamed("long", "longitude")).select("trans_num", "long", "amt"),
    f"SELECT trans_num, CAST(cc_num % 90 - 45 AS DOUBLE) AS long, amt FROM {TX} t",
)
N = f"(SELECT *, CAST(trans_num AS BIGINT) AS n FROM {TX} t)"
BROKEN = "(cc_num < 1 OR n % 17 = 0 OR n % 19 = 0 OR n % 3 = 2)"
add(
    "s_17",
    lambda t: ingest.validate_transactions(requests(t).select(*API_FIELDS))[0].select("trans_num", "amt", "merch_zipcode"),
    f"SELECT trans_num, amt, CASE WHEN n % 3 = 1 THEN 28705.0::DOUBLE END AS merch_zipcode FROM {N} x WHERE NOT {BROKEN}",
)
add(
    "s_17_rejected",
    lambda t: ingest.validate_transactions(requests(t).select(*API_FIELDS))[1].select(
        "trans_num", F.array_join("errors", "; ").alias("errors")
    ),
    f"""SELECT trans_num, concat_ws('; ', CASE WHEN cc_num < 1 THEN 'cc_num: below 1' END, CASE WHEN n % 17 = 0 THEN 'gender: longer than 1' END,
 CASE WHEN n % 19 = 0 THEN 'lat: above 90' END, CASE WHEN n % 3 = 2 THEN 'merch_zipcode: below 0' END) AS errors FROM {N} x WHERE {BROKEN}""",
)
add(
    "s_18",
    lambda t: ingest.ensure_trans_num(t.tx.withColumn("trans_num", F.when(F.col("is_fraud") == 0, F.col("trans_num"))))
    .groupBy(F.col("trans_num").startswith("srv_").alias("generated"))
    .agg(F.count(F.lit(1)).alias("n")),
    f"SELECT is_fraud = 1 AS generated, count(*) AS n FROM {TX} t GROUP BY 1",
)
ID_SOURCE = ["category", "cc_num", "city", "is_fraud", "merchant", "state"]
add(
    "s_18_ids",
    lambda t: ingest.ensure_trans_num(
        t.tx.select(*ID_SOURCE, F.when(F.col("is_fraud") == 0, F.col("trans_num")).otherwise(F.lit("")).alias("trans_num"))
    ).select("trans_num", *ID_SOURCE),
    f"""SELECT CASE WHEN is_fraud = 0 THEN trans_num ELSE 'srv_' || sha256(to_json(struct_pack({", ".join(f"{c} := {c}" for c in ID_SOURCE)}))::VARCHAR) END AS trans_num,
 {", ".join(ID_SOURCE)} FROM {TX} t""",
)
add("s_19", lambda t: ingest.assert_model_schema(t.tx, ["amt", "category", "trans_num"]), f"SELECT amt, category, trans_num FROM {TX} t")
