"""Streams over the event files, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardwatch.bindings import stream_of_transactions
from cardwatch.streaming import ordered, replay, stateful
from catalog.features import FEATURE_SQL, STATE
from catalog.ingestion import scratch
from catalog.registry import TS, TX, Tables, add


def stream(t: Tables):
    return stream_of_transactions(t.spark, t.folder)


def landed(t: Tables, df):
    """Write a stream to a folder and read it back."""
    sink = scratch(t)
    writer = df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", scratch(t))
    replay.run_available(writer)
    return t.spark.read.parquet(sink)


def rule(batch):
    return batch.withColumns({"risk_score": F.col("amt") / 500, "prediction": F.col("amt") >= 150})


def scored(t: Tables) -> str:
    sink = scratch(t)
    replay.score_stream(stream(t), rule, sink, scratch(t))
    return sink


add("t_s1", lambda t: landed(t, stream(t)).select("trans_num", TS, "amt"), f"SELECT trans_num, {TS}, amt FROM {TX} t")
add(
    "t_s2",
    lambda t: t.spark.read.parquet(f"{scored(t)}/predictions").select(
        "trans_num", F.col("risk_score").cast("double").alias("risk_score"), "prediction"
    ),
    f"SELECT trans_num, (amt / 500)::DECIMAL(12,6)::DOUBLE AS risk_score, amt >= 150 AS prediction FROM {TX} t",
)
add(
    "t_s4",
    lambda t: replay.progress_table(t.spark, scored(t)).select("iterations", "rows_sent", "failures"),
    f"SELECT 1::BIGINT AS iterations, count(*) AS rows_sent, 0::BIGINT AS failures FROM {TX} t",
)
KPIS = f"""count(*) AS transactions, sum(is_fraud)::BIGINT AS frauds, sum(amt) AS amount,
 coalesce(sum(amt) FILTER (WHERE is_fraud = 1), 0) AS fraud_amount"""
add(
    "t_s5",
    lambda t: replay.live_kpis(stream(t), scratch(t), scratch(t)),
    f"""SELECT date_trunc('hour', {TS}) AS window_start, date_trunc('hour', {TS}) + INTERVAL 1 HOUR AS window_end, {KPIS} FROM {TX} t GROUP BY 1, 2""",
    "amount fraud_amount",
)
VELOCITY = f"""SELECT date_trunc('hour', {TS}) - to_hours(h) AS window_start, date_trunc('hour', {TS}) - to_hours(h) + INTERVAL 2 HOUR AS window_end, cc_num,
 count(*) AS transactions FROM {TX} t, (VALUES (0), (1)) v(h) GROUP BY 1, 2, 3"""
add("t_s5_velocity", lambda t: replay.card_velocity(t.tx), VELOCITY)
add("t_s5_velocity_live", lambda t: replay.live_card_velocity(stream(t), scratch(t), scratch(t)), VELOCITY)

REPLAYED = 700


def in_event_order(t: Tables):
    """The log replayed by event time, so many rows a batch and four batches at most, in two runs on one checkpoint."""
    log, sink, checkpoint = scratch(t), scratch(t), scratch(t)
    ordered.write_log(t.tx, log, chunk_rows=500)

    def handle(rows, number: int) -> None:
        rows.withColumn("batch", F.lit(number).cast("long")).write.parquet(f"{sink}/n={number}")

    for bound in (2, 4):
        ordered.replay(t.spark, log, handle, checkpoint, REPLAYED, bound, chunk_rows=500)
    return t.spark.read.parquet(sink).select("trans_num", "batch", "pos", "amt")


add(
    "t_s1_ordered",
    in_event_order,
    f"""SELECT trans_num, pos // {REPLAYED} AS batch, pos, amt FROM
 (SELECT *, row_number() OVER (ORDER BY {TS}, trans_num) - 1 AS pos FROM {TX} t) x WHERE pos < {4 * REPLAYED}""",
)
add(
    "t_s6",
    lambda t: landed(t, replay.dedupe_stream(stream(t).unionByName(stream(t)))).select("trans_num", "amt"),
    f"SELECT trans_num, amt FROM {TX} t",
)

LANDINGS = 3
LIVE = [(column, sql, is_float) for column, sql, is_float in FEATURE_SQL.values() if column in stateful.STREAMED]


def live_features(t: Tables):
    """The log lands in parts, by event time; after each the stream builds the features of what has come."""
    log, sink, checkpoint = scratch(t), scratch(t), scratch(t)
    edges = t.tx.agg(F.percentile_approx(TS, [k / LANDINGS for k in range(1, LANDINGS)])).first()[0]
    part = sum((F.when(F.col(TS) > edge, 1).otherwise(0) for edge in edges), F.lit(0))
    for k in range(LANDINGS):
        t.tx.where(part == k).write.mode("append").parquet(log)
        arrived = replay.stream_transactions(t.spark, log, t.tx.schema, max_files=1_000_000)
        stateful.build_available(arrived, sink, checkpoint, amt_prior=30.0)
    return t.spark.read.parquet(sink).select("trans_num", *[column for column, _, _ in LIVE])


add(
    "t_s3_live",
    live_features,
    f"""SELECT trans_num, {", ".join(f"{sql} AS {column}" for column, sql, _ in LIVE)} FROM (SELECT * REPLACE (30.0::DOUBLE AS g) FROM {STATE} x) w""",
    " ".join(column for column, _, is_float in LIVE if is_float),
)
