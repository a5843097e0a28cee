"""Streaming: ordered replay, idempotent scoring, live figures."""

from __future__ import annotations

import time
from collections.abc import Callable
from math import gcd

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cardwatch.functions.columns import count_where, or_zero
from cardwatch.operators.store import insert_new
from cardwatch.operators.versions import keep_first
from cardwatch.schemas import LABEL, PREDICTIONS, TRANSACTIONS_RAW, TS

PROGRESS_SCHEMA = "batch long, rows_sent long, rows_written long, failed boolean, latency_sec double"


def stream_transactions(
    spark: SparkSession, folder: str, schema: T.StructType = TRANSACTIONS_RAW, max_files: int = 1
) -> DataFrame:
    """Micro-batches over a folder of Parquet files, oldest first, ``max_files`` per batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("latestFirst", "false")
    return reader.parquet(folder)


def run_available(writer) -> StreamingQuery:
    """Process what is there and stop: a bounded replay."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def persist_stream_batch(
    batch: DataFrame, batch_number: int, sink: str, scorer: Callable[[DataFrame], DataFrame], replay_id: str = "replay"
) -> tuple[int, int]:
    """Score one micro-batch and store the rows that are not stored yet.

    Rows of a micro-batch live in a folder of its own, so only that folder is
    looked at for duplicates: the check does not grow with the store.
    """
    spark = batch.sparkSession
    batch_id = f"{replay_id}-{batch_number:010d}"
    folder = f"{sink}/predictions/batch_id={batch_id}"
    scored = scorer(batch).withColumn("batch_id", F.lit(batch_id))
    fields = [f for f in PREDICTIONS.fields if f.name in scored.columns and f.name not in ("id", "created_at")]
    rows = scored.select(
        F.sha2(F.concat_ws("|", "batch_id", "trans_num"), 256).alias("id"),
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields],
        F.current_timestamp().alias("created_at"),
    )
    stored = _read_or_empty(spark, folder, T.StructType([f for f in rows.schema.fields if f.name != "batch_id"]))
    fresh = insert_new(stored.withColumn("batch_id", F.lit(batch_id)), rows, ["batch_id", "trans_num"]).drop("batch_id")
    fresh.write.mode("append").parquet(folder)
    after = spark.read.parquet(folder).count()
    return batch.count(), after


def score_stream(
    stream: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    replay_id: str = "replay",
) -> StreamingQuery:
    """Score every micro-batch into ``sink`` and log its progress there.

    A micro-batch may run more than once after a failure; its rows are keyed
    by (batch, transaction), so a repeat stores nothing new.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        started = time.perf_counter()
        failed, sent, written = False, 0, 0
        try:
            sent, written = persist_stream_batch(batch, number, sink, scorer, replay_id)
        except Exception:
            failed = True
            raise
        finally:
            row = (number, sent, written, failed, time.perf_counter() - started)
            spark.createDataFrame([row], PROGRESS_SCHEMA).coalesce(1).write.mode("append").parquet(f"{sink}/progress")

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return run_available(writer)


def progress_table(spark: SparkSession, sink: str) -> DataFrame:
    """Replay summary: batches, rows, failures and total latency; the rows of a repeated batch count once."""
    log = spark.read.schema(PROGRESS_SCHEMA).parquet(f"{sink}/progress")
    per_batch = log.groupBy("batch").agg(
        F.max(~F.col("failed")).alias("succeeded"),
        F.max(F.when(~F.col("failed"), F.col("rows_sent"))).alias("rows_sent"),
        count_where(F.col("failed")).alias("failures"),
        F.sum("latency_sec").alias("latency_sec"),
    )
    return per_batch.agg(
        count_where(F.col("succeeded")).alias("iterations"),
        F.coalesce(F.sum("rows_sent"), F.lit(0)).alias("rows_sent"),
        F.coalesce(F.sum("failures"), F.lit(0)).alias("failures"),
        or_zero(F.sum("latency_sec")).alias("total_latency_sec"),
    )


def stream_kpis(stream: DataFrame, window: str = "1 hour", watermark: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Volume, frauds and amount per event-time window; works on streams and tables alike."""
    timed = stream.withWatermark(TS, watermark)
    frame = F.window(TS, window, slide) if slide else F.window(TS, window)
    y = F.coalesce(F.col(LABEL).cast("int"), F.lit(0))
    return (
        timed.groupBy(frame.alias("w"))
        .agg(
            F.count(F.lit(1)).alias("transactions"),
            F.sum(y).alias("frauds"),
            or_zero(F.sum("amt")).alias("amount"),
            or_zero(F.sum(F.when(y == 1, F.col("amt")))).alias("fraud_amount"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "transactions", "frauds", "amount", "fraud_amount")
    )


def live_kpis(stream: DataFrame, sink: str, checkpoint: str, **options) -> DataFrame:
    """Run the windowed figures over what is there and return the newest figure of each window.

    Windows that may still change are written again by later micro-batches;
    the batch number decides which version counts.
    """

    def handle(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(sink)

    writer = stream_kpis(stream, **options).writeStream.outputMode("update").foreachBatch(handle)
    run_available(writer.option("checkpointLocation", checkpoint))
    versions = stream.sparkSession.read.parquet(sink)
    return keep_first(versions, ["window_start", "window_end"], [F.desc("batch")]).drop("batch")


_UNITS = {"second": 1, "minute": 60, "hour": 3_600, "day": 86_400, "week": 604_800}


def _seconds(duration: str) -> int:
    """A duration such as "2 hours" in seconds."""
    number, unit = duration.split()
    return int(number) * _UNITS[unit.rstrip("s")]


def card_panes(stream: DataFrame, window: str = "2 hours", slide: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Transactions per card in panes: the longest stretches of which all sliding windows are made."""
    pane = f"{gcd(_seconds(window), _seconds(slide))} seconds"
    timed = stream.withWatermark(TS, watermark)
    counts = timed.groupBy(F.window(TS, pane).alias("p"), "cc_num").agg(F.count(F.lit(1)).alias("transactions"))
    return counts.select(F.col("p.start").alias("pane_start"), "cc_num", "transactions")


def merge_panes(panes: DataFrame, window: str = "2 hours", slide: str = "1 hour") -> DataFrame:
    """Counts of sliding windows from those of their panes: panes are multiplied by overlapping windows, rows are not."""
    counts = panes.groupBy(F.window("pane_start", window, slide).alias("w"), "cc_num").agg(F.sum("transactions").alias("transactions"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "cc_num", "transactions")


def card_velocity(table: DataFrame, window: str = "2 hours", slide: str = "1 hour") -> DataFrame:
    """Transactions per card in sliding event-time windows of a table."""
    return merge_panes(card_panes(table, window, slide), window, slide)


def live_card_velocity(
    stream: DataFrame, sink: str, checkpoint: str, window: str = "2 hours", slide: str = "1 hour", watermark: str = "2 hours"
) -> DataFrame:
    """The same of what a stream holds: each row is counted once, in its pane, and panes outlive the watermark in ``sink``.

    Panes that still change are written again by later micro-batches; the
    batch number decides which version counts.
    """

    def handle(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(sink)

    writer = card_panes(stream, window, slide, watermark).writeStream.outputMode("update").foreachBatch(handle)
    run_available(writer.option("checkpointLocation", checkpoint))
    versions = stream.sparkSession.read.parquet(sink)
    return merge_panes(keep_first(versions, ["pane_start", "cc_num"], [F.desc("batch")]), window, slide)


def dedupe_stream(stream: DataFrame, watermark: str = "2 hours", key: str = "trans_num") -> DataFrame:
    """Drop repeated ids that arrive within the watermark."""
    return stream.withWatermark(TS, watermark).dropDuplicatesWithinWatermark([key])
