"""Replay of a table in event order: so many rows a micro-batch, and no more than so many batches.

The table is first written as a log with the position of each row in event
order, cut into chunks of positions. A streaming source hands out positions:
its offset is the next one, a batch is the following ``batch_rows``, and the
bound on batches is the last position it ever offers. Each micro-batch then
reads only its chunks of the log. The checkpoint keeps the offset, so a
restarted replay goes on where it stopped and a failed batch is replayed with
exactly the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from cardwatch.plans.prefix import prefix_sum
from cardwatch.plans.slices import ROWS_PER_SLICE
from cardwatch.schemas import TS

CHUNK_ROWS = 100_000
#: Positions of one input partition of a micro-batch.
SPAN = 250_000


def write_log(
    df: DataFrame, folder: str, key: str = "trans_num", chunk_rows: int = CHUNK_ROWS, rows_per_slice: int = ROWS_PER_SLICE
) -> int:
    """Write the rows with ``pos`` (from 0, by time, then key) in chunks of positions; returns their number.

    Rows without a time have no place in the replay and are left out.
    """
    timed = df.where(F.col(TS).isNotNull()).withColumn("__us", F.unix_micros(F.col(TS).cast("timestamp")))
    n = timed.count()
    placed = prefix_sum(timed, ["__us", key], (), (), rows_per_slice, n=n).drop("__us")
    chunked = placed.withColumn("chunk", F.call_function("div", F.col("pos"), F.lit(chunk_rows)))
    # One writer for each chunk: a chunk holds at most ``chunk_rows`` rows.
    chunked.repartition("chunk").sortWithinPartitions("chunk", "pos").write.partitionBy("chunk").parquet(folder)
    return n


class Span(InputPartition):
    """Some positions in a row."""

    def __init__(self, start: int, end: int):
        super().__init__(None)
        self.start, self.end = start, end


class PositionReader(DataSourceStreamReader):
    """Positions 0 .. last in steps of ``step``."""

    def __init__(self, step: int, last: int):
        self.step, self.last = step, last
        self.next: int | None = None

    def initialOffset(self) -> dict:
        return {"position": 0}

    def latestOffset(self) -> dict:
        self.next = min(self.last, (self.next or 0) + self.step)
        return {"position": self.next}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.next is None:  # a restarted query first plans its last batch again
            self.next = end["position"]
        a, z = start["position"], end["position"]
        return [Span(k, min(k + SPAN, z)) for k in range(a, z, SPAN)]

    def read(self, partition: Span) -> Iterator[tuple[int]]:
        for position in range(partition.start, partition.end):
            yield (position,)

    def commit(self, end: dict) -> None:
        pass


class Positions(DataSource):
    """Streaming source ``event_positions`` with the options rows, batch_rows and, if bounded, max_batches."""

    @classmethod
    def name(cls) -> str:
        return "event_positions"

    def schema(self) -> str:
        return "pos long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        step, last = int(self.options["batch_rows"]), int(self.options["rows"])
        if step < 1:
            raise ValueError("batch_rows must be at least 1")
        batches = int(self.options.get("max_batches", "-1"))
        return PositionReader(step, last if batches < 0 else min(last, step * batches))


def positions(spark: SparkSession, rows: int, batch_rows: int, max_batches: int | None = None) -> DataFrame:
    """The stream of positions."""
    spark.dataSource.register(Positions)
    reader = spark.readStream.format("event_positions").option("rows", rows).option("batch_rows", batch_rows)
    return (reader if max_batches is None else reader.option("max_batches", max_batches)).load()


def replay(
    spark: SparkSession,
    folder: str,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    batch_rows: int,
    max_batches: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> int:
    """Hand the rows of a log to ``handle(rows, batch number)`` in event order; returns the position after the last one of this run, 0 if none was left.

    Each batch has ``batch_rows`` rows, the last one the rest. ``max_batches``
    bounds the batches of all runs on one checkpoint together.
    """
    log = spark.read.parquet(folder)
    rows = log.agg(F.max("pos")).first()[0]
    if rows is None:
        return 0

    reached = 0

    def run(batch: DataFrame, number: int) -> None:
        nonlocal reached
        first, last = batch.agg(F.min("pos"), F.max("pos")).first()
        if first is None:
            return
        chunks = F.col("chunk").between(first // chunk_rows, last // chunk_rows)
        handle(log.where(chunks & F.col("pos").between(first, last)).drop("chunk"), number)
        reached = last + 1

    writer = positions(spark, rows + 1, batch_rows, max_batches).writeStream.foreachBatch(run)
    query = writer.option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return reached
