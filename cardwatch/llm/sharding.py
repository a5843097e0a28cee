"""Contiguous shards of nearly equal bytes.

Method: the rows are range-partitioned by id, each partition's bytes are
totalled, the totals of earlier partitions are carried into a running sum
inside each partition, and that global prefix sum is cut at equal targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardwatch.llm.common import Workspace, n_bytes, text_or_empty

ROW_OVERHEAD = 8


def shard_by_bytes(
    docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = ROW_OVERHEAD
) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard, bytes_before.

    Shards are consecutive ranges of (id, size, checksum); a document belongs
    to the shard that holds its middle byte, so a shard misses its target by
    at most the longest document. ``slot`` counts 0, 1, 2 ... inside a shard.
    Only (id, size, checksum) is shuffled, never a text.

    A null text is an empty one; null ids come first; equal rows take
    consecutive places; an empty table gives no rows; other columns of the
    input are ignored. A shard stays empty only if one document is longer
    than a target.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    spark = docs.sparkSession
    work = Workspace(spark, "sharding")
    text = text_or_empty(text_col)
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (n_bytes(text) + overhead).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    order = ["doc_id", "size", "text_crc32"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written once: the partition numbers are then data, not a property of a run.
    ranged = work.write(sized.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")

    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    carry = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("part_bytes"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("part_rows"),
    )
    total = totals.agg(F.sum("bytes")).first()[0] or 1

    here = Window.partitionBy("part").orderBy(*order)
    before = F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = (
        ranged.withColumns({"bytes_before": before, "pos": F.row_number().over(here)})
        .join(F.broadcast(carry), "part")  # one row per partition
        .select(
            *order,
            (F.col("bytes_before") + F.col("part_bytes")).alias("bytes_before"),
            (F.col("pos") - 1 + F.col("part_rows")).alias("pos"),
        )
    )
    middle = F.col("bytes_before") * 2 + F.col("size")
    shard = F.least(F.lit(n_shards - 1), F.call_function("div", middle * n_shards, F.lit(2 * total)))
    placed = work.write(placed.withColumn("shard", shard.cast("int")), "placed")
    starts = placed.groupBy("shard").agg(F.min("pos").alias("start"))
    return placed.join(F.broadcast(starts), "shard").select(  # at most n_shards rows
        *order,
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("pos") - F.col("start")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "bytes_before",
    )
