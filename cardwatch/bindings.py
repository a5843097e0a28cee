"""Views of the star-schema test tables in the shape the operators expect.

``transactions`` reads the event table as a card log; ``predictions`` reads
order lines as versioned scored rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch.schemas import TS
from cardwatch.streaming.replay import stream_transactions

# Newest-first order of the bound predictions: total, without a surrogate id.
VERSION_ORDER = ("created_at", "id1", "id2", "id3")
# The same, and of versions alike in all of that one and the same for its score and its flag. Whoever reads both the
# flags and the scores of the newest versions then asks twice for the same rows, which Spark shuffles once.
SCORED_VERSION_ORDER = (*VERSION_ORDER, "risk_score", "return_flag")
#: Order lines that one task sorts, at the most.
LINES_PER_TASK = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Card log bound to ``events``."""
    return as_transactions(table(spark, folder, "events"))


def stream_of_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """The same log as a stream over the event files."""
    schema = table(spark, folder, "events").schema
    return as_transactions(stream_transactions(spark, f"{folder}/events*.parquet", schema))


def as_transactions(events: DataFrame) -> DataFrame:
    """Events as card rows; ``k`` is the number inside ``props``."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return (
        events.withColumn("k", k)
        .select(
            F.col("event_id").cast("string").alias("trans_num"),
            F.col("user_id").alias("cc_num"),
            F.col("ts").cast("timestamp").alias(TS),
            F.col("value").alias("amt"),
            F.col("event_type").alias("category"),
            F.concat(F.lit("m_"), (F.col("k") % 20).cast("string")).alias("merchant"),
            F.concat(F.lit("c_"), (F.col("k") % 7).cast("string")).alias("city"),
            F.concat(F.lit("s_"), (F.col("k") % 3).cast("string")).alias("state"),
            F.when((F.col("value") >= 150) & (F.col("k") % 3 == 0), 1).otherwise(0).alias("is_fraud"),
        )
    )


def predictions(spark: SparkSession, folder: str, by_order: bool = False) -> DataFrame:
    """Versioned predictions bound to order lines and their dimensions.

    Dimensions are joined one by one, so that Spark knows the size of each and
    broadcasts it only if it is small; orders and suppliers grow with the data.
    ``by_order`` adds ``order_id``, which all versions of an id share, and deals
    the lines out by it in parts of bounded size if there are many.
    """
    def dimension(name: str) -> DataFrame:
        return table(spark, folder, name)

    lines, orders = dimension("lineitem"), dimension("orders")
    if by_order:
        parts = -(-lines.count() // LINES_PER_TASK)
        if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
            lines, orders = lines.repartition(parts, "l_orderkey"), orders.repartition(parts, "o_orderkey")

    risk = (F.col("l_discount") * 10).cast("decimal(12,6)")
    second = ((F.col("o_orderkey") * 7919) % 86400).cast("int")
    event_time = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), second)
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(dimension("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(dimension("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(dimension("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("trans_num"),
            F.col("l_shipdate").cast("timestamp").alias("created_at"),
            F.col("l_partkey").alias("id1"),
            F.col("l_suppkey").alias("id2"),
            F.col("l_extendedprice").alias("id3"),
            event_time.cast("timestamp").alias(TS),
            F.col("o_custkey").alias("cc_num"),
            F.col("s_name").alias("merchant"),
            F.col("o_orderpriority").alias("category"),
            F.col("l_extendedprice").alias("amt"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("state"),
            risk.alias("risk_score"),
            (risk >= F.lit(0.8).cast("decimal(12,6)")).alias("prediction"),
            F.col("l_returnflag").alias("return_flag"),
            *([F.col("l_orderkey").alias("order_id")] if by_order else []),
        )
    )
