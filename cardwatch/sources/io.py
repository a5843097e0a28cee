"""Reading and writing transaction, feature and prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwatch.schemas import API_FIELDS, LABEL, TRANSACTIONS_RAW

JDBC_BATCH = 10_000
CSV_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def read_transactions_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = TRANSACTIONS_RAW, infer: bool = False
) -> DataFrame:
    """CSV with header, one file or a folder.

    Columns are matched by header name, so files may order or omit them; bad
    values become NULL. ``infer`` reads the types from the data instead,
    at the price of a second pass.
    """
    reader = spark.read.option("header", True)
    if infer or schema is None:
        return reader.option("inferSchema", True).csv(path)
    text = reader.option("mode", "PERMISSIVE").csv(path)
    known = {f.name: f.dataType for f in schema.fields}
    return text.select(*[F.col(f"`{c}`").try_cast(known[c]).alias(c) if c in known else F.col(f"`{c}`") for c in text.columns])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_features(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Parquet, overwriting; optionally split by a date column for pruning."""
    if partition_by is None:
        df.write.mode("overwrite").parquet(path)
        return
    # One writer per day and hash bucket keeps the file count in hand without one task per day.
    spread = F.pmod(F.xxhash64(*[c for c in df.columns if c != partition_by]), F.lit(32))
    df.repartition(F.col(partition_by), spread).write.mode("overwrite").partitionBy(partition_by).parquet(path)


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: T.StructType | None = TRANSACTIONS_RAW) -> None:
    write_features(read_transactions_csv(spark, source, schema), target)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("timestampFormat", CSV_TIME).csv(path)


def write_details(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Scored rows as JSON lines or CSV."""
    if fmt not in ("json", "csv"):
        raise ValueError(f"unknown format {fmt!r}")
    if fmt == "csv":
        write_csv(df, path)
    else:
        df.write.mode("overwrite").option("timestampFormat", CSV_TIME).json(path)


def fraud_only(df: DataFrame) -> DataFrame:
    """Positive rows in request column order."""
    return df.where(F.col(LABEL).cast("int") == 1).select(*[c for c in API_FIELDS if c in df.columns])


def read_table(
    spark: SparkSession, url: str, table: str, *, column: str, lower: int, upper: int, partitions: int = 64, **options
) -> DataFrame:
    """A database table read in parallel ranges of a numeric column."""
    return spark.read.jdbc(
        url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=options
    )


def append_table(df: DataFrame, sink: str, table: str | None = None, **options) -> None:
    """Append to a Parquet folder, or to a database table in chunks when ``table`` is given."""
    if table is None:
        df.write.mode("append").parquet(sink)
    else:
        df.write.option("batchsize", JDBC_BATCH).jdbc(sink, table, mode="append", properties=options)
