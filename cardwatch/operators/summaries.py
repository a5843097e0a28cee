"""Monitoring reads over versioned predictions.

Every read takes the predictions table, picks the newest version of each
transaction, applies the optional filters of ``prediction_filters`` and
aggregates. ``newest`` names the version order, newest first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwatch.functions.columns import count_where, or_zero, prediction_label
from cardwatch.operators.filters import not_blank, prediction_filters
from cardwatch.operators.versions import NEWEST, latest_predictions
from cardwatch.plans.slices import ROWS_PER_SLICE
from cardwatch.schemas import PAYLOAD_TYPES, TS
from cardwatch.session import ensure_checkpoint_dir

AMOUNT_BUCKETS = 24


def _current(pred: DataFrame, newest, filters: dict) -> DataFrame:
    return latest_predictions(pred, newest).where(prediction_filters(**filters))


def _risk() -> Column:
    return F.col("risk_score").cast("double")


def _amt() -> Column:
    return F.col("amt").cast("double")


def _risk_measures(amount: bool = True) -> list[Column]:
    n = F.count(F.lit(1))
    frauds = count_where(F.col("prediction"))
    measures = [
        n.alias("transaction_count"),
        frauds.alias("fraud_count"),
        (frauds.cast("double") / n).alias("fraud_rate"),
        or_zero(F.avg(_risk())).alias("avg_risk_score"),
        or_zero(F.max(_risk())).alias("max_risk_score"),
    ]
    if amount:
        measures.append(or_zero(F.sum(_amt())).alias("total_amount"))
    return measures


# --- lists of values and bounds ------------------------------------------------


def unique_values(pred: DataFrame, column: str) -> DataFrame:
    return pred.select(column).where(not_blank(column)).distinct().orderBy(column)


def unique_merchants(pred: DataFrame) -> DataFrame:
    return unique_values(pred, "merchant")


def unique_categories(pred: DataFrame) -> DataFrame:
    return unique_values(pred, "category")


def _bounds(pred: DataFrame, column: str) -> DataFrame:
    return pred.agg(
        F.min(column).cast("date").alias("min_date"), F.max(column).cast("date").alias("max_date")
    )


def date_bounds(pred: DataFrame) -> DataFrame:
    return _bounds(pred, TS)


def prediction_date_bounds(pred: DataFrame) -> DataFrame:
    return _bounds(pred, "created_at")


# --- ranked lists --------------------------------------------------------------


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def rank_page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, rows_per_task: int = ROWS_PER_SLICE) -> DataFrame:
    """One page of a globally ordered table with its 1-based ``rank``; ``order`` ends in a unique column.

    A page within the first ``rows_per_task`` rows is taken from the top
    ``limit + offset`` rows, so the un-partitioned window sees no more than
    that. A deeper page is found by the sizes of sorted ranges: only the
    ranges it lies in are ranked.
    """
    offset = max(offset, 0)
    if limit + offset > rows_per_task:
        return _deep_page(df, order, limit, offset)
    head = top_k(df, order, limit + offset)
    ranked = head.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") > offset)


def _deep_page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """The rows are written once by ranges of the order; the driver sees one number for each range."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/ranges-{uuid.uuid4().hex[:12]}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id())
    ranged.write.parquet(path)
    table = spark.read.schema(ranged.schema).parquet(path)
    starts, before = [], 0
    for r in table.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).orderBy("__range").collect():
        if before < offset + limit and before + r["n"] > offset:
            starts.append((r["__range"], before))
        before += r["n"]
    first = spark.createDataFrame(starts, "__range int, __before long")
    # The constant bounds let the scan skip the files of all other ranges.
    near = table.where(F.col("__range").between(starts[0][0], starts[-1][0])) if starts else table.where("false")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    ranked = near.join(F.broadcast(first), "__range").withColumn("rank", F.col("__before") + place)
    page = ranked.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
    return page.drop("__range", "__before").orderBy("rank")


def recent_transactions(
    pred: DataFrame, limit: int = 100, offset: int = 0, newest=NEWEST, rows_per_task: int = ROWS_PER_SLICE, **filters
) -> DataFrame:
    """Newest versions by risk, then event time, then id."""
    order = [
        F.coalesce(_risk(), F.lit(-1.0)).desc(),
        F.col(TS).desc_nulls_first(),
        F.col("trans_num").asc_nulls_last(),
    ]
    optional = ["batch_id"] if "batch_id" in pred.columns else []
    shown = ["trans_num", TS, "amt", "merchant", "category", *optional, "risk_score", "prediction", "created_at"]
    return rank_page(_current(pred, newest, filters).select(*shown), order, limit, offset, rows_per_task).select(
        "trans_num",
        TS,
        "amt",
        "merchant",
        "category",
        *optional,
        "risk_score",
        prediction_label("prediction").alias("prediction"),
        F.col("prediction").alias("prediction_raw"),
        "rank",
        F.col(TS).alias("transaction_created_at"),
        F.col("created_at").alias("prediction_created_at"),
    )


def transaction_detail(pred: DataFrame, trans_num: str, newest=NEWEST) -> DataFrame:
    """All stored fields of one transaction's newest version."""
    mine = latest_predictions(pred.where(F.col("trans_num") == trans_num), newest)
    stored = [c for c in [*PAYLOAD_TYPES, "batch_id"] if c in pred.columns]
    return mine.select(
        "trans_num",
        *stored,
        "risk_score",
        prediction_label("prediction").alias("prediction"),
        F.col("prediction").alias("prediction_raw"),
        F.col("created_at").alias("prediction_created_at"),
    )


def top_risk(recent: DataFrame, n: int = 5) -> DataFrame:
    """The riskiest rows of a recent-transactions list, newest first among equals."""
    when = F.coalesce("prediction_created_at", "transaction_created_at")
    order = [F.col("risk_score").desc_nulls_last(), when.desc_nulls_last(), F.col("trans_num").asc_nulls_last()]
    return top_k(recent, order, n)


def flag_high_risk(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Add ``high_risk`` and the status text (Fraud, Legit, Pending) of each row.

    ``prediction`` is the stored boolean; rows without a score are never high risk.
    """
    high = F.coalesce(_risk() >= F.lit(threshold), F.lit(False))
    return df.withColumn("high_risk", high).withColumn(
        "status", F.initcap(prediction_label("prediction"))
    )


# --- aggregates ----------------------------------------------------------------


def kpis(pred: DataFrame, latest_only: bool = False, newest=NEWEST, **filters) -> DataFrame:
    """Headline figures in one row.

    By default every stored version counts, also superseded ones;
    ``latest_only`` restricts the figures to newest versions.
    """
    scope = latest_predictions(pred, newest) if latest_only else pred
    fraud = F.col("prediction")
    n, frauds = F.count(F.lit(1)), count_where(fraud)
    return scope.where(prediction_filters(**filters)).agg(
        n.cast("double").alias("total_transactions"),
        frauds.cast("double").alias("fraud_count"),
        or_zero(F.sum(F.when(fraud, _amt()).otherwise(0.0))).alias("amount_saved"),
        or_zero(F.avg(F.when(fraud, _amt()))).alias("avg_fraud_amount"),
        or_zero(F.avg(_risk())).alias("avg_risk_score"),
        or_zero(F.max(_risk())).alias("max_risk_score"),
        or_zero(frauds / F.nullif(n, F.lit(0))).alias("fraud_rate"),
    )


def fraud_over_time(pred: DataFrame, newest=NEWEST, **filters) -> DataFrame:
    return (
        _current(pred, newest, filters)
        .groupBy(F.to_date(TS).alias("date"))
        .agg(count_where(F.col("prediction")).alias("fraud_count"), F.avg(_risk()).alias("avg_risk_score"))
        .orderBy(F.col("date").asc_nulls_last())
    )


def merchant_ranking(pred: DataFrame, top_n: int = 10, newest=NEWEST, **filters) -> DataFrame:
    ranked = (
        _current(pred, newest, filters)
        .groupBy("merchant")
        .agg(count_where(F.col("prediction")).alias("fraud_count"), F.avg(_risk()).alias("avg_risk_score"))
        .where("fraud_count > 0")
    )
    order = [F.desc("fraud_count"), F.col("avg_risk_score").desc_nulls_first(), F.col("merchant").asc_nulls_last()]
    return top_k(ranked, order, top_n)


def risk_distribution(pred: DataFrame, newest=NEWEST, **filters) -> DataFrame:
    """Counts in ten equal risk buckets; empty buckets are absent."""
    tenth = F.floor(F.coalesce(F.col("risk_score"), F.lit(0)) * 10).cast("int")
    index = F.least(F.lit(9), F.greatest(F.lit(0), tenth))
    label = F.format_string("%.1f - %.1f", F.col("bucket_index") / 10.0, (F.col("bucket_index") + 1) / 10.0)
    return (
        _current(pred, newest, filters)
        .groupBy(index.alias("bucket_index"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(label.alias("risk_score_bucket"), "count", "bucket_index")
        .orderBy("bucket_index")
    )


def risk_summary(pred: DataFrame, key: str, top_n: int = 15, newest=NEWEST, **filters) -> DataFrame:
    summary = _current(pred, newest, filters).groupBy(key).agg(*_risk_measures())
    order = [F.desc("fraud_count"), F.desc("fraud_rate"), F.desc("avg_risk_score"), F.col(key).asc_nulls_last()]
    return top_k(summary, order, top_n)


def category_summary(pred: DataFrame, top_n: int = 15, **options) -> DataFrame:
    return risk_summary(pred, "category", top_n, **options)


def merchant_summary(pred: DataFrame, top_n: int = 15, **options) -> DataFrame:
    return risk_summary(pred, "merchant", top_n, **options)


def hourly_summary(pred: DataFrame, newest=NEWEST, **filters) -> DataFrame:
    return (
        _current(pred, newest, filters)
        .groupBy(F.hour(TS).alias("hour_of_day"))
        .agg(*_risk_measures(amount=False))
        .orderBy(F.col("hour_of_day").asc_nulls_last())
    )


def _money_range(start: Column, size: int) -> Column:
    return F.format_string("$%,d-$%,d", start, start + size - 1)


def amount_bucket_summary(
    pred: DataFrame, bucket_size: float = 100.0, newest=NEWEST, buckets: int | None = AMOUNT_BUCKETS, **filters
) -> DataFrame:
    """Risk by amount bucket: the lowest ``buckets`` of them, as the report shows, or all if None."""
    size = F.lit(float(bucket_size))
    start = F.floor(or_zero(_amt()) / size) * size
    summary = (
        _current(pred, newest, filters)
        .groupBy(start.alias("bucket_start"))
        .agg(*_risk_measures(amount=False))
        .withColumn("bucket_label", _money_range(F.col("bucket_start").cast("long"), int(bucket_size)))
    )
    order = [F.col("bucket_start").asc_nulls_last()]
    return summary.orderBy(*order) if buckets is None else top_k(summary, order, buckets)


# --- chart projections ---------------------------------------------------------

# Chart name -> (summary, key column, metric column).
CHARTS = {
    "fraud_over_time": ("fraud_over_time", "date", "fraud_count"),
    "avg_risk_over_time": ("fraud_over_time", "date", "avg_risk_score"),
    "risk_distribution": ("risk_distribution", "risk_score_bucket", "count"),
    "category_fraud_count": ("category_summary", "category", "fraud_count"),
    "category_fraud_rate": ("category_summary", "category", "fraud_rate"),
    "category_avg_risk": ("category_summary", "category", "avg_risk_score"),
    "category_max_risk": ("category_summary", "category", "max_risk_score"),
    "merchant_fraud_count": ("merchant_summary", "merchant", "fraud_count"),
    "merchant_fraud_rate": ("merchant_summary", "merchant", "fraud_rate"),
    "merchant_avg_risk": ("merchant_summary", "merchant", "avg_risk_score"),
    "hourly_fraud_count": ("hourly_summary", "hour_of_day", "fraud_count"),
    "hourly_avg_risk": ("hourly_summary", "hour_of_day", "avg_risk_score"),
    "amount_fraud_rate": ("amount_bucket_summary", "bucket_label", "fraud_rate"),
}


def metric_view(summary: DataFrame, key: str, metric: str) -> DataFrame:
    """One metric of a summary, lowest first as the bar charts draw it."""
    return summary.select(key, metric).orderBy(F.col(metric).asc_nulls_last(), F.col(key).asc_nulls_last())


def chart(pred: DataFrame, name: str, **options) -> DataFrame:
    summary, key, metric = CHARTS[name]
    return metric_view(globals()[summary](pred, **options), key, metric)
