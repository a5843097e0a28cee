"""Data profiling: quality, activity, amounts, time, risk and correlation.

Quantiles come from ``exact_quantiles`` (value counts, no single-task
percentile), positions from ``prefix_sum``; the rest are plain aggregates.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwatch.functions.columns import (
    correlation,
    count_where,
    haversine_km,
    hour_band,
    positives,
    ratio,
    skewness_corrected,
    seeded_order,
)
from cardwatch.operators.versions import dedupe_first
from cardwatch.plans.prefix import exact_quantiles, null_safe_join, prefix_sum
from cardwatch.plans.refine import few_groups, grouped_quantiles
from cardwatch.plans.slices import ROWS_PER_SLICE
from cardwatch.schemas import ENGINEERED_PATTERN, LABEL, TS
from cardwatch.session import written

# Day names, Monday first.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
ID_LIKE = ("cc_num", "zip", "merch_zipcode", "trans_num")


def _label() -> Column:
    return F.col(LABEL).cast("long")


def _volume() -> list[Column]:
    """Labelled rows, frauds and their rate; the rate of no rows is NULL."""
    n, frauds = F.count(LABEL), positives()
    return [n.alias("transactions"), frauds.alias("frauds"), ratio(frauds, n).alias("fraud_rate")]


def long_format(df: DataFrame, columns: list[str], dtype: str = "double", keep: list[str] = ()) -> DataFrame:
    """(feature, value) rows of several columns."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(dtype).alias("value")) for c in columns])
    return df.select(*keep, F.explode(cells).alias("cell")).select(*keep, "cell.feature", "cell.value")


def _spread_row(row: DataFrame, names: dict[str, list[Column]], labels: list[str]) -> DataFrame:
    """Turn one wide row into one row per name."""
    entries = [
        F.struct(F.lit(name).alias(labels[0]), *[c.alias(labels[1 + i]) for i, c in enumerate(cells)])
        for name, cells in names.items()
    ]
    return row.select(F.explode(F.array(*entries)).alias("entry")).select("entry.*")


# --- quality -----------------------------------------------------------------------


def duplicate_counts(df: DataFrame, key: str = "trans_num") -> DataFrame:
    """Surplus rows by full content and by id; NULLs count as equal."""
    # Equal rows meet by content; the counts per content are merged before any shuffle.
    full = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    full = full.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    ids = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    ids = ids.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_ids"))
    both = full.withColumn("one", F.lit(1)).join(ids.withColumn("one", F.lit(1)), "one")
    return both.select("duplicate_rows", "duplicate_ids")


def null_summary(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    row = df.agg(*[(ratio(count_where(F.col(c).isNull()), n) * 100).alias(c) for c in df.columns])
    names = {c: [F.col(c)] for c in df.columns}
    return _spread_row(row, names, ["column", "null_pct"]).orderBy(F.desc("null_pct"), "column")


def sanity_counts(df: DataFrame) -> DataFrame:
    measures = [
        count_where(F.col("amt") < 0).alias("negative_amt"),
        count_where(F.col(TS).isNull()).alias("invalid_time"),
    ]
    if "merch_zipcode" in df.columns:
        share = ratio(count_where(F.col("merch_zipcode").isNull()), F.count(F.lit(1)))
        measures.append((share * 100).alias("null_pct_merch_zipcode"))
    return df.agg(*measures)


# --- activity per card ----------------------------------------------------------------


def user_activity(df: DataFrame, key: str = "cc_num") -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_transactions"))


def top_users(df: DataFrame, n: int = 15, key: str = "cc_num") -> DataFrame:
    return user_activity(df, key).orderBy(F.desc("n_transactions"), key).limit(n)


def user_activity_summary(df: DataFrame, key: str = "cc_num") -> DataFrame:
    """Describe of transactions per card."""
    probs = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    activity = user_activity(df, key)
    n = F.col("n_transactions")
    base = activity.agg(
        F.count(n).alias("users"),
        F.sum(n).alias("transactions"),
        F.avg(n).alias("mean"),
        F.stddev_samp(n).alias("std"),
        F.min(n).alias("min"),
        F.max(n).alias("max"),
    )
    return _with_quantiles(base, exact_quantiles(activity, "n_transactions", list(probs.values())), list(probs), [])


def _with_quantiles(base: DataFrame, quantiles: DataFrame, names: list[str], by: list[str], small: bool = False) -> DataFrame:
    """Join quantile columns to an aggregate with the same groups; ``small`` if there are few."""
    wide = quantiles.select(*by, *[F.col("quantiles")[i].alias(name) for i, name in enumerate(names)])
    if by:
        return null_safe_join(base, wide, by, small=small)
    return base.withColumn("__one", F.lit(1)).join(wide.withColumn("__one", F.lit(1)), "__one", "left").drop("__one")


def concentration_curve(df: DataFrame, key: str = "cc_num", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Cumulative share of transactions over cards, most active first."""
    activity = user_activity(df, key).withColumn("__down", -F.col("n_transactions"))
    users, total = activity.agg(F.count(F.lit(1)), F.sum("n_transactions")).first()
    placed = prefix_sum(activity, ["__down", key], ["n_transactions"], (), rows_per_slice, n=users)
    return placed.select(
        key,
        "n_transactions",
        (F.col("pos") + 1).alias("rank"),
        ((F.col("pos") + 1) / F.lit(float(users or 1))).alias("share_users"),
        (F.col("cum_n_transactions") / F.lit(float(total or 1))).alias("share_transactions"),
    )


def top_share(df: DataFrame, frac: float = 0.1, key: str = "cc_num", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Share of all transactions made by the most active share of cards."""
    curve = concentration_curve(df, key, rows_per_slice)
    users = F.max("rank")
    head = F.greatest(F.lit(1), F.ceil(users * F.lit(frac)))
    # The curve rises with the rank, so its value at the cut is a maximum below it.
    totals = curve.agg(head.alias("top_users")).first()["top_users"]
    return curve.where(F.col("rank") <= F.lit(totals)).agg(
        F.max("rank").alias("top_users"), F.max("share_transactions").alias("share_transactions")
    )


# --- classes and amounts ----------------------------------------------------------------


def class_distribution(df: DataFrame) -> DataFrame:
    """Rows per class (unlabelled kept), percentage and the class ratio."""
    counts = df.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(1))  # two or three rows by now
    total = F.sum("n").over(everything)
    legit = F.sum(F.when(F.col(LABEL) == 0, F.col("n")).otherwise(0)).over(everything)
    fraud = F.sum(F.when(F.col(LABEL) == 1, F.col("n")).otherwise(0)).over(everything)
    return counts.select(
        LABEL,
        "n",
        F.round(F.col("n") / total * 100, 4).alias("pct"),
        F.when(fraud == 0, F.lit(float("inf"))).otherwise(legit / F.nullif(fraud, F.lit(0))).alias("imbalance_ratio"),
    )


AMOUNT_QUANTILES = {"median": 0.5, "q1": 0.25, "q3": 0.75, "p95": 0.95, "p99": 0.99}


def amount_summary(df: DataFrame, by: str | None = None, value: str = "amt") -> DataFrame:
    """Location, spread and tail of the amount, overall or per group."""
    keys = [by] if by else []
    given = df.where(F.col(value).isNotNull())
    base = given.groupBy(*keys).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        skewness_corrected(value).alias("skew"),
    )
    out = _with_quantiles(
        base, exact_quantiles(given, value, list(AMOUNT_QUANTILES.values()), keys), list(AMOUNT_QUANTILES), keys
    )
    # Mode by value counts, the smallest of the most frequent.
    counts = given.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    modes = counts.groupBy(*keys).agg(F.max_by(F.col(value), F.struct("__n", (-F.col(value)).alias("v"))).alias("mode"))
    if keys:
        out = null_safe_join(out, modes, keys)
    else:
        out = out.withColumn("__one", F.lit(1)).join(modes.withColumn("__one", F.lit(1)), "__one", "left").drop("__one")
    return out.withColumn("iqr", F.col("q3") - F.col("q1"))


def class_amount_ratio(df: DataFrame) -> DataFrame:
    """Mean and median amount of both classes and their ratios, in one row."""
    means = df.groupBy(LABEL).agg(F.avg("amt").alias("mean"))
    medians = exact_quantiles(df, "amt", [0.5], [LABEL]).select(LABEL, F.col("quantiles")[0].alias("median"))
    both = null_safe_join(means, medians, [LABEL])
    picked = both.agg(
        *[
            F.max(F.when(F.col(LABEL).cast("int") == y, F.col(m))).alias(f"{m}_{name}")
            for m in ("mean", "median")
            for y, name in ((0, "legit"), (1, "fraud"))
        ]
    )
    return picked.withColumns({f"{m}_ratio": ratio(F.col(f"{m}_fraud"), F.col(f"{m}_legit")) for m in ("mean", "median")})


def iqr_outliers(df: DataFrame, value: str = "amt") -> DataFrame:
    """Fraud by upper-IQR outlier flag, with the limit and the outlier share."""
    row = exact_quantiles(df, value, [0.25, 0.75]).first()
    q1, q3 = row["quantiles"] if row else (None, None)
    upper = None if q1 is None else q3 + 1.5 * (q3 - q1)
    flagged = df.withColumn("amt_outlier_iqr", F.coalesce(F.col(value) > F.lit(upper).cast("double"), F.lit(False)).cast("int"))
    n = F.count(F.lit(1))
    out = flagged.groupBy("amt_outlier_iqr").agg(*_volume(), n.alias("__rows"))
    share = F.col("__rows") / F.sum("__rows").over(Window.partitionBy(F.lit(1)))  # two rows
    return out.select(
        "amt_outlier_iqr",
        "transactions",
        "frauds",
        "fraud_rate",
        F.lit(upper).cast("double").alias("upper_limit"),
        (share * 100).alias("rows_pct"),
    )


def tail_segments(df: DataFrame, value: str = "amt") -> DataFrame:
    """Fraud among the rows at or above the 95th, 99th and 99.9th percentile."""
    probs = {"p95": 0.95, "p99": 0.99, "p999": 0.999}
    row = exact_quantiles(df, value, list(probs.values())).first()
    limits = dict(zip(probs, row["quantiles"] if row else [None] * len(probs)))
    measures = {}
    for name, limit in limits.items():
        inside = F.col(value) >= F.lit(limit).cast("double")
        labelled = count_where(inside & _label().isNotNull())
        frauds = F.coalesce(F.sum(F.when(inside, _label())), F.lit(0))
        measures[name] = (count_where(inside), frauds, ratio(frauds, labelled))
    wide = df.agg(*[c.alias(f"{n}_{i}") for n, cells in measures.items() for i, c in enumerate(cells)])
    entries = {f"amt >= {n}": [F.lit(limits[n]).cast("double"), *[F.col(f"{n}_{i}") for i in range(3)]] for n in limits}
    return _spread_row(wide, entries, ["segment", "threshold", "n", "frauds", "fraud_rate"])


def transform_amount(df: DataFrame, value: str = "amt") -> DataFrame:
    """Log amount and the amount clipped at its 99th percentile."""
    row = exact_quantiles(df, value, [0.99]).first()
    p99 = row["quantiles"][0] if row else None
    amount = F.col(value)
    return df.withColumns(
        {
            "amt_log1p": F.log1p(F.when(amount < 0, 0.0).otherwise(amount)),
            "amt_clip_p99": F.when(amount > F.lit(p99).cast("double"), F.lit(p99).cast("double")).otherwise(amount),
        }
    )


def sample_n(df: DataFrame, n: int, seed: int, key: str = "trans_num") -> DataFrame:
    """A repeatable sample of at most n rows: the first n in the seeded order of the key, without gathering them in one task."""
    mixed = df.withColumn("__h", seeded_order(key, seed))
    return prefix_sum(mixed, ["__h", key]).where(F.col("pos") < n).drop("__h", "pos")


# --- time -------------------------------------------------------------------------------


def add_calendar(df: DataFrame) -> DataFrame:
    ts = F.col(TS)
    weekday = F.weekday(ts)
    return df.withColumns(
        {
            "year": F.year(ts),
            "month": F.month(ts),
            "day": F.dayofmonth(ts),
            "hour": F.hour(ts),
            "weekday": weekday,
            "weekday_name": _weekday_name(weekday),
            "is_weekend": F.coalesce(weekday >= 5, F.lit(False)).cast("int"),
        }
    )


def _weekday_name(weekday: Column) -> Column:
    return F.when(weekday.isNotNull(), F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), weekday + 1))


def monthly_rate(df: DataFrame) -> DataFrame:
    """Volume and fraud per month; months without rows appear with 0 and no rate."""
    month = F.trunc(F.col(TS).cast("date"), "month")
    got = df.where(F.col(TS).isNotNull()).groupBy(month.alias("month")).agg(*_volume())
    months = got.agg(F.min("month").alias("a"), F.max("month").alias("b")).where("a is not null")
    months = months.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    out = months.join(got, "month", "left").fillna(0, ["transactions", "frauds"])
    return out.orderBy("month")


def hourly_rate(df: DataFrame) -> DataFrame:
    got = df.where(F.col(TS).isNotNull()).groupBy(F.hour(TS).alias("hour")).agg(*_volume())
    return got.orderBy("hour")


def weekday_rate(df: DataFrame) -> DataFrame:
    """Volume and fraud per weekday, Monday first; absent days have no figures."""
    days = df.sparkSession.createDataFrame([(i, d) for i, d in enumerate(WEEKDAYS)], "weekday int, weekday_name string")
    got = df.where(F.col(TS).isNotNull()).groupBy(F.weekday(TS).alias("weekday")).agg(*_volume())
    return days.join(got, "weekday", "left").orderBy("weekday")


def weekday_hour_heatmap(df: DataFrame) -> DataFrame:
    """Mean label per weekday and hour: a row per weekday, a column per hour."""
    hours = df.where(F.col(TS).isNotNull()).select(F.weekday(TS).alias("weekday"), F.hour(TS).alias("hour"), LABEL)
    grid = hours.groupBy("weekday").agg(
        *[F.avg(F.when(F.col("hour") == h, _label())).alias(f"h{h:02d}") for h in range(24)]
    )
    days = df.sparkSession.createDataFrame([(i, d) for i, d in enumerate(WEEKDAYS)], "weekday int, weekday_name string")
    return days.join(grid, "weekday", "left").orderBy("weekday")


def temporal_extremes(df: DataFrame) -> DataFrame:
    """Busiest month and the months, hours and weekdays with extreme fraud rates; first wins ties."""

    def first_max(key: str, metric: str, tie: str) -> Column:
        return F.max_by(F.col(key), F.struct(F.col(metric), (-_rank_number(tie)).alias("t")))

    def first_min(key: str, metric: str, tie: str) -> Column:
        return F.min_by(F.col(key), F.struct(F.col(metric), _rank_number(tie).alias("t")))

    def _rank_number(tie: str) -> Column:
        return F.unix_date(F.col(tie)) if tie == "month" else F.col(tie)

    monthly = monthly_rate(df).where("fraud_rate is not null").agg(
        first_max("month", "transactions", "month").alias("month_max_volume"),
        F.max("transactions").alias("max_month_volume"),
        first_min("month", "fraud_rate", "month").alias("month_min_rate"),
        F.min("fraud_rate").alias("min_month_rate"),
        first_max("month", "fraud_rate", "month").alias("month_max_rate"),
        F.max("fraud_rate").alias("max_month_rate"),
    )
    hourly = hourly_rate(df).where("fraud_rate is not null").agg(
        first_max("hour", "fraud_rate", "hour").alias("hour_max_rate"),
        F.max("fraud_rate").alias("max_hour_rate"),
        first_min("hour", "fraud_rate", "hour").alias("hour_min_rate"),
        F.min("fraud_rate").alias("min_hour_rate"),
    )
    weekly = weekday_rate(df).where("fraud_rate is not null").agg(
        first_max("weekday_name", "fraud_rate", "weekday").alias("weekday_max_rate"),
        F.max("fraud_rate").alias("max_weekday_rate"),
    )
    parts = [p.withColumn("one", F.lit(1)) for p in (monthly, hourly, weekly)]
    return reduce(lambda a, b: a.join(b, "one"), parts).drop("one")


# --- risk by key ---------------------------------------------------------------------------


def risk_rate_by(df: DataFrame, col: str | Column, min_count: int = 1000, name: str | None = None) -> DataFrame:
    """Fraud rate per value with enough support, riskiest first."""
    key = F.col(col) if isinstance(col, str) else col
    name = name or (col if isinstance(col, str) else "key")
    out = df.groupBy(key.alias(name)).agg(*_volume()).where(F.col(name).isNotNull())
    return out.where(F.col("transactions") >= min_count).orderBy(F.desc("fraud_rate"), name)


def hour_band_rate(df: DataFrame, min_count: int = 1000) -> DataFrame:
    return risk_rate_by(df, hour_band(F.hour(TS)), min_count, "hour_band")


def card_stats(df: DataFrame, min_count: int = 20, top: int = 10) -> DataFrame:
    """Cards with most frauds. Distinct merchants come from the (card, merchant) pairs."""
    pairs = df.where(F.col("cc_num").isNotNull()).groupBy("cc_num", "merchant").agg(
        F.count(LABEL).alias("n"),
        F.sum(_label()).alias("frauds"),
        F.sum("amt").alias("amount"),
        F.count("amt").alias("amounts"),
    )
    out = pairs.groupBy("cc_num").agg(
        F.sum("n").alias("tx_count"),
        F.coalesce(F.sum("frauds"), F.lit(0)).alias("fraud_count"),
        F.count("merchant").alias("unique_merchants"),
        ratio(F.sum("amount"), F.sum("amounts")).alias("avg_amt"),
    )
    out = out.withColumn("fraud_rate", ratio(F.col("fraud_count"), F.col("tx_count")))
    return out.where(F.col("tx_count") >= min_count).orderBy(F.desc("fraud_count"), "cc_num").limit(top)


def merchant_stats(df: DataFrame, min_count: int = 200, top: int = 10) -> DataFrame:
    out = df.where(F.col("merchant").isNotNull()).groupBy("merchant").agg(
        F.count(LABEL).alias("tx_count"), positives().alias("fraud_count"), F.avg("amt").alias("avg_amt")
    )
    out = out.withColumn("fraud_rate", ratio(F.col("fraud_count"), F.col("tx_count")))
    return out.where(F.col("tx_count") >= min_count).orderBy(F.desc("fraud_rate"), "merchant").limit(top)


# --- correlation ---------------------------------------------------------------------------


def numeric_columns(df: DataFrame, exclude=ID_LIKE) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def correlations(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson correlation of all column pairs, each over rows where both are known."""
    cols = cols or numeric_columns(df)
    pairs = list(combinations(cols, 2))
    row = df.agg(*[correlation(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    entries = [
        F.struct(F.lit(a).alias("var_1"), F.lit(b).alias("var_2"), F.col(f"r{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def target_correlations(df: DataFrame, cols: list[str] | None = None, target: str = LABEL) -> DataFrame:
    """Correlation of each column with the target, strongest first."""
    cols = [c for c in (cols or numeric_columns(df)) if c != target]
    row = df.agg(*[correlation(c, target).alias(c) for c in cols])
    out = _spread_row(row, {c: [F.col(c)] for c in cols}, ["feature", "corr"])
    return out.orderBy(F.abs("corr").desc_nulls_last(), "feature")


def collinear_pairs(df: DataFrame, thr: float = 0.85, cols: list[str] | None = None) -> DataFrame:
    pairs = correlations(df, cols).where(F.abs("corr") >= thr)
    return pairs.orderBy(F.abs("corr").desc(), "var_1", "var_2")


# --- engineered columns ------------------------------------------------------------------------


def engineered_columns(df: DataFrame) -> list[str]:
    import re

    return [c for c in df.columns if re.match(ENGINEERED_PATTERN, c)]


def distinct_counts(df: DataFrame, cols: list[str], approximate: bool = False) -> DataFrame:
    """(feature, n_unique): exact by value counts, or in one pass by sketches."""
    if approximate:
        row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
        return _spread_row(row, {c: [F.col(c)] for c in cols}, ["feature", "n_unique"])
    values = long_format(df, cols, "string").where("value is not null").distinct()
    found = values.groupBy("feature").agg(F.count(F.lit(1)).alias("n_unique"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    return names.join(found, "feature", "left").fillna(0, ["n_unique"])


def feature_profile(df: DataFrame, cols: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Family, type, gaps, cardinality and variance of engineered columns, which are worked out once and written."""
    cols = cols or engineered_columns(df)
    df = written(df.select(*cols))
    types = dict(df.dtypes)
    numeric = set(numeric_columns(df, ()))
    n = F.count(F.lit(1))
    row = df.agg(
        n.alias("__rows"),
        *[(ratio(count_where(F.col(c).isNull()), n) * 100).alias(f"null_{c}") for c in cols],
        *[F.var_samp(F.col(c)).alias(f"var_{c}") for c in cols if c in numeric],
    )
    entries = {
        c: [
            F.lit(c[0]),
            F.lit(types[c]),
            F.col(f"null_{c}"),
            F.lit(c in numeric),
            F.col(f"var_{c}") if c in numeric else F.lit(None).cast("double"),
            F.col("__rows"),
        ]
        for c in cols
    }
    labels = ["feature", "family", "dtype", "null_pct", "is_numeric", "variance", "__rows"]
    out = _spread_row(row, entries, labels).join(distinct_counts(df, cols, approximate), "feature")
    out = out.withColumn("unique_ratio", ratio(F.col("n_unique"), F.col("__rows"))).drop("__rows")
    return out.orderBy(F.desc("null_pct"), F.desc("unique_ratio"), "feature")


def family_summary(profile: DataFrame) -> DataFrame:
    return (
        profile.groupBy("family")
        .agg(
            F.count("feature").alias("n_features"),
            (F.avg(F.col("is_numeric").cast("int")) * 100).alias("pct_numeric"),
            F.avg("null_pct").alias("avg_null_pct"),
            F.avg("unique_ratio").alias("avg_unique_ratio"),
        )
        .orderBy("family")
    )


DESCRIBE_QUANTILES = {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}


def robust_describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean, deviation, extremes and quantiles of several columns, which are worked out once and written."""
    cells = long_format(written(df.select(*cols)), cols).where("value is not null")
    base = cells.groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    quantiles = exact_quantiles(cells, "value", list(DESCRIBE_QUANTILES.values()), ["feature"])
    return _with_quantiles(base, quantiles, list(DESCRIBE_QUANTILES), ["feature"]).orderBy("feature")


# --- distance and amount profiles -------------------------------------------------------------------

LOCAL_KM = 80.0


def _clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def distance_profile(df: DataFrame, by: str | None = "category", travel_boost: float = 1.0) -> DataFrame:
    """How often and how far cards buy away from home, per group or overall."""
    given = df.dropna(subset=["lat", "long", "merch_lat", "merch_long", *([by] if by else [])])
    far = given.withColumn("km", haversine_km("lat", "long", "merch_lat", "merch_long"))
    local = F.col("km") <= LOCAL_KM
    sigma = F.when(count_where(local) > 5, F.stddev_pop(F.when(local, F.col("km")))).otherwise(3.0)
    return far.groupBy(*([by] if by else [])).agg(
        F.count(F.lit(1)).alias("n"),
        _clip(F.avg((F.col("km") > LOCAL_KM).cast("double")) * travel_boost, 0.01, 0.5).alias("travel_rate"),
        _clip(sigma, 1.5, 20.0).alias("sigma_km"),
    )


def amount_profile(df: DataFrame, by: str | None = "category", value: str = "amt") -> DataFrame:
    """Shape of the amount distribution: log moments, gamma moments, tail quantiles and family."""
    keys = [by] if by else []
    given = df.where(F.col(value) > 0)
    for k in keys:
        given = given.where(F.col(k).isNotNull())
    v = F.col(value)
    logs = F.ln(F.greatest(v, F.lit(0.01)))
    base = given.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(logs).alias("mu"),
        F.greatest(F.stddev_pop(logs), F.lit(0.08)).alias("sigma"),
        F.avg(v).alias("__mean"),
        F.var_pop(v).alias("__var"),
        F.skewness(v).alias("__skew"),
    )
    base = base.where("n > 0")
    small = bool(keys) and few_groups(given, keys)
    quantiles = (grouped_quantiles if small else exact_quantiles)(given, value, [0.01, 0.99, 0.995], keys)
    out = _with_quantiles(base, quantiles, ["__q01", "__q99", "__q995"], keys, small)
    tails = null_safe_join(given, out.select(*keys, "__q99"), keys, small=small) if keys else given.withColumn(
        "__q99", F.lit(out.first()["__q99"]).cast("double")
    )
    tails = tails.groupBy(*keys).agg(F.avg((v > F.col("__q99")).cast("double")).alias("__tail"))
    if keys:
        out = null_safe_join(out, tails, keys, small=small)
    else:
        out = out.withColumn("__one", F.lit(1)).join(tails.withColumn("__one", F.lit(1)), "__one").drop("__one")
    mean, var = F.col("__mean"), F.col("__var")
    safe = F.nullif(var, F.lit(0.0))
    q99 = F.greatest(F.col("__q99"), F.col("__q01") + 1.0)
    return out.select(
        *keys,
        "n",
        F.when(F.coalesce(F.nanvl("__skew", F.lit(0.0)), F.lit(0.0)) >= 1.5, "lognormal").otherwise("gamma").alias("dist"),
        "mu",
        "sigma",
        F.when(var > 0, F.greatest(mean * mean / safe, F.lit(0.2))).otherwise(2.0).alias("shape"),
        F.when(var > 0, F.greatest(var / mean, F.lit(0.5))).otherwise(F.greatest(mean / 2, F.lit(1.0))).alias("scale"),
        F.greatest(F.col("__q01"), F.lit(0.01)).alias("q01"),
        q99.alias("q99"),
        F.greatest(F.col("__q995"), F.col("__q99") + 1.0).alias("q995"),
        _clip(F.col("__tail"), 0.005, 0.05).alias("tail_rate"),
    )


# --- reference tables ----------------------------------------------------------------------------------


def frequency(df: DataFrame, col: str) -> DataFrame:
    """Normalised frequency of each known value."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    return counts.withColumn("prob", F.col("n") / F.lit(float(total)))


def city_reference(df: DataFrame) -> DataFrame:
    """Median position and size of each city, with its share of transactions."""
    keys = ["city", "state"]
    given = df.dropna(subset=["city", "state", "lat", "long"])
    wanted = ["zip", "lat", "long", "city_pop"]
    medians = exact_quantiles(long_format(given, wanted, "double", keys), "value", [0.5], [*keys, "feature"])
    wide = medians.groupBy(*keys).agg(
        *[F.max(F.when(F.col("feature") == c, F.col("quantiles")[0])).alias(c) for c in wanted]
    )
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))
    out = wide.join(counts, keys, "left")
    total = out.agg(F.sum("cnt")).first()[0] or 1
    return out.withColumn("prob", F.col("cnt") / F.lit(float(total)))


def merchants_by_category(df: DataFrame) -> DataFrame:
    """Distinct (category, merchant) pairs: rows, not one ever-growing list per category."""
    return df.select("category", "merchant").dropna().distinct()


def time_histograms(df: DataFrame) -> DataFrame:
    """Smoothed shares of weekdays and of hours on working days and weekends."""
    spark = df.sparkSession
    stamped = df.where(F.col(TS).isNotNull()).groupBy(F.weekday(TS).alias("d"), F.hour(TS).alias("h")).agg(
        F.count(F.lit(1)).alias("c")
    )
    slots = [("weekday", i) for i in range(7)]
    slots += [(name, h) for name in ("weekday_hour", "weekend_hour") for h in range(24)]
    frame = spark.createDataFrame(slots, "histogram string, slot int")
    hours = F.when(F.col("d") < 5, "weekday_hour").otherwise("weekend_hour")
    both = F.array(
        F.struct(F.lit("weekday").alias("histogram"), F.col("d").alias("slot")),
        F.struct(hours.alias("histogram"), F.col("h").alias("slot")),
    )
    counts = stamped.select(F.explode(both).alias("e"), "c").groupBy("e.histogram", "e.slot").agg(F.sum("c").alias("c"))
    smooth = frame.join(counts, ["histogram", "slot"], "left").withColumn("n", F.coalesce("c", F.lit(0)))
    total = F.sum(F.col("n") + 1.0).over(Window.partitionBy("histogram"))  # 24 slots at most
    return smooth.select("histogram", "slot", "n", ((F.col("n") + 1.0) / total).alias("prob")).orderBy("histogram", "slot")


# The personal fields of a card.
USER_COLUMNS = [
    "cc_num",
    "first",
    "last",
    "gender",
    "street",
    "city",
    "state",
    "zip",
    "lat",
    "long",
    "city_pop",
    "job",
    "dob",
]


def user_pool(df: DataFrame, order_by: list[str | Column]) -> DataFrame:
    """One row per card with its personal fields; ``order_by`` declares which."""
    required = [c for c in ("cc_num", "city", "state", "lat", "long") if c in df.columns]
    kept = dedupe_first(df.dropna(subset=required), "cc_num", order_by)
    return kept.select(*[c for c in USER_COLUMNS if c in df.columns])


def user_hour_profile(df: DataFrame) -> DataFrame:
    """Transactions per card and hour of day as a 24-slot array."""
    by_hour = df.groupBy("cc_num").agg(
        F.array(*[F.count_if(F.hour(TS) == h).cast("int") for h in range(24)]).alias("hours")
    )
    return by_hour


FAR_KM = 500.0
RARE_HOURS = 6
ODD_HOURS = 5


def anomaly_flags(df: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Rule-based flags against the history in ``reference`` (by default the data itself).

    amount above the category's 99th percentile; merchant far from home; an
    hour among 0-4 that is one of the card's six rarest; a merchant never seen
    in the category.
    """
    ref = df if reference is None else reference
    small = few_groups(ref, ["category"])
    limits = (grouped_quantiles if small else exact_quantiles)(ref.where("amt > 0"), "amt", [0.99], ["category"])
    limits = limits.select("category", F.col("quantiles")[0].alias("__q99"))
    hours = user_hour_profile(ref)
    order = F.array_sort(
        F.transform("hours", lambda n, h: F.struct(n.alias("n"), h.alias("h")))
    )
    rare = F.transform(F.slice(order, 1, RARE_HOURS), lambda s: s["h"])
    hours = hours.select("cc_num", rare.alias("__rare"))
    pairs = merchants_by_category(ref).withColumn("__known", F.lit(True))
    out = null_safe_join(df, limits, ["category"], small=small)
    out = out.join(hours, "cc_num", "left")
    out = out.join(pairs, ["category", "merchant"], "left")
    hour = F.hour(TS)
    flags = {
        "high_amount": F.coalesce(F.col("amt") > F.col("__q99"), F.lit(False)),
        "odd_hour": F.coalesce((hour < ODD_HOURS) & F.array_contains("__rare", hour), F.lit(False)),
        "merchant_mismatch": F.col("__known").isNull(),
    }
    if {"lat", "long", "merch_lat", "merch_long"} <= set(df.columns):
        flags["far_from_home"] = F.coalesce(haversine_km("lat", "long", "merch_lat", "merch_long") > FAR_KM, F.lit(False))
    return out.withColumns(flags).drop("__q99", "__rare", "__known")
