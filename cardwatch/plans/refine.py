"""Exact quantiles of a few large groups by refinement, without shuffling or joining the table by group.

The rows of each group are counted in cells of their value range, map side,
and only the cells that hold a wanted rank are cut again. What travels is a
count for each cell; what is kept between rounds is a few ranges for each
group, whose number is known before anything is sent to all tasks.
"""

from __future__ import annotations

from math import ceil, floor, isfinite

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwatch.plans.prefix import exact_quantiles, null_safe_join, picked_quantiles, prefix_sum
from cardwatch.plans.slices import ROWS_PER_SLICE

#: Groups that may be sent to all tasks, one row each; more are handled by value counts and prefix sums.
MAX_GROUPS = 20_000
CELLS = 4_096
#: Rounds after the first; values of very different size can need more, and then what is left is ordered by slices.
ROUNDS = 6


def few_groups(df: DataFrame, by: list[str], limit: int = MAX_GROUPS) -> bool:
    """Whether ``by`` has at most ``limit`` values; looks at the key columns only."""
    return df.select(*by).distinct().limit(limit + 1).count() <= limit


def _scaled(v: Column) -> Column:
    """Ascending with v, logarithmic in its size, finite for every finite number."""
    return F.signum(v) * F.log1p(F.abs(v))


def _cell(v: Column, low: Column, high: Column, cells: int) -> Column:
    """Which of ``cells`` equal parts of low .. high holds v; the ends never share a part."""
    return F.least(F.floor((v - low) / F.nullif(high - low, F.lit(0.0)) * cells), F.lit(cells - 1).cast("long"))


def _inside(rows: DataFrame, groups: list[tuple], by: list[str], keys: list[T.StructField]) -> DataFrame:
    """Rows whose value lies in one of the ranges of their group, with the range as ``__r``."""
    span = T.StructType([T.StructField(c, T.DoubleType()) for c in ("low", "high")] + [T.StructField("below", T.LongType())])
    schema = T.StructType([*keys, T.StructField("__n", T.LongType()), T.StructField("__ranges", T.ArrayType(span))])
    ranges = rows.sparkSession.createDataFrame(groups, schema)
    met = null_safe_join(rows, ranges, by, "inner", small=True)
    hit = F.filter("__ranges", lambda r: (F.col("__v") >= r["low"]) & (F.col("__v") <= r["high"]))
    return met.withColumn("__r", F.get(hit, F.lit(0))).where("__r is not null").drop("__ranges")


def grouped_quantiles(
    df: DataFrame,
    value: str | Column,
    probs: list[float],
    by: list[str],
    rows_per_slice: int = ROWS_PER_SLICE,
    max_groups: int = MAX_GROUPS,
    cells: int = CELLS,
) -> DataFrame:
    """The result of ``exact_quantiles`` by group: one row per group with ``n`` and array ``quantiles``.

    Rounds go on until a range holds one value or at most ``rows_per_slice``
    rows, or ``ROUNDS`` are over; each is one pass over the key and value columns that shuffles at
    most ``cells`` counts for each range and task. The values of the last
    ranges are counted when the result is read. More than ``max_groups``
    groups give the same result by value counts and prefix sums.

    NULL values are left out, a NULL key is a group; NaN is above all numbers.
    """
    by = list(by)
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*by, v.alias("__v")).where("__v is not null")
    keys = [T.StructField(f.name, f.dataType) for f in rows.select(*by).schema.fields]
    real = F.when(F.abs("__v") < float("inf"), _scaled(F.col("__v")))  # false for NaN, which is above all
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(real).alias("low"), F.max(real).alias("high"))
    found = sizes.limit(max_groups + 1).collect()
    if len(found) > max_groups:
        return exact_quantiles(df, value, probs, by, rows_per_slice)

    width = len(by)
    n = {tuple(r[:width]): r["n"] for r in found}
    ranks = {key: sorted({f((count - 1) * float(p)) for p in probs for f in (floor, ceil)}) for key, count in n.items()}

    # First round: cells of equal size on a logarithmic scale, infinite values and NaN in cells of their own.
    ends = rows.sparkSession.createDataFrame(
        [(*r[:width], r["low"], r["high"]) for r in found],
        T.StructType([*keys, T.StructField("__low", T.DoubleType()), T.StructField("__high", T.DoubleType())]),
    )
    placed = null_safe_join(rows, ends, by, "inner", small=True)
    number = F.col("__v")
    cell = (
        F.when(F.isnan(number), F.lit(cells + 1).cast("long"))
        .when(number == float("inf"), F.lit(cells).cast("long"))
        .when(number == float("-inf"), F.lit(-1).cast("long"))
        .otherwise(F.coalesce(_cell(_scaled(number), F.col("__low"), F.col("__high"), cells), F.lit(0).cast("long")))
    )
    zero = F.struct(F.lit(0.0).alias("low"), F.lit(0).cast("long").alias("below"))
    hits = _hits(placed.withColumn("__r", zero).withColumn("__cell", cell), by, ranks, keys)

    def long_ranges() -> bool:
        return any(r["inside"] > rows_per_slice and r["low"] < r["high"] and isfinite(r["low"]) for r in hits)

    for _ in range(ROUNDS):
        if not long_ranges():
            break
        inside = _inside(rows, _ranges(hits, n, width), by, keys)
        low, high = F.col("__r.low"), F.col("__r.high")
        finer = F.coalesce(_cell(number, low, high, cells), F.lit(0).cast("long"))
        hits = _hits(inside.withColumn("__cell", finer), by, ranks, keys)

    inside = _inside(rows, _ranges(hits, n, width), by, keys)
    counts = inside.groupBy(*by, "__n", F.col("__r.below").alias("__below"), "__v").agg(F.count(F.lit(1)).alias("__c"))
    if long_ranges():
        counts = prefix_sum(counts, ["__v"], ["__c"], [*by, "__below"], rows_per_slice)
    else:
        running = Window.partitionBy(*by, "__below").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("cum___c", F.sum("__c").over(running))
    return picked_quantiles(counts.withColumn("cum___c", F.col("__below") + F.col("cum___c")), probs, by)


def _hits(celled: DataFrame, by: list[str], ranks: dict[tuple, list[int]], keys: list[T.StructField]) -> list:
    """The cells that hold a wanted rank: key, low, high (real values), below, inside; at most one for each rank."""
    counts = celled.groupBy(*by, F.col("__r.below").alias("__below"), "__cell").agg(
        F.count(F.lit(1)).alias("inside"), F.min("__v").alias("low"), F.max("__v").alias("high")
    )
    earlier = Window.partitionBy(*by, "__below").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("__below") + F.coalesce(F.sum("inside").over(earlier), F.lit(0))
    cells = counts.select(*by, "low", "high", below.alias("below"), "inside")
    wanted = celled.sparkSession.createDataFrame(
        [(*key, aims) for key, aims in ranks.items()],
        T.StructType([*keys, T.StructField("__ranks", T.ArrayType(T.LongType()))]),
    )
    met = null_safe_join(cells, wanted, by, "inner", small=True)
    return met.where(
        F.exists("__ranks", lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("inside")))
    ).drop("__ranks").collect()


def _ranges(hits: list, n: dict[tuple, int], width: int) -> list[tuple]:
    """One row for each group: key, number of rows, its ranges."""
    out: dict[tuple, list[tuple]] = {key: [] for key in n}
    for r in hits:
        out[tuple(r[:width])].append((r["low"], r["high"], r["below"]))
    return [(*key, n[key], ranges) for key, ranges in out.items()]
