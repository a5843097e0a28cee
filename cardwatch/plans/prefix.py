"""Positions, running sums and exact quantiles over inputs of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwatch.plans.slices import ROWS_PER_SLICE, plan_slices, with_slice
from cardwatch.session import written


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", small: bool = False) -> DataFrame:
    """Equi-join that treats NULL keys as equal; ``small`` marks a right side of proven size."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in keys])
    joined = left.join(F.broadcast(renamed) if small else renamed, condition, how)
    return joined.drop(*[f"__r_{c}" for c in keys])


def prefix_sum(
    df: DataFrame,
    order: list[str],
    values: list[str] = (),
    by: list[str] = (),
    rows_per_slice: int = ROWS_PER_SLICE,
    n: int | None = None,
) -> DataFrame:
    """Add ``pos`` (0-based) and ``cum_<value>`` (inclusive) in ascending order, per ``by``.

    No task sees more than about one slice. What earlier slices contribute is
    carried in by a join with one row per slice that continues a group; a
    slice continues at most one group, so that table has no more rows than
    there are slices. ``n`` is the row count, if the caller knows it.
    """
    by, values = list(by), list(values)
    plan = plan_slices(df, [*by, *order], rows_per_slice=rows_per_slice, n=n)
    df = with_slice(df, plan)
    running = Window.partitionBy("__slice", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns(
        {
            "pos": F.row_number().over(Window.partitionBy("__slice", *by).orderBy(*order)).cast("long") - 1,
            **{f"cum_{v}": F.sum(v).over(running) for v in values},
        }
    )
    if not plan.split:
        return local.drop("__slice")

    partial = df.groupBy("__slice", *by).agg(
        F.count(F.lit(1)).alias("__before_pos"), *[F.sum(v).alias(f"__before_{v}") for v in values]
    )
    earlier = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    names = ["__before_pos", *[f"__before_{v}" for v in values]]
    carry = partial.select("__slice", *by, *[F.sum(c).over(earlier).alias(c) for c in names])
    carry = carry.where(F.col("__before_pos") > 0)
    out = null_safe_join(local, carry, ["__slice", *by], small=plan.small)
    out = out.withColumn("pos", F.col("pos") + F.coalesce("__before_pos", F.lit(0)))
    for v in values:
        out = out.withColumn(f"cum_{v}", F.col(f"cum_{v}") + F.coalesce(F.col(f"__before_{v}"), F.lit(0)))
    return out.drop("__slice", *names)


def exact_quantiles(
    df: DataFrame, value: str | Column, probs: list[float], by: list[str] = (), rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Exact interpolated quantiles: one row per group with ``n`` and array ``quantiles``.

    Works on value counts, so repeated values are merged before the shuffle
    and no task ever holds all values of a group, unlike a percentile
    aggregate. The counts of groups are read by several passes and written once.
    """
    by = list(by)
    v = F.col(value) if isinstance(value, str) else value
    counts = df.select(*by, v.cast("double").alias("__v")).where("__v is not null")
    counts = counts.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__c"))
    if by:
        counts = written(counts)
        placed = prefix_sum(counts, ["__v"], ["__c"], by, rows_per_slice)
        placed = null_safe_join(placed, counts.groupBy(*by).agg(F.sum("__c").alias("__n")), by, "inner")
    else:
        distinct, total = counts.agg(F.count(F.lit(1)), F.sum("__c")).first()
        placed = prefix_sum(counts, ["__v"], ["__c"], by, rows_per_slice, n=distinct)
        placed = placed.withColumn("__n", F.lit(total or 0).cast("long"))
    return picked_quantiles(placed, probs, by)


def picked_quantiles(placed: DataFrame, probs: list[float], by: list[str]) -> DataFrame:
    """Quantiles of values ``__v`` that occur ``__c`` times, with their running count ``cum___c`` in a group of ``__n`` rows.

    Values that hold none of the wanted ranks may be missing.
    """
    start, end = F.col("cum___c") - F.col("__c"), F.col("cum___c")
    picks = []
    for i, p in enumerate(probs):
        rank = (F.col("__n") - 1) * F.lit(float(p))
        for side, target in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            picks.append(F.max(F.when((start <= target) & (target < end), F.col("__v"))).alias(f"{side}{i}"))
    picked = placed.groupBy(*by).agg(F.max("__n").alias("n"), *picks)

    def interpolate(i: int, p: float) -> Column:
        rank = (F.col("n") - 1) * F.lit(float(p))
        return F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (rank - F.floor(rank))

    return picked.select(*by, "n", F.array(*[interpolate(i, p) for i, p in enumerate(probs)]).alias("quantiles"))


def exact_median(df: DataFrame, value: str) -> float | None:
    """The exact median as a driver-side number (a single value)."""
    row = exact_quantiles(df, value, [0.5]).first()
    return None if row is None or row["n"] is None else row["quantiles"][0]


def equal_bin(pos: Column, n: Column, bins: int) -> Column:
    """1-based equal-count bin of a 0-based position, cut the way quantile binning does."""
    return F.when(n <= 1, F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.call_function("div", pos * bins + n - 2, F.greatest(n - 1, F.lit(1))))
    ).cast("int")
