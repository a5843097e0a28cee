"""Look-back state over sliced histories.

A history cut into slices needs, for each slice, what all earlier slices of
the same key contributed. The helpers here compute that from one partial row
per (key, slice): the running part only ever orders slices, never rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def before(keys: list[str], order: list[str]) -> Window:
    """All rows of a key strictly before the current one."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def partial_moments(value: str, name: str) -> list[Column]:
    """Count, mean and centred square sum of a column, to be merged later."""
    return [
        F.count(value).alias(f"{name}_n"),
        F.avg(value).alias(f"{name}_mean"),
        (F.var_pop(value) * F.count(value)).alias(f"{name}_m2"),
    ]


def window_moments(value: str, name: str, w) -> dict[str, Column]:
    n = F.count(value).over(w)
    return {
        f"{name}_n": n,
        f"{name}_mean": F.avg(value).over(w),
        f"{name}_m2": F.var_pop(value).over(w) * n,
    }


def window_moment_results(value: str, name: str, w) -> dict[str, Column]:
    """Prior count, mean and sample deviation straight from one window."""
    return {
        f"{name}_n": F.count(value).over(w),
        f"{name}_mean": F.avg(value).over(w),
        f"{name}_std": F.stddev_samp(value).over(w),
    }


def carry_in(
    partial: DataFrame, keys: list[str], slice_col: str, moments: list[str] = (), sums: list[str] = ()
) -> DataFrame:
    """Totals of all earlier slices of a key, as ``c_*`` columns.

    Moments are merged around the key's first slice mean, so equal values
    give a square sum of exactly zero and no precision is lost to large means.
    """
    w = before(keys, [slice_col])
    centre = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = partial
    for m in moments:
        out = out.withColumn(f"__c0_{m}", F.first(f"{m}_mean", ignorenulls=True).over(centre))
        shift = F.col(f"{m}_mean") - F.col(f"__c0_{m}")
        out = out.withColumns(
            {
                f"__d_{m}": F.col(f"{m}_n") * shift,
                f"__q_{m}": F.col(f"{m}_m2") + F.col(f"{m}_n") * shift * shift,
            }
        )
    columns = [F.col(c) for c in [*keys, slice_col]]
    for m in moments:
        n, d, q = (F.sum(c).over(w) for c in (f"{m}_n", f"__d_{m}", f"__q_{m}"))
        n_safe = F.nullif(n, F.lit(0))
        columns += [
            n.alias(f"c_{m}_n"),
            (F.col(f"__c0_{m}") + d / n_safe).alias(f"c_{m}_mean"),
            F.greatest(q - d * d / n_safe, F.lit(0.0)).alias(f"c_{m}_m2"),
        ]
    columns += [F.sum(s).over(w).alias(f"c_{s}") for s in sums]
    return out.select(*columns)


def merge_moments(df: DataFrame, name: str) -> DataFrame:
    """Combine carried and local moments into ``{name}_n/_mean/_std``."""
    na, nb = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in (f"c_{name}_n", f"{name}_n"))
    ma, mb = F.col(f"c_{name}_mean"), F.col(f"{name}_mean")
    qa, qb = (F.coalesce(F.col(c), F.lit(0.0)) for c in (f"c_{name}_m2", f"{name}_m2"))
    n = na + nb
    delta = mb - ma
    mean = F.when(nb == 0, ma).when(na == 0, mb).otherwise(ma + delta * nb / F.nullif(n, F.lit(0.0)))
    m2 = F.when((na == 0) | (nb == 0), qa + qb).otherwise(qa + qb + delta * delta * na * nb / F.nullif(n, F.lit(0.0)))
    std = F.when(n > 1, F.sqrt(m2 / F.nullif(n - 1, F.lit(0.0))))
    df = df.withColumns({"__n": n.cast("long"), "__mean": mean, "__std": std})
    df = df.drop(f"{name}_n", f"{name}_mean", f"{name}_m2", f"c_{name}_n", f"c_{name}_mean", f"c_{name}_m2")
    return df.withColumnsRenamed({"__n": f"{name}_n", "__mean": f"{name}_mean", "__std": f"{name}_std"})


def merge_sum(df: DataFrame, name: str) -> DataFrame:
    total = F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(f"c_{name}"), F.lit(0))
    return df.withColumn(name, total).drop(f"c_{name}")


def lookback_counts(rows: DataFrame, keys: list[str], widths: dict[str, int], block_seconds: int = 86_400) -> DataFrame:
    """Rows of a key in the ``w`` whole seconds before each second.

    Needs a ``__sec`` column. Rows are first merged per (key, second), then
    handled in blocks of one day that also see the end of the day before: a
    group never exceeds two days of seconds, however many rows a key has.
    """
    reach = max(widths.values())
    assert reach <= block_seconds
    ticks = rows.groupBy(*keys, "__sec").agg(F.count(F.lit(1)).alias("__c"))
    block = F.floor(F.col("__sec") / block_seconds).cast("long")
    reaches_next = F.col("__sec") >= (F.col("__block") + 1) * block_seconds - reach
    seen = ticks.withColumn("__block", block).withColumn(
        "__view",
        F.explode(
            F.when(reaches_next, F.array(F.col("__block"), F.col("__block") + 1)).otherwise(F.array("__block"))
        ),
    )
    by_second = Window.partitionBy(*keys, "__view").orderBy("__sec")
    counts = {
        name: F.coalesce(F.sum("__c").over(by_second.rangeBetween(-w, -1)), F.lit(0)) for name, w in widths.items()
    }
    return seen.withColumns(counts).where("__view = __block").drop("__c", "__block", "__view")
