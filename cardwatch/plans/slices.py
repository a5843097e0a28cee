"""Ordered slices: the answer to hot keys and to global order.

A running computation over an ordered group normally lands in one task. When
the group may hold a third of all rows that task never ends, so such groups
are cut into *slices*: consecutive ranges of the sort key, each about
``rows_per_slice`` long. A slice is a pure function of the row (the cut points
are sampled once and kept), so a retried task always puts a row into the same
slice.

Only groups above the limit get cut points. Every row looks up its slice by a
binary search over all cut points; a group without any falls between two of
them as a whole and stays one slice.

Any number of cut points is possible. Up to ``CUTS_IN_PLAN`` they are constants
of the plan. More are a table in the shared folder and never pass through the
driver: ``TOP_CUTS`` of them, evenly spaced, are constants and lead a row to a
stretch of cut points, which is joined to it and searched in the same way.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwatch.session import ensure_checkpoint_dir

ROWS_PER_SLICE = 500_000
SAMPLES_PER_CUT = 8
CUTS_IN_PLAN = 10_000
TOP_CUTS = 1_024
#: Tables with a row for each slice or cut point are broadcast up to so many rows.
BROADCAST_ROWS = 1_000_000
#: Copies of a stretch of cut points, each for a part of its rows, where the stretches are too many to broadcast.
COPIES = 256
CUTTABLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.BooleanType)


def _in_order(name: str, kind: T.DataType) -> Column:
    """A column as a value of the same order that can be a constant of the plan: dates and times as whole numbers."""
    if isinstance(kind, T.DateType):
        return F.unix_date(name).alias(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name).alias(name)
    if isinstance(kind, T.TimestampNTZType):  # without a zone, so that no hour comes twice
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)").alias(name)
    return F.col(name)


@dataclass(frozen=True)
class SlicePlan:
    """Cut points (key and order values together, ascending); none when every group fits one slice."""

    by: tuple[str, ...]
    order: tuple[str, ...]
    total: int
    largest: int
    cuts: list[tuple] = field(default_factory=list)
    schema: T.StructType | None = None
    #: All cut points with their number ``pos``, if they are too many for ``cuts``, which then has every ``stride``-th.
    table: DataFrame | None = None
    n_cuts: int = 0
    stride: int = 1

    @property
    def split(self) -> bool:
        return bool(self.cuts)

    @property
    def small(self) -> bool:
        """Whether a table with one row for each slice can be broadcast."""
        return max(self.n_cuts, len(self.cuts)) <= BROADCAST_ROWS

    def hot_keys(self, spark) -> DataFrame:
        """The keys that were cut: never more than there are cut points."""
        if self.table is not None:
            return self.table.select(*self.by).distinct()
        keys = dict.fromkeys(c[: len(self.by)] for c in self.cuts)
        return spark.createDataFrame(list(keys), T.StructType([self.schema[c] for c in self.by]))


def plan_slices(
    df: DataFrame,
    order: list[str],
    by: list[str] | tuple[str, ...] = (),
    rows_per_slice: int = ROWS_PER_SLICE,
    max_slices: int | None = None,
    n: int | None = None,
) -> SlicePlan:
    """Count the groups and choose cut points for those that are too long.

    Reads only the key and order columns. There are about as many cut points as
    the long groups have ``rows_per_slice``, however large the input is; only a
    caller that names ``max_slices`` gets longer slices instead. A caller that
    knows the row count passes it as ``n`` and saves the counting job when
    there is no key.
    """
    by, order = tuple(by), tuple(order)
    if by:
        sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
        total, largest = sizes.agg(F.sum("__n"), F.max("__n")).first()
        total, largest = total or 0, largest or 0
    else:
        total = largest = df.count() if n is None else n
    limit = max(rows_per_slice, -(-total // max_slices)) if max_slices else rows_per_slice
    if largest <= limit:
        return SlicePlan(by, order, total, largest)

    candidates = df.select(*by, *[_in_order(c, df.schema[c].dataType) for c in order])
    schema = candidates.schema
    for f in schema.fields:
        if not isinstance(f.dataType, CUTTABLE if f.name in by else (*CUTTABLE, T.DecimalType)):
            raise TypeError(f"cannot cut by {f.name}: {f.dataType.simpleString()}")
    if by:
        hot = sizes.where(F.col("__n") > limit).drop("__n").toDF(*[f"__hot_{c}" for c in by])
        if -(-total // limit) <= BROADCAST_ROWS:  # no more groups than that exceed the limit
            hot = F.broadcast(hot)
        match = F.lit(True)
        for c in by:
            match = match & F.col(c).eqNullSafe(F.col(f"__hot_{c}"))
        candidates = candidates.join(hot, match, "left_semi")
    fraction = min(1.0, SAMPLES_PER_CUT / limit)
    sample = candidates.sample(fraction=fraction, seed=17)
    step = max(1, int(fraction * limit))
    if -(-total // limit) > CUTS_IN_PLAN:
        return _plan_by_table(SlicePlan(by, order, total, largest, schema=schema), sample, step)
    cuts: list[tuple] = []
    key, seen = None, 0
    for row in map(tuple, sample.orderBy(*by, *order).collect()):
        if row[: len(by)] != key:
            key, seen = row[: len(by)], 0
        elif seen % step == 0 and (not cuts or row != cuts[-1]):
            cuts.append(row)
        seen += 1
    return SlicePlan(by, order, total, largest, cuts, schema, n_cuts=len(cuts))


def _plan_by_table(plan: SlicePlan, sample: DataFrame, step: int) -> SlicePlan:
    """Cut points as a written table, found from the positions of the sampled rows.

    The sample is far smaller than the input, so the slices its own positions
    need are found in the same way, until they fit the plan.
    """
    from cardwatch.plans.prefix import prefix_sum

    spark = sample.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/cuts-{uuid.uuid4().hex[:12]}"

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    line = [*plan.by, *plan.order]
    placed = prefix_sum(written(sample, "sample"), list(plan.order), by=list(plan.by))
    points = written(placed.where((F.col("pos") > 0) & (F.col("pos") % step == 0)).select(*line).distinct(), "points")
    table = written(prefix_sum(points, line), "numbered")
    n = table.count()
    stride = max(1, -(-n // TOP_CUTS))
    top = table.where(F.col("pos") % stride == 0).orderBy("pos").select(*line).collect()
    return SlicePlan(plan.by, plan.order, plan.total, plan.largest, [tuple(r) for r in top], plan.schema, table, n, stride)


def with_slice(df: DataFrame, plan: SlicePlan, name: str = "__slice") -> DataFrame:
    """Add the slice number: how many cut points are at or before the row."""
    if not plan.split:
        return df.withColumn(name, F.lit(0))
    point = T.StructType([plan.schema[c] for c in (*plan.by, *plan.order)])
    here = F.struct(*[_in_order(f.name, df.schema[f.name].dataType).cast(f.dataType).alias(f.name) for f in point.fields])
    text = json.dumps([dict(zip(point.names, cut)) for cut in plan.cuts], default=str)  # decimals as texts
    # Parsed once while planning: the tasks see a constant array.
    cuts = F.from_json(F.lit(text), T.ArrayType(point))
    passed = _count_at_or_before(cuts, F.lit(len(plan.cuts)), len(plan.cuts), here)
    if plan.table is None:
        return df.withColumn(name, passed)

    stretches = plan.table.groupBy((F.call_function("div", F.col("pos"), F.lit(plan.stride)) + 1).cast("int").alias("__top"))
    stretches = stretches.agg(F.sort_array(F.collect_list(F.struct(*point.names))).alias("__cuts"))
    df = df.withColumn("__top", passed)
    if plan.small:
        found, on = df.join(F.broadcast(stretches), "__top", "left"), ["__top"]
    else:  # rows of a stretch are many, so each of them meets one of several copies
        on = ["__top", "__copy"]
        copies = stretches.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
        dealt = df.withColumn("__copy", F.pmod(F.xxhash64(*point.names), F.lit(COPIES)).cast("int"))
        found = dealt.join(copies, on, "left")
    inside = _count_at_or_before(F.col("__cuts"), F.size("__cuts"), plan.stride, here)
    number = F.when(F.col("__top") == 0, 0).otherwise((F.col("__top") - 1) * plan.stride + inside)
    return found.withColumn(name, number.cast("int")).drop(*on, "__cuts").select(*[c for c in df.columns if c != "__top"], name)


def _count_at_or_before(cuts: Column, n: Column, most: int, here: Column) -> Column:
    """Binary search over an ascending array of ``n`` values, ``most`` at the most."""
    strides = [1 << i for i in reversed(range(most.bit_length()))]

    def advance(found: Column, stride: Column) -> Column:
        probe = found + stride
        inside = F.element_at(cuts, F.least(probe, n)) <= here
        return F.when((probe <= n) & inside, probe).otherwise(found)

    return F.aggregate(F.array(*map(F.lit, strides)), F.lit(0), advance)
