"""Slices, prefix sums and quantiles against plain definitions, with tiny slices."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cardwatch.plans import slices
from cardwatch.plans.history import lookback_counts
from cardwatch.plans.prefix import equal_bin, exact_quantiles, prefix_sum
from cardwatch.plans.slices import plan_slices, with_slice


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = []
    for i in range(600):
        key = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        value = rng.choice([1.0, 1.0, 2.5, rng.uniform(0, 9)])
        data.append((key, f"r{i:04d}", value, rng.randrange(0, 3)))
    return spark.createDataFrame(data, "key string, id string, value double, w int").cache()


def test_slices_are_ordered_and_small(rows):
    plan = plan_slices(rows, ["value", "id"], rows_per_slice=50)
    sliced = with_slice(rows, plan)
    sizes = sliced.groupBy("__slice").agg(F.count("*").alias("n"), F.min(F.struct("value", "id")).alias("lo"), F.max(F.struct("value", "id")).alias("hi"))
    got = sizes.orderBy("__slice").collect()
    assert len(got) > 6 and max(r["n"] for r in got) <= 250
    for a, b in zip(got, got[1:]):
        assert tuple(a["hi"]) < tuple(b["lo"])


def test_only_hot_keys_are_cut(rows):
    plan = plan_slices(rows, ["id"], ["key"], rows_per_slice=150)
    slices = {r["key"]: r["n"] for r in with_slice(rows, plan).groupBy("key").agg(F.countDistinct("__slice").alias("n")).collect()}
    assert slices["hot"] > 1 and slices["a"] == slices["b"] == slices[None] == 1


def test_number_of_slices_is_bounded(rows):
    plan = plan_slices(rows, ["id"], rows_per_slice=1, max_slices=10)
    assert 5 <= len(plan.cuts) <= 25


@pytest.fixture(params=["plan", "table", "copies"])
def cuts_as(request, monkeypatch):
    """Cut points as constants, as a broadcast table and as a table that is shuffled in copies."""
    if request.param != "plan":
        monkeypatch.setattr(slices, "CUTS_IN_PLAN", 2)
        monkeypatch.setattr(slices, "TOP_CUTS", 4)
    if request.param == "copies":
        monkeypatch.setattr(slices, "BROADCAST_ROWS", 1)
        monkeypatch.setattr(slices, "COPIES", 3)
    return request.param


def test_any_number_of_cut_points(rows, cuts_as):
    plan = plan_slices(rows, ["value", "id"], rows_per_slice=12)
    assert (plan.table is None) == (cuts_as == "plan") and plan.small == (cuts_as != "copies")
    if plan.table is not None:
        assert plan.stride > 1 and len(plan.cuts) <= 4 < plan.n_cuts == plan.table.count()
        assert "from_json" not in str(plan.table._jdf.queryExecution().analyzed())
    sliced = with_slice(rows, plan)
    assert sliced.columns == [*rows.columns, "__slice"] and sliced.count() == rows.count()
    # The number of cut points at or before a row, by definition.
    points = sorted(map(tuple, plan.table.select("value", "id").collect())) if plan.table is not None else plan.cuts
    for r in sliced.collect():
        assert r["__slice"] == sum(c <= (r["value"], r["id"]) for c in points)
    assert sliced.groupBy("__slice").count().agg(F.max("count")).first()[0] <= 5 * 12


def test_hot_keys_of_any_plan(spark, rows, cuts_as):
    plan = plan_slices(rows, ["id"], ["key"], rows_per_slice=60)
    got = {r["key"] for r in plan.hot_keys(spark).collect()}
    assert got == {r["key"] for r in rows.groupBy("key").count().where("count > 60").collect()}
    sizes = with_slice(rows, plan).groupBy("key", "__slice").count()
    assert sizes.count() > len(got) + 3


@pytest.mark.parametrize("by", [[], ["key"]])
def test_prefix_sum_with_any_number_of_cut_points(rows, by, cuts_as):
    w = Window.partitionBy(*by).orderBy("value", "id")
    want = rows.select("id", (F.row_number().over(w) - 1).cast("long").alias("pos"), F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum_w"))
    got = prefix_sum(rows, ["value", "id"], ["w"], by, rows_per_slice=25).select("id", "pos", "cum_w")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("by", [[], ["key"]])
def test_prefix_sum_equals_plain_window(rows, by):
    w = Window.partitionBy(*by).orderBy("value", "id")
    want = rows.select("id", (F.row_number().over(w) - 1).cast("long").alias("pos"), F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum_w"))
    got = prefix_sum(rows, ["value", "id"], ["w"], by, rows_per_slice=40).select("id", "pos", "cum_w")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("in_plan", [2, 10_000])
@pytest.mark.parametrize("limit", [25, 10_000])
@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz", "decimal(20,3)", "decimal(38,0)"])
def test_any_sortable_order_on_both_sides_of_the_limit(rows, kind, limit, in_plan, monkeypatch):
    monkeypatch.setattr(slices, "CUTS_IN_PLAN", in_plan)
    number = F.pmod(F.xxhash64("id"), F.lit(90)).cast("int")
    whole = F.date_add(F.lit("2023-12-01").cast("date"), number)
    values = {
        "date": whole,
        "timestamp": F.timestamp_micros(F.lit(1_700_000_000_123_457) + number * 1_000_003),
        "timestamp_ntz": F.timestamp_micros(F.lit(-5_000_000) + number * 1_000_003).cast("timestamp_ntz"),
    }
    data = rows.withColumn("at", values.get(kind, (number - 40).cast("double") / 8).cast(kind))
    w = Window.orderBy("at", "id")
    want = data.select("id", (F.row_number().over(w) - 1).cast("long").alias("pos"))
    got = prefix_sum(data, ["at", "id"], (), (), rows_per_slice=limit).select("id", "pos")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_no_single_partition_over_rows(rows, spark):
    """The only un-partitioned step runs over one row per slice, not over rows."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = prefix_sum(rows, ["value", "id"], ["w"], rows_per_slice=40)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = plan.splitlines()
    single = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    assert len(single) == 1 and "HashAggregate" in lines[single[0] + 1]


@pytest.mark.parametrize("limit", [20, 10_000])
def test_exact_quantiles(rows, limit):
    probs = [0.0, 0.1, 0.5, 0.95, 1.0]
    want = {r["key"]: r["q"] for r in rows.groupBy("key").agg(F.percentile("value", F.array(*map(F.lit, probs))).alias("q")).collect()}
    got = {r["key"]: r["quantiles"] for r in exact_quantiles(rows, "value", probs, ["key"], limit).collect()}
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([(None,)], "v double")
    assert exact_quantiles(empty, "v", [0.5]).first()["n"] is None


def test_equal_bins(spark):
    sizes = {}
    for r in spark.range(13).select(equal_bin(F.col("id"), F.lit(13), 5).alias("b")).collect():
        sizes[r["b"]] = sizes.get(r["b"], 0) + 1
    assert [sizes[i] for i in range(1, 6)] == [3, 2, 3, 2, 3]
    assert spark.range(1).select(equal_bin(F.col("id"), F.lit(1), 10).alias("b")).first()["b"] == 1


def test_lookback_across_days(spark):
    day = 86_400
    seconds = [day - 10, day - 1, day - 1, day, day + 5, 3 * day]
    data = spark.createDataFrame([("k", s) for s in seconds], "key string, __sec long")
    got = {r["__sec"]: r["n"] for r in lookback_counts(data, ["key"], {"n": 10, "d": day}).collect()}
    assert got == {day - 10: 0, day - 1: 1, day: 3, day + 5: 3, 3 * day: 0}
