"""Quantiles by refinement against value counts and plain lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cardwatch.bindings import transactions
from cardwatch.operators.profile import amount_profile, anomaly_flags
from cardwatch.plans.prefix import exact_quantiles
from cardwatch.plans.refine import few_groups, grouped_quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]


def plain(values):
    values = sorted(values, key=lambda v: (math.isnan(v), v))
    out = []
    for p in PROBS:
        rank = (len(values) - 1) * p
        low, high = values[math.floor(rank)], values[math.ceil(rank)]
        out.append(low + (high - low) * (rank - math.floor(rank)))
    return out


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(5)
    return {
        ("hot", 1): [rng.lognormvariate(3, 2) for _ in range(3_000)],
        ("hot", None): [float(rng.randrange(7)) for _ in range(400)],
        (None, 2): [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(500)],
        ("near", 3): [1e9 + rng.random() * 1e-6 for _ in range(300)],
        ("one", 4): [5.0],
        ("same", 4): [-2.5] * 90,
        ("ends", 5): [math.nan] * 40 + [math.inf] * 3 + [-math.inf] * 50 + [rng.uniform(-9, 9) for _ in range(200)],
    }


@pytest.mark.parametrize("limit, cells", [(500_000, 4_096), (100, 4), (20, 64)])
def test_equals_plain_lists_with_many_rounds(spark, groups, limit, cells):
    rows = [(*key, v) for key, values in groups.items() for v in [*values, None]] + [("empty", 6, None)]
    df = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "a string, b int, value double")
    got = {(r["a"], r["b"]): r for r in grouped_quantiles(df, "value", PROBS, ["a", "b"], limit, cells=cells).collect()}
    assert set(got) == set(groups)
    for key, values in groups.items():
        assert got[key]["n"] == len(values)
        assert str(list(got[key]["quantiles"])) == str(plain(values)), key


def test_more_groups_than_may_be_sent_give_the_same(spark, groups):
    rows = [(*key, v) for key, values in groups.items() if key[0] != "ends" for v in values]
    df = spark.createDataFrame(rows, "a string, b int, value double")
    assert few_groups(df, ["a", "b"], 6) and not few_groups(df, ["a", "b"], 5)
    few, many = (
        sorted(map(str, grouped_quantiles(df, "value", PROBS, ["a", "b"], 50, max_groups=m).collect())) for m in (6, 5)
    )
    assert few == many == sorted(map(str, exact_quantiles(df, "value", PROBS, ["a", "b"], 50).collect()))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "a string, value double")
    assert grouped_quantiles(empty, "value", [0.5], ["a"]).collect() == []


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_table_is_not_joined_by_group_with_a_shuffle(spark, tiny):
    tx = transactions(spark, tiny).withColumn("category", F.when(F.col("category") != "view", F.col("category")))
    assert "SortMergeJoin" not in plan_of(amount_profile(tx))
    limits = plan_of(anomaly_flags(tx).select("trans_num", "high_amount"))
    assert not [line for line in limits.splitlines() if "SortMergeJoin" in line and "__r_category" in line]
    assert [line for line in limits.splitlines() if "BroadcastHashJoin" in line and "__r_category" in line]
