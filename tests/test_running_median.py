"""Running medians against plain definitions: the wavelet matrix, whole histories, cut histories."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cardwatch.operators import running_median as rm
from cardwatch.plans.slices import plan_slices, with_slice


def test_order_statistics():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 200):
        values = rng.integers(0, max(2, n // 3), n).astype(float)
        low = rng.integers(0, n, 300)
        high = low + 1 + rng.integers(0, n, 300) % (n - low)
        k = rng.integers(0, n, 300) % (high - low)
        want = [sorted(values[a:z])[i] for a, z, i in zip(low, high, k)]
        assert rm.order_statistics(values, low, high, k).tolist() == want


def test_counts_of_earlier_rows():
    rng = np.random.default_rng(2)
    numbers = rng.integers(0, 5, 60)
    older = np.array([3, 0, 7, 1, 4])
    more = np.full(9, older.sum())
    more[:6] = np.concatenate([[0], np.cumsum(older)])
    high = rng.integers(0, 61, 200)
    k = rng.integers(0, 1000, 200) % (high + older.sum())
    found, place, equal = rm.WaveletMatrix(numbers, 3).kth(np.zeros(200, int), high, k, more)
    for h, i, v, p, e in zip(high, k, found, place, equal):
        pool = sorted([*np.repeat(np.arange(5), older), *numbers[:h]])
        assert v == pool[i] and e == pool.count(v) and p == i - pool.index(v)


def test_medians_of_many_histories():
    rng = random.Random(4)
    for _ in range(60):
        earlier = [float(rng.randrange(9)) for _ in range(rng.randrange(4))]
        lengths = [rng.randrange(1, 9) for _ in range(rng.randrange(1, 5))]
        values = [rng.choice([None, float(rng.randrange(9))]) for _ in range(sum(lengths))]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        missing = np.array([v is None for v in values])
        got = rm.prior_medians(np.array([v or 0.0 for v in values]), missing, starts, np.array(earlier))
        for s, n in zip(starts, lengths):
            for i in range(s, s + n):
                before = (earlier if s == 0 else []) + [v for v in values[s:i] if v is not None]
                assert (np.isnan(got[i]) and not before) or got[i] == statistics.median(before)


@pytest.fixture(scope="module")
def log(spark):
    """A card with two thirds of all rows, a hot value, NULLs, ties in every order column and repeated rows."""
    rng = random.Random(7)
    rows = []
    for i in range(900):
        card = 1 if rng.random() < 0.66 else rng.choice([2, 3, 4, None])
        value = rng.choice([None, 5.0, 5.0, 5.0, round(rng.uniform(0, 40), 1), float(i) / 20])
        rows.append((card, rng.randrange(300), f"t{i:04d}", value))
    rows += [(1, 7, "same", 5.0)] * 3 + [(9, k, f"n{k}", None) for k in range(5)]
    return spark.createDataFrame(rows, "card long, at long, id string, amt double")


def want(log):
    w = Window.partitionBy("card").orderBy("at", "id", "amt").rowsBetween(Window.unboundedPreceding, -1)
    return sorted(map(str, log.withColumn("m", F.percentile("amt", 0.5).over(w)).collect()))


@pytest.mark.parametrize("batch", [10_000, 7])
def test_whole_histories(spark, log, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = rm.median_of_whole_histories(log, ["card"], ["at", "id", "amt"], "amt", "m")
        assert sorted(map(str, got.collect())) == want(log)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("limit", [20, 60, 100_000])
def test_cut_histories(log, limit):
    plan = plan_slices(log, ["at", "id"], ["card"], rows_per_slice=limit)
    rows = with_slice(log, plan, "part")
    wide = rows.withColumn("other", F.lit("x"))
    got = rm.median_of_sliced_histories(wide, rows, ["card"], "part", ["at", "id"], "amt", "m", limit)
    assert got.columns == [*wide.columns, "m"]
    assert sorted(map(str, got.drop("part", "other").collect())) == want(log)


def test_no_rows(log):
    none = log.where("false").withColumn("part", F.lit(0))
    assert rm.median_of_whole_histories(none, ["card"], ["at"], "amt", "m").count() == 0
    assert rm.median_of_sliced_histories(none, none, ["card"], "part", ["at"], "amt", "m", 10).count() == 0


def test_short_slices_send_a_value_range_a_few_times(spark, monkeypatch):
    """Rows sent for their values, before the bound by time: slices far shorter than a value range must not each get a copy of it."""
    monkeypatch.setattr(rm, "VALUE_RANGES", 8)
    rng = random.Random(3)
    log = spark.createDataFrame([(1, i, f"t{i:04d}", round(rng.uniform(0, 40), 1)) for i in range(2400)], "card long, at long, id string, amt double").cache()
    rows = with_slice(log, plan_slices(log, ["at", "id"], ["card"], rows_per_slice=10), "part")
    sent, join = [], rm.null_safe_join

    def recorded(left, *args, **options):
        out = join(left, *args, **options)
        if "__for" in out.columns:
            sent.append(out)
        return out

    monkeypatch.setattr(rm, "null_safe_join", recorded)
    got = rm.median_of_sliced_histories(rows, rows, ["card"], "part", ["at", "id"], "amt", "m", 10)
    assert len(sent) == 1 and sent[0].count() < 12 * 2400
    assert sorted(map(str, got.drop("part").collect())) == want(log)
