from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardwatch.functions.columns import haversine_km, hour_band, iv_band
from cardwatch.operators import profile as E
from cardwatch.operators import selection as V


def test_month_gap_is_present(spark):
    rows = [(datetime(2024, 1, 5), 1), (datetime(2024, 3, 5), 0)]
    got = E.monthly_rate(spark.createDataFrame(rows, "trans_date_trans_time timestamp, is_fraud int")).collect()
    assert [(r["month"].month, r["transactions"], r["fraud_rate"]) for r in got] == [(1, 1, 1.0), (2, 0, None), (3, 1, 0.0)]


def test_absent_weekday_has_no_figures(spark):
    rows = [(datetime(2024, 1, 1), 1)]
    got = E.weekday_rate(spark.createDataFrame(rows, "trans_date_trans_time timestamp, is_fraud int")).collect()
    assert len(got) == 7 and got[0]["transactions"] == 1 and got[1]["transactions"] is None


def test_unlabelled_rows_are_a_class(spark):
    got = {r["is_fraud"]: r for r in E.class_distribution(spark.createDataFrame([(0,), (None,), (0,)], "is_fraud int")).collect()}
    assert got[None]["n"] == 1 and got[0]["imbalance_ratio"] == float("inf")


def test_duplicates_count_nulls_as_equal(spark):
    got = E.duplicate_counts(spark.createDataFrame([("a", None), ("a", None), ("a", 1)], "trans_num string, x int")).first()
    assert tuple(got) == (1, 2)


def test_amount_summary_matches_definition(spark):
    got = E.amount_summary(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (10.0,), (10.0,), (None,)], "amt double")).first()
    assert got["mode"] == 2.0 and got["count"] == 5 and got["median"] == 2.0 and got["iqr"] == 8.0
    assert got["skew"] == pytest.approx(26.4 / 16.8**1.5 * 20**0.5 / 3)


def test_constant_column_has_no_correlation(spark):
    data = spark.createDataFrame([(1.0, 1), (1.0, 0)], "amt double, is_fraud int")
    assert E.target_correlations(data, ["amt"]).first()["corr"] is None


def test_small_expressions(spark):
    row = spark.range(1).select(
        haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("km"),
        *[hour_band(F.lit(h)).alias(f"h{h}") for h in (0, 5, 6, 12, 18, 23)],
        *[iv_band(F.lit(v).cast("double")).alias(f"i{i}") for i, v in enumerate((None, 0.01, 0.05, 0.2, 0.4, 0.9))],
    ).first()
    assert row["km"] == pytest.approx(111.195, abs=1e-3)
    assert row[1:7] == ("madrugada", "madrugada", "manana", "tarde", "noche", "noche")
    assert row[7:] == ("na", "inutil", "debil", "medio", "fuerte", "muy_fuerte_o_leakage")


def test_constant_column_has_no_information(spark):
    data = spark.range(50).select(F.col("id").cast("string").alias("trans_num"), F.lit("x").alias("c"), (F.col("id") % 2).cast("int").alias("is_fraud"))
    assert V.information_value(data, ["c"]).first()["iv"] == 0.0
    assert V.mutual_information(data, ["c"]).first()["mi"] == pytest.approx(0.0, abs=1e-12)


def test_information_value_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=400).round(1), rng.integers(0, 2, 400)
    data = spark.createDataFrame([(f"{i:03d}", float(a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "trans_num string, x double, is_fraud int")
    order = np.lexsort([np.arange(400), x])
    pos = np.empty(400, int)
    pos[order] = np.arange(400)
    bins = np.maximum(1, (10 * pos + 398) // 399)
    good = np.array([((bins == b) & (y == 0)).sum() for b in range(1, 11)])
    bad = np.array([((bins == b) & (y == 1)).sum() for b in range(1, 11)])
    dg, db = (good + 0.5) / (good.sum() + 5), (bad + 0.5) / (bad.sum() + 5)
    want = ((dg - db) * np.log(dg / db)).sum()
    for limit in (10_000, 60):
        assert V.information_value(data, ["x"], rows_per_slice=limit).first()["iv"] == pytest.approx(want)


def test_perfect_predictor_has_full_information(spark):
    data = spark.range(200).select((F.col("id") % 2).cast("int").alias("is_fraud"), F.concat(F.lit("v"), (F.col("id") % 2).cast("string")).alias("c"))
    assert V.mutual_information(data, ["c"]).first()["mi"] == pytest.approx(np.log(2))


def test_stratified_sample_is_exact_and_repeatable(spark):
    data = spark.range(1000).select(F.col("id").cast("string").alias("trans_num"), (F.col("id") % 10 == 0).cast("int").alias("is_fraud"))
    one = V.stratified_sample(data, "is_fraud", 100, 3, rows_per_slice=90)
    assert sorted(r[0] for r in one.collect()) == sorted(r[0] for r in V.stratified_sample(data, "is_fraud", 100, 3).collect())
    assert {r[0]: r[1] for r in one.groupBy("is_fraud").count().collect()} == {0: 90, 1: 10}
