"""Signals of columns work out the rows they are given once."""

import pytest
from pyspark.sql import functions as F

from cardwatch.operators.selection import feature_signal


def test_rows_are_worked_out_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def slow(x):
        calls.add(1)
        return x / 7

    rows = spark.range(400).select((F.col("id") % 3 == 0).cast("int").alias("is_fraud"), (F.col("id") % 50).cast("double").alias("x"))
    got = feature_signal(rows.withColumn("A1_x", slow(F.col("x"))), ["A1_x"]).collect()
    assert calls.value == 400
    plain = feature_signal(rows.withColumn("A1_x", F.col("x") / 7), ["A1_x"]).collect()
    assert [r["feature"] for r in got] == [r["feature"] for r in plain] == ["A1_x"]
    for c in ("corr_with_target", "single_feature_auc", "mutual_info"):
        assert got[0][c] == pytest.approx(plain[0][c], abs=1e-12)
