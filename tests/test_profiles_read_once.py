"""Profiles and quantiles work out the rows they are given once, however many passes they need."""

import pytest
from pyspark.sql import functions as F

from cardwatch.operators import profile as E
from cardwatch.plans.prefix import exact_quantiles


@pytest.mark.parametrize(
    "profile, calls_a_row",
    [
        (lambda df: E.robust_describe(df, ["A1_x", "A2_y"]), 1),
        (lambda df: E.feature_profile(df, ["A1_x", "A2_y"]), 1),
        # One pass, whose filter for missing values works out the value once more.
        (lambda df: exact_quantiles(df, "A1_x", [0.1, 0.5], ["is_fraud"], rows_per_slice=20).orderBy("is_fraud"), 2),
    ],
)
def test_rows_are_worked_out_once(spark, profile, calls_a_row):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def slow(x):
        calls.add(1)
        return x / 7

    x = F.col("id").cast("double")
    rows = spark.range(300).select((F.col("id") % 3 == 0).cast("int").alias("is_fraud"), x.alias("x"), (F.col("id") % 50).alias("A2_y"))
    got = profile(rows.withColumn("A1_x", slow("x"))).collect()
    assert calls.value == 300 * calls_a_row
    for row, plain in zip(got, profile(rows.withColumn("A1_x", F.col("x") / 7)).collect(), strict=True):
        for c, value in plain.asDict().items():  # sums depend on the order of parts
            assert row[c] == (pytest.approx(value, rel=1e-12) if isinstance(value, (float, list)) else value)
