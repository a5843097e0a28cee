"""Metrics work out the rows they are given once, however many passes they need."""

import pytest
from pyspark.sql import functions as F

from cardwatch.operators import evaluate as X


@pytest.mark.parametrize("metric", [X.roc_auc, X.pr_auc_trapezoid, X.average_precision, X.roc_curve, X.pr_curve, X.precision_recall_at_k, X.lift_table])
def test_rows_are_worked_out_once(spark, metric):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def slow(x):
        calls.add(1)
        return x / 7

    rows = spark.range(300).select(F.col("id").cast("string").alias("trans_num"), (F.col("id") % 3 == 0).cast("int").alias("is_fraud"), (F.col("id") % 50).cast("double").alias("x"))
    scored = rows.withColumn("risk_score", slow(F.col("x")))
    got = metric(scored, rows_per_slice=20).collect()
    assert calls.value == 300
    assert got == metric(rows.withColumn("risk_score", F.col("x") / 7)).collect()
