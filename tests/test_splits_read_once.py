"""Splits work out the rows they are given once, however many passes they need."""

import pytest
from pyspark.sql import functions as F

from cardwatch.operators import ml


@pytest.mark.parametrize("split", [ml.stratified_split, ml.stratified_folds])
def test_rows_are_worked_out_once(spark, split):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def slow(y):
        calls.add(1)
        return y

    rows = spark.range(300).select(F.col("id").cast("string").alias("trans_num"), (F.col("id") % 3 == 0).cast("int").alias("is_fraud"))
    got = split(rows.withColumn("is_fraud", slow("is_fraud")), rows_per_slice=20).orderBy("trans_num").collect()
    assert calls.value == 300
    assert got == split(rows).orderBy("trans_num").collect()
