"""Cut histories find the slices of their rows once, however many pieces of carried state read them."""

from pyspark.sql import functions as F

from cardwatch.operators import running_median as rm
from cardwatch.plans.slices import plan_slices, with_slice


def test_running_median_finds_slices_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def slow(part):
        calls.add(1)
        return part

    rows = spark.range(400).select((F.col("id") % 2).alias("card"), F.col("id").alias("at"), (F.col("id") * 37 % 101).cast("double").alias("amt"))
    rows = with_slice(rows, plan_slices(rows, ["at"], ["card"], rows_per_slice=40), "part")
    path = [["card"], "part", ["at"], "amt", "m", 40]
    got = rm.median_of_sliced_histories(rows, rows.withColumn("part", slow("part")), *path).orderBy("at").collect()
    assert calls.value == 400
    plain = rm.median_of_whole_histories(rows, ["card"], ["at"], "amt", "m").select(*rows.columns, "m").orderBy("at").collect()
    assert [r["m"] for r in got] == [r["m"] for r in plain]
