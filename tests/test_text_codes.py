"""Models over text columns of any number of values, and the columns that the model queries use."""

from pyspark.sql import functions as F

from cardwatch.bindings import transactions
from cardwatch.operators import ml
from cardwatch.operators.features import FEATURES
from catalog import modelling
from catalog.registry import Tables


def test_more_values_than_bins(spark, tmp_path):
    rows = spark.range(600).select(
        F.concat(F.lit("t"), "id").alias("trans_num"), F.format_string("m%04d", F.col("id") % 400).alias("merchant"),
        F.when(F.col("id") % 3 > 0, "x").otherwise(F.lit(None)).alias("city"), F.lit(None).cast("string").alias("never"),
        (F.col("id") % 7).cast("double").alias("amt"), (F.col("id") % 400 < 100).cast("int").alias("is_fraud"),
    )
    model = ml.fit_rf(rows, dict(numTrees=5, maxDepth=3))
    ml.save_model(model, str(tmp_path / "m"), spark)
    loaded, _ = ml.load_model(str(tmp_path / "m"), spark)
    new = spark.createDataFrame([("a", "m0007", None, None), ("b", "unseen", "y", "z"), ("c", None, "x", None)], "trans_num string, merchant string, city string, never string")
    new = new.withColumns({"amt": F.lit(1.0), "is_fraud": F.lit(0)})
    for m in (model, loaded):
        codes = {r["trans_num"]: (r["merchant__cat"], r["city__cat"], r["never__cat"]) for r in m.transform(new).collect()}
        assert codes == {"a": (7.0, 0.0, -1.0), "b": (-1.0, -1.0, -1.0), "c": (0.0, 0.0, -1.0)}
    assert ml.score(loaded, rows).where("prediction = (is_fraud = 1)").count() > 590


def test_model_queries_take_all_columns(spark, tiny):
    data = modelling.model_table(Tables(spark, tiny))
    assert set(FEATURES) | {"trans_num", "cc_num", "merchant", "category", "city", "state", "amt"} <= set(data.columns)
    kept = {f.name for f in transactions(spark, tiny).schema.fields if f.dataType.typeName() not in ("timestamp", "timestamp_ntz", "date")}
    assert kept <= set(data.columns)
