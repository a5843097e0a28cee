"""Many rows of whole histories are dealt out by their number; the features stay the same."""

from pyspark.sql import functions as F

from cardwatch.bindings import transactions
from cardwatch.operators import features


def test_a_task_gets_a_bounded_number_of_rows(spark, tiny, monkeypatch):
    tx = transactions(spark, tiny)
    usual = features.build_features(tx).orderBy("trans_num").collect()
    monkeypatch.setattr(features, "ROWS_PER_TASK", 40)
    built = features.build_features(tx)
    sizes = [r["count"] for r in built.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 10 and max(sizes) < len(usual) / 4
    assert built.orderBy("trans_num").collect() == usual
