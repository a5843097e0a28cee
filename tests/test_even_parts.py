"""Fits and scores read rows that were worked out once and lie in even parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardwatch.operators import ml


@pytest.fixture(scope="module")
def table(spark):
    """All rows in one part, as a window over a class leaves them."""
    rng = np.random.default_rng(5)
    rows = [(f"t{i:04d}", float(x), "ab"[i % 2], int(x > 1)) for i, x in enumerate(rng.normal(size=800))]
    return spark.createDataFrame(rows, "trans_num string, x double, text string, is_fraud int").coalesce(1)


def sizes(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_folds_lie_in_even_parts(table):
    for fold in ml.prepared_folds(ml.stratified_folds(table, k=2)):
        for part in (fold.train, fold.test):
            assert len(sizes(part)) > 1 and max(sizes(part)) < 2 * np.mean(sizes(part))


def test_folds_work_out_their_rows_once(spark, table):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def slow(x):
        calls.add(1)
        return x

    folded = ml.stratified_folds(table, k=2).withColumn("y", slow(F.col("x")))
    ml.prepared_folds(folded)
    assert calls.value == table.count()


def test_a_classifier_reads_even_parts_and_the_model_has_all_stages(table):
    seen = []

    class Spy(type(ml.rf())):
        def fit(self, df):
            seen.append(df)
            return super().fit(df)

    spy = Spy(labelCol="is_fraud", weightCol="weight", numTrees=2, maxDepth=2, seed=1)
    model = ml._fit(table, spy, "is_fraud", ("trans_num",))
    assert len(sizes(seen[0])) > 1 and max(sizes(seen[0])) < 2 * np.mean(sizes(seen[0]))
    assert [type(s).__name__ for s in model.stages] == ["ImputerModel", "TextCodesModel", "VectorAssembler", "RandomForestClassificationModel"]
    first, second = (ml.score(ml.fit_rf(table, dict(numTrees=3)), table).orderBy("trans_num").collect() for _ in range(2))
    assert first == second


def test_ranks_come_from_written_scores(table):
    ranked = ml.score_ranked(ml.fit_rf(table, dict(numTrees=2)), table)
    assert "UDF" not in ranked._jdf.queryExecution().optimizedPlan().toString()
    got = ranked.orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 801))
    assert [r["trans_num"] for r in got] == [r["trans_num"] for r in sorted(got, key=lambda r: (-r["risk_score"], r["trans_num"]))]
