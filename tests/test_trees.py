"""Forests and boosted trees on binned rows, against Spark's own fits."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cardwatch.operators import ml, trees


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 6))
    x[:, 3] = rng.integers(0, 3, 1500)
    x[:, 4] = 7.0  # a column of one value
    y = (x[:, 0] + x[:, 3] + x[:, 1] * x[:, 2] + rng.normal(size=1500) * 0.6 > 1.8).astype(int)
    rows = [(i, Vectors.dense(v), int(t), float(1 + 2 * t)) for i, (v, t) in enumerate(zip(x, y))]
    return ml.written_evenly(spark.createDataFrame(rows, ["id", "features", "is_fraud", "weight"]), "id")


def scores(model, rows):
    got = model.transform(rows).select("id", vector_to_array("probability")[1].alias("p")).orderBy("id").toPandas()
    return got["p"].to_numpy()


#: Nothing is drawn: the trees are those of Spark.
FIXED = {
    "rf": lambda: ml.rf(numTrees=1, maxDepth=6, featureSubsetStrategy="all", minInstancesPerNode=3, bootstrap=False),
    "gbt": lambda: ml.gbt(maxIter=4, maxDepth=4, featureSubsetStrategy="all", subsamplingRate=1.0, stepSize=0.3, minInstancesPerNode=2),
}


@pytest.mark.parametrize("kind", FIXED)
@pytest.mark.parametrize("way", ["in one task", "by jobs", "side by side"])
def test_without_draws_the_model_is_sparks(monkeypatch, vectors, kind, way):
    if way != "in one task":
        monkeypatch.setattr(trees, "LOCAL_BYTES", 0)
        monkeypatch.setattr(trees, "DRIVER_BYTES", 0)
    classifier = FIXED[kind]()
    want, got = classifier.fit(vectors), trees.fit(classifier, vectors, fits=8 if way == "side by side" else 1)
    assert type(got) is type(want) and got.totalNumNodes == want.totalNumNodes and got.numFeatures == want.numFeatures
    assert scores(got, vectors) == pytest.approx(scores(want, vectors), abs=1e-9)
    assert {p.name: v for p, v in got.extractParamMap().items()} == {p.name: v for p, v in want.extractParamMap().items()}


DRAWN = {"rf": lambda seed: ml.rf(numTrees=16, maxDepth=5, seed=seed), "gbt": lambda seed: ml.gbt(maxIter=8, maxDepth=3, stepSize=0.2, seed=seed)}


@pytest.mark.parametrize("kind", DRAWN)
def test_with_draws_the_model_is_alike(monkeypatch, vectors, kind):
    y = vectors.orderBy("id").toPandas()["is_fraud"].to_numpy()

    def loss(p):
        return -np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-9, 1)).mean()

    own = scores(trees.fit(DRAWN[kind](42), vectors), vectors)
    assert loss(own) == pytest.approx(loss(scores(DRAWN[kind](42).fit(vectors), vectors)), rel=0.08)
    assert not np.array_equal(own, scores(trees.fit(DRAWN[kind](43), vectors), vectors))
    for name, value in (("LOCAL_BYTES", 0), ("PASS_BYTES", 200_000), ("PART_BYTES", 20_000)):  # the same draws in many passes and parts
        monkeypatch.setattr(trees, name, value)
    assert scores(trees.fit(DRAWN[kind](42), vectors), vectors) == pytest.approx(own, abs=1e-9)


def test_poisson_draws():
    block = trees.Block(0, 200_000, np.empty(0, np.uint8), np.empty(0, np.uint8))
    n = trees.drawn(42, 3, block, 1.0, True)
    assert n.mean() == pytest.approx(1, abs=0.01) and n.var() == pytest.approx(1, abs=0.02)
    assert trees.drawn(42, 3, block, 0.8, False).mean() == pytest.approx(0.8, abs=0.005)
    assert not np.array_equal(n, trees.drawn(42, 4, block, 1.0, True))


@pytest.mark.parametrize("kind", ["rf", "gbt"])
def test_rows_of_one_task_need_no_job_for_each_level(spark, vectors, kind):
    """Fits of folds and searches: their number of jobs does not depend on trees and levels."""
    fold = ml.Fold(0, vectors.select("is_fraud", "features", "weight"), vectors.select("is_fraud", "features", F.col("id").cast("string").alias("trans_num")))
    classifier = ml.gbt(maxIter=12, maxDepth=5) if kind == "gbt" else ml.rf(numTrees=12, maxDepth=9)
    tracker, before = spark.sparkContext.statusTracker(), None
    before = len(tracker.getJobIdsForGroup())
    saved, _ = ml.fold_scores([fold], {kind: classifier}, parallelism=1)
    assert saved.count() == 1500
    assert len(tracker.getJobIdsForGroup()) - before < 24


def test_rows_of_one_class_are_left_to_spark(vectors):
    assert trees.binned(vectors.where("is_fraud = 0"), ml.rf()) is None


def test_gaps_are_refused(vectors):
    gap = vectors.sparkSession.createDataFrame([(Vectors.dense([1.0, float("nan")]), 1, 1.0), (Vectors.dense([1.0, 2.0]), 0, 1.0)], ["features", "is_fraud", "weight"])
    with pytest.raises(Exception, match="NaN"):
        trees.fit(ml.rf(numTrees=2), gap)
