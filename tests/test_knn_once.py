"""A search deals its visits out once, in the numbers' own precision, and the near-minority filter searches once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardwatch.operators import ml
from cardwatch.operators.knn import knn_join


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)], int(i % 7 == 0)) for i in range(400)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, is_minority int")


def test_visits_meet_the_groups_by_a_broadcast(vectors):
    pairs = knn_join(vectors.where("is_minority = 0"), vectors.where("is_minority = 1"), "embedding", 3)
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [cell" not in plan and "FlatMapCoGroups" in plan
    assert "as array<double>" not in plan


def test_single_precision_gives_the_same_neighbours(vectors):
    wide = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    got, same = (
        knn_join(v.where("is_minority = 0"), w.where("is_minority = 1"), "embedding", 3).orderBy("left_id", "rank").collect()
        for v, w in ((vectors, wide), (wide, vectors))
    )
    assert got == same and len(got) == 3 * 342


def test_the_filter_searches_once(vectors):
    kept, summary = ml.near_minority_filter(vectors, "embedding", "is_minority")
    assert "FlatMapCoGroups" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert kept.count() == 400 - summary.first()["dropped_majority"]
