import numpy as np
import pytest
from pyspark.sql import functions as F

from cardwatch.operators import ml
from cardwatch.operators.knn import knn_join


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    data = rng.integers(0, 6, size=(120, 4)).astype(float)
    rows = [(i, v.tolist(), int(i % 6 == 0)) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, "vec_id long, v array<double>, is_fraud int"), data


def brute(data, left, right, k, skip_self):
    out = {}
    for i in left:
        near = sorted((float(np.sqrt(((data[i] - data[j]) ** 2).sum())), j) for j in right if not (skip_self and i == j))[:k]
        out[i] = [j for _, j in near]
    return out


@pytest.mark.parametrize("piece_bytes", [1 << 20, 200])
@pytest.mark.parametrize("skip_self", [False, True])
def test_knn_matches_brute_force(vectors, piece_bytes, skip_self):
    df, data = vectors
    left = df if skip_self else df.where("is_fraud = 0")
    right = df if skip_self else df.where("is_fraud = 1")
    got = {}
    for r in knn_join(left, right, "v", 3, exclude_self=skip_self, piece_bytes=piece_bytes).orderBy("left_id", "rank").collect():
        got.setdefault(r["left_id"], []).append(r["neighbour_id"])
    ids = lambda f: [r["vec_id"] for r in f.select("vec_id").collect()]
    assert got == brute(data, ids(left), ids(right), 3, skip_self)


@pytest.mark.parametrize("piece_bytes", [1 << 20, 400])
def test_equal_distances_go_to_the_smaller_id(spark, piece_bytes):
    same = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    found = knn_join(same.where("vec_id >= 390"), same, "v", 5, piece_bytes=piece_bytes).collect()
    assert {(r["left_id"], r["neighbour_id"], r["rank"]) for r in found} == {(i, j, j + 1) for i in range(390, 400) for j in range(5)}


@pytest.mark.parametrize("piece_bytes", [1 << 20, 400])
def test_vectors_far_from_the_origin(spark, piece_bytes):
    data = np.random.default_rng(3).normal(0, 1, (60, 4)) + 1e6
    data[0] += 1e5  # one far point does not blur the others
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, v array<double>")
    got = {}
    for r in knn_join(df, df, "v", 3, exclude_self=True, piece_bytes=piece_bytes).orderBy("left_id", "rank").collect():
        got.setdefault(r["left_id"], []).append(r["neighbour_id"])
    assert got == brute(data, range(60), range(60), 3, True)


def clustered(spark, n=1500):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 50, (30, 6))
    data = centres[rng.integers(0, 30, n)] + rng.normal(0, 0.5, (n, 6))
    data[: n // 3] = centres[0] + rng.normal(0, 0.5, (n // 3, 6))  # a third of all points in one cluster
    data[-20:] = data[0]  # copies
    data[-1] *= 1e4
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, v array<double>"), data


@pytest.mark.parametrize("piece_bytes", [1 << 20, 3000])
@pytest.mark.parametrize("max_pivots", [1, 512])
def test_pivots_change_no_neighbour(spark, piece_bytes, max_pivots):
    df, data = clustered(spark)
    some = df.where("vec_id % 7 = 0 or vec_id > 1480")
    got = {}
    for r in knn_join(some, df, "v", 4, exclude_self=True, piece_bytes=piece_bytes, max_pivots=max_pivots).orderBy("left_id", "rank").collect():
        got.setdefault(r["left_id"], []).append(r["neighbour_id"])
    assert got == brute(data, [r["vec_id"] for r in some.collect()], range(len(data)), 4, True)


def test_most_distances_are_not_measured(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 50, (40, 6))
    data = centres[np.arange(4000) % 40] + rng.normal(0, 0.5, (4000, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, v array<double>")
    measured = []
    assert knn_join(df, df, "v", 5, exclude_self=True, max_pivots=64, measured=measured).count() == 20_000
    pairs = sum(m.agg(F.sum("points")).first()[0] or 0 for m in measured)
    assert pairs < 0.1 * 4000 * 4000


def test_cells_out_of_reach_hold_no_neighbour():
    """The bounds against all distances, for vectors far from the origin and pivots close to each other."""
    from cardwatch.operators.knn import cells_within, distances

    rng = np.random.default_rng(8)
    for shift, spread in ((0, 1), (1e6, 1e-3), (1e7, 10)):
        points = rng.normal(0, spread, (300, 3)) + shift
        rows = rng.normal(0, spread, (50, 3)) + shift
        pivots = points[:20]
        cell = distances(points, pivots).argmin(1)
        far = distances(points, pivots).min(1)
        low = np.array([far[cell == c].min() for c in range(20)])
        high = np.array([far[cell == c].max() for c in range(20)])
        exact = distances(rows, points)
        limit = np.sort(exact, axis=1)[:, 3]
        inside = cells_within(distances(rows, pivots), limit, low, high, distances(pivots, pivots))
        for i in range(50):
            assert set(cell[exact[i] <= limit[i]]) <= set(np.flatnonzero(inside[i]))


def test_rows_without_a_vector_have_no_neighbours(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, None), (3, [2.0])], "vec_id long, v array<double>")
    got = {(r["left_id"], r["neighbour_id"]) for r in knn_join(df, df, "v", 2, exclude_self=True).collect()}
    assert got == {(1, 3), (3, 1)} and knn_join(df, df.limit(0), "v", 2).count() == 0


def test_codes_add_to_the_distance(spark):
    df = spark.createDataFrame([(1, [0.0], [1]), (2, [0.0], [2]), (3, [1.0], [1])], "vec_id long, v array<double>, c array<bigint>")
    got = {(r["left_id"], r["neighbour_id"]): r["distance"] for r in knn_join(df, df, "v", 2, exclude_self=True, codes="c", penalty=4.0).collect()}
    assert got[(1, 2)] == 2.0 and got[(1, 3)] == 1.0


def test_filter_without_minority_does_nothing(vectors):
    df, _ = vectors
    kept, summary = ml.near_minority_filter(df.withColumn("is_fraud", F.lit(0)), "v")
    assert kept.count() == 120 and summary.first()["dropped_majority"] == 0


def table(spark):
    return spark.range(300).select(
        F.col("id").cast("string").alias("trans_num"),
        (F.col("id") % 17 + F.when(F.col("id") % 10 == 0, 30).otherwise(0)).cast("double").alias("amt"),
        F.concat(F.lit("k"), (F.col("id") % 3).cast("string")).alias("category"),
        (F.col("id") % 10 == 0).cast("int").alias("is_fraud"),
    )


def test_oversampling_reaches_the_ratio_and_stays_inside(spark):
    out = ml.smote_nc(table(spark), ["amt"], ["category"], ratio=0.5)
    made = out.where(F.col("trans_num").startswith("syn_"))
    assert out.where("is_fraud = 1").count() == 135
    low, high = made.agg(F.min("amt"), F.max("amt")).first()
    assert 30 <= low and high <= 46
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, ml.smote_nc(table(spark), ["amt"], ["category"], ratio=0.5).collect()))


def test_splits_keep_the_ratio_and_repeat(spark):
    one = ml.stratified_split(table(spark), rows_per_slice=50)
    assert {(r["split"], r["is_fraud"]): r["count"] for r in one.groupBy("split", "is_fraud").count().collect()} == {
        ("test", 0): 54, ("test", 1): 6, ("train", 0): 216, ("train", 1): 24,
    }
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, ml.stratified_split(table(spark)).collect()))


def test_preprocessing(spark):
    train = spark.createDataFrame([(1.0, "b"), (3.0, "a"), (None, "a"), (8.0, None)], "x double, c string")
    assert [r["x"] for r in ml.impute_median(train, ["x"]).collect()] == [1.0, 3.0, 3.0, 8.0]
    assert [r["c"] for r in ml.impute_mode(train, ["c"]).collect()] == ["b", "a", "a", "a"]
    new = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string")
    assert sorted((r["c"]) for r in ml.ordinal_encode(train, ["c"], new).collect()) == [-1, -1, 0, 1]
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r["x"] for r in ml.standardize(flat, ["x"]).collect()] == [0.0, 0.0]
    assert [r["risk_score"] for r in ml.minmax_score(flat.withColumnRenamed("x", "raw_score")).collect()] == [0.0, 0.0]


def test_training_frame_refuses_and_drops(spark):
    with pytest.raises(ValueError):
        ml.training_frame(spark.range(1))
    data = spark.createDataFrame([("1",), (None,), ("x",)], "is_fraud string").withColumn("t", F.current_timestamp())
    out = ml.training_frame(data)
    assert out.columns == ["is_fraud"] and [r[0] for r in out.collect()] == [1, 0, 0]


def test_model_round_trip(spark, tmp_path):
    data = table(spark)
    model = ml.fit_rf(data, dict(numTrees=5, maxDepth=3))
    scored = ml.score_ranked(model, data, 0.5)
    assert scored.where("is_fraud = 1 and prediction").count() == 30
    assert scored.where("rank = 1").first()["is_fraud"] == 1
    ml.save_model(model, str(tmp_path / "m"), spark, rows=300, features=["amt", "category"])
    loaded, meta = ml.load_model(str(tmp_path / "m"), spark)
    assert meta["features"] == ["amt", "category"] and meta["rows"] == 300
    assert ml.score(loaded, data).where("prediction").count() == ml.score(model, data).where("prediction").count()
