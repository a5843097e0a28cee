"""Folds prepared once, benchmark and search: figures against plain recomputations from the saved scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardwatch.operators import ml
from cardwatch.operators.evaluate import average_precision, confusion, evaluate_model, grouped_average_precision

SPACES = {
    "gbt": {"maxIter": [2, 4], "maxDepth": [2, 3], "stepSize": [0.1, 0.3], "subsamplingRate": [1.0], "featureSubsetStrategy": ["all"]},
    "rf": {"numTrees": [3, 5], "maxDepth": [2, 4]},
}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        x, text = float(rng.normal()), rng.choice(["a", "b", "c", None])
        y = int(x + (text == "a") + rng.normal() * 0.7 > 1.2)
        rows.append((f"t{i:03d}", x if i % 9 else None, None if text is None else str(text), y))
    return spark.createDataFrame(rows, "trans_num string, x double, text string, is_fraud int")


@pytest.fixture(scope="module")
def folded(table):
    return ml.stratified_folds(table, k=2)


def plain_average_precision(scores, labels):
    total, hits, seen, gained = sum(labels), 0, 0, 0.0
    for s in sorted(set(scores), reverse=True):
        here = [y for x, y in zip(scores, labels) if x == s]
        hits, seen = hits + sum(here), seen + len(here)
        gained += sum(here) * hits / seen
    return gained / total


def test_preparation_is_fitted_on_the_training_rows_only(spark, folded):
    for fold in ml.prepared_folds(folded):
        train = folded.where(F.col("fold") != fold.name)
        middle = train.select(F.percentile("x", 0.5)).first()[0]  # an odd number of values: the imputer's median is one of them
        filled = {r["features"][0] for r in fold.train.collect()}
        values = sorted(r["x"] for r in train.where("x is not null").collect())
        missing = filled - set(values)
        assert not missing or len(missing) == 1 and abs(missing.pop() - middle) < max(np.diff(values))
        weights = {r["is_fraud"]: r["weight"] for r in fold.train.collect()}
        sizes = {r["is_fraud"]: r["count"] for r in train.groupBy("is_fraud").count().collect()}
        n = sum(sizes.values())
        assert weights == {y: pytest.approx(n / (2 * size)) for y, size in sizes.items()}
        assert "weight" not in fold.test.columns and fold.test.count() == folded.where(F.col("fold") == fold.name).count()


def test_ranks_follow_from_the_saved_scores(folded):
    found = ml.search(folded, n_iter=3, spaces=SPACES)
    saved = found.scores.toPandas()
    assert sorted(found.draws) == [f"{k}-{i}" for k in ("gbt", "rf") for i in range(3)]
    assert len(saved) == 6 * folded.count()
    means = {}
    for name, part in saved.groupby("classifier"):
        folds = [plain_average_precision(list(f.risk_score), list(f.is_fraud)) for _, f in part.groupby("fold")]
        means[name] = np.mean(folds)
    for kind in SPACES:
        rows = {r["draw"]: r for r in found.ranking().where(F.col("kind") == kind).collect()}
        for name, r in rows.items():
            assert r["pr_auc_mean"] == pytest.approx(means[name])
        order = sorted(rows, key=lambda d: (-round(means[d], 12), int(d[-1])))
        assert [d for d, _ in sorted(rows.items(), key=lambda x: x[1]["rank"])] == order
    assert ml.draws_from(SPACES["rf"], 4, 1) == ml.draws_from(SPACES["rf"], 4, 1)


def test_search_returns_a_model_of_the_best_draw(table):
    best = ml.random_search(table, "rf", n_iter=2, folds=2, space=SPACES["rf"])
    scored = ml.score(best["best_model"], table).collect()
    assert best["best_params"] in ml.draws_from(SPACES["rf"], 2, 42) and 0 < best["best_cv_pr_auc"] <= 1
    assert len(scored) == 400 and all(0 <= r["risk_score"] <= 1 and r["prediction"] == (r["risk_score"] >= 0.5) for r in scored)


def test_benchmark(folded):
    got = {r["model"]: r for r in ml.cv_benchmark(folded, {"a": ml.rf(numTrees=3, maxDepth=2), "b": ml.gbt(maxIter=2, maxDepth=2)}).collect()}
    assert set(got) == {"a", "b"}
    for r in got.values():
        assert 0 < r["pr_auc_mean"] <= 1 and 0 < r["roc_auc_mean"] <= 1 and r["cv_fit_time_mean_sec"] > 0


@pytest.mark.parametrize("limit", [3, 10_000])
def test_average_precision_by_group(spark, limit):
    rng = np.random.default_rng(1)
    rows = [(g, float(rng.integers(0, 9)), int(rng.random() < 0.3)) for g in ("a", "b") for _ in range(80)] + [("c", 0.5, 0)]
    df = spark.createDataFrame(rows, "g string, risk_score double, is_fraud int")
    got = {r["g"]: r["average_precision"] for r in grouped_average_precision(df, ["g"], rows_per_slice=limit).collect()}
    assert got["c"] is None
    for g in ("a", "b"):
        assert got[g] == pytest.approx(plain_average_precision([s for x, s, _ in rows if x == g], [y for x, _, y in rows if x == g]))
        assert got[g] == pytest.approx(average_precision(df.where(F.col("g") == g)).first()[0])


def test_a_model_is_evaluated_from_one_scoring(table):
    model = ml.fit_rf(table, {"numTrees": 3, "maxDepth": 3})
    got = evaluate_model(model, table, threshold=0.4, name="rf")
    for name in ("confusion", "lift", "scored"):
        plan = got[name]._jdf.queryExecution().executedPlan().toString()
        assert "probability" not in plan and "scored-" in plan
    again = ml.score(model, table, 0.4)
    rows = {r["trans_num"]: r for r in got["scored"].collect()}
    assert all(rows[r["trans_num"]]["risk_score"] == r["risk_score"] and rows[r["trans_num"]]["prediction"] == r["prediction"] for r in again.collect())
    assert got["confusion"].first() == confusion(again).first()
    metrics = got["metrics"].first()
    assert metrics["pr_auc"] == pytest.approx(plain_average_precision([r["risk_score"] for r in rows.values()], [r["is_fraud"] for r in rows.values()]))
    assert sum(r["n"] for r in got["lift"].collect()) == 400
