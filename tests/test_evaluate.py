import pytest

from cardwatch.operators import evaluate as X


def frame(spark, scores, labels, threshold=0.5):
    rows = [(f"t{i}", y, s, s >= threshold) for i, (s, y) in enumerate(zip(scores, labels))]
    return spark.createDataFrame(rows, "trans_num string, is_fraud int, risk_score double, prediction boolean")


def areas(df):
    r = X.ranking_metrics(df).first()
    return r["roc_auc"], r["average_precision"], r["pr_auc_trapezoid"]


def test_all_scores_tied(spark):
    assert areas(frame(spark, [0.5] * 3, [1, 0, 1])) == pytest.approx((0.5, 2 / 3, 5 / 6))


def test_perfect_ranking(spark):
    assert areas(frame(spark, [0.9, 0.8, 0.1], [1, 1, 0])) == pytest.approx((1, 1, 1))


def test_one_class_has_no_area(spark):
    assert areas(frame(spark, [0.9, 0.1], [1, 1])) == (None, None, None)


def test_empty_input(spark):
    empty = frame(spark, [0.5], [1]).where("false")
    assert tuple(X.prf(empty).first()) == (None, None, None)
    assert X.metrics_row(empty).first()["rows_joined"] == 0


def test_zero_division_is_zero(spark):
    r = X.prf(frame(spark, [0.1, 0.2], [1, 0])).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)


def test_slices_do_not_change_metrics(spark, tiny):
    from cardwatch import bindings
    from pyspark.sql import functions as F

    tx = bindings.transactions(spark, tiny)
    scored = tx.withColumns({"risk_score": F.col("amt") / 500, "prediction": F.col("amt") > 100})
    assert tuple(X.metrics_row(scored).first()) == pytest.approx(tuple(X.metrics_row(scored, rows_per_slice=37).first()))
    assert X.lift_table(scored, rows_per_slice=37).collect() == X.lift_table(scored).collect()


def test_lift_of_one_row(spark):
    r = X.lift_table(frame(spark, [0.5], [1])).first()
    assert (r["decile"], r["lift"]) == (1, 1.0)


def test_batch_filter_comes_before_the_version(spark):
    pred = spark.createDataFrame(
        [("1", "x", "a", True, 0.9, "2024-01-01"), ("2", "y", "a", False, 0.1, "2024-01-02")],
        "id string, batch_id string, trans_num string, prediction boolean, risk_score double, created_at string",
    )
    tx = spark.createDataFrame([("a", 1)], "trans_num string, is_fraud int")
    assert X.evaluation_frame(tx, pred, "x").first()["prediction"] is True
    assert X.evaluation_frame(tx, pred).first()["prediction"] is False
