from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cardwatch.operators import summaries as S
from cardwatch.operators.versions import latest_predictions

COLUMNS = "id string, trans_num string, trans_date_trans_time timestamp, amt double, merchant string, category string, risk_score decimal(12,6), prediction boolean, created_at timestamp"


def t(day, hour=0, minute=0, second=0):
    return datetime(2024, 1, day, hour, minute, second)


@pytest.fixture(scope="module")
def pred(spark):
    from decimal import Decimal as D

    rows = [
        ("1", "a", t(1), 10.0, "m", "c", D("0.9"), True, t(1)),
        ("2", "a", t(1), 10.0, "m", "c", D("0.1"), False, t(2)),
        ("3", "b", t(2, 23, 59, 59), 250.0, "n", "c", D("1.0"), True, t(1)),
        ("4", "b2", t(3), 50.0, " ", "d", D("0"), False, t(1)),
        ("5", "c", None, None, None, None, D("1.0"), True, t(1)),
    ]
    return spark.createDataFrame(rows, COLUMNS)


def test_latest_version_breaks_ties_by_id(spark, pred):
    tied = pred.where("trans_num = 'a'").withColumn("created_at", F.lit(t(5)))
    assert latest_predictions(tied).first()["id"] == "2"


def test_superseded_rows_count_only_by_default(pred):
    mine = pred.where("trans_num = 'a'")
    assert (S.kpis(mine).first()["total_transactions"], S.kpis(mine).first()["fraud_count"]) == (2, 1)
    latest = S.kpis(mine, latest_only=True).first()
    assert (latest["total_transactions"], latest["fraud_count"]) == (1, 0)


def test_kpis_of_nothing_are_zero(pred):
    assert set(S.kpis(pred, min_risk_score=5).first()) == {0.0}


def test_unknown_time_comes_first_among_equal_risk(pred):
    got = [r["trans_num"] for r in S.recent_transactions(pred).collect()]
    assert got == ["c", "b", "a", "b2"]


@pytest.mark.parametrize("offset", [-3, 0, 7, 180, 395, 400, 1000])
def test_deep_pages_equal_near_ones(spark, offset):
    rows = spark.range(400).select(F.concat(F.lit("t"), "id").alias("id"), F.when(F.col("id") % 9 != 0, F.col("id") % 5).alias("v"))
    order = [F.col("v").desc_nulls_first(), F.col("id").asc()]
    near = S.rank_page(rows, order, 30, offset).collect()
    deep = S.rank_page(rows, order, 30, offset, rows_per_task=1).collect()
    assert sorted(map(tuple, deep)) == sorted(map(tuple, near))
    assert [r["rank"] for r in deep] == list(range(max(offset, 0) + 1, min(400, max(offset, 0) + 30) + 1))


def test_deep_page_ranks_only_its_ranges(spark):
    page = S.rank_page(spark.range(4000), [F.col("id").desc()], 10, 3000, rows_per_task=1)
    assert page.count() == 10
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(__range" in plan and "SinglePartition" not in plan
    assert S.rank_page(spark.range(0), [F.col("id").desc()], 10, 3000, rows_per_task=1).count() == 0


def test_page_keeps_global_rank(pred):
    page = S.recent_transactions(pred, limit=2, offset=1).collect()
    assert [(r["trans_num"], r["rank"]) for r in page] == [("b", 2), ("a", 3)]


def test_end_date_is_inclusive(pred):
    got = {r["trans_num"] for r in S.recent_transactions(pred, end_date="2024-01-02").collect()}
    assert got == {"a", "b"}


def test_empty_text_is_no_filter(pred):
    assert S.recent_transactions(pred, merchant="", category="").count() == 4


def test_filter_applies_after_choosing_versions(pred):
    # The older version of "a" has a high risk; it must not come back.
    assert "a" not in {r["trans_num"] for r in S.recent_transactions(pred, min_risk_score=0.5).collect()}


def test_blank_values_are_not_listed(pred):
    assert [r[0] for r in S.unique_merchants(pred).collect()] == ["m", "n"]


def test_risk_buckets_clamp_both_ends(pred):
    got = {r["bucket_index"]: (r["risk_score_bucket"], r["count"]) for r in S.risk_distribution(pred).collect()}
    assert got == {0: ("0.0 - 0.1", 1), 1: ("0.1 - 0.2", 1), 9: ("0.9 - 1.0", 2)}


def test_only_the_lowest_amount_buckets(spark, pred):
    many = spark.range(60).select(
        F.col("id").cast("string").alias("trans_num"), F.col("id").cast("string"), (F.col("id") * 100.0).alias("amt"),
        F.lit(False).alias("prediction"), F.lit(0.5).alias("risk_score"), F.lit(t(1)).alias("created_at"),
    )
    got = [r["bucket_start"] for r in S.amount_bucket_summary(many).collect()]
    assert got == [i * 100.0 for i in range(24)]


def test_category_order_and_figures(pred):
    assert [r["category"] for r in S.category_summary(pred).collect()] == [None, "c", "d"]
    rows = {r["category"]: r for r in S.category_summary(pred).collect()}
    assert rows["c"]["transaction_count"] == 2 and rows["c"]["fraud_count"] == 1 and rows["c"]["total_amount"] == 260.0


def test_chart_catalogue_is_complete(pred):
    assert len(S.CHARTS) == 13
    for name in S.CHARTS:
        assert len(S.chart(pred, name).columns) == 2


def test_detail_has_all_stored_fields(pred):
    row = S.transaction_detail(pred, "a").first()
    assert row["prediction"] == "legit" and row["prediction_raw"] is False


def test_partial_top_row_before_the_shuffle(pred):
    plan = latest_predictions(pred)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
