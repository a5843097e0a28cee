"""Flags and scores of the newest versions come from the same rows, joined and shuffled once."""

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from cardwatch import bindings
from cardwatch.operators.versions import latest_predictions
from catalog.registry import EVALUATED_BY, Tables


@contextmanager
def settings(spark, **values):
    names = {f"spark.sql.{k.replace('__', '.')}": v for k, v in values.items()}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_order_lines_are_shuffled_once(spark, tiny):
    with settings(spark, adaptive__enabled="false", autoBroadcastJoinThreshold="-1"):
        frame = Tables(spark, tiny).evaluated.select("is_fraud", "risk_score")
        plan = frame._jdf.queryExecution().executedPlan().toString().splitlines()
    lines = [row for row in plan if re.search(r"Exchange hashpartitioning\(l_orderkey", row)]
    assert len([row for row in lines if "ReusedExchange" not in row]) == 1


@pytest.mark.parametrize("lines_per_task", [1_000_000, 200])
def test_parts_of_bounded_size_hold_the_same_versions(spark, tiny, monkeypatch, lines_per_task):
    monkeypatch.setattr(bindings, "LINES_PER_TASK", lines_per_task)
    pred = bindings.predictions(spark, tiny, by_order=True)
    if lines_per_task == 200:
        dealt = pred.select("order_id", F.spark_partition_id().alias("part"))
        assert dealt.distinct().groupBy("order_id").count().where("count > 1").isEmpty()
        assert dealt.groupBy("part").count().agg(F.max("count")).first()[0] < 1_000
    with settings(spark, autoBroadcastJoinThreshold="-1"):
        got = latest_predictions(pred, **EVALUATED_BY).drop("order_id")
        want = latest_predictions(bindings.predictions(spark, tiny), EVALUATED_BY["newest"])
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_alike_versions_give_flag_and_score_of_one_row(spark):
    rows = [("a", 1, 9, 9, 9, 9, 0.1, "R"), ("a", 1, 9, 9, 9, 9, 0.7, "N"), ("a", 1, 8, 9, 9, 9, 0.9, "R"), ("b", 2, 5, 5, 5, 5, 0.2, "R")]
    schema = "trans_num string, order_id long, created_at int, id1 int, id2 int, id3 int, risk_score double, return_flag string"
    for data in (rows, rows[::-1]):
        newest = latest_predictions(spark.createDataFrame(data, schema).repartition(1), **EVALUATED_BY)
        assert sorted(tuple(r) for r in newest.select("trans_num", "risk_score", "return_flag").collect()) == [("a", 0.7, "N"), ("b", 0.2, "R")]
