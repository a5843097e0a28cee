"""The growing store: idempotent batches, the maintained newest table and the plans of both."""

import pytest
from pyspark.sql import functions as F

from cardwatch.operators.prediction_store import PredictionStore
from cardwatch.operators.versions import latest_predictions


def scored(spark, rows):
    """(id, amount, score) as scored rows."""
    df = spark.createDataFrame(rows, "trans_num string, amt double, risk_score double")
    return df.withColumn("prediction", (F.col("risk_score") >= 0.5).cast("int"))


@pytest.fixture
def store(spark, tmp_path):
    return PredictionStore(spark, str(tmp_path / "store"), buckets=4)


def content(df):
    return sorted((r["trans_num"], r["amt"], float(r["risk_score"])) for r in df.collect())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


FIRST = [(f"t{i}", float(i), i / 100) for i in range(60)]
SECOND = [(f"t{i}", float(i) + 0.5, 0.9) for i in range(40, 90)]


def test_batches_and_a_repeat(spark, store):
    one, fresh = store.persist(scored(spark, FIRST), "m", 0.5, "2024-01-01")
    assert fresh.count() == 60
    two, fresh = store.persist(scored(spark, SECOND), "m", 0.5, "2024-01-02")
    assert content(fresh) == sorted((t, a, s) for t, a, s in SECOND) and one != two
    again, fresh = store.persist(scored(spark, [(t, a, 0.1) for t, a, _ in FIRST]), "m", 0.5, "2024-01-03")
    assert again == one and fresh.count() == 0
    assert store.versions().count() == 110 and store.batches().count() == 2
    assert {str(r["created_at"])[:10] for r in store.batches().collect()} == {"2024-01-01", "2024-01-02"}


def test_newest_table_equals_the_window(spark, store):
    assert store.newest().count() == 0 and store.versions().count() == 0 and store.batches().count() == 0
    store.persist(scored(spark, FIRST), "m", 0.5, "2024-01-01")
    store.merge()
    store.persist(scored(spark, SECOND), "m", 0.5, "2024-01-02")
    store.persist(scored(spark, [("t3", 3.0, 0.7), ("t95", 1.0, 0.2)]), "m", 0.5, "2023-12-31")  # older than what is stored
    store.persist(scored(spark, [("t4", 4.0, 0.7), ("t95", 2.0, 0.3)]), "m", 0.5, "2024-01-02")
    assert len(store.pending()) == 3
    store.merge()
    assert store.pending() == []
    want = latest_predictions(store.versions())
    assert content(store.newest()) == content(want)
    assert dict((t, s) for t, _, s in content(store.newest()))["t95"] == 0.3
    for k in range(3):  # older generations go, the newest stays readable
        store.persist(scored(spark, [("t1", float(k), 0.01 * k)]), "m", 0.5, f"2024-02-0{k + 1}")
        store.merge()
    assert len(store.files.names("newest")) == 2
    assert content(store.newest()) == content(latest_predictions(store.versions()))
    store.merge()
    assert len(store.files.names("newest")) == 2


def test_newest_versions_are_a_plain_scan(spark, store):
    store.persist(scored(spark, FIRST), "m", 0.5, "2024-01-01")
    store.merge()
    plan = plan_of(store.newest())
    assert "Window" not in plan and "Exchange" not in plan and "FileScan" in plan


def test_only_pending_rows_are_shuffled(spark, store):
    store.persist(scored(spark, FIRST), "m", 0.5, "2024-01-01")
    store.merge()
    store.persist(scored(spark, SECOND), "m", 0.5, "2024-01-02")
    plan = plan_of(store.merging())
    assert plan.count("Exchange") == 1 and plan.count("SortMergeJoin") == 1
    assert "Window" not in plan and "Bucketed: true" in plan
    store.merge()
    assert spark.catalog.listTables() == [] or not any(t.name.startswith("newest_") for t in spark.catalog.listTables())


def test_one_batch_is_one_partition(spark, store):
    one, _ = store.persist(scored(spark, FIRST), "m", 0.5, "2024-01-01")
    store.persist(scored(spark, SECOND), "m", 0.5, "2024-01-02")
    part = store.versions().where(F.col("batch_id") == one)
    assert part.count() == 60
    scan = next(line for line in plan_of(part).splitlines() if "FileScan" in line)
    assert f"(batch_id" in scan.split("PartitionFilters:")[1] and one[:20] in scan


def test_a_half_written_batch_or_generation_is_written_again(spark, store):
    one, _ = store.persist(scored(spark, FIRST), "m", 0.5, "2024-01-01")
    store.files.remove(f"versions/batch_id={one}/_SUCCESS")  # as if the driver had been lost
    store.merge()
    assert store.newest().count() == 0
    assert store.persist(scored(spark, FIRST), "m", 0.5, "2024-01-01")[1].count() == 60
    store.merge()
    assert store.newest().count() == 60


def test_another_session_opens_the_store(spark, store):
    store.persist(scored(spark, FIRST), "m", 0.5, "2024-01-01")
    store.merge()
    other = PredictionStore(spark.newSession(), store.folder, buckets=4)
    assert other.newest().count() == 60
    other.persist(scored(spark, SECOND), "m", 0.5, "2024-01-02")
    other.merge()
    assert content(store.newest()) == content(latest_predictions(store.versions()))


def test_repeated_transactions_and_missing_columns(spark, store):
    _, fresh = store.persist(scored(spark, [("a", 1.0, 0.5), ("a", 1.0, 0.6), ("b", None, 0.5)]), "m", 0.5)
    assert fresh.count() == 2
    with pytest.raises(ValueError, match="risk_score"):
        store.persist(scored(spark, FIRST).drop("risk_score"), "m", 0.5)
    empty = store.persist(scored(spark, []), "m", 0.5)
    assert empty[1].count() == 0
