from pyspark.sql import functions as F

from cardwatch import bindings
from cardwatch.streaming import replay


def rule(batch):
    return batch.withColumns({"risk_score": F.col("amt") / 500, "prediction": F.col("amt") >= 150})


def source(spark, tiny, tmp_path, parts=3):
    folder = str(tmp_path / "in")
    tx = bindings.transactions(spark, tiny)
    tx.repartition(parts, "trans_num").write.parquet(folder)
    return tx, replay.stream_transactions(spark, folder, tx.schema)


def test_scored_stream_equals_batch(spark, tiny, tmp_path):
    tx, stream = source(spark, tiny, tmp_path)
    sink = str(tmp_path / "sink")
    replay.score_stream(stream, rule, sink, str(tmp_path / "cp"))
    stored = spark.read.parquet(f"{sink}/predictions")
    assert stored.count() == tx.count() and stored.select("batch_id").distinct().count() == 3
    summary = replay.progress_table(spark, sink).first()
    assert (summary["iterations"], summary["rows_sent"], summary["failures"]) == (3, tx.count(), 0)


def test_repeated_micro_batch_stores_nothing_new(spark, tiny, tmp_path):
    tx = bindings.transactions(spark, tiny)
    sink = str(tmp_path / "sink")
    for _ in range(2):
        sent, stored = replay.persist_stream_batch(tx, 4, sink, rule)
        assert sent == stored == tx.count()


def test_failed_batch_is_logged_and_retried(spark, tiny, tmp_path):
    tx, stream = source(spark, tiny, tmp_path, 1)
    sink, cp = str(tmp_path / "sink"), str(tmp_path / "cp")
    calls = []

    def flaky(batch):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return rule(batch)

    try:
        replay.score_stream(stream, flaky, sink, cp)
    except Exception:
        pass
    replay.score_stream(stream, flaky, sink, cp)
    assert spark.read.parquet(f"{sink}/predictions").count() == tx.count()
    assert replay.progress_table(spark, sink).first()["failures"] == 1


def test_live_figures_equal_batch(spark, tiny, tmp_path):
    tx, stream = source(spark, tiny, tmp_path)
    live = replay.live_kpis(stream, str(tmp_path / "k"), str(tmp_path / "cp"), watermark="40 days")
    want = replay.stream_kpis(tx)
    pick = ["window_start", "transactions", "frauds"]
    assert sorted(map(tuple, live.select(*pick).collect())) == sorted(map(tuple, want.select(*pick).collect()))


def test_repeated_ids_are_dropped(spark, tiny, tmp_path):
    tx, stream = source(spark, tiny, tmp_path, 1)
    sink = str(tmp_path / "out")
    writer = replay.dedupe_stream(stream.unionByName(stream)).writeStream.format("parquet").option("path", sink)
    replay.run_available(writer.option("checkpointLocation", str(tmp_path / "cp")))
    assert spark.read.parquet(sink).count() == tx.count()
