"""Replay in event order: batch sizes, the bound, restarts and repeated batches; live sliding counts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cardwatch.streaming import ordered, replay

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Several files whose events overlap in time, some at the same instant, some without a time."""
    folder = str(tmp_path_factory.mktemp("events"))
    rng = random.Random(3)
    for part in range(4):
        rows = [(f"t{part}{i:03d}", rng.randrange(3), START + timedelta(seconds=60 * rng.randrange(400)), 1.0 * i) for i in range(60)]
        rows.append((f"n{part}", 1, None, 0.0))
        spark.createDataFrame(rows, "trans_num string, cc_num long, trans_date_trans_time timestamp, amt double").write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def log_of(events, tmp_path):
    folder = str(tmp_path / "log")
    assert ordered.write_log(events, folder, chunk_rows=50, rows_per_slice=40) == 240
    return folder


def wanted(events):
    timed = events.where("trans_date_trans_time is not null").collect()
    return [r["trans_num"] for r in sorted(timed, key=lambda r: (r["trans_date_trans_time"], r["trans_num"]))]


def collected(got):
    def handle(rows, number):
        got[number] = [r["trans_num"] for r in rows.orderBy("pos").collect()]

    return handle


def test_batches_in_event_order(spark, events, tmp_path):
    got = {}
    end = ordered.replay(spark, log_of(events, tmp_path), collected(got), str(tmp_path / "c"), 70, chunk_rows=50)
    assert [len(got[k]) for k in sorted(got)] == [70, 70, 70, 30] and end == 240
    assert sum((got[k] for k in sorted(got)), []) == wanted(events)


def test_bound_and_restart(spark, events, tmp_path):
    log, checkpoint, got = log_of(events, tmp_path), str(tmp_path / "c"), {}
    ordered.replay(spark, log, collected(got), checkpoint, 50, max_batches=2, chunk_rows=50)
    assert sorted(got) == [0, 1] and sum(got.values(), []) == wanted(events)[:100]
    ordered.replay(spark, log, collected(got), checkpoint, 50, max_batches=2, chunk_rows=50)
    assert sorted(got) == [0, 1]
    ordered.replay(spark, log, collected(got), checkpoint, 50, max_batches=4, chunk_rows=50)
    assert sorted(got) == [0, 1, 2, 3] and sum((got[k] for k in sorted(got)), []) == wanted(events)[:200]


def test_a_failed_batch_comes_again_with_the_same_rows(spark, events, tmp_path):
    log, checkpoint, got, seen = log_of(events, tmp_path), str(tmp_path / "c"), {}, []

    def failing(rows, number):
        if number == 1:
            seen.append([r["trans_num"] for r in rows.orderBy("pos").collect()])
            raise RuntimeError("lost")
        collected(got)(rows, number)

    with pytest.raises(Exception, match="lost"):
        ordered.replay(spark, log, failing, checkpoint, 100, chunk_rows=50)
    ordered.replay(spark, log, collected(got), checkpoint, 100, chunk_rows=50)
    assert got[1] == seen[0] and sum((got[k] for k in sorted(got)), []) == wanted(events)


def test_nothing_to_replay(spark, events, tmp_path):
    folder, got = str(tmp_path / "log"), {}
    assert ordered.write_log(events.where("trans_date_trans_time is null"), folder) == 0
    with pytest.raises(ValueError):
        ordered.Positions({"rows": "1", "batch_rows": "0"}).streamReader(None)
    assert got == {}


@pytest.mark.parametrize("window,slide", [("2 hours", "1 hour"), ("90 minutes", "1 hour"), ("1 hour", "1 hour")])
def test_live_sliding_counts(spark, events, tmp_path, window, slide):
    source = str(tmp_path / "in")
    timed = events.where("trans_date_trans_time is not null")
    timed.repartitionByRange(3, "trans_date_trans_time").write.parquet(source)
    stream = replay.stream_transactions(spark, source, timed.schema)
    live = replay.live_card_velocity(stream, str(tmp_path / "s"), str(tmp_path / "c"), window, slide, "12 hours")
    plain = timed.groupBy(F.window("trans_date_trans_time", window, slide).alias("w"), "cc_num").count()
    want = sorted(map(tuple, plain.select("w.start", "w.end", "cc_num", "count").collect()))
    assert sorted(map(tuple, live.collect())) == want
    assert sorted(map(tuple, replay.card_velocity(timed, window, slide).collect())) == want
