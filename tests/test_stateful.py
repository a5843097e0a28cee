"""The features a stream builds from keyed state equal those of the whole table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardwatch import bindings
from cardwatch.operators.features import FEATURES, build_features
from cardwatch.schemas import TS
from cardwatch.streaming import replay, stateful

EXACT = [c for c in stateful.STREAMED if c[:2] != "A5"]


def landed_in_order(tx, cuts, folder):
    """Hand over the rows range by range of event time."""
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:]):
        part = tx
        if low is not None:
            part = part.where(F.col(TS) >= F.lit(low).cast("timestamp"))
        if high is not None:
            part = part.where(F.col(TS) < F.lit(high).cast("timestamp"))
        part.repartition(3, "trans_num").write.mode("append").parquet(folder)
        yield


def stream_and_table(spark, tx, cuts, tmp_path):
    folder, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for _ in landed_in_order(tx, cuts, folder):
        stream = replay.stream_transactions(spark, folder, tx.schema, max_files=1_000)
        stateful.build_available(stream, sink, checkpoint, 30.0)
    return spark.read.parquet(sink), build_features(tx, amt_prior=30.0)


def compare(got, want, columns):
    got = got.select("trans_num", *columns).toPandas().set_index("trans_num").sort_index()
    want = want.select("trans_num", *columns).toPandas().set_index("trans_num").sort_index()
    assert list(got.index) == list(want.index)
    for c in columns:
        if got[c].dtype == object:
            assert list(got[c]) == list(want[c]), c
        else:
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-6, atol=1e-7, err_msg=c)


def test_stream_equals_table(spark, tiny, tmp_path):
    tx = bindings.transactions(spark, tiny)
    got, want = stream_and_table(spark, tx, ["2024-01-09", "2024-01-20 12:00:00"], tmp_path)
    assert got.columns == [c for c in want.columns if c != stateful.UNBOUNDED]
    compare(got, want, [*EXACT, "location_key", "merchant", "is_fraud"])


def test_hot_card_equal_amounts_gaps_and_nulls(spark, tmp_path):
    """One card with most rows, equal times, equal amounts within and beyond a day, missing merchant, place and extras."""
    rows = []
    for k in range(160):
        card = 1 if k % 5 else 2 + k % 3
        second = 1_704_067_200 + (k // 2) * [1, 9, 59, 3_000, 40_000][k // 32]
        merchant = None if k % 7 == 0 else f"m{k % 3}"
        city = None if k % 11 == 0 else f"c{k % 4}"
        rows.append((f"t{k:03}", card, second, float(k % 4), merchant, city, "s", None if k % 2 else 2**60 + k, k % 3 == 0))
    schema = "trans_num string, cc_num long, sec long, amt double, merchant string, city string, state string, big long, odd boolean"
    tx = spark.createDataFrame(rows, schema).withColumn(TS, F.timestamp_seconds("sec")).drop("sec")
    times = [r[0] for r in tx.select(F.date_format(TS, "yyyy-MM-dd HH:mm:ss")).distinct().collect()]
    cuts = sorted(times)[10::26]
    tx.write.parquet(str(tmp_path / "tx"))
    got, want = stream_and_table(spark, spark.read.parquet(str(tmp_path / "tx")), cuts, tmp_path)
    compare(got, want, [*EXACT, "big", "odd", "merchant", "location_city"])


def test_left_out_is_named():
    assert [f for f in FEATURES if f not in stateful.STREAMED] == [stateful.UNBOUNDED]


@pytest.mark.parametrize("cut", [1, 4, 7])
def test_moments_do_not_depend_on_the_cut(cut):
    values = np.array([1e6, 1e6, 3.0, 5.5, 1e6, 0.1, 7.0, 7.0, 2.5])
    whole, end = stateful.prior_moments(values, None)
    a, state = stateful.prior_moments(values[:cut], None)
    b, last = stateful.prior_moments(values[cut:], state)
    for k in whole:
        np.testing.assert_allclose(np.concatenate([a[k], b[k]]), whole[k])
    np.testing.assert_allclose(last, end)
    equal, _ = stateful.prior_moments(np.full(5, 0.1), None)
    assert list(equal["std"][2:]) == [0.0] * 3 and list(equal["mean"][1:]) == [0.1] * 4
