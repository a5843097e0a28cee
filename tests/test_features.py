import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from brute_features import brute
from pyspark.sql import functions as F

from cardwatch import bindings
from cardwatch.operators.features import FEATURES, build_features, build_features_incremental

COLUMNS = "trans_num string, trans_date_trans_time timestamp, amt double, cc_num long, merchant string, city string, state string"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def frame(spark, rows):
    return spark.createDataFrame(
        [
            (r["trans_num"], START + timedelta(microseconds=r["us"] - int(START.timestamp() * 1e6)), r["amt"], r["cc_num"], r["merchant"], r["city"], r["state"])
            for r in rows
        ],
        COLUMNS,
    )


def row(num, seconds, amt, cc=1, merchant="A", city="X", state="S"):
    us = int(START.timestamp() * 1e6) + int(seconds * 1e6)
    hour = int(seconds // 3600) % 24
    return dict(trans_num=num, us=us, hour=hour, amt=float(amt), cc_num=cc, merchant=merchant, city=city, state=state)


def assert_same(built, expected):
    got = {r["trans_num"]: r for r in built.select("trans_num", *FEATURES).collect()}
    assert got.keys() == expected.keys()
    for num, want in expected.items():
        for name, value in want.items():
            have = got[num][name]
            if value is None:
                assert have is None, (num, name, have)
            elif name == "A5_amt_user_std_score" and value > 1e6:
                assert have == pytest.approx(value, rel=1e-3), (num, name)
            else:
                assert have == pytest.approx(value, rel=1e-7, abs=1e-6), (num, name, have, value)


def skewed_rows(n=400, hot_share=0.5, seed=5):
    """One card and one merchant hold about half of all rows; ties in time and amount."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        hot = rng.random() < hot_share
        out.append(
            row(
                f"t{i:05d}",
                rng.choice([rng.randrange(0, 200_000), rng.randrange(0, 400), 5000]) + rng.choice([0, 0.25]),
                rng.choice([5.0, 7.5, 9.99, round(rng.uniform(1, 300), 2)]),
                cc=7 if hot else rng.randrange(8, 14),
                merchant="big" if rng.random() < 0.5 else f"m{rng.randrange(5)}",
                city=f"c{rng.randrange(4)}",
                state=f"s{rng.randrange(2)}",
            )
        )
    return out


def test_golden_micro_table(spark):
    rows = [
        row("a", 0, 10, merchant="A", city="X"),
        row("b", 10, 10, merchant="A", city="Y"),
        row("c", 10, 30, merchant="B", city="X"),
        row("d", 86_400, 10, merchant="A", city="X"),
    ]
    built = {r["trans_num"]: r for r in build_features(frame(spark, rows)).collect()}
    d = built["d"]
    assert d["A4_identical_amt_cnt_24h"] == 2
    assert d["A5_amt_user_std_score"] == pytest.approx(0.577350, abs=1e-6)
    assert d["T1_time_diff_sec"] == 86390
    assert built["c"]["A5_amt_user_std_score"] == pytest.approx(2e10)
    assert built["c"]["T8_txn_count_10s"] == 1
    assert built["a"]["T1_time_diff_sec"] is None and built["a"]["T2_amt_time_angle"] == 0
    assert_same(build_features(frame(spark, rows)), brute(rows))


def test_matches_brute_force_on_events(spark, tiny):
    tx = bindings.transactions(spark, tiny)
    rows = [
        dict(r.asDict(), us=r["us"], hour=r["h"])
        for r in tx.withColumn("us", F.unix_micros("trans_date_trans_time")).withColumn("h", F.hour("trans_date_trans_time")).collect()
    ]
    assert_same(build_features(tx), brute(rows))


@pytest.mark.parametrize("limit", [10_000, 40])
def test_hot_cards_and_merchants(spark, limit):
    """Cutting hot histories into slices must not change any value."""
    rows = skewed_rows()
    assert_same(build_features(frame(spark, rows), rows_per_slice=limit), brute(rows))


@pytest.mark.parametrize("few", [True, False])
def test_hot_cards_with_a_table_of_cut_points(spark, few, monkeypatch):
    from cardwatch.plans import slices

    monkeypatch.setattr(slices, "CUTS_IN_PLAN", 2)
    monkeypatch.setattr(slices, "TOP_CUTS", 4)
    if not few:
        monkeypatch.setattr(slices, "BROADCAST_ROWS", 1)
        monkeypatch.setattr(slices, "COPIES", 3)
    rows = skewed_rows()
    assert_same(build_features(frame(spark, rows), rows_per_slice=20), brute(rows))


def test_one_card_at_one_instant(spark):
    """Even rows with equal card and time are cut, by transaction id."""
    rows = [row(f"x{i:04d}", 100, 1 + i % 3, merchant="M") for i in range(120)]
    assert_same(build_features(frame(spark, rows), rows_per_slice=25), brute(rows))


def test_no_look_ahead(spark):
    rows = skewed_rows(150)
    cut = sorted(r["us"] for r in rows)[100]
    early = [r for r in rows if r["us"] < cut]
    assert_same(
        build_features(frame(spark, rows), amt_prior=10.0).where(F.unix_micros("trans_date_trans_time") < cut),
        brute(early, prior=10.0),
    )


def test_merchant_tie_across_cards_and_null_places(spark):
    rows = [row("b", 5, 10, cc=1), row("a", 5, 20, cc=2), row("c", 9, 30, cc=3)]
    data = frame(spark, rows).withColumn("city", F.lit(None).cast("string")).withColumn("merchant", F.lit(None).cast("string"))
    built = {r["trans_num"]: r for r in build_features(data).collect()}
    assert built["a"]["A7_amt_diff_merchant_mean"] == 10.0
    assert built["c"]["A7_amt_diff_merchant_mean"] == 15.0
    assert built["a"]["location_key"] == "S|UNK" and built["a"]["merchant"] == "UNK"


def test_negative_pair_sum_is_floored(spark):
    rows = [row("a", 0, -5), row("b", 5, 3)]
    built = {r["trans_num"]: r for r in build_features(frame(spark, rows)).collect()}
    assert built["b"]["A11_user_merchant_cum_sum"] == 0.0


def test_bad_values_are_dropped(spark):
    data = spark.createDataFrame(
        [("a", "garbage", "1", "1"), ("b", "2024-01-01 00:00:00", "abc", "1"), ("c", "2024-01-01 00:00:00", "2.5", "1")],
        "trans_num string, trans_date_trans_time string, amt string, cc_num string",
    )
    built = build_features(data).collect()
    assert [r["trans_num"] for r in built] == ["c"]
    assert built[0]["A2_amt_user_cum_mean"] == 2.5


def test_batch_scope_ignores_other_batches(spark):
    rows = [row("a", 0, 10), row("b", 10, 20), row("c", 20, 40)]
    data = frame(spark, rows).withColumn("batch_id", F.when(F.col("trans_num") == "c", "2").otherwise("1"))
    built = {r["trans_num"]: r for r in build_features(data, scope="batch").collect()}
    assert built["c"]["T1_time_diff_sec"] is None and built["c"]["A2_amt_user_cum_mean"] == 40.0
    assert built["b"]["A2_amt_user_cum_mean"] == 10.0


def test_incremental_equals_full_build(spark):
    rows = skewed_rows(200)
    cut = sorted(r["us"] for r in rows)[150]
    data = frame(spark, rows)
    us = F.unix_micros("trans_date_trans_time")
    new = build_features_incremental(data.where(us < cut), data.where(us >= cut), amt_prior=10.0)
    expected = {k: v for k, v in brute(rows, prior=10.0).items() if k in {r["trans_num"] for r in rows if r["us"] >= cut}}
    assert_same(new, expected)


def test_exchange_count(spark, tiny):
    """One shuffle by merchant and one by card serve every window."""
    tx = bindings.transactions(spark, tiny)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = build_features(tx, amt_prior=10.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 2
    assert "SinglePartition" not in plan


def test_incremental_build_with_missing_merchants(spark):
    schema = "trans_num string, cc_num long, trans_date_trans_time timestamp_ntz, amt double, category string, merchant string, city string, state string, is_fraud int"
    day = [datetime(2024, 1, k + 1) for k in range(3)]
    rows = [("a", 1, day[0], 10.0, "x", None, "c", "s", 0), ("b", 2, day[1], 20.0, "x", "UNK", "c", "s", 0), ("c", 3, day[2], 30.0, "x", None, "c", "s", 0)]
    table = spark.createDataFrame(rows, schema).withColumn("trans_date_trans_time", F.col("trans_date_trans_time").cast("timestamp"))
    full = build_features(table, amt_prior=5.0).where("trans_num = 'c'").first()
    part = build_features_incremental(table.where("trans_num <> 'c'"), table.where("trans_num = 'c'"), amt_prior=5.0).first()
    assert full["A7_amt_diff_merchant_mean"] == part["A7_amt_diff_merchant_mean"] == 15.0
    assert full["A8_merchant_amt_std"] == part["A8_merchant_amt_std"]
