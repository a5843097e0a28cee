"""Cards are handled in groups of their hash, with one value for each; what does not fit it is kept in maps."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_stateful import EXACT, compare, landed_in_order

from cardwatch.operators.features import DAY, build_features
from cardwatch.schemas import TS
from cardwatch.streaming import replay, stateful

COLUMNS = ["cc_num", "amt", "trans_num", "merchant", "location_country", "location_city", "location_key", "__us", "__sec", "__night", "__sin", "__cos"]


class State:
    """Keyed state in memory that counts how often it is asked."""

    def __init__(self):
        self.calls, self.variables, self.timers = 0, {}, set()

    def getValueState(self, name, schema):
        return Entry(self, name)

    def getMapState(self, name, key, schema):
        return Entries(self, name)

    def registerTimer(self, at):
        self.timers.add(at)

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Entries:
    def __init__(self, state, name):
        self.state, self.held = state, state.variables.setdefault(name, {})

    def _asked(self):
        self.state.calls += 1
        return self.held

    def getValue(self, key):
        return self._asked().get(key)

    def containsKey(self, key):
        return key in self._asked()

    def updateValue(self, key, value):
        self._asked()[key] = value

    def removeKey(self, key):
        del self._asked()[key]

    def iterator(self):
        return iter(list(self._asked().items()))

    def keys(self):
        return iter(list(self._asked()))


class Entry(Entries):
    def exists(self):
        return self.containsKey(())

    def get(self):
        return self.getValue(())

    def update(self, value):
        self.updateValue((), value)

    def clear(self):
        self._asked().clear()


class Watermark:
    def __init__(self, seconds):
        self.seconds = seconds

    def getCurrentWatermarkInMs(self):
        return self.seconds * 1000


def group(cards, rows, start):
    k = np.arange(cards * rows)
    sec = start + k * 601 // cards
    place = (k % 5).astype(str)
    values = [k % cards, (k % 4).astype(float), k.astype(str), (k % 3).astype(str), place, place, place, sec * 1_000_000, sec, k % 2, k / 7, k / 9]
    return pd.DataFrame(dict(zip(COLUMNS, values)))


def test_a_card_is_read_and_written_once_a_micro_batch():
    state, history = State(), stateful.CardHistory(COLUMNS)
    history.init(state)
    for start in (0, 100_000, 200_000):
        state.calls = 0
        (out,) = history.handleInputRows((7,), iter([group(40, 50, start)]), None)
        assert len(out) == 2_000 and state.calls <= 2 * 40 + 2
    assert list(out["__u_n"][:50]) == list(range(100, 150))
    assert out["__same"].max() > 0


@pytest.mark.parametrize("packed", [2, 1_000])
def test_a_day_without_rows_leaves_nothing_recent(packed):
    state, history = State(), stateful.CardHistory(COLUMNS, packed)
    history.init(state)
    list(history.handleInputRows((7,), iter([group(4, 30, 0)]), None))
    late = group(1, 1, 40_000).assign(trans_num="x")
    list(history.handleInputRows((7,), iter([late]), None))
    assert (len(state.variables["amounts"]) > 0) == (packed == 2)
    names = stateful._CARD_NAMES

    def recent():
        cards = {key[0]: dict(zip(names, value)) for key, value in state.variables["cards"].items()}
        return {card for card, c in cards.items() if c["sec"] or c["day_sec"] or c["day_in_maps"] or c["hours"]}

    list(history.handleExpiredTimer((7,), Watermark(20_000 + DAY), None))
    assert recent() == {0} and state.variables["timer"]
    assert {card for card, _ in state.variables["amounts"]} == ({0} if packed == 2 else set())
    list(history.handleExpiredTimer((7,), Watermark(50_000 + DAY), None))
    assert recent() == set() and not state.variables["timer"]
    assert not state.variables["amounts"] and not state.variables["hours"]
    assert [value[names.index("u_n")] for value in state.variables["cards"].values()] == [31, 30, 30, 30]


def test_what_does_not_fit_the_value_counts_as_well(spark, tmp_path):
    """One hot card and others, with room for two merchants, places and amounts."""
    rows = []
    for k in range(200):
        second = 1_704_067_200 + (k // 2) * [1, 59, 900, 3_000, 20_000][k // 40]
        card = 1 if k % 5 else 2 + k % 3
        rows.append((f"t{k:03}", card, second, float(k % 6), f"m{k % 7}", f"c{k % 4}", f"s{k % 3}"))
    schema = "trans_num string, cc_num long, sec long, amt double, merchant string, city string, state string"
    tx = spark.createDataFrame(rows, schema).withColumn(TS, F.timestamp_seconds("sec")).drop("sec")
    times = sorted({r[0] for r in tx.select(F.date_format(TS, "yyyy-MM-dd HH:mm:ss")).collect()})
    folder, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for _ in landed_in_order(tx, times[15::30], folder):
        stream = replay.stream_transactions(spark, folder, tx.schema, max_files=1_000)
        stateful.build_available(stream, sink, checkpoint, 30.0, packed=2)
    compare(spark.read.parquet(sink), build_features(tx, amt_prior=30.0), EXACT)


def test_state_has_no_more_parts_than_the_cores_can_use(spark, tmp_path):
    rows = [(f"t{k}", k % 9, float(k), "m", "c", "s") for k in range(30)]
    tx = spark.createDataFrame(rows, "trans_num string, cc_num long, amt double, merchant string, city string, state string")
    tx = tx.withColumn(TS, F.timestamp_seconds(F.lit(1_704_067_200) + F.col("amt")))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    try:
        for _ in landed_in_order(tx, [], str(tmp_path / "in")):
            stream = replay.stream_transactions(spark, str(tmp_path / "in"), tx.schema, max_files=1_000)
            stateful.build_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 30.0)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "150"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
    assert len([d for d in (tmp_path / "cp" / "state" / "0").iterdir() if d.name.isdigit()]) == stateful.STATE_PARTS


def test_moments_of_groups_are_those_of_each_key():
    rng = np.random.default_rng(5)
    codes, values = rng.integers(0, 4, 60), rng.choice([1e6, 0.01, 3.5], 60)
    codes[:4] = range(4)
    states = [None, (3, 2.0, 1.5, 4.0), None, (1, 0.01, 0.0, 0.0)]
    out, now = stateful.moments_by(codes, values, states)
    for k, state in enumerate(states):
        alone, last = stateful.prior_moments(values[codes == k], state)
        for name in out:
            np.testing.assert_allclose(out[name][codes == k], alone[name])
        np.testing.assert_allclose(now[k], last)
