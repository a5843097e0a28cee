"""Look-back features on a stream, from keyed state instead of stored history.

Two stateful passes, each with one shuffle: one by merchant, which holds the
moments of its amounts, and one by card. Keys are handled in ``BUCKETS`` groups
of their hash, so that a micro-batch with many keys of few rows is worked out
by array operations over the keys of a group. State stays one entry for each
key, and a micro-batch touches only the keys that occur in it. A card has

* one value, read and written once a micro-batch: moments of amounts and
  intervals, sums of the clock columns, number of places, the last row, the
  first ``PACKED`` merchants (moments) and places of each kind (counts), counts
  per second of the last two hours, and per amount and second of the last day;
* what does not fit there: a map of the other merchants and one of the other
  places, of which a micro-batch touches only the entries that occur in it,
  and, for a card with more than ``PACKED`` entries in a day, maps of amounts.

What is too old goes when the card's next rows come, or by an event-time timer
of its group, once a day, if none come. Timers fire in the next micro-batch.

All 37 columns of ``build_features`` but ``A3_amt_dev_user_cum_median`` come
out: an exact median needs every earlier amount, which no state of bounded
size can hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from cardwatch.operators.features import DAY, FEATURES, LOCATIONS, PLACES, VELOCITY, _finish, prepare
from cardwatch.schemas import TS
from cardwatch.session import ship_package
from cardwatch.streaming.replay import run_available

UNBOUNDED = "A3_amt_dev_user_cum_median"
STREAMED = [f for f in FEATURES if f != UNBOUNDED]
HOUR = 3_600
LONGEST = max(VELOCITY.values())
#: Groups of keys. A checkpoint goes on only with the number it was started with.
BUCKETS = 1_024
#: Merchants, places of a kind and recent amounts of a card that are kept in its value; each access to a map is a round trip.
PACKED = 1_024
#: Parts of the state, if the session has more partitions than this and than twice its cores: each costs a second a micro-batch.
STATE_PARTS = 32
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Count, first value, and sums of differences to it and of their squares: equal values have no spread at all.
_MOMENTS = "n long, origin double, s1 double, s2 double"
_CARD = (
    ", ".join(f"{p}_{field}" for p in ("u", "i") for field in _MOMENTS.split(", "))
    + ", nights long, sins double, coss double, city_new long, country_new long, amt double, us long, place string"
    + ", merchants array<string>, merchant_n array<long>, merchant_origin array<double>, merchant_s1 array<double>"
    + ", merchant_s2 array<double>"
    + "".join(f", {kind} array<string>, {kind}_n array<long>" for kind in PLACES)
    + ", sec array<long>, sec_n array<long>"
    + ", day_amt array<double>, day_sec array<long>, day_n array<long>, day_in_maps boolean, hours array<long>"
)


def _names(ddl: str) -> list[str]:
    return [field.split()[0] for field in ddl.split(", ")]


_CARD_NAMES = _names(_CARD)


def _value(state: dict) -> tuple:
    return tuple(state[name] for name in _CARD_NAMES)


# --- running values ---------------------------------------------------------------------------


def _starts(codes: np.ndarray) -> np.ndarray:
    """Where each of the codes 0, 1, .. begins; they ascend and none is missing."""
    return np.flatnonzero(np.diff(codes, prepend=-1))


def _sums(codes: np.ndarray, values: np.ndarray, carried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of sums before each row of its code, and after the last; ``carried`` has a row for each code."""
    starts = _starts(codes)
    after = pd.DataFrame(values).groupby(codes).cumsum().to_numpy()
    before = np.concatenate([np.zeros((1, after.shape[1])), after[:-1]])
    before[starts] = 0.0
    return carried[codes] + before, carried + after[np.append(starts[1:], len(codes)) - 1]


def moments_by(codes: np.ndarray, values: np.ndarray, states: list[tuple | None]) -> tuple[dict[str, np.ndarray], list[tuple]]:
    """Count, mean, sample deviation and sum of what came before each value of its code, and the states after the last ones."""
    order = np.argsort(codes, kind="stable")
    codes, values = codes[order], values[order]
    starts = _starts(codes)
    known = np.array([s or (0, v, 0.0, 0.0) for s, v in zip(states, values[starts])], float)
    origin = known[codes, 1]
    shifted = values - origin
    before, after = _sums(codes, np.stack([shifted, shifted * shifted], 1), known[:, 2:])
    n = known[codes, 0].astype(np.int64) + np.arange(len(codes)) - starts[codes]
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(n > 0, origin + before[:, 0] / n, np.nan)
        spread = np.maximum(before[:, 1] - before[:, 0] * before[:, 0] / n, 0.0)
        std = np.where(n > 1, np.sqrt(spread / (n - 1)), np.nan)
    found = {"n": n, "mean": mean, "std": std, "sum": np.where(n > 0, before[:, 0] + n * origin, np.nan)}
    out = {k: np.empty_like(v) for k, v in found.items()}
    for k, v in found.items():
        out[k][order] = v
    total = known[:, 0].astype(np.int64) + np.diff(np.append(starts, len(codes)))
    return out, list(zip(total.tolist(), known[:, 1].tolist(), after[:, 0].tolist(), after[:, 1].tolist()))


def prior_moments(values: np.ndarray, state: tuple | None) -> tuple[dict[str, np.ndarray], tuple]:
    """The same for the values of one key."""
    out, (now,) = moments_by(np.zeros(len(values), np.int64), values, [state])
    return out, now


def counts_back(at: np.ndarray, seconds: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Rows from ``width`` to 1 seconds before each moment; ``seconds`` ascend."""
    sums = np.concatenate([[0], counts.cumsum()])
    return sums[np.searchsorted(seconds, at, "left")] - sums[np.searchsorted(seconds, at - width, "left")]


def counts_back_by(
    codes: np.ndarray, sec: np.ndarray, n: np.ndarray, new: int, widths: list[int]
) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same within a code, for the last ``new`` entries and several widths, and all entries, merged by code and second."""
    first = sec.min()
    span = sec.max() - first + max(widths) + 1  # as far back as it goes, an entry stays clear of the code before it
    line = codes * span + (sec - first)
    merged, counts = _merged(line, n)
    found = [counts_back(line[len(line) - new :], merged, counts, width) for width in widths]
    return found, (merged // span, merged % span + first, counts)


def earlier_equal(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many equal codes (0, 1, ..) stand before each, and how often each code occurs."""
    sizes = np.bincount(codes)
    n = np.empty(len(codes), np.int64)
    n[np.argsort(codes, kind="stable")] = np.arange(len(codes)) - np.repeat(sizes.cumsum() - sizes, sizes)
    return n, sizes


def _merged(seconds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One entry a second, ascending."""
    order, where = np.unique(seconds, return_inverse=True)
    return order, np.bincount(where, counts, len(order)).astype(np.int64)


def _paired(codes: np.ndarray, values: pd.Series) -> tuple[np.ndarray, list[tuple[int, object]]]:
    """A code for each pair of code and value, and the pairs."""
    inner, found = pd.factorize(values)
    pairs, where = np.unique(codes * len(found) + inner, return_inverse=True)
    return where, [(int(p // len(found)), found[p % len(found)]) for p in pairs]


def _day_after(us: int) -> int:
    """When nothing recent is left of a row, in milliseconds."""
    return (us // 1_000_000 + DAY + 1) * 1000


def _in_order(rows: Iterator[pd.DataFrame], names: list[str], order: list[str]) -> pd.DataFrame:
    """All rows of a group of keys; names come along, because those with a leading underscore do not reach the worker."""
    frame = pd.concat(list(rows), ignore_index=True).set_axis(names, axis=1)
    columns = [frame[c] for c in order[:-1]]
    keys = [c.to_numpy() if pd.api.types.is_numeric_dtype(c) else pd.factorize(c)[0] for c in columns]
    places = np.lexsort(keys[::-1])
    if np.logical_and.reduce([k[places][1:] == k[places][:-1] for k in keys]).any():
        return frame.sort_values(order, kind="stable", ignore_index=True)
    return frame.take(places).reset_index(drop=True)


def _with_columns(frame: pd.DataFrame, out: dict[str, np.ndarray]) -> pd.DataFrame:
    return pd.concat([frame, pd.DataFrame(out, index=frame.index)], axis=1)


# --- processors -------------------------------------------------------------------------------


class MerchantHistory(StatefulProcessor):
    """Moments of a merchant's earlier amounts."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle) -> None:
        self.state = handle.getMapState("moments", "merchant string", _MOMENTS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _in_order(rows, self.names, ["merchant", "__us", "cc_num", "trans_num"])
        codes, merchants = pd.factorize(frame["merchant"])
        past, now = moments_by(codes, frame["amt"].to_numpy(float), [self.state.getValue((m,)) for m in merchants])
        for merchant, state in zip(merchants, now):
            self.state.updateValue((merchant,), state)
        yield _with_columns(frame, {"__m_mean": past["mean"], "__m_std": past["std"]})

    def close(self) -> None:
        pass


class Cards:
    """The rows of a group of cards in one micro-batch, with the cards' values before (``None``: a new card) and after."""

    def __init__(self, frame: pd.DataFrame, known):
        self.frame = frame
        self.codes, self.ids = pd.factorize(frame["cc_num"])
        self.starts = _starts(self.codes)
        self.ends = np.append(self.starts[1:], len(frame))
        self.amt = frame["amt"].to_numpy(float)
        self.us, self.sec = (frame[c].to_numpy(np.int64) for c in ("__us", "__sec"))
        self.old = [dict(zip(_CARD_NAMES, value)) if value else None for value in map(known, self.ids.tolist())]
        self.new: list[dict] = [{} for _ in self.ids]
        self.out: dict[str, np.ndarray] = {}

    def each(self, name: str, default) -> list:
        """A field of every card."""
        return [old[name] if old else default for old in self.old]

    def entries(self, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
        """The codes and values of lists that the cards hold."""
        lists = [self.each(name, ()) for name in names]
        sizes = [len(values) for values in lists[0]]
        return np.repeat(np.arange(len(sizes)), sizes), [np.array([v for values in one for v in values]) for one in lists]

    def before(self, name: str, values: np.ndarray, default) -> np.ndarray:
        """The value of the row before, in the card's order."""
        shifted = np.concatenate([values[:1], values[:-1]])
        shifted[self.starts] = self.each(name, default)
        return shifted

    def keep(self, codes: np.ndarray, names: list[str], values: list[np.ndarray]) -> None:
        """Lists for the cards, from values in the order of their codes."""
        edges = np.searchsorted(codes, np.arange(len(self.ids) + 1))
        for name, column in zip(names, values):
            column = column.tolist()
            for new, a, z in zip(self.new, edges[:-1].tolist(), edges[1:].tolist()):
                new[name] = column[a:z]


class CardHistory(StatefulProcessor):
    """Everything the card-level features need of the cards' past."""

    def __init__(self, names: list[str], packed: int = PACKED):
        self.names = names
        self.packed = packed

    def init(self, handle) -> None:
        self.handle = handle
        self.cards = handle.getMapState("cards", "card long", _CARD)
        self.timer = handle.getValueState("timer", "set boolean")
        self.pairs = handle.getMapState("merchants", "card long, merchant string", _MOMENTS)
        self.places = handle.getMapState("places", "card long, kind string, place string", "n long")
        self.same = handle.getMapState("amounts", "card long, amt double", "sec array<long>, n array<long>")
        self.hours = handle.getMapState("hours", "card long, hour long", "amounts array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        c = Cards(_in_order(rows, self.names, ["cc_num", "__us", "trans_num"]), lambda card: self.cards.getValue((card,)))
        for kind in PLACES:
            self._place_counts(c, kind)
        self._moments(c)
        self._merchants(c)
        self._recent(c)
        self._repeats(c)
        for card, new in zip(c.ids.tolist(), c.new):
            self.cards.updateValue((card,), _value(new))
        if not self.timer.exists():
            self.timer.update((True,))
            self.handle.registerTimer(_day_after(int(c.us.max())))
        yield _with_columns(c.frame, c.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """After a day without rows nothing recent of a card is left."""
        now, idle, more = timerValues.getCurrentWatermarkInMs(), [], False
        for (card,), value in self.cards.iterator():
            state = dict(zip(_CARD_NAMES, value))
            if state["sec"] or state["day_sec"] or state["day_in_maps"]:
                if _day_after(state["us"]) <= now:
                    idle.append((card, state))
                else:
                    more = True
        for card, state in idle:
            for hour in state["hours"]:
                for amt in self.hours.getValue((card, hour))[0]:
                    if self.same.containsKey((card, amt)):
                        self.same.removeKey((card, amt))
                self.hours.removeKey((card, hour))
            state.update(sec=[], sec_n=[], day_amt=[], day_sec=[], day_n=[], day_in_maps=False, hours=[])
            self.cards.updateValue((card,), _value(state))
        if more:
            self.handle.registerTimer(now + DAY * 1000)
        else:
            self.timer.clear()
        return iter([])

    def close(self) -> None:
        pass

    def _place_counts(self, c: Cards, kind: str) -> None:
        codes, pairs = _paired(c.codes, c.frame[PLACES[kind]])
        n, sizes = earlier_equal(codes)
        known = [dict(zip(old[kind], old[f"{kind}_n"])) if old else {} for old in c.old]
        before = []
        for (k, place), size in zip(pairs, sizes.tolist()):
            if place in known[k] or len(known[k]) < self.packed:
                before.append(known[k].get(place, 0))
                known[k][place] = before[-1] + size
            else:
                before.append((self.places.getValue((c.ids[k], kind, place)) or (0,))[0])
                self.places.updateValue((c.ids[k], kind, place), (before[-1] + size,))
        for new, places in zip(c.new, known):
            new.update({kind: list(places), f"{kind}_n": list(places.values())})
        c.out[f"__{kind}_n"] = n + np.array(before, np.int64)[codes]

    def _moments(self, c: Cards) -> None:
        fields = _names(_MOMENTS)
        past, u = moments_by(c.codes, c.amt, [tuple(old[f"u_{f}"] for f in fields) if old else None for old in c.old])
        c.out.update({f"__u_{k}": past[k] for k in ("n", "mean", "std")})

        places = c.frame["location_key"].to_numpy(object)
        c.out["__prev_amt"] = c.before("amt", c.amt, np.nan)
        c.out["__prev_place"] = c.before("place", places, None)
        timed = np.ones(len(c.us), bool)
        timed[c.starts] = [old is not None for old in c.old]  # the first row of a card has no interval
        gap = np.where(timed, (c.us - c.before("us", c.us, 0)) / 1_000_000, np.nan)
        c.out["__t1"] = gap
        means, stds = np.full(len(gap), np.nan), np.full(len(gap), np.nan)
        i = [tuple(old[f"i_{f}"] for f in fields) if old and old["i_n"] else None for old in c.old]
        if timed.any():
            codes, present = pd.factorize(c.codes[timed])
            past, after = moments_by(codes, gap[timed], [i[k] for k in present])
            means[timed], stds[timed] = past["mean"], past["std"]
            for k, state in zip(present, after):
                i[k] = state
        c.out["__i_mean"], c.out["__i_std"] = means, stds
        for new, first, second in zip(c.new, u, i):
            for p, state in (("u", first), ("i", second or (0, 0.0, 0.0, 0.0))):
                new.update({f"{p}_{f}": value for f, value in zip(fields, state)})

        names = ("nights", "sins", "coss", "city_new", "country_new")
        columns = [*(c.frame[f"__{n}"] for n in ("night", "sin", "cos")), c.out["__city_n"] == 0, c.out["__country_n"] == 0]
        carried = np.array([c.each(name, 0) for name in names], float).T
        before, after = _sums(c.codes, np.stack([np.asarray(v, float) for v in columns], 1), carried)
        for k, name in enumerate(names):
            whole = name not in ("sins", "coss")
            c.out[f"__{name}"] = before[:, k].astype(np.int64) if whole else before[:, k]
            for new, value in zip(c.new, after[:, k].tolist()):
                new[name] = int(value) if whole else value
        last = c.ends - 1
        for new, amt, us, place in zip(c.new, c.amt[last].tolist(), c.us[last].tolist(), places[last]):
            new.update(amt=amt, us=us, place=place)

    def _merchants(self, c: Cards) -> None:
        columns = [f"merchant_{field}" for field in _names(_MOMENTS)]
        known = [dict(zip(old["merchants"], zip(*(old[f] for f in columns)))) if old else {} for old in c.old]
        codes, pairs = _paired(c.codes, c.frame["merchant"])
        states, packed = [], []
        for k, merchant in pairs:
            packed.append(merchant in known[k] or len(known[k]) < self.packed)
            states.append(known[k].setdefault(merchant, None) if packed[-1] else self.pairs.getValue((c.ids[k], merchant)))
        past, now = moments_by(codes, c.amt, states)
        for (k, merchant), fits, state in zip(pairs, packed, now):
            if fits:
                known[k][merchant] = state
            else:
                self.pairs.updateValue((c.ids[k], merchant), state)
        for new, merchants in zip(c.new, known):
            new["merchants"] = list(merchants)
            new.update({f: list(values) for f, values in zip(columns, zip(*merchants.values()))})
        c.out.update({f"__p_{k}": v for k, v in past.items()})

    def _recent(self, c: Cards) -> None:
        codes, (sec, n) = c.entries("sec", "sec_n")
        line = [np.concatenate(v).astype(np.int64) for v in ((codes, c.codes), (sec, c.sec), (n, np.ones_like(c.sec)))]
        found, (codes, sec, n) = counts_back_by(*line, len(c.sec), list(VELOCITY.values()))
        c.out.update({f"__v{name}": counts for name, counts in zip(VELOCITY, found)})
        kept = sec >= c.sec[c.ends - 1][codes] - LONGEST
        c.keep(codes[kept], ["sec", "sec_n"], [sec[kept], n[kept]])

    def _repeats(self, c: Cards) -> None:
        """Equal amounts of the day before: from the card's value, or from maps while a day holds too many."""
        old_codes, (old_amt, old_sec, old_n) = c.entries("day_amt", "day_sec", "day_n")
        codes, sec, n = (
            np.concatenate(v).astype(np.int64) for v in ((old_codes, c.codes), (old_sec, c.sec), (old_n, np.ones_like(c.sec)))
        )
        pairs, which = _paired(codes, pd.Series(np.concatenate([old_amt, c.amt]).astype(float)))
        (found,), (entry, sec, n) = counts_back_by(pairs, sec, n, len(c.sec), [DAY])
        cards, amts = np.array([k for k, _ in which]), np.array([v for _, v in which], float)
        codes, amt = cards[entry], amts[entry]
        kept = sec >= c.sec[c.ends - 1][codes] - DAY
        codes, amt, sec, n = codes[kept], amt[kept], sec[kept], n[kept]
        c.keep(codes, ["day_amt", "day_sec", "day_n"], [amt, sec, n])
        for k, (card, old, new) in enumerate(zip(c.ids.tolist(), c.old, c.new)):
            new.update(day_in_maps=bool(old and old["day_in_maps"]), hours=list(old["hours"]) if old else [])
            if new["day_in_maps"]:
                at = slice(c.starts[k], c.ends[k])
                found[at] = self._repeats_in_maps(card, new["hours"], c.amt[at], c.sec[at])
            elif len(new["day_sec"]) > self.packed:
                at = codes == k
                self._day_to_maps(card, new["hours"], amt[at], sec[at], n[at])
                new["day_in_maps"] = True
            if new["day_in_maps"]:
                new.update(day_amt=[], day_sec=[], day_n=[])
        c.out["__same"] = found

    def _day_to_maps(self, card: int, hours: list[int], amt: np.ndarray, sec: np.ndarray, n: np.ndarray) -> None:
        """Entries ascend by amount and second; an index by hour tells which amounts have old entries."""
        values, codes = np.unique(amt, return_inverse=True)
        order = np.argsort(codes, kind="stable")
        edges = _starts(codes[order])[1:]
        for value, at in zip(values.tolist(), np.split(order, edges)):
            self.same.updateValue((card, value), (sec[at].tolist(), n[at].tolist()))
        self._index(card, hours, amt, sec)

    def _index(self, card: int, hours: list[int], amt: np.ndarray, sec: np.ndarray) -> None:
        for hour, values in pd.Series(amt).groupby(sec // HOUR).unique().items():
            known = self.hours.getValue((card, int(hour)))[0] if int(hour) in hours else []
            self.hours.updateValue((card, int(hour)), (sorted({*known, *map(float, values)}),))
            if not known:
                hours.append(int(hour))

    def _repeats_in_maps(self, card: int, hours: list[int], amt: np.ndarray, sec: np.ndarray) -> np.ndarray:
        n = np.zeros(len(amt), np.int64)
        oldest = int(sec[-1]) - DAY
        for value, at in pd.Series(amt).groupby(amt, sort=False).indices.items():
            old = self.same.getValue((card, float(value))) or ([], [])
            seconds, counts = _merged(
                np.concatenate([np.asarray(old[0], np.int64), sec[at]]),
                np.concatenate([np.asarray(old[1], np.int64), np.ones(len(at), np.int64)]),
            )
            n[at] = counts_back(sec[at], seconds, counts, DAY)
            self.same.updateValue((card, float(value)), (seconds.tolist(), counts.tolist()))
        self._index(card, hours, amt, sec)
        for hour in [h for h in hours if (h + 1) * HOUR <= oldest]:
            for value in self.hours.getValue((card, hour))[0]:
                entry = self.same.getValue((card, value))
                if not entry:
                    continue
                seconds, counts = entry
                first = int(np.searchsorted(seconds, oldest))
                if first == len(seconds):
                    self.same.removeKey((card, value))
                elif first:
                    self.same.updateValue((card, value), (list(seconds[first:]), list(counts[first:])))
            self.hours.removeKey((card, hour))
            hours.remove(hour)
        return n


# --- the stream -------------------------------------------------------------------------------


def _carried(field: T.StructField) -> Column:
    """A column that only travels along, in a form in which missing values and all digits survive."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.TimestampType):
        return F.unix_micros(c).cast("string")
    return c.cast("string") if isinstance(field.dataType, (T.IntegralType, T.BooleanType, T.DecimalType, T.DateType)) else c


def _restored(field: T.StructField, column: str) -> Column:
    c = F.col(column)
    if isinstance(field.dataType, T.TimestampType):
        return F.timestamp_micros(c.cast("long"))
    return c.cast(field.dataType)


_STATE = {
    "__m_mean double, __m_std double": 1,
    "__city_n long, __country_n long, __key_n long, __u_n long, __u_mean double, __u_std double, __prev_amt double,"
    " __prev_place string, __t1 double, __i_mean double, __i_std double, __nights long, __sins double, __coss double,"
    " __city_new long, __country_new long, __p_n long, __p_mean double, __p_std double, __p_sum double,"
    + ", ".join(f" __v{name} long" for name in VELOCITY)
    + ", __same long": 2,
}


def stream_features(stream: DataFrame, amt_prior: float, watermark: str = "0 seconds", packed: int = PACKED) -> DataFrame:
    """The input columns, the three location columns and ``STREAMED`` for every row of a stream.

    Micro-batches must come in event order; inside one any order will do. A
    row is handled as by ``build_features(..., amt_prior=amt_prior)``; rows
    older than the watermark are dropped, so that with the default nothing
    older than the newest row of the batches before is accepted.

    The rows of a group of keys in one micro-batch are handled together: bound
    the micro-batch by the source, as for any keyed state. Up to ``packed``
    merchants, places and recent amounts of a card are kept in one value.
    """
    ship_package(stream.sparkSession)
    rows = prepare(stream)
    needed = [TS, "cc_num", "amt", "trans_num", "merchant", *LOCATIONS, "__us", "__sec", "__night", "__sin", "__cos"]
    others = [f for f in rows.schema.fields if f.name not in needed]
    narrow = rows.select(
        *[F.col(c).cast("string") if c in ("trans_num", "merchant") else F.col(c) for c in needed],
        *[_carried(f).alias(f"__x{k}") for k, f in enumerate(others)],
    )
    kept = [c for c in stream.columns if c != "merchant"] + ["merchant"]
    types = {f.name: f for f in rows.schema.fields}
    out = narrow.withWatermark(TS, watermark)
    first, second = (T.StructType.fromDDL(s) for s in _STATE)
    histories = (("merchant", MerchantHistory, first), ("cc_num", partial(CardHistory, packed=packed), second))
    for key, processor, added in histories:
        out = out.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
        schema = T.StructType([*out.schema.fields, *added.fields])
        out = out.groupBy("__bucket").transformWithStateInPandas(
            processor(out.columns), outputStructType=schema, outputMode="Append", timeMode="EventTime", eventTimeColumnName=TS
        )
    out = out.withColumns(
        {
            **{f.name: _restored(f, f"__x{k}") for k, f in enumerate(others)},
            "trans_num": F.col("trans_num").cast(types["trans_num"].dataType),
            "__prev": F.struct(F.col("__prev_amt").alias("amt"), F.col("__prev_place").alias("location_key")),
            "__prior": F.lit(float(amt_prior)),
            "__median": F.lit(None).cast("double"),
        }
    )
    return _finish(out).select(*kept, *LOCATIONS, *STREAMED)


@contextmanager
def keyed_state(spark: SparkSession):
    """State on disk for the queries started inside; the session's own choices come back afterwards.

    No batch is run for timers alone, since none of them emits a row: it would open and close every state store again.
    A checkpoint keeps the number of parts it was started with.
    """
    parts = max(STATE_PARTS, 2 * spark.sparkContext.defaultParallelism)
    chosen = {
        "spark.sql.shuffle.partitions": str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), parts)),
        "spark.sql.streaming.stateStore.providerClass": _ROCKS,
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {name: spark.conf.get(name, None) for name in chosen}
    for name, value in chosen.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def build_available(
    stream: DataFrame, sink: str, checkpoint: str, amt_prior: float, watermark: str = "0 seconds", packed: int = PACKED
) -> None:
    """Append the features of what has arrived to ``sink`` and stop; the next run goes on with the state of this one."""
    with keyed_state(stream.sparkSession):
        features = stream_features(stream, amt_prior, watermark, packed)
        writer = features.writeStream.format("parquet").outputMode("append").option("path", sink)
        run_available(writer.option("checkpointLocation", checkpoint))
