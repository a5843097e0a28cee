"""Look-back features of card transactions.

37 columns per transaction, each computed from strictly earlier rows in the
order (event time, card, transaction id):

===== ==========================================================================
A1-A6 amount against the card's own past (difference, mean, median, repeats, score)
A7-A8 amount against the merchant's past
A9-16 amount against the past of the card at this merchant
T1-T2 time since the card's previous row, and its angle with the amount
T3-T7 hour on the circle, night flag and share, concentration of usual hours
T8    the card's rows in the last 1 s, 10 s, 60 s, 1 h, 2 h (whole seconds)
T9    interval in line with the card's usual intervals
L1-L4 visits to this city / state, distinct places, shares
L5-L6 same place as before, place known
===== ==========================================================================

Layout: the merchant pass runs first, on the narrow input, then one shuffle by
card serves all card-level windows. Cards and merchants whose history is too
long for one task are cut into time slices (see ``cardwatch.plans.slices``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwatch.functions.columns import seconds
from cardwatch.operators.running_median import median_of_sliced_histories, median_of_whole_histories
from cardwatch.plans.history import (
    before,
    carry_in,
    lookback_counts,
    merge_moments,
    merge_sum,
    partial_moments,
    window_moment_results,
    window_moments,
)
from cardwatch.plans.prefix import exact_median, exact_quantiles, null_safe_join
from cardwatch.plans.slices import ROWS_PER_SLICE, plan_slices, with_slice
from cardwatch.schemas import TS
from cardwatch.session import written

UNKNOWN = "UNK"
EPS = 1e-9
NIGHT_ENDS = 6
DAY = 86_400
#: Rows of whole histories that one task gets, about: a dozen sorts hold some 3 KB for each of them at a time.
ROWS_PER_TASK = 100_000
VELOCITY = {"1s": 1, "10s": 10, "60s": 60, "1h": 3_600, "2h": 7_200}

# The engineered columns in their order.
FEATURES = [
    "A1_amt_diff_prev",
    "A2_amt_user_cum_mean",
    "A3_amt_dev_user_cum_median",
    "A4_identical_amt_cnt_24h",
    "A5_amt_user_std_score",
    "A6_amt_within_1std_user",
    "A7_amt_diff_merchant_mean",
    "A8_merchant_amt_std",
    "A9_user_merchant_cum_mean",
    "A10_user_merchant_cum_std",
    "A11_user_merchant_cum_sum",
    "A12_user_merchant_global_mean",
    "A13_user_merchant_global_std",
    "A14_user_merchant_global_sum",
    "A15_amt_within_2std_user_merchant",
    "A16_amt_within_confidence_user_merchant",
    "T1_time_diff_sec",
    "T2_amt_time_angle",
    "T3_hour_sin",
    "T4_hour_cos",
    "T5_is_madrugada",
    "T6_user_madrugada_ratio_cum",
    "T7_user_hour_vonmises_proxy",
    "T8_txn_count_1s",
    "T8_txn_count_10s",
    "T8_txn_count_60s",
    "T8_txn_count_1h",
    "T8_txn_count_2h",
    "T9_time_interval_coherent",
    "L1_user_city_visit_count",
    "L2_user_country_visit_count",
    "L3_user_unique_city_count",
    "L3_user_unique_country_count",
    "L4_user_city_txn_ratio",
    "L4_user_country_txn_ratio",
    "L5_same_location_as_prev",
    "L6_location_seen_before",
]
LOCATIONS = ["location_country", "location_city", "location_key"]

# The second comes first so that the time-range windows find their order ready.
CARD_ORDER = ["__sec", "__us", "trans_num"]
MERCHANT_ORDER = ["__us", "cc_num", "trans_num"]
PLACES = {"city": "location_city", "country": "location_country", "key": "location_key"}


def coerce_required(df: DataFrame) -> DataFrame:
    """Type the required fields; rows that lack one after typing are dropped."""
    types = {"trans_date_trans_time": "timestamp", "amt": "double", "cc_num": "bigint"}
    typed = df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})
    return typed.dropna(subset=list(types))


def with_location(df: DataFrame) -> DataFrame:
    """Country (else state), city and their combination; missing parts read UNK."""
    area = next((c for c in ("country", "state") if c in df.columns), None)
    country = F.coalesce(F.col(area).cast("string"), F.lit(UNKNOWN)) if area else F.lit(UNKNOWN)
    city = F.coalesce(F.col("city").cast("string"), F.lit(UNKNOWN)) if "city" in df.columns else F.lit(UNKNOWN)
    df = df.withColumns({"location_country": country, "location_city": city})
    return df.withColumn("location_key", F.concat_ws("|", "location_country", "location_city"))


def prepare(df: DataFrame) -> DataFrame:
    """Required fields, locations and the clock columns the windows order by."""
    if "trans_num" not in df.columns:
        raise ValueError("trans_num is needed to order rows of equal time; see ensure_trans_num")
    merchant = F.coalesce("merchant", F.lit(UNKNOWN)) if "merchant" in df.columns else F.lit(UNKNOWN)
    df = with_location(coerce_required(df)).withColumn("merchant", merchant)
    hour = F.hour(TS)
    angle = hour * (2 * math.pi / 24)
    return df.withColumns(
        {
            "__us": F.unix_micros(TS),
            "__sec": seconds(TS),
            "__night": (hour < NIGHT_ENDS).cast("int"),
            "__sin": F.sin(angle),
            "__cos": F.cos(angle),
        }
    )


def build_features(
    df: DataFrame,
    *,
    scope: str = "history",
    batch_col: str = "batch_id",
    amt_prior: float | None = None,
    exact_median_feature: bool = True,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """All input columns, three location columns and the 37 features.

    ``scope="batch"`` treats each batch as a world of its own, the way a
    request is scored without stored history. ``amt_prior`` fixes the amount
    that stands in for a missing history; by default it is the exact median
    of the input (of the batch, in batch scope).
    """
    own = [batch_col] if scope == "batch" else []
    kept = [c for c in df.columns if c != "merchant"] + ["merchant"]
    rows = prepare(df)
    if amt_prior is not None:
        rows = rows.withColumn("__prior", F.lit(float(amt_prior)))
    elif own:
        medians = exact_quantiles(rows, "amt", [0.5], own, rows_per_slice)
        medians = medians.select(*own, F.col("quantiles")[0].alias("__prior"))
        rows = null_safe_join(rows, medians, own)
    else:
        rows = rows.withColumn("__prior", F.lit(exact_median(rows, "amt")).cast("double"))
    with_merchant = keyed_history(rows, [*own, "merchant"], "amt", MERCHANT_ORDER, "__m", rows_per_slice)
    stated = _card_history(with_merchant, rows, own, rows_per_slice, exact_median_feature)
    return _finish(stated).select(*kept, *LOCATIONS, *FEATURES)


# --- merchant history ------------------------------------------------------------


def keyed_history(
    df: DataFrame,
    keys: list[str],
    value: str,
    order: list[str],
    name: str = "prior",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Prior count, mean and sample deviation of a value per key, hot keys included.

    One shuffle by (key, slice); the carried state of cut keys has one row per
    slice and is broadcast.
    """
    plan = plan_slices(df, order, keys, rows_per_slice)
    if not plan.split:
        return df.withColumns(window_moment_results(value, name, before(keys, order)))
    df = with_slice(df, plan, "__hs")
    segment = [*keys, "__hs"]
    local = df.withColumns(window_moments(value, name, before(segment, order)))
    partial = df.groupBy(*segment).agg(*partial_moments(value, name))
    carry = carry_in(partial, keys, "__hs", moments=[name]).where(F.col(f"c_{name}_n") > 0)
    return merge_moments(null_safe_join(local, carry, segment, small=plan.small), name).drop("__hs")


# --- card history ----------------------------------------------------------------


def _card_history(rows: DataFrame, plain: DataFrame, own: list[str], rows_per_slice: int, exact: bool) -> DataFrame:
    """Card-level state of ``rows``; ``plain`` is the same input before the merchant pass."""
    keys = [*own, "cc_num"]
    plan = plan_slices(plain, CARD_ORDER, keys, rows_per_slice)
    if not plan.split:
        return _whole_histories(rows, keys, exact, plan.total)
    hot = plan.hot_keys(rows.sparkSession)
    hot = hot.toDF(*[f"__k_{c}" for c in keys])
    hot = F.broadcast(hot) if plan.small else hot
    match = F.lit(True)
    for c in keys:
        match = match & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    usual = _whole_histories(rows.join(hot, match, "left_anti"), keys, exact, plan.total)
    cut_rows, cut_plain = (with_slice(d.join(hot, match, "left_semi"), plan, "__cs") for d in (rows, plain))
    # Every piece of carried state reads the narrow rows with their slices: found once and written.
    clock = ["__night", "__sin", "__cos"]
    cut_plain = written(cut_plain.select(*dict.fromkeys([*keys, "__cs", *CARD_ORDER, "amt", "merchant", *LOCATIONS, *clock])))
    return usual.unionByName(_cut_histories(cut_rows, cut_plain, keys, rows_per_slice, plan.small))


def _whole_histories(rows: DataFrame, keys: list[str], exact: bool, total: int) -> DataFrame:
    """Histories that fit one task: plain windows over a single shuffle by card.

    The rows are laid out by card once, which also serves every finer key.
    The finer windows run first and the card-level ones last, so that all of
    the latter share one sort. There are at most ``total`` rows; many are dealt
    out in parts of their number, since parts merged by their bytes on the way
    can be too much for the sorts of one task.
    """
    w = before(keys, CARD_ORDER)
    here = Window.partitionBy(*keys).orderBy(*CARD_ORDER)
    tick = Window.partitionBy(*keys).orderBy("__sec")
    if total > ROWS_PER_TASK:
        rows = rows.repartition(max(-(-total // ROWS_PER_TASK), rows.sparkSession.sparkContext.defaultParallelism), *keys)
    else:
        rows = rows.repartition(*keys)
    same = Window.partitionBy(*keys, "amt").orderBy("__sec").rangeBetween(-DAY, -1)
    rows = rows.withColumn("__same", F.count(F.lit(1)).over(same))
    pair = before([*keys, "merchant"], CARD_ORDER)
    rows = rows.withColumns({**window_moment_results("amt", "__p", pair), "__p_sum": F.sum("amt").over(pair)})
    rows = rows.withColumns(
        {f"__{name}_n": F.count(F.lit(1)).over(before([*keys, column], CARD_ORDER)) for name, column in PLACES.items()}
    )
    rows = rows.withColumn("__prev", F.lag(_row_state()).over(here))
    rows = rows.withColumn("__t1", _interval())
    rows = rows.withColumns(
        {
            **window_moment_results("amt", "__u", w),
            **window_moment_results("__t1", "__i", w),
            "__nights": F.sum("__night").over(w),
            "__sins": F.sum("__sin").over(w),
            "__coss": F.sum("__cos").over(w),
            **{f"__{p}_new": F.sum((F.col(f"__{p}_n") == 0).cast("long")).over(w) for p in ("city", "country")},
            **{f"__v{name}": F.count(F.lit(1)).over(tick.rangeBetween(-s, -1)) for name, s in VELOCITY.items()},
        }
    )
    if not exact:
        return rows.withColumn("__median", F.percentile_approx("amt", 0.5).over(w))
    return median_of_whole_histories(rows, keys, CARD_ORDER, "amt", "__median", clustered=True)


def _cut_histories(rows: DataFrame, plain: DataFrame, keys: list[str], rows_per_slice: int, few: bool) -> DataFrame:
    """Histories cut into time slices (column ``__cs``): local windows plus carried state.

    All carried state comes from ``plain``, so each piece is one narrow scan
    of the cut cards and none builds on another's joins. ``few`` says that a table with one row
    for each slice can be broadcast.
    """
    segment = [*keys, "__cs"]

    def attach(left: DataFrame, right: DataFrame, on: list[str], small: bool = False) -> DataFrame:
        """Left join; only the batch id of batch scope can be NULL."""
        if len(keys) > 1:
            return null_safe_join(left, right, on, small=small)
        return left.join(F.broadcast(right) if small else right, on, "left")

    w = before(segment, CARD_ORDER)
    here = Window.partitionBy(*segment).orderBy(*CARD_ORDER)

    # The last row of the slice before; one row per slice.
    ends = plain.groupBy(*segment).agg(F.max_by(_row_state(), F.struct(*CARD_ORDER)).alias("__end"))
    by_slice = Window.partitionBy(*keys).orderBy("__cs")
    ends = ends.withColumn("__end", F.lag("__end").over(by_slice))

    def timed(df: DataFrame) -> DataFrame:
        df = attach(df, ends, segment, small=few)
        df = df.withColumn("__prev", F.coalesce(F.lag(_row_state()).over(here), "__end")).drop("__end")
        return df.withColumn("__t1", _interval())

    # Card-level state: one row per slice.
    sums = {"__nights": "__night", "__sins": "__sin", "__coss": "__cos"}
    card = carry_in(
        timed(plain)
        .groupBy(*segment)
        .agg(
            *partial_moments("amt", "__u"),
            *partial_moments("__t1", "__i"),
            *[F.sum(source).alias(name) for name, source in sums.items()],
        ),
        keys,
        "__cs",
        ["__u", "__i"],
        list(sums),
    )
    rows = timed(rows).withColumns(
        {
            **window_moments("amt", "__u", w),
            **window_moments("__t1", "__i", w),
            **{name: F.sum(source).over(w) for name, source in sums.items()},
        }
    )
    rows = attach(rows, card, segment, small=few)
    for name in ("__u", "__i"):
        rows = merge_moments(rows, name)
    for name in sums:
        rows = merge_sum(rows, name)

    # Pair and place histories: state per (card, slice, merchant or place).
    pair = before([*segment, "merchant"], CARD_ORDER)
    partial = plain.groupBy(*segment, "merchant").agg(*partial_moments("amt", "__p"), F.sum("amt").alias("__p_sum"))
    carry = carry_in(partial, [*keys, "merchant"], "__cs", ["__p"], ["__p_sum"])
    local = {**window_moments("amt", "__p", pair), "__p_sum": F.sum("amt").over(pair)}
    for name, column in PLACES.items():
        local[f"__{name}_n"] = F.count(F.lit(1)).over(before([*segment, column], CARD_ORDER))
    rows = rows.withColumns(local)
    rows = merge_moments(attach(rows, carry, [*segment, "merchant"]), "__p")
    rows = merge_sum(rows, "__p_sum")
    for name, column in PLACES.items():
        count, new = f"__{name}_n", f"__{name}_new"
        partial = plain.groupBy(*segment, column).agg(F.count(F.lit(1)).alias(count))
        carry = carry_in(partial, [*keys, column], "__cs", sums=[count])
        rows = merge_sum(attach(rows, carry, [*segment, column]), count)
        if name == "key":
            continue
        # A place is new in the slice that carries nothing for it.
        debut = carry.groupBy(*segment).agg(F.count_if(F.col(f"c_{count}").isNull()).alias(new))
        rows = rows.withColumn(new, F.sum((F.col(count) == 0).cast("long")).over(w))
        rows = merge_sum(attach(rows, carry_in(debut, keys, "__cs", sums=[new]), segment, small=few), new)

    # Time-range counts do not follow slices: they come from merged seconds.
    velocity = lookback_counts(plain, keys, {f"__v{name}": s for name, s in VELOCITY.items()})
    rows = attach(rows, velocity, [*keys, "__sec"])
    repeats = lookback_counts(plain, [*keys, "amt"], {"__same": DAY})
    rows = attach(rows, repeats, [*keys, "amt", "__sec"])
    rows = median_of_sliced_histories(rows, plain, keys, "__cs", CARD_ORDER, "amt", "__median", rows_per_slice, few)
    return rows.drop("__cs")


def _row_state() -> Column:
    return F.struct("amt", "__us", "location_key")


def _interval() -> Column:
    return (F.col("__us") - F.col("__prev.__us")) / 1_000_000


# --- columns from state ------------------------------------------------------------


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _within(value: Column, centre: Column, reach: Column) -> Column:
    return (value >= centre - reach) & (value <= centre + reach)


def _finish(rows: DataFrame) -> DataFrame:
    amt, prior = F.col("amt"), F.col("__prior")
    mean = F.coalesce("__u_mean", prior)
    std = F.coalesce("__u_std", F.lit(0.0))
    n = F.col("__u_n")
    pair_mean = F.coalesce("__p_mean", prior)
    pair_std = F.coalesce("__p_std", F.lit(0.0))
    pair_sum = F.greatest(F.coalesce("__p_sum", F.lit(0.0)), F.lit(0.0))
    t1 = F.col("__t1")

    def share(part: Column) -> Column:
        return F.when(n > 0, part / F.nullif(n, F.lit(0))).otherwise(0.0)

    resultant = F.sqrt(F.col("__sins") * F.col("__sins") + F.col("__coss") * F.col("__coss"))
    features = {
        "A1_amt_diff_prev": F.coalesce(F.abs(amt - F.col("__prev.amt")), F.lit(0.0)),
        "A2_amt_user_cum_mean": mean,
        "A3_amt_dev_user_cum_median": F.abs(amt - F.coalesce("__median", prior)),
        "A4_identical_amt_cnt_24h": F.col("__same").cast("int"),
        "A5_amt_user_std_score": F.abs(amt - mean) / (std + EPS),
        "A6_amt_within_1std_user": _flag(_within(amt, mean, std)),
        "A7_amt_diff_merchant_mean": F.abs(amt - F.coalesce("__m_mean", prior)),
        "A8_merchant_amt_std": F.coalesce("__m_std", F.lit(0.0)),
        "A15_amt_within_2std_user_merchant": _flag(_within(amt, pair_mean, pair_std * 2)),
        "A16_amt_within_confidence_user_merchant": _flag(_within(amt, pair_mean, pair_std) & (F.col("__p_n") >= 3)),
        "T1_time_diff_sec": t1,
        "T2_amt_time_angle": F.when(t1.isNull(), 0.0).otherwise(F.atan2(amt, F.greatest(t1, F.lit(1.0)))),
        "T3_hour_sin": F.col("__sin"),
        "T4_hour_cos": F.col("__cos"),
        "T5_is_madrugada": F.col("__night"),
        "T6_user_madrugada_ratio_cum": share(F.coalesce("__nights", F.lit(0))),
        "T7_user_hour_vonmises_proxy": share(F.coalesce(resultant, F.lit(0.0))),
        "T9_time_interval_coherent": _flag(
            _within(t1, F.col("__i_mean"), F.coalesce("__i_std", F.lit(0.0)) * 2)
        ),
        "L1_user_city_visit_count": F.col("__city_n").cast("int"),
        "L2_user_country_visit_count": F.col("__country_n").cast("int"),
        "L3_user_unique_city_count": F.coalesce("__city_new", F.lit(0)).cast("int"),
        "L3_user_unique_country_count": F.coalesce("__country_new", F.lit(0)).cast("int"),
        "L4_user_city_txn_ratio": share(F.col("__city_n")),
        "L4_user_country_txn_ratio": share(F.col("__country_n")),
        "L5_same_location_as_prev": _flag(F.col("location_key") == F.col("__prev.location_key")),
        "L6_location_seen_before": _flag(F.col("__key_n") > 0),
    }
    for name in VELOCITY:
        features[f"T8_txn_count_{name}"] = F.col(f"__v{name}").cast("int")
    for kind, value in (("mean", pair_mean), ("std", pair_std), ("sum", pair_sum)):
        number = {"mean": 9, "std": 10, "sum": 11}[kind]
        features[f"A{number}_user_merchant_cum_{kind}"] = value
        features[f"A{number + 3}_user_merchant_global_{kind}"] = value
    return rows.withColumns(features)


def build_features_incremental(
    history: DataFrame, batch: DataFrame, amt_prior: float, **options
) -> DataFrame:
    """Features of a new batch given the stored history.

    Only history of the cards and merchants in the batch is read again: card
    features need the card's rows, merchant features need all rows of the
    merchant. ``amt_prior`` must be fixed, or the answer would depend on how
    the data was cut into batches.
    """
    marked = history.withColumn("__new", F.lit(False)).unionByName(
        batch.withColumn("__new", F.lit(True)), allowMissingColumns=True
    )
    old = F.col("__new") == F.lit(False)
    cards = batch.select("cc_num").distinct().withColumnRenamed("cc_num", "__card")
    merchant = F.coalesce("merchant", F.lit(UNKNOWN))  # as the build names it: a missing merchant is one
    merchants = batch.select(merchant.alias("__merchant")).distinct()
    known = marked.where(old)
    of_cards = known.join(cards, F.col("cc_num") == F.col("__card"), "left_semi")
    others = known.join(cards, F.col("cc_num") == F.col("__card"), "left_anti")
    of_merchants = others.join(merchants, merchant == F.col("__merchant"), "left_semi")
    relevant = of_cards.unionByName(of_merchants).unionByName(marked.where("__new"))
    built = build_features(relevant, amt_prior=amt_prior, **options)
    return built.where("__new").drop("__new")
