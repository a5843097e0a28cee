"""The look-back features of the bound transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardwatch.operators.features import build_features, build_features_incremental, prepare, with_location
from cardwatch.plans.prefix import exact_quantiles
from catalog.registry import TS, TX, add

BASE = f"""SELECT *, epoch_us({TS}) AS us, epoch_us({TS}) // 1000000 AS sec, hour({TS}) AS h,
 state AS location_country, city AS location_city, concat(state, '|', city) AS location_key FROM {TX} t"""

HISTORY = f"""(SELECT *, (n_city = 0)::INTEGER AS new_city, (n_country = 0)::INTEGER AS new_country FROM (SELECT *,
 (us - lag(us) OVER u) / 1e6::DOUBLE AS t1, lag(amt) OVER u AS prev_amt, lag(location_key) OVER u AS prev_key,
 count(*) OVER up AS n, avg(amt) OVER up AS u_mean, stddev_samp(amt) OVER up AS u_std, median(amt) OVER up AS u_median,
 sum((h < 6)::INTEGER) OVER up AS nights, sum(sin(2 * pi() * h / 24)) OVER up AS sins, sum(cos(2 * pi() * h / 24)) OVER up AS coss,
 avg(amt) OVER m AS m_mean, stddev_samp(amt) OVER m AS m_std,
 count(*) OVER p AS p_n, avg(amt) OVER p AS p_mean, stddev_samp(amt) OVER p AS p_std, sum(amt) OVER p AS p_sum,
 count(*) OVER c AS n_city, count(*) OVER y AS n_country, count(*) OVER k AS n_key,
 count(*) OVER (PARTITION BY cc_num, amt ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS same,
 count(*) OVER (PARTITION BY cc_num ORDER BY sec RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS v_1s,
 count(*) OVER (PARTITION BY cc_num ORDER BY sec RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING) AS v_10s,
 count(*) OVER (PARTITION BY cc_num ORDER BY sec RANGE BETWEEN 60 PRECEDING AND 1 PRECEDING) AS v_60s,
 count(*) OVER (PARTITION BY cc_num ORDER BY sec RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS v_1h,
 count(*) OVER (PARTITION BY cc_num ORDER BY sec RANGE BETWEEN 7200 PRECEDING AND 1 PRECEDING) AS v_2h
 FROM ({BASE}) b
 WINDOW u AS (PARTITION BY cc_num ORDER BY us, trans_num),
 up AS (PARTITION BY cc_num ORDER BY us, trans_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 m AS (PARTITION BY merchant ORDER BY us, cc_num, trans_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 p AS (PARTITION BY cc_num, merchant ORDER BY us, trans_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 c AS (PARTITION BY cc_num, location_city ORDER BY us, trans_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 y AS (PARTITION BY cc_num, location_country ORDER BY us, trans_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 k AS (PARTITION BY cc_num, location_key ORDER BY us, trans_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) s)"""

STATE = f"""(SELECT s.*, g.g, avg(t1) OVER up AS i_mean, stddev_samp(t1) OVER up AS i_std,
 sum(new_city) OVER up AS cities, sum(new_country) OVER up AS countries
 FROM {HISTORY} s, (SELECT median(amt) AS g FROM {TX} x) g
 WINDOW up AS (PARTITION BY cc_num ORDER BY us, trans_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def within(mean: str, std: str, times: int) -> str:
    low = f"coalesce({mean}, g) - {times} * coalesce({std}, 0)"
    high = f"coalesce({mean}, g) + {times} * coalesce({std}, 0)"
    return f"amt >= {low} AND amt <= {high}"


# query name -> (feature column, SQL over the state, rounded?)
FEATURE_SQL = {
    "f_a1": ("A1_amt_diff_prev", "coalesce(abs(amt - prev_amt), 0)", True),
    "f_a2": ("A2_amt_user_cum_mean", "coalesce(u_mean, g)", True),
    "f_a3": ("A3_amt_dev_user_cum_median", "abs(amt - coalesce(u_median, g))", True),
    "f_a4": ("A4_identical_amt_cnt_24h", "same::INTEGER", False),
    "f_a6": ("A6_amt_within_1std_user", f"({within('u_mean', 'u_std', 1)})::INTEGER", False),
    "f_a7": ("A7_amt_diff_merchant_mean", "abs(amt - coalesce(m_mean, g))", True),
    "f_a8": ("A8_merchant_amt_std", "coalesce(m_std, 0)", True),
    "f_a9": ("A9_user_merchant_cum_mean", "coalesce(p_mean, g)", True),
    "f_a10": ("A10_user_merchant_cum_std", "coalesce(p_std, 0)", True),
    "f_a11": ("A11_user_merchant_cum_sum", "greatest(coalesce(p_sum, 0), 0)", True),
    "f_a12": ("A12_user_merchant_global_mean", "coalesce(p_mean, g)", True),
    "f_a13": ("A13_user_merchant_global_std", "coalesce(p_std, 0)", True),
    "f_a14": ("A14_user_merchant_global_sum", "greatest(coalesce(p_sum, 0), 0)", True),
    "f_a15": ("A15_amt_within_2std_user_merchant", f"({within('p_mean', 'p_std', 2)})::INTEGER", False),
    "f_a16": ("A16_amt_within_confidence_user_merchant", f"({within('p_mean', 'p_std', 1)} AND p_n >= 3)::INTEGER", False),
    "f_t1": ("T1_time_diff_sec", "t1", True),
    "f_t2": ("T2_amt_time_angle", "CASE WHEN t1 IS NULL THEN 0 ELSE atan2(amt, greatest(t1, 1)) END", True),
    "f_t3": ("T3_hour_sin", "sin(2 * pi() * h / 24)", True),
    "f_t4": ("T4_hour_cos", "cos(2 * pi() * h / 24)", True),
    "f_t5": ("T5_is_madrugada", "(h < 6)::INTEGER", False),
    "f_t6": ("T6_user_madrugada_ratio_cum", "CASE WHEN n > 0 THEN nights::DOUBLE / n ELSE 0 END", True),
    "f_t7": ("T7_user_hour_vonmises_proxy", "CASE WHEN n > 0 THEN sqrt(sins * sins + coss * coss) / n ELSE 0 END", True),
    "f_t8a": ("T8_txn_count_1s", "v_1s::INTEGER", False),
    "f_t8b": ("T8_txn_count_10s", "v_10s::INTEGER", False),
    "f_t8c": ("T8_txn_count_60s", "v_60s::INTEGER", False),
    "f_t8d": ("T8_txn_count_1h", "v_1h::INTEGER", False),
    "f_t8e": ("T8_txn_count_2h", "v_2h::INTEGER", False),
    "f_t9": (
        "T9_time_interval_coherent",
        "coalesce(t1 >= i_mean - 2 * coalesce(i_std, 0) AND t1 <= i_mean + 2 * coalesce(i_std, 0), false)::INTEGER",
        False,
    ),
    "f_l1": ("L1_user_city_visit_count", "n_city::INTEGER", False),
    "f_l2": ("L2_user_country_visit_count", "n_country::INTEGER", False),
    "f_l3a": ("L3_user_unique_city_count", "coalesce(cities, 0)::INTEGER", False),
    "f_l3b": ("L3_user_unique_country_count", "coalesce(countries, 0)::INTEGER", False),
    "f_l4a": ("L4_user_city_txn_ratio", "CASE WHEN n > 0 THEN n_city::DOUBLE / n ELSE 0 END", True),
    "f_l4b": ("L4_user_country_txn_ratio", "CASE WHEN n > 0 THEN n_country::DOUBLE / n ELSE 0 END", True),
    "f_l5": ("L5_same_location_as_prev", "coalesce(location_key = prev_key, false)::INTEGER", False),
    "f_l6": ("L6_location_seen_before", "(n_key > 0)::INTEGER", False),
}

for name, (column, expression, is_float) in FEATURE_SQL.items():
    add(
        name,
        lambda t, column=column: build_features(t.tx).select("trans_num", column),
        f"SELECT trans_num, {expression} AS {column} FROM {STATE} w",
        column if is_float else "",
    )

# A past without spread divides by 1e-9: such values are compared to the thousand.
add(
    "f_a5",
    lambda t: build_features(t.tx).select(
        "trans_num",
        F.when(F.col("A5_amt_user_std_score") > 1e5, F.round("A5_amt_user_std_score", -3)).otherwise(F.round("A5_amt_user_std_score", 4)).alias("A5_amt_user_std_score"),
    ),
    f"""SELECT trans_num, CASE WHEN a5 > 1e5 THEN round(a5, -3) ELSE round(a5, 4) END AS A5_amt_user_std_score FROM
 (SELECT trans_num, abs(amt - coalesce(u_mean, g)) / (coalesce(u_std, 0) + 1e-9) AS a5 FROM {STATE} w) z""",
)

FLOATS = " ".join(c for c, _, f in FEATURE_SQL.values() if f)
SELECTED = ", ".join(f"{sql} AS {c}" for c, sql, _ in FEATURE_SQL.values())
WIDE = ["trans_num", "cc_num", "location_key", *[c for c, _, _ in FEATURE_SQL.values()]]
add(
    "build_features",
    lambda t: build_features(t.tx).select(*WIDE),
    f"SELECT trans_num, cc_num, location_key, {SELECTED} FROM {STATE} w",
    FLOATS,
)
# The same values with every card and merchant history cut into slices, and A5 by its logarithm.
add(
    "build_features_sliced",
    lambda t: build_features(t.tx, rows_per_slice=60).select(*WIDE, F.log(1 + F.col("A5_amt_user_std_score")).alias("log_a5")),
    f"""SELECT trans_num, cc_num, location_key, {SELECTED}, ln(1 + abs(amt - coalesce(u_mean, g)) / (coalesce(u_std, 0) + 1e-9)) AS log_a5
 FROM {STATE} w""",
    FLOATS + " log_a5",
)

add("f_0a", lambda t: with_location(t.tx).select("trans_num", "location_country"), f"SELECT trans_num, state AS location_country FROM {TX} t")
add(
    "f_0b",
    lambda t: with_location(t.tx).select("trans_num", "location_city", "location_key"),
    f"SELECT trans_num, city AS location_city, concat(state, '|', city) AS location_key FROM {TX} t",
)
add(
    "f_0c",
    lambda t: exact_quantiles(t.tx, "amt", [0.5]).select(F.col("quantiles")[0].alias("g")),
    f"SELECT median(amt) AS g FROM {TX} t",
    "g",
)


def prior_count(t):
    from cardwatch.operators.features import CARD_ORDER, keyed_history

    return keyed_history(prepare(t.tx), ["cc_num"], "amt", CARD_ORDER).select("trans_num", "prior_n")


add("f_0d", prior_count, f"SELECT trans_num, n AS prior_n FROM {HISTORY} w")


def incremental(t):
    cut = F.lit("2024-01-25").cast("timestamp")
    new = build_features_incremental(t.tx.where(F.col(TS) < cut), t.tx.where(F.col(TS) >= cut), amt_prior=30.0)
    return new.select("trans_num", *[c for c, _, _ in FEATURE_SQL.values()])


add(
    "t_s3",
    incremental,
    f"SELECT trans_num, {SELECTED} FROM (SELECT * REPLACE (30.0::DOUBLE AS g) FROM {STATE} x) w WHERE {TS} >= TIMESTAMP '2024-01-25'",
    FLOATS,
)
