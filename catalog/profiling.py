"""Quality, activity, amount, time, risk and correlation profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardwatch.operators import profile as E
from cardwatch.operators.features import FEATURES, build_features
from catalog.features import FEATURE_SQL, STATE
from catalog.registry import PLACED, SHIFT, TS, TX, add, rounded

VOLUME = "count(is_fraud) AS transactions, coalesce(sum(is_fraud), 0)::BIGINT AS frauds, sum(is_fraud)::DOUBLE / nullif(count(is_fraud), 0) AS fraud_rate"
ACTIVITY = f"(SELECT cc_num, count(*) AS n_transactions FROM {TX} t GROUP BY cc_num)"
DAYS = "(VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'), (5, 'Saturday'), (6, 'Sunday'))"
WEEKDAY = f"(isodow({TS}) - 1)::INTEGER"


def gappy(t):
    """The card log with every seventh amount and every fifth city missing."""
    n = F.col("trans_num").cast("long")
    return t.tx.withColumns({"amt": F.when(n % 7 != 0, F.col("amt")), "city": F.when(n % 5 != 0, F.col("city"))})


GAPPY = f"""(SELECT * REPLACE (CASE WHEN CAST(trans_num AS BIGINT) % 7 <> 0 THEN amt END AS amt,
 CASE WHEN CAST(trans_num AS BIGINT) % 5 <> 0 THEN city END AS city) FROM {TX} t)"""


def repeated(t):
    return t.tx.unionByName(t.tx.where("is_fraud = 1")).unionByName(t.tx.where("amt > 200").withColumn("amt", F.lit(1.0)))


add(
    "e_1",
    lambda t: E.duplicate_counts(repeated(t)),
    f"SELECT sum(is_fraud)::BIGINT AS duplicate_rows, (sum(is_fraud) + count(*) FILTER (WHERE amt > 200))::BIGINT AS duplicate_ids FROM {TX} t",
)
add(
    "e_2",
    lambda t: E.null_summary(gappy(t).select("trans_num", "amt", "city")),
    f"""SELECT 'trans_num' AS "column", 0.0::DOUBLE AS null_pct UNION ALL
 SELECT 'amt', count(*) FILTER (WHERE amt IS NULL) * 100.0::DOUBLE / count(*) FROM {GAPPY} g UNION ALL
 SELECT 'city', count(*) FILTER (WHERE city IS NULL) * 100.0::DOUBLE / count(*) FROM {GAPPY} g""",
    "null_pct",
)
add(
    "e_3",
    lambda t: E.sanity_counts(t.tx.withColumn("amt", F.col("amt") - 5).withColumn("merch_zipcode", F.when(F.col("is_fraud") == 1, 1.0))),
    f"""SELECT count(*) FILTER (WHERE amt - 5 < 0) AS negative_amt, 0::BIGINT AS invalid_time,
 count(*) FILTER (WHERE is_fraud = 0) * 100.0::DOUBLE / count(*) AS null_pct_merch_zipcode FROM {TX} t""",
    "null_pct_merch_zipcode",
)
add("e_4", lambda t: E.user_activity(t.tx), f"SELECT * FROM {ACTIVITY} a")
add("e_4_top", lambda t: E.top_users(t.tx), f"SELECT * FROM {ACTIVITY} a ORDER BY n_transactions DESC, cc_num LIMIT 15")


def quantile(column: str, p: float) -> str:
    return f"quantile_cont({column}::DOUBLE, {p})"


add(
    "e_4_summary",
    lambda t: E.user_activity_summary(t.tx),
    f"""SELECT count(*) AS users, sum(n_transactions)::BIGINT AS transactions, avg(n_transactions) AS mean, stddev_samp(n_transactions) AS std,
 min(n_transactions) AS min, max(n_transactions) AS max, {", ".join(f"{quantile('n_transactions', p / 100)} AS p{p}" for p in (50, 75, 90, 95, 99))}
 FROM {ACTIVITY} a""",
    "mean std p50 p75 p90 p95 p99",
)
CURVE = f"""(SELECT cc_num, n_transactions, row_number() OVER w AS rank, (row_number() OVER w)::DOUBLE / count(*) OVER () AS share_users,
 (sum(n_transactions) OVER w)::DOUBLE / (sum(n_transactions) OVER ())::DOUBLE AS share_transactions FROM {ACTIVITY} a
 WINDOW w AS (ORDER BY n_transactions DESC, cc_num))"""
add("e_5", lambda t: E.concentration_curve(t.tx), f"SELECT * FROM {CURVE} c", "share_users share_transactions")
add(
    "e_5_top_share",
    lambda t: E.top_share(t.tx),
    f"""SELECT max(rank) AS top_users, max(share_transactions) AS share_transactions FROM {CURVE} c
 WHERE rank <= greatest(1, ceil(0.1::DOUBLE * (SELECT count(*) FROM {ACTIVITY} a)))""",
    "share_transactions",
)
add(
    "e_6",
    lambda t: E.class_distribution(t.tx),
    f"""SELECT is_fraud, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS pct,
 (SELECT count(*) FILTER (WHERE is_fraud = 0)::DOUBLE / count(*) FILTER (WHERE is_fraud = 1) FROM {TX} u) AS imbalance_ratio FROM {TX} t GROUP BY is_fraud""",
    "imbalance_ratio",
)
AMOUNTS = """count(amt) AS count, avg(amt) AS mean, stddev_samp(amt) AS std, min(amt) AS min, max(amt) AS max, skewness(amt) AS skew,
 median(amt) AS median, quantile_cont(amt, 0.25) AS q1, quantile_cont(amt, 0.75) AS q3, quantile_cont(amt, 0.95) AS p95,
 quantile_cont(amt, 0.99) AS p99, quantile_cont(amt, 0.75) - quantile_cont(amt, 0.25) AS iqr"""
MODE = f"(SELECT amt FROM {TX} u {{where}} GROUP BY amt ORDER BY count(*) DESC, amt LIMIT 1)"
AMOUNT_R = "mean std skew median q1 q3 p95 p99 iqr"
add("e_7", lambda t: E.amount_summary(t.tx), f"SELECT {AMOUNTS}, {MODE.format(where='')} AS mode FROM {TX} t", AMOUNT_R)
add(
    "e_7_by_class",
    lambda t: E.amount_summary(t.tx, "is_fraud"),
    f"""SELECT is_fraud, {AMOUNTS}, CASE is_fraud WHEN 1 THEN {MODE.format(where='WHERE is_fraud = 1')}
 ELSE {MODE.format(where='WHERE is_fraud = 0')} END AS mode FROM {TX} t GROUP BY is_fraud""",
    AMOUNT_R,
)
add(
    "e_8",
    lambda t: E.class_amount_ratio(t.tx),
    f"""SELECT *, mean_fraud / mean_legit AS mean_ratio, median_fraud / median_legit AS median_ratio FROM (SELECT
 avg(amt) FILTER (WHERE is_fraud = 0) AS mean_legit, avg(amt) FILTER (WHERE is_fraud = 1) AS mean_fraud,
 median(amt) FILTER (WHERE is_fraud = 0) AS median_legit, median(amt) FILTER (WHERE is_fraud = 1) AS median_fraud FROM {TX} t) x""",
    "mean_legit mean_fraud median_legit median_fraud mean_ratio median_ratio",
)
add(
    "e_9",
    lambda t: E.add_calendar(t.tx).select("trans_num", "year", "month", "day", "hour", "weekday", "weekday_name", "is_weekend"),
    f"""SELECT trans_num, year({TS})::INTEGER AS year, month({TS})::INTEGER AS month, day({TS})::INTEGER AS day, hour({TS})::INTEGER AS hour,
 {WEEKDAY} AS weekday, dayname({TS}) AS weekday_name, (isodow({TS}) >= 6)::INTEGER AS is_weekend FROM {TX} t""",
)


def monthly_tx(t):
    """Orders as card rows: seven years, so months matter."""
    o = t.raw("orders").withColumn(TS, F.col("o_orderdate").cast("timestamp"))
    return o.select(F.col("o_orderkey").alias("trans_num"), TS, F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("is_fraud"))


MONTHLY_TX = f"""(SELECT o_orderkey AS trans_num, o_orderdate AS {TS}, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS is_fraud
 FROM orders)"""
MONTHS = f"(SELECT date_trunc('month', {TS})::DATE AS month, {VOLUME} FROM {MONTHLY_TX} t GROUP BY 1)"
add(
    "e_10",
    lambda t: E.monthly_rate(monthly_tx(t)),
    f"""SELECT s.month, coalesce(m.transactions, 0) AS transactions, coalesce(m.frauds, 0) AS frauds, m.fraud_rate FROM
 (SELECT unnest(generate_series((SELECT min(month) FROM {MONTHS} a), (SELECT max(month) FROM {MONTHS} b), INTERVAL 1 MONTH))::DATE AS month) s
 LEFT JOIN {MONTHS} m ON m.month = s.month""",
    "fraud_rate",
)
add("e_11", lambda t: E.hourly_rate(t.tx), f"SELECT hour({TS})::INTEGER AS hour, {VOLUME} FROM {TX} t GROUP BY 1", "fraud_rate")
WEEKLY = f"(SELECT {WEEKDAY} AS weekday, {VOLUME} FROM {TX} t GROUP BY 1)"
add(
    "e_12",
    lambda t: E.weekday_rate(t.tx),
    f"SELECT d.weekday, d.weekday_name, transactions, frauds, fraud_rate FROM {DAYS} d(weekday, weekday_name) LEFT JOIN {WEEKLY} w ON w.weekday = d.weekday",
    "fraud_rate",
)
HEAT = ", ".join(f"avg(is_fraud) FILTER (WHERE hour({TS}) = {h}) AS h{h:02d}" for h in range(24))
add(
    "e_13",
    lambda t: E.weekday_hour_heatmap(t.tx),
    f"""SELECT d.weekday, d.weekday_name, x.* EXCLUDE (weekday) FROM {DAYS} d(weekday, weekday_name)
 LEFT JOIN (SELECT {WEEKDAY} AS weekday, {HEAT} FROM {TX} t GROUP BY 1) x ON x.weekday = d.weekday""",
    " ".join(f"h{h:02d}" for h in range(24)),
)
HOURS = f"(SELECT hour({TS})::INTEGER AS hour, {VOLUME} FROM {MONTHLY_TX} t GROUP BY 1)"
DAILY = f"(SELECT d.*, {VOLUME} FROM {MONTHLY_TX} t JOIN {DAYS} d(weekday, weekday_name) ON d.weekday = {WEEKDAY} GROUP BY ALL)"


def pick(column: str, source: str, metric: str, direction: str, tie: str) -> str:
    return f"(SELECT {column} FROM {source} z ORDER BY {metric} {direction}, {tie} LIMIT 1)"


add(
    "e_14",
    lambda t: E.temporal_extremes(monthly_tx(t)),
    f"""SELECT {pick('month', MONTHS, 'transactions', 'DESC', 'month')} AS month_max_volume, (SELECT max(transactions) FROM {MONTHS} z) AS max_month_volume,
 {pick('month', MONTHS, 'fraud_rate', 'ASC', 'month')} AS month_min_rate, (SELECT min(fraud_rate) FROM {MONTHS} z) AS min_month_rate,
 {pick('month', MONTHS, 'fraud_rate', 'DESC', 'month')} AS month_max_rate, (SELECT max(fraud_rate) FROM {MONTHS} z) AS max_month_rate,
 {pick('hour', HOURS, 'fraud_rate', 'DESC', 'hour')} AS hour_max_rate, (SELECT max(fraud_rate) FROM {HOURS} z) AS max_hour_rate,
 {pick('hour', HOURS, 'fraud_rate', 'ASC', 'hour')} AS hour_min_rate, (SELECT min(fraud_rate) FROM {HOURS} z) AS min_hour_rate,
 {pick('weekday_name', DAILY, 'fraud_rate', 'DESC', 'weekday')} AS weekday_max_rate, (SELECT max(fraud_rate) FROM {DAILY} z) AS max_weekday_rate""",
    "min_month_rate max_month_rate max_hour_rate min_hour_rate max_weekday_rate",
)
UPPER = f"(SELECT quantile_cont(amt, 0.75) + 1.5 * (quantile_cont(amt, 0.75) - quantile_cont(amt, 0.25)) FROM {TX} u)"
add(
    "e_15",
    lambda t: E.iqr_outliers(t.tx),
    f"""SELECT (amt > {UPPER})::INTEGER AS amt_outlier_iqr, {VOLUME}, {UPPER} AS upper_limit,
 count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS rows_pct FROM {TX} t GROUP BY 1""",
    "fraud_rate upper_limit rows_pct",
)
add(
    "e_16",
    lambda t: E.tail_segments(t.tx),
    " UNION ALL ".join(
        f"""SELECT 'amt >= {name}' AS segment, any_value(q) AS threshold, count(*) AS n, sum(is_fraud)::BIGINT AS frauds, avg(is_fraud) AS fraud_rate
 FROM {TX} t, (SELECT quantile_cont(amt, {p}) AS q FROM {TX} u) z WHERE amt >= q"""
        for name, p in (("p95", 0.95), ("p99", 0.99), ("p999", 0.999))
    ),
    "threshold fraud_rate",
)
add(
    "e_17",
    lambda t: E.transform_amount(t.tx).select("trans_num", "amt_log1p", "amt_clip_p99"),
    f"SELECT trans_num, ln(1 + greatest(amt, 0)) AS amt_log1p, least(amt, (SELECT quantile_cont(amt, 0.99) FROM {TX} u)) AS amt_clip_p99 FROM {TX} t",
    "amt_log1p amt_clip_p99",
)
add(
    "e_18",
    lambda t: E.sample_n(t.tx, 1000, 42).select("trans_num"),
    f"SELECT trans_num FROM {TX} t ORDER BY sha256(trans_num || '|42'), trans_num LIMIT 1000",
)


def rate_by(key: str, alias: str, view: str = TX, least: int = 1000) -> str:
    return f"SELECT {key} AS {alias}, {VOLUME} FROM {view} t GROUP BY 1 HAVING count(is_fraud) >= {least}"


add("e_19", lambda t: E.risk_rate_by(t.tx, "category", 1000), rate_by("category", "category"), "fraud_rate")
add("e_19_state", lambda t: E.risk_rate_by(t.tx, "state", 3300), rate_by("state", "state", least=3300), "fraud_rate")
BAND = f"CASE WHEN hour({TS}) <= 5 THEN 'madrugada' WHEN hour({TS}) <= 11 THEN 'manana' WHEN hour({TS}) <= 17 THEN 'tarde' ELSE 'noche' END"
add("e_20", lambda t: E.hour_band_rate(t.tx), rate_by(BAND, "hour_band"), "fraud_rate")
add(
    "e_21",
    lambda t: E.card_stats(t.tx),
    f"""SELECT cc_num, count(is_fraud) AS tx_count, sum(is_fraud)::BIGINT AS fraud_count, count(DISTINCT merchant) AS unique_merchants, avg(amt) AS avg_amt,
 avg(is_fraud) AS fraud_rate FROM {TX} t GROUP BY cc_num HAVING count(is_fraud) >= 20 ORDER BY fraud_count DESC, cc_num LIMIT 10""",
    "avg_amt fraud_rate",
)
add(
    "e_22",
    lambda t: E.merchant_stats(t.tx),
    f"""SELECT merchant, count(is_fraud) AS tx_count, sum(is_fraud)::BIGINT AS fraud_count, avg(amt) AS avg_amt, avg(is_fraud) AS fraud_rate
 FROM {TX} t GROUP BY merchant HAVING count(is_fraud) >= 200 ORDER BY fraud_rate DESC, merchant LIMIT 10""",
    "avg_amt fraud_rate",
)
CORR_COLS = ["amt", "is_fraud", "day", "hour", "weekday"]
CALENDAR = f"(SELECT amt, is_fraud, day({TS}) AS day, hour({TS}) AS hour, isodow({TS}) - 1 AS weekday FROM {GAPPY} t)"
PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS var_1, '{b}' AS var_2, corr({a}, {b}) AS corr FROM {CALENDAR} c" for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1 :]
)
add("e_23", lambda t: E.correlations(E.add_calendar(gappy(t)), CORR_COLS), PAIRS, "corr")
add(
    "e_23_target",
    lambda t: E.target_correlations(E.add_calendar(gappy(t)), CORR_COLS),
    " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, is_fraud) AS corr FROM {CALENDAR} c" for c in CORR_COLS if c != "is_fraud"),
    "corr",
)
add("e_24", lambda t: E.collinear_pairs(E.add_calendar(gappy(t)), 0.3, CORR_COLS), f"SELECT * FROM ({PAIRS}) p WHERE abs(corr) >= 0.3", "corr")

# All engineered columns, the computed ones to six digits, so that both engines count the same values. A past without
# spread divides by 1e-9, so A5 spans many powers of ten and is profiled by its logarithm.
A5 = "A5_amt_user_std_score"
A5_SQL = "ln(1 + abs(amt - coalesce(u_mean, g)) / (coalesce(u_std, 0) + 1e-9))"
COMPUTED = [A5, *[c for c, _, is_float in FEATURE_SQL.values() if is_float]]
FEATURES_SQL = "whole_features"


def over_features(sql: str) -> str:
    """SQL over ``whole_features``: every transaction with its label and all engineered columns."""
    cells = {A5: A5_SQL, **{c: expression for c, expression, _ in FEATURE_SQL.values()}}
    columns = [f"round({x} + {SHIFT}::DOUBLE, 6) + 0.0::DOUBLE AS {c}" if c in COMPUTED else f"{x} AS {c}" for c, x in cells.items()]
    return f"WITH whole_features AS MATERIALIZED (SELECT trans_num, is_fraud, {', '.join(columns)} FROM {STATE} w) {sql}"


def whole_features(t):
    built = build_features(t.tx).withColumn(A5, F.log(1 + F.col(A5)))
    return rounded(built, dict.fromkeys(COMPUTED, 6)).select("trans_num", "is_fraud", *FEATURES)


PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, '{c[0]}' AS family, '{"double" if c in COMPUTED else "int"}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) * 100.0::DOUBLE / count(*) AS null_pct,
 true AS is_numeric, var_samp({c}) AS variance, count(DISTINCT {c}) AS n_unique, count(DISTINCT {c})::DOUBLE / count(*) AS unique_ratio FROM {FEATURES_SQL} f"""
    for c in FEATURES
)
PROFILE_SQL = over_features(PROFILE_SQL)


def profiled(t):
    return E.feature_profile(whole_features(t))


add("e_26", profiled, PROFILE_SQL, "null_pct variance:3 unique_ratio")
add(
    "e_26_family",
    lambda t: E.family_summary(profiled(t)),
    f"""SELECT family, count(*) AS n_features, avg(is_numeric::INTEGER) * 100 AS pct_numeric, avg(null_pct) AS avg_null_pct,
 avg(unique_ratio) AS avg_unique_ratio FROM ({PROFILE_SQL}) p GROUP BY family""",
    "pct_numeric avg_null_pct avg_unique_ratio",
)
add(
    "e_27",
    lambda t: E.robust_describe(whole_features(t), FEATURES),
    over_features(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
 {", ".join(f"quantile_cont({c}::DOUBLE, {p}) AS {n}" for n, p in E.DESCRIBE_QUANTILES.items())} FROM {FEATURES_SQL} f"""
            for c in FEATURES
        )
    ),
    "mean std min max p01 p05 p50 p95 p99",
)
KM = """2 * 6371.0::DOUBLE * asin(sqrt(least(1, pow(sin(radians(merch_lat - lat) / 2), 2)
 + cos(radians(lat)) * cos(radians(merch_lat)) * pow(sin(radians(merch_long - long) / 2), 2))))"""


def with_km(t):
    from cardwatch.functions.columns import haversine_km

    return t.placed.select("trans_num", haversine_km("lat", "long", "merch_lat", "merch_long").alias("km"))


add("e_28", with_km, f"SELECT trans_num, {KM} AS km FROM {PLACED} p", "km")
DISTANCE = """count(*) AS n, least(0.5, greatest(0.01, avg((km > 80)::INTEGER))) AS travel_rate,
 least(20.0, greatest(1.5, CASE WHEN count(*) FILTER (WHERE km <= 80) > 5 THEN stddev_pop(km) FILTER (WHERE km <= 80) ELSE 3 END)) AS sigma_km"""
add(
    "e_29",
    lambda t: E.distance_profile(t.placed),
    f"SELECT category, {DISTANCE} FROM (SELECT category, {KM} AS km FROM {PLACED} p) d GROUP BY category",
    "travel_rate sigma_km",
)
add("e_29_global", lambda t: E.distance_profile(t.placed, None), f"SELECT {DISTANCE} FROM (SELECT {KM} AS km FROM {PLACED} p) d", "travel_rate sigma_km")


def amount_sql(by: str) -> str:
    key, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    match = f"AND u.{by} = g.{by}" if by else ""
    return f"""SELECT {key}n, CASE WHEN m3 / pow(sqrt(v), 3) >= 1.5 THEN 'lognormal' ELSE 'gamma' END AS dist, mu, greatest(s, 0.08) AS sigma,
 greatest(m * m / v, 0.2) AS shape, greatest(v / m, 0.5) AS scale, greatest(0.01, a) AS q01, greatest(b, a + 1) AS q99, greatest(c, b + 1) AS q995,
 least(0.05, greatest(0.005, (SELECT avg((amt > g.b)::INTEGER) FROM {TX} u WHERE amt > 0 {match}))) AS tail_rate FROM
 (SELECT {key}count(*) AS n, avg(ln(greatest(amt, 0.01))) AS mu, stddev_pop(ln(greatest(amt, 0.01))) AS s, avg(amt) AS m, var_pop(amt) AS v,
  avg(pow(amt, 3)) - 3 * avg(amt) * avg(amt * amt) + 2 * pow(avg(amt), 3) AS m3,
  quantile_cont(amt, 0.01) AS a, quantile_cont(amt, 0.99) AS b, quantile_cont(amt, 0.995) AS c FROM {TX} t WHERE amt > 0 {group}) g"""


PROFILE_R = "mu sigma shape scale q01 q99 q995 tail_rate"
add("e_30", lambda t: E.amount_profile(t.tx), amount_sql("category"), PROFILE_R)
add("e_30_global", lambda t: E.amount_profile(t.tx, None), amount_sql(""), PROFILE_R)
add(
    "e_31",
    lambda t: E.frequency(t.tx, "category"),
    f"SELECT category, count(*) AS n, count(*)::DOUBLE / (sum(count(*)) OVER ())::DOUBLE AS prob FROM {TX} t GROUP BY category",
    "prob",
)
CITY = f"""SELECT city, state, median(zip) AS zip, median(lat) AS lat, median(long) AS long, median(city_pop) AS city_pop, count(*) AS cnt,
 count(*)::DOUBLE / (sum(count(*)) OVER ())::DOUBLE AS prob FROM {PLACED} p GROUP BY city, state"""
add("e_32", lambda t: E.city_reference(t.placed), CITY, "prob zip lat long city_pop")
add(
    "j_4",
    lambda t: E.city_reference(t.placed).select("city", "state", "cnt"),
    f"SELECT city, state, count(*) AS cnt FROM {TX} t GROUP BY city, state",
)
add("e_33", lambda t: E.merchants_by_category(t.tx), f"SELECT DISTINCT category, merchant FROM {TX} t")
SLOTS = f"""(SELECT 'weekday' AS histogram, s.i::INTEGER AS slot, (SELECT count(*) FROM {TX} t WHERE {WEEKDAY} = s.i) AS n FROM range(7) s(i) UNION ALL
 SELECT 'weekday_hour', s.i::INTEGER, (SELECT count(*) FROM {TX} t WHERE {WEEKDAY} < 5 AND hour({TS}) = s.i) FROM range(24) s(i) UNION ALL
 SELECT 'weekend_hour', s.i::INTEGER, (SELECT count(*) FROM {TX} t WHERE {WEEKDAY} >= 5 AND hour({TS}) = s.i) FROM range(24) s(i))"""
add(
    "e_34",
    lambda t: E.time_histograms(t.tx),
    f"SELECT *, (n + 1)::DOUBLE / (sum(n + 1) OVER (PARTITION BY histogram))::DOUBLE AS prob FROM {SLOTS} s",
    "prob",
)
add(
    "e_35",
    lambda t: E.user_pool(t.placed, [TS, "trans_num"]),
    f"""SELECT cc_num, city, state, zip, lat, long, city_pop FROM (SELECT *, row_number() OVER (PARTITION BY cc_num ORDER BY {TS}, trans_num) AS r
 FROM {PLACED} p) x WHERE r = 1""",
)
HOUR_LIST = "[" + ", ".join(f"(count(*) FILTER (WHERE hour({TS}) = {h}))::INTEGER" for h in range(24)) + "]"
add(
    "e_36",
    lambda t: E.user_hour_profile(t.tx).select("cc_num", F.array_join(F.col("hours").cast("array<string>"), ",").alias("hours")),
    f"SELECT cc_num, array_to_string({HOUR_LIST}, ',') AS hours FROM {TX} t GROUP BY cc_num",
)
RARE = f"""(SELECT cc_num, h FROM (SELECT c.cc_num, s.h, row_number() OVER (PARTITION BY c.cc_num ORDER BY
 (SELECT count(*) FROM {TX} t WHERE t.cc_num = c.cc_num AND hour(t.{TS}) = s.h), s.h) AS r
 FROM (SELECT DISTINCT cc_num FROM {TX} d) c, range(24) s(h)) x WHERE r <= 6)"""
add(
    "e_37",
    lambda t: E.anomaly_flags(t.placed, t.placed.where(F.col(TS) < "2024-01-10")).select(
        "trans_num", "high_amount", "merchant_mismatch", "far_from_home"
    ),
    f"""SELECT trans_num, coalesce(amt > q, false) AS high_amount, k.category IS NULL AS merchant_mismatch, {KM} > 500 AS far_from_home FROM {PLACED} p
 LEFT JOIN (SELECT category, quantile_cont(amt, 0.99) AS q FROM {PLACED} z WHERE {TS} < TIMESTAMP '2024-01-10' GROUP BY 1) l ON l.category = p.category
 LEFT JOIN (SELECT DISTINCT category, merchant FROM {PLACED} z WHERE {TS} < TIMESTAMP '2024-01-10') k
 ON k.category = p.category AND k.merchant = p.merchant""",
)
add(
    "e_37_hours",
    lambda t: E.anomaly_flags(t.tx).select("trans_num", "odd_hour"),
    f"""SELECT trans_num, hour({TS}) < 5 AND EXISTS (SELECT 1 FROM {RARE} r WHERE r.cc_num = t.cc_num AND r.h = hour(t.{TS})) AS odd_hour FROM {TX} t""",
)
