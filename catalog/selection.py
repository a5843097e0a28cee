"""Variable selection over the card log and its features."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardwatch.functions.columns import iv_band
from cardwatch.operators import selection as V
from cardwatch.operators.features import FEATURES
from catalog.profiling import FEATURES_SQL, GAPPY, gappy, over_features, whole_features
from catalog.registry import TX, add, sample_sql

QUALITY_COLS = {"amt": "double", "city": "string", "category": "string", "merchant": "string", "trans_num": "string"}


def quality_sql(view: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, '{d}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) * 100.0::DOUBLE / count(*) AS null_pct,
 count(DISTINCT {c}) AS n_unique, count(DISTINCT {c})::DOUBLE / count(*) AS unique_ratio,
 (SELECT max(n) FROM (SELECT count(*) AS n FROM {view} m GROUP BY {c}) x) * 100.0::DOUBLE / count(*) AS mode_pct FROM {view} q"""
        for c, d in QUALITY_COLS.items()
    )


QUALITY_R = "null_pct unique_ratio mode_pct"
add("v_2", lambda t: V.column_quality(gappy(t), list(QUALITY_COLS)), quality_sql(GAPPY), QUALITY_R)
add(
    "v_3",
    lambda t: V.stratified_sample(t.tx, "is_fraud", 2000, 42).select("trans_num", "is_fraud"),
    sample_sql(2000, 42),
)

BINS = 10
CUTS = ", ".join(str(i / BINS) for i in range(1, BINS))


def mi_source(view: str, texts: list[str], numbers: list[str]) -> str:
    parts = [f"SELECT '{c}' AS feature, coalesce({c}, 'nan') AS value, is_fraud AS y FROM {view} a" for c in texts]
    parts += [
        f"""SELECT '{c}' AS feature, len(list_filter(q.cuts, lambda x: coalesce(a.{c}::DOUBLE, q.mid) > x))::VARCHAR AS value, is_fraud AS y
 FROM {view} a, (SELECT quantile_cont({c}::DOUBLE, [{CUTS}]) AS cuts, quantile_cont({c}::DOUBLE, 0.5) AS mid FROM {view} b) q"""
        for c in numbers
    ]
    return "(" + " UNION ALL ".join(parts) + ")"


def mi_sql(view: str, texts: list[str], numbers: list[str]) -> str:
    return f"""SELECT feature, greatest(0, sum(n::DOUBLE / total * ln(n::DOUBLE * total / (nx::DOUBLE * ny)))) AS mi FROM
 (SELECT feature, value, y, count(*) AS n, sum(count(*)) OVER (PARTITION BY feature, value) AS nx,
  sum(count(*)) OVER (PARTITION BY feature, y) AS ny, sum(count(*)) OVER (PARTITION BY feature) AS total
  FROM {mi_source(view, texts, numbers)} s GROUP BY feature, value, y) c GROUP BY feature"""


TEXTS, NUMBERS = ["city", "category", "merchant", "trans_num"], ["amt"]
add("v_4", lambda t: V.mutual_information(gappy(t), [*TEXTS, *NUMBERS]), mi_sql(GAPPY, TEXTS, NUMBERS), "mi")


def iv_sql(view: str, texts: list[str], numbers: list[str]) -> str:
    buckets = [
        f"""SELECT '{c}' AS feature, CASE WHEN r <= 25 THEN v ELSE 'OTHER' END AS bucket, y FROM (SELECT coalesce({c}, 'nan') AS v, is_fraud AS y FROM {view} a) x
 JOIN (SELECT v AS w, row_number() OVER (ORDER BY count(*) DESC, v) AS r FROM (SELECT coalesce({c}, 'nan') AS v FROM {view} a) z GROUP BY v) top ON top.w = x.v"""
        for c in texts
    ]
    buckets += [
        f"""SELECT '{c}' AS feature, CASE WHEN {c} IS NOT NULL THEN greatest(1, (10 * pos + n - 2) // (n - 1))::VARCHAR END AS bucket, y FROM
 (SELECT {c}, is_fraud AS y, row_number() OVER (PARTITION BY {c} IS NULL ORDER BY {c}, trans_num) - 1 AS pos, count({c}) OVER () AS n FROM {view} a) x"""
        for c in numbers
    ]
    return f"""SELECT feature, sum((dg - db) * ln(dg / db)) AS iv FROM (SELECT feature,
 (good + 0.5::DOUBLE) / ((sum(good) OVER f)::DOUBLE + 0.5::DOUBLE * count(*) OVER f) AS dg, (bad + 0.5::DOUBLE) / ((sum(bad) OVER f)::DOUBLE + 0.5::DOUBLE * count(*) OVER f) AS db
 FROM (SELECT feature, bucket, sum(y) AS bad, count(*) - sum(y) AS good FROM ({" UNION ALL ".join(buckets)}) b GROUP BY feature, bucket) g
 WINDOW f AS (PARTITION BY feature)) d GROUP BY feature"""


add("v_5", lambda t: V.information_value(gappy(t), [*TEXTS, *NUMBERS]), iv_sql(GAPPY, TEXTS, NUMBERS), "iv")
IV_BAND_SQL = """CASE WHEN {x} IS NULL THEN 'na' WHEN {x} < 0.02 THEN 'inutil' WHEN {x} < 0.1 THEN 'debil' WHEN {x} < 0.3 THEN 'medio'
 WHEN {x} < 0.5 THEN 'fuerte' ELSE 'muy_fuerte_o_leakage' END"""
add(
    "v_6",
    lambda t: t.tx.select("trans_num", iv_band(F.when(F.col("category") != "view", F.col("amt") / 200)).alias("iv_band")),
    f"SELECT trans_num, {IV_BAND_SQL.format(x='v')} AS iv_band FROM (SELECT trans_num, CASE WHEN category <> 'view' THEN amt / 200 END AS v FROM {TX} t) x",
)


def report(t):
    data = gappy(t)
    cols = [*TEXTS, *NUMBERS]
    return V.selection_report(V.column_quality(data, cols), V.selection_metrics(data, cols))


add(
    "v_7",
    report,
    f"""SELECT *, CASE WHEN hard_drop OR constant OR high_card_low_signal THEN 'DROP' ELSE 'KEEP' END AS decision FROM (SELECT q.*, m.mi, i.iv,
 {IV_BAND_SQL.format(x='i.iv')} AS iv_band, q.feature IN ('trans_num') AS hard_drop, n_unique <= 1 AS constant,
 unique_ratio > 0.2 AND mi < 0.003 AND iv < 0.05 AS high_card_low_signal, mi < 0.0015 AND iv < 0.02 AS low_signal
 FROM ({quality_sql(GAPPY)}) q JOIN ({mi_sql(GAPPY, TEXTS, NUMBERS)}) m ON m.feature = q.feature
 JOIN ({iv_sql(GAPPY, TEXTS, NUMBERS)}) i ON i.feature = q.feature) z""",
    QUALITY_R + " mi iv",
)
add(
    "v_8",
    lambda t: V.model_input(gappy(t), report(t)),
    f"SELECT amt, category, city, merchant, is_fraud FROM {GAPPY} g",
)
#: A column that knows the label, beside all engineered ones.
LEAK = "Z1_planted_leak"
LEAK_SQL = f"(SELECT *, is_fraud + 0.25::DOUBLE * (L1_user_city_visit_count % 2) AS {LEAK} FROM {FEATURES_SQL})"


def signal(t, planted: bool = False):
    data = whole_features(t)
    if planted:
        data = data.withColumn(LEAK, F.col("is_fraud") + 0.25 * (F.col("L1_user_city_visit_count") % 2))
    return V.feature_signal(data, [*FEATURES, *([LEAK] if planted else [])])


def auc_sql(c: str, view: str) -> str:
    return f"""(SELECT greatest(a, 1 - a) FROM (SELECT sum(bad * (below + good / 2)) / (sum(bad) * sum(good)) AS a FROM
 (SELECT bad, good, coalesce(sum(good) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM
 (SELECT {c} AS v, sum(is_fraud)::DOUBLE AS bad, sum(1 - is_fraud)::DOUBLE AS good FROM {view} f WHERE {c} IS NOT NULL GROUP BY 1) s) p) r)"""


def signal_sql(cols: list[str], view: str) -> str:
    def corr(c: str) -> str:
        return f"CASE WHEN min({c}) < max({c}) THEN corr({c}, is_fraud) END"

    each = [
        f"""SELECT '{c}' AS feature, '{c[0]}' AS family, {corr(c)} AS corr_with_target, abs({corr(c)}) AS abs_corr_with_target,
 {auc_sql(c, view)} AS single_feature_auc FROM {view} f"""
        for c in cols
    ]
    return f"SELECT c.*, m.mi AS mutual_info FROM ({' UNION ALL '.join(each)}) c JOIN ({mi_sql(view, [], cols)}) m ON m.feature = c.feature"


SIGNAL_R = "corr_with_target abs_corr_with_target single_feature_auc mutual_info"
add("v_9", signal, over_features(signal_sql(FEATURES, FEATURES_SQL)), SIGNAL_R)
add(
    "v_10",
    lambda t: V.suspicious(signal(t, True)),
    over_features(f"SELECT * FROM ({signal_sql([*FEATURES, LEAK], LEAK_SQL)}) s WHERE single_feature_auc >= 0.95 OR mutual_info > 0.3"),
    SIGNAL_R,
)
