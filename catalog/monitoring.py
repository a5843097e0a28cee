"""Filters and monitoring reads over the bound predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardwatch.bindings import VERSION_ORDER
from cardwatch.operators import summaries as S
from cardwatch.operators.filters import not_blank
from cardwatch.operators.versions import latest_predictions
from catalog.registry import LATEST, PRED, TS, add, as_double

NEW = {"newest": VERSION_ORDER}

MEASURES = """count(*) AS transaction_count, count(*) FILTER (WHERE prediction) AS fraud_count,
 count(*) FILTER (WHERE prediction)::DOUBLE / count(*) AS fraud_rate,
 coalesce(avg(risk_score::DOUBLE), 0) AS avg_risk_score, coalesce(max(risk_score)::DOUBLE, 0) AS max_risk_score"""
RATES = "fraud_rate avg_risk_score max_risk_score"
LABEL_SQL = "CASE WHEN prediction THEN 'fraud' WHEN NOT prediction THEN 'legit' ELSE 'pending' END"


def by_key(key: str, where: str = "true", top: int = 15) -> str:
    return f"""SELECT {key}, {MEASURES}, coalesce(sum(amt), 0) AS total_amount FROM {LATEST} lp WHERE {where}
 GROUP BY {key} ORDER BY fraud_count DESC, fraud_rate DESC, avg_risk_score DESC, {key} ASC LIMIT {top}"""


def filtered(name: str, where: str, **options) -> None:
    add(name, lambda t: S.category_summary(t.pred, **NEW, **options), by_key("category", where), RATES + " total_amount:2")


filtered("p_1", f"{TS} >= DATE '1998-01-01'", start_date="1998-01-01")
filtered("p_2", f"{TS} < DATE '1998-06-30' + INTERVAL 1 DAY", end_date="1998-06-30")
filtered("p_3", "created_at >= DATE '1999-01-01'", created_start_date="1999-01-01")
filtered("p_4", "created_at < DATE '1999-12-31' + INTERVAL 1 DAY", created_end_date="1999-12-31")
filtered("p_5", "risk_score >= 0.7", min_risk_score=0.7)
filtered("p_6", "merchant = 'Supplier#000000007'", merchant="Supplier#000000007")
filtered("p_7", "category = '2-HIGH'", category="2-HIGH")
filtered("p_8", "prediction", only_fraud=True)
filtered(
    "p_9",
    f"{TS} >= DATE '1997-01-01' AND {TS} < DATE '2000-12-31' + INTERVAL 1 DAY AND risk_score >= 0.3 AND category = '5-LOW' AND prediction",
    start_date="1997-01-01",
    end_date="2000-12-31",
    min_risk_score=0.3,
    category="5-LOW",
    only_fraud=True,
)
add(
    "p_10",
    lambda t: t.pred.where(not_blank("merchant")).agg(F.count(F.lit(1)).alias("n")),
    f"SELECT count(*) AS n FROM {PRED} p WHERE merchant IS NOT NULL AND trim(merchant) <> ''",
)

VERSION = f"trans_num, created_at, id1, id2, id3, {TS}, cc_num, merchant, category, amt, prediction"
DOUBLE_RISK = "risk_score::DOUBLE AS risk_score"
add(
    "q_1",
    lambda t: as_double(latest_predictions(t.pred, VERSION_ORDER), "risk_score").select(*VERSION.split(", "), "risk_score"),
    f"SELECT {VERSION}, {DOUBLE_RISK} FROM {LATEST} lp",
)
add("q_2", lambda t: S.unique_merchants(t.pred), f"SELECT DISTINCT merchant FROM {PRED} p WHERE trim(merchant) <> ''")
add("q_3", lambda t: S.unique_categories(t.pred), f"SELECT DISTINCT category FROM {PRED} p WHERE trim(category) <> ''")
add("q_4", lambda t: S.date_bounds(t.pred), f"SELECT min({TS})::DATE AS min_date, max({TS})::DATE AS max_date FROM {PRED} p")
add(
    "q_5",
    lambda t: S.prediction_date_bounds(t.pred),
    f"SELECT min(created_at)::DATE AS min_date, max(created_at)::DATE AS max_date FROM {PRED} p",
)


def recent(where: str = "true", limit: int = 100, offset: int = 0) -> str:
    order = f"coalesce(risk_score, -1) DESC, {TS} DESC NULLS FIRST, trans_num ASC"
    return f"""SELECT trans_num, {TS}, amt, merchant, category, {DOUBLE_RISK}, {LABEL_SQL} AS prediction,
 prediction AS prediction_raw, row_number() OVER (ORDER BY {order}) AS rank,
 {TS} AS transaction_created_at, created_at AS prediction_created_at
 FROM {LATEST} lp WHERE {where} ORDER BY {order} LIMIT {limit} OFFSET {offset}"""


add("q_6", lambda t: as_double(S.recent_transactions(t.pred, 100, 40, **NEW), "risk_score"), recent(offset=40))


def last_page(t):
    """A page that ends 30 rows before the last one, found by ranges of the order."""
    n = latest_predictions(t.pred, VERSION_ORDER).count()
    return as_double(S.recent_transactions(t.pred, 100, max(n - 130, 0), rows_per_task=1000, **NEW), "risk_score")


add("q_6_deep", last_page, recent(offset=f"(SELECT greatest(count(*) - 130, 0) FROM {LATEST} ld)"))
add(
    "q_6_filtered",
    lambda t: as_double(S.recent_transactions(t.pred, 50, min_risk_score=0.5, category="1-URGENT", **NEW), "risk_score"),
    recent("risk_score >= 0.5 AND category = '1-URGENT'", 50),
)

KPI = """SELECT count(*)::DOUBLE AS total_transactions, (count(*) FILTER (WHERE prediction))::DOUBLE AS fraud_count,
 coalesce(sum(CASE WHEN prediction THEN amt ELSE 0 END), 0) AS amount_saved,
 coalesce(avg(CASE WHEN prediction THEN amt END), 0) AS avg_fraud_amount,
 coalesce(avg(risk_score::DOUBLE), 0) AS avg_risk_score, coalesce(max(risk_score)::DOUBLE, 0) AS max_risk_score,
 coalesce((count(*) FILTER (WHERE prediction))::DOUBLE / nullif(count(*), 0), 0) AS fraud_rate"""
KPI_R = "amount_saved:2 avg_fraud_amount avg_risk_score max_risk_score fraud_rate"
add("q_7", lambda t: S.kpis(t.pred, **NEW), f"{KPI} FROM {PRED} p", KPI_R)
add("q_7_latest", lambda t: S.kpis(t.pred, latest_only=True, **NEW), f"{KPI} FROM {LATEST} p", KPI_R)
add("q_7_empty", lambda t: S.kpis(t.pred, min_risk_score=2.0, **NEW), f"{KPI} FROM {PRED} p WHERE risk_score >= 2", KPI_R)

COUNTS = "count(*) FILTER (WHERE prediction) AS fraud_count, avg(risk_score::DOUBLE) AS avg_risk_score"
OVER_TIME = f"SELECT {TS}::DATE AS date, {COUNTS} FROM {LATEST} lp GROUP BY {TS}::DATE"
add("q_8", lambda t: S.fraud_over_time(t.pred, **NEW), OVER_TIME, "avg_risk_score")
add(
    "q_9",
    lambda t: S.merchant_ranking(t.pred, 10, **NEW),
    f"""SELECT merchant, {COUNTS} FROM {LATEST} lp GROUP BY merchant
 HAVING count(*) FILTER (WHERE prediction) > 0 ORDER BY fraud_count DESC, avg_risk_score DESC, merchant ASC LIMIT 10""",
    "avg_risk_score",
)
RISK = f"""SELECT format('{{:.1f}} - {{:.1f}}', bucket_index / 10.0::DOUBLE, (bucket_index + 1) / 10.0::DOUBLE) AS risk_score_bucket,
 count(*) AS count, bucket_index FROM (SELECT least(9, greatest(0, floor(coalesce(risk_score, 0) * 10)::INTEGER))
 AS bucket_index FROM {LATEST} lp) b GROUP BY bucket_index"""
add("q_10", lambda t: S.risk_distribution(t.pred, **NEW), RISK)
add(
    "q_11",
    lambda t: as_double(S.transaction_detail(t.pred, "1243-7", VERSION_ORDER), "risk_score"),
    f"""SELECT trans_num, {TS}, cc_num, merchant, category, amt, city, state, {DOUBLE_RISK},
 {LABEL_SQL} AS prediction, prediction AS prediction_raw, created_at AS prediction_created_at
 FROM {LATEST} lp WHERE trans_num = '1243-7'""",
)
add("q_12", lambda t: S.category_summary(t.pred, **NEW), by_key("category"), RATES + " total_amount:2")
add("q_13", lambda t: S.merchant_summary(t.pred, **NEW), by_key("merchant"), RATES + " total_amount:2")
HOURLY = f"SELECT hour({TS})::INTEGER AS hour_of_day, {MEASURES} FROM {LATEST} lp GROUP BY 1"
add("q_14", lambda t: S.hourly_summary(t.pred, **NEW), HOURLY, RATES)
AMOUNT = f"""SELECT bucket_start, {MEASURES}, format('${{:,}}-${{:,}}', bucket_start::BIGINT, bucket_start::BIGINT + 4999) AS bucket_label
 FROM (SELECT *, floor(coalesce(amt, 0) / 5000.0::DOUBLE) * 5000.0::DOUBLE AS bucket_start FROM {LATEST} lp) b
 GROUP BY bucket_start ORDER BY bucket_start LIMIT 24"""
add("q_15", lambda t: S.amount_bucket_summary(t.pred, 5000.0, **NEW), AMOUNT, RATES)
add(
    "q_16",
    lambda t: as_double(S.top_risk(S.recent_transactions(t.pred, 200, **NEW)), "risk_score").select("trans_num", "merchant", "risk_score"),
    f"""SELECT trans_num, merchant, risk_score FROM ({recent(limit=200)}) r
 ORDER BY risk_score DESC NULLS LAST, coalesce(prediction_created_at, transaction_created_at) DESC NULLS LAST, trans_num LIMIT 5""",
)
add(
    "q_17",
    lambda t: S.flag_high_risk(latest_predictions(t.pred, VERSION_ORDER)).select("trans_num", "high_risk", "status"),
    f"""SELECT trans_num, coalesce(risk_score >= 0.8, false) AS high_risk,
 CASE WHEN prediction THEN 'Fraud' WHEN NOT prediction THEN 'Legit' ELSE 'Pending' END AS status FROM {LATEST} lp""",
)
SUMMARY_SQL = {
    "fraud_over_time": OVER_TIME,
    "risk_distribution": RISK,
    "category_summary": by_key("category"),
    "merchant_summary": by_key("merchant"),
    "hourly_summary": HOURLY,
    "amount_bucket_summary": AMOUNT.replace("5000.0", "10000.0").replace("4999", "9999"),
}
for chart, (summary, key, metric) in S.CHARTS.items():
    size = {"bucket_size": 10000.0} if summary == "amount_bucket_summary" else {}
    add(
        f"q_19_{chart}",
        lambda t, chart=chart, size=size: S.chart(t.pred, chart, **NEW, **size),
        f"SELECT {key}, {metric} FROM ({SUMMARY_SQL[summary]}) s",
        metric if metric in ("avg_risk_score", "fraud_rate", "max_risk_score") else "",
    )
