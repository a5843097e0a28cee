"""Metrics of scored rows: few ties (amount score) and many ties (stored risk)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardwatch.operators import evaluate as X
from catalog.registry import EVALUATED, EVALUATED_BY, SCORED, add, as_double


def counts(view: str) -> str:
    return f"""(SELECT count(*) FILTER (WHERE is_fraud = 0 AND NOT prediction) AS tn, count(*) FILTER (WHERE is_fraud = 0 AND prediction) AS fp,
 count(*) FILTER (WHERE is_fraud = 1 AND NOT prediction) AS fn, count(*) FILTER (WHERE is_fraud = 1 AND prediction) AS tp FROM {view} v)"""


def steps(view: str) -> str:
    return f"""(SELECT *, sum(hits) OVER w AS tp, sum(misses) OVER w AS fp, sum(hits) OVER () AS positives, sum(misses) OVER () AS negatives
 FROM (SELECT risk_score::DOUBLE AS score, sum(is_fraud)::DOUBLE AS hits, sum(1 - is_fraud)::DOUBLE AS misses FROM {view} v GROUP BY 1) g
 WINDOW w AS (ORDER BY score DESC))"""


PRF = "tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall, 2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0) AS f1"
MCC = "(tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn)::DOUBLE * (tn + fp)::DOUBLE * (tn + fn)::DOUBLE)"
ACC = f"""(tp + tn)::DOUBLE / (tn + fp + fn + tp) AS accuracy,
 (tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2 AS balanced_accuracy, {MCC} AS mcc"""
ROC = "sum(misses * (tp - hits + hits / 2)) / max(positives * negatives)"
P0 = "CASE WHEN tp - hits + fp - misses = 0 THEN 1 ELSE (tp - hits) / (tp - hits + fp - misses) END"
TRAPEZOID = f"sum(hits * (tp / (tp + fp) + {P0}) / 2) / max(positives)"
AP = "sum(hits * tp / (tp + fp)) / max(positives)"

add(
    "x_0",
    lambda t: as_double(X.evaluation_frame(t.truth, t.by_order, **EVALUATED_BY), "risk_score"),
    f"SELECT trans_num, is_fraud, prediction, risk_score::DOUBLE AS risk_score, created_at FROM {EVALUATED} e",
)
for suffix, view, frame in (("", SCORED, lambda t: t.scored), ("_ties", EVALUATED, lambda t: t.evaluated)):
    add(f"x_1{suffix}", lambda t, f=frame: X.confusion(f(t)), f"SELECT tn, fp, fn, tp FROM {counts(view)} c")
    add(f"x_2{suffix}", lambda t, f=frame: X.prf(f(t)), f"SELECT {PRF} FROM {counts(view)} c", "precision recall f1")
    add(
        f"x_3{suffix}",
        lambda t, f=frame: X.accuracy_family(f(t)),
        f"SELECT {ACC} FROM {counts(view)} c",
        "accuracy balanced_accuracy mcc",
    )
    add(f"x_4{suffix}", lambda t, f=frame: X.roc_auc(f(t)), f"SELECT {ROC} AS roc_auc FROM {steps(view)} s", "roc_auc")
    add(
        f"x_5{suffix}",
        lambda t, f=frame: X.pr_auc_trapezoid(f(t)),
        f"SELECT {TRAPEZOID} AS pr_auc_trapezoid FROM {steps(view)} s",
        "pr_auc_trapezoid",
    )
    add(
        f"x_6{suffix}",
        lambda t, f=frame: X.average_precision(f(t)),
        f"SELECT {AP} AS average_precision FROM {steps(view)} s",
        "average_precision",
    )
    add(
        f"x_7_roc{suffix}",
        lambda t, f=frame: X.roc_curve(f(t)),
        f"""SELECT score AS threshold, fp / negatives AS fpr, tp / positives AS tpr FROM {steps(view)} s
 UNION ALL SELECT NULL, 0.0::DOUBLE, 0.0::DOUBLE""",
        "fpr tpr",
    )
    add(
        f"x_7_pr{suffix}",
        lambda t, f=frame: X.pr_curve(f(t)),
        f"""SELECT score AS threshold, tp / (tp + fp) AS precision, tp / positives AS recall FROM {steps(view)} s
 UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE""",
        "precision recall",
    )
    ranked = f"""(SELECT is_fraud, row_number() OVER (ORDER BY risk_score DESC, trans_num) - 1 AS pos, count(*) OVER () AS n,
 sum(is_fraud) OVER () AS positives FROM {view} v)"""
    add(
        f"x_8{suffix}",
        lambda t, f=frame: X.precision_recall_at_k(f(t)),
        f"""SELECT f AS k_frac, greatest(1, floor(n * f))::BIGINT AS k_abs,
 sum(CASE WHEN pos < greatest(1, floor(n * f)) THEN is_fraud ELSE 0 END)::DOUBLE / greatest(1, floor(n * f)) AS precision_at_k,
 sum(CASE WHEN pos < greatest(1, floor(n * f)) THEN is_fraud ELSE 0 END)::DOUBLE / positives AS recall_at_k
 FROM {ranked} r, (VALUES (0.01::DOUBLE), (0.02::DOUBLE), (0.05::DOUBLE), (0.10::DOUBLE)) v(f) GROUP BY f, n, positives""",
        "precision_at_k recall_at_k",
    )
    add(
        f"x_9{suffix}",
        lambda t, f=frame: X.lift_table(f(t)),
        f"""SELECT greatest(1, (10 * pos + n - 2) // (n - 1))::INTEGER AS decile, count(*) AS n, avg(is_fraud) AS fraud_rate,
 sum(is_fraud)::BIGINT AS fraud_count, avg(is_fraud) / (max(positives)::DOUBLE / max(r.n)) AS lift FROM {ranked} r GROUP BY 1""",
        "fraud_rate lift",
    )
    both = f"""{counts(view)} c, (SELECT {ROC} AS roc_auc, {TRAPEZOID} AS pr_auc_trapezoid, {AP} AS average_precision FROM {steps(view)} s) a"""
    add(
        f"x_10{suffix}",
        lambda t, f=frame: X.metrics_row(f(t)),
        f"""SELECT tn + fp + fn + tp AS rows_joined, (tp + fn)::DOUBLE / (tn + fp + fn + tp) AS fraud_rate, {PRF}, {ACC},
 roc_auc, pr_auc_trapezoid, average_precision, pr_auc_trapezoid AS pr_auc FROM {both}""",
        "fraud_rate precision recall f1 accuracy balanced_accuracy mcc roc_auc pr_auc_trapezoid average_precision pr_auc",
    )


def results(t, shift: float):
    """Result rows of two rule-based models per category, as a leaderboard input."""
    by = t.scored.groupBy(F.col("category").alias("model"))
    hit = F.sum(F.col("is_fraud") * F.col("prediction").cast("int"))
    return by.agg(
        (F.avg("is_fraud") + shift).alias("pr_auc"),
        (hit / F.sum("is_fraud")).alias("recall"),
        (hit / F.sum(F.col("prediction").cast("int"))).alias("precision"),
        F.avg("amt").alias("fit_time_sec"),
    )


def results_sql(shift: float) -> str:
    return f"""(SELECT category AS model, avg(is_fraud) + {shift}::DOUBLE AS pr_auc, sum(is_fraud * prediction::INTEGER) / sum(is_fraud) AS recall,
 sum(is_fraud * prediction::INTEGER) / sum(prediction::INTEGER) AS precision, avg(amt) AS fit_time_sec FROM {SCORED} s GROUP BY 1)"""


def cross_validated(t):
    return t.scored.groupBy(F.col("category").alias("model")).agg(
        F.avg("is_fraud").alias("pr_auc_mean"), F.stddev_pop("is_fraud").alias("pr_auc_std"), F.sum("amt").alias("cv_wall_time_sec")
    )


CV = f"(SELECT category AS model, avg(is_fraud) AS pr_auc_mean, stddev_pop(is_fraud) AS pr_auc_std, sum(amt) AS cv_wall_time_sec FROM {SCORED} s GROUP BY 1)"
add("x_11_leaderboard", lambda t: X.leaderboard(results(t, 0.0)), f"SELECT * FROM {results_sql(0.0)} r", "pr_auc recall precision fit_time_sec")
add(
    "x_11_quality_per_minute",
    lambda t: X.quality_per_minute(cross_validated(t)),
    f"SELECT *, cv_wall_time_sec / 60 AS cv_time_min, pr_auc_mean / (cv_wall_time_sec / 60) AS pr_auc_per_min FROM {CV} c",
    "pr_auc_mean pr_auc_std cv_wall_time_sec cv_time_min pr_auc_per_min",
)
add(
    "x_11_versions",
    lambda t: X.stack_versions(results(t, 0.0), results(t, 0.1)),
    f"SELECT *, 'baseline' AS version FROM {results_sql(0.0)} a UNION ALL SELECT *, 'tuned' AS version FROM {results_sql(0.1)} b",
    "pr_auc recall precision fit_time_sec",
)
add(
    "x_11_compare",
    lambda t: X.compare_runs(cross_validated(t), results(t, 0.05), results(t, 0.1).where("model <> 'click'")),
    f"""SELECT c.model, pr_auc_mean, pr_auc_std, h.pr_auc AS holdout_pr_auc, u.pr_auc AS tuned_holdout_pr_auc,
 h.pr_auc - pr_auc_mean AS delta_holdout_vs_cv, u.pr_auc - h.pr_auc AS delta_tuned_vs_holdout FROM {CV} c
 LEFT JOIN {results_sql(0.05)} h ON h.model = c.model LEFT JOIN (SELECT * FROM {results_sql(0.1)} x WHERE model <> 'click') u ON u.model = c.model""",
    "pr_auc_mean pr_auc_std holdout_pr_auc tuned_holdout_pr_auc delta_holdout_vs_cv delta_tuned_vs_holdout",
)
add(
    "x_12",
    lambda t: X.evaluation_report(t.truth, t.by_order, **EVALUATED_BY),
    f"""SELECT tn + fp + fn + tp AS rows_joined, (tp + fn)::DOUBLE / (tn + fp + fn + tp) AS fraud_rate, {PRF}, pr_auc
 FROM {counts(EVALUATED)} c, (SELECT {TRAPEZOID} AS pr_auc FROM {steps(EVALUATED)} s) a""",
    "fraud_rate precision recall f1 pr_auc",
)
add(
    "x_13",
    lambda t: X.scoring_summary(t.scored, 2.0, 0.02),
    f"""SELECT count(*) AS n_transactions, 0.02::DOUBLE AS fraud_ratio_target, avg(is_fraud) AS fraud_ratio_observed, sum(is_fraud)::BIGINT AS fraud_count,
 2.0::DOUBLE AS total_time_sec, 2000.0::DOUBLE / count(*) AS avg_latency_ms, count(*) / 2.0::DOUBLE AS throughput_txn_per_sec FROM {SCORED} s""",
    "fraud_ratio_observed avg_latency_ms",
)
