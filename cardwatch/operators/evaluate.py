"""Metrics of scored, labelled rows at any size.

Score-based metrics first merge rows of equal score, then take running sums
in score order; nothing is sorted in one task. Input columns: ``is_fraud``,
``risk_score`` and, for threshold metrics, ``prediction``.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwatch.functions.columns import count_where
from cardwatch.operators.versions import NEWEST, latest_predictions
from cardwatch.plans.prefix import equal_bin, prefix_sum
from cardwatch.plans.slices import ROWS_PER_SLICE
from cardwatch.schemas import LABEL
from cardwatch.session import ensure_checkpoint_dir, written

TOP_FRACTIONS = (0.01, 0.02, 0.05, 0.10)


def evaluation_frame(tx: DataFrame, pred: DataFrame, batch_id: str | None = None, newest=NEWEST, within=()) -> DataFrame:
    """Ground truth joined to the newest prediction (of one batch, if given); ``within`` as in ``latest_predictions``."""
    if batch_id:
        pred = pred.where(F.col("batch_id") == batch_id)
    latest = latest_predictions(pred, newest, within).select("trans_num", "prediction", "risk_score", "created_at")
    truth = tx.select("trans_num", LABEL)
    return truth.join(latest, "trans_num").select("trans_num", LABEL, "prediction", "risk_score", "created_at")


# --- threshold metrics ---------------------------------------------------------


def confusion(df: DataFrame, label: str = LABEL, predicted: str = "prediction") -> DataFrame:
    y, p = F.col(label).cast("int") == 1, F.col(predicted).cast("int") == 1
    return df.agg(
        count_where(~y & ~p).alias("tn"),
        count_where(~y & p).alias("fp"),
        count_where(y & ~p).alias("fn"),
        count_where(y & p).alias("tp"),
    )


def _rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 when whole is 0."""
    return F.when(whole == 0, 0.0).otherwise(part.cast("double") / F.nullif(whole, F.lit(0)))


def _prf_columns() -> dict[str, Column]:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    some = tn + fp + fn + tp > 0
    return {
        "precision": F.when(some, _rate(tp, tp + fp)),
        "recall": F.when(some, _rate(tp, tp + fn)),
        "f1": F.when(some, _rate(2 * tp, 2 * tp + fp + fn)),
    }


def prf(df: DataFrame) -> DataFrame:
    """Precision, recall and F1; NULL on empty input."""
    return confusion(df).select(*[c.alias(n) for n, c in _prf_columns().items()])


def _accuracy_columns() -> dict[str, Column]:
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    # A class without rows does not enter the balanced mean.
    tpr, tnr = tp / F.nullif(tp + fn, F.lit(0.0)), tn / F.nullif(tn + fp, F.lit(0.0))
    present = tpr.isNotNull().cast("int") + tnr.isNotNull().cast("int")
    balanced = (F.coalesce(tpr, F.lit(0.0)) + F.coalesce(tnr, F.lit(0.0))) / F.nullif(present, F.lit(0))
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return {
        "accuracy": (tp + tn) / F.nullif(n, F.lit(0.0)),
        "balanced_accuracy": balanced,
        "mcc": F.when(n > 0, F.coalesce((tp * tn - fp * fn) / F.nullif(spread, F.lit(0.0)), F.lit(0.0))),
    }


def accuracy_family(df: DataFrame) -> DataFrame:
    return confusion(df).select(*[c.alias(n) for n, c in _accuracy_columns().items()])


# --- score curves ----------------------------------------------------------------


def score_steps(df: DataFrame, label: str = LABEL, score: str = "risk_score", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """One row per distinct score, best first, with running class counts.

    Columns: score, hits, misses (rows at this score), tp, fp (rows at or
    above), positives, negatives (totals).
    """
    y = F.col(label).cast("int")
    steps = df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(y).cast("long").alias("hits"), F.sum(1 - y).cast("long").alias("misses")
    )
    return placed_steps(written(steps), rows_per_slice)


def placed_steps(steps: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Running class counts over (score, hits, misses) rows, best score first."""
    distinct, *totals = steps.agg(F.count(F.lit(1)), F.sum("hits"), F.sum("misses")).first()
    down = steps.withColumn("__down", -F.col("score"))
    placed = prefix_sum(down, ["__down"], ["hits", "misses"], (), rows_per_slice, n=distinct)
    return placed.select(
        "score",
        "hits",
        "misses",
        F.col("cum_hits").alias("tp"),
        F.col("cum_misses").alias("fp"),
        F.lit(totals[0] or 0).cast("long").alias("positives"),
        F.lit(totals[1] or 0).cast("long").alias("negatives"),
    )


def _both_classes() -> Column:
    return (F.max("positives") > 0) & (F.max("negatives") > 0)


def _precision(tp: Column, fp: Column) -> Column:
    """Precision at a step; the empty prediction counts as 1."""
    return F.when(tp + fp == 0, 1.0).otherwise(tp / F.nullif(tp + fp, F.lit(0)))


def _ranking_columns() -> dict[str, Column]:
    """AUCs as plain sums over steps: each step knows its own and its previous counts."""
    hits, misses, tp, fp = (F.col(c).cast("double") for c in ("hits", "misses", "tp", "fp"))
    positives, negatives = F.max("positives").cast("double"), F.max("negatives").cast("double")
    before_tp, before_fp = tp - hits, fp - misses
    pairs = F.sum(misses * (before_tp + hits / 2))
    trapezoid = F.sum(hits * (_precision(tp, fp) + _precision(before_tp, before_fp)) / 2)
    step = F.sum(hits * _precision(tp, fp))
    return {
        "roc_auc": F.when(_both_classes(), pairs / F.nullif(positives * negatives, F.lit(0.0))),
        "pr_auc_trapezoid": F.when(_both_classes(), trapezoid / F.nullif(positives, F.lit(0.0))),
        "average_precision": F.when(_both_classes(), step / F.nullif(positives, F.lit(0.0))),
    }


def ranking_metrics(df: DataFrame, names=("roc_auc", "pr_auc_trapezoid", "average_precision"), **options) -> DataFrame:
    """The area metrics, all from one pass over the score steps; NULL with one class."""
    return _areas(score_steps(df, **options), names)


def _areas(steps: DataFrame, names=("roc_auc", "pr_auc_trapezoid", "average_precision")) -> DataFrame:
    columns = _ranking_columns()
    return steps.agg(*[columns[n].alias(n) for n in names])


def grouped_average_precision(
    df: DataFrame, by: list[str], label: str = LABEL, score: str = "risk_score", rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Exact average precision of each group; NULL where a class is missing.

    Equal scores are merged first, so a group is as long as its number of distinct scores.
    """
    y = F.col(label).cast("int")
    steps = df.groupBy(*by, (-F.col(score).cast("double")).alias("__down")).agg(
        F.sum(y).cast("long").alias("hits"), F.sum(1 - y).cast("long").alias("misses")
    )
    placed = prefix_sum(steps, ["__down"], ["hits", "misses"], by, rows_per_slice)
    positives, negatives = F.sum("hits"), F.sum("misses")
    gained = F.sum(F.col("hits") * F.col("cum_hits") / (F.col("cum_hits") + F.col("cum_misses")))
    return placed.groupBy(*by).agg(F.when((positives > 0) & (negatives > 0), gained / positives).alias("average_precision"))


def roc_auc(df: DataFrame, **options) -> DataFrame:
    return ranking_metrics(df, ("roc_auc",), **options)


def pr_auc_trapezoid(df: DataFrame, **options) -> DataFrame:
    """Area under the precision-recall line, starting at recall 0, precision 1."""
    return ranking_metrics(df, ("pr_auc_trapezoid",), **options)


def average_precision(df: DataFrame, **options) -> DataFrame:
    """Step-wise area: precision weighted by recall gained."""
    return ranking_metrics(df, ("average_precision",), **options)


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.nullif(F.col(whole), F.lit(0)).cast("double")


def _with_start(points: DataFrame, start: tuple) -> DataFrame:
    """Curves begin before the first row: no threshold, nothing predicted positive."""
    return points.unionByName(points.sparkSession.createDataFrame([start], points.schema))


def roc_curve(df: DataFrame, **options) -> DataFrame:
    """False and true positive rate at every distinct score, and the start (0, 0)."""
    points = score_steps(df, **options).select(
        F.col("score").alias("threshold"),
        _share("fp", "negatives").alias("fpr"),
        _share("tp", "positives").alias("tpr"),
    )
    return _with_start(points, (None, 0.0, 0.0))


def pr_curve(df: DataFrame, **options) -> DataFrame:
    """Precision and recall at every distinct score, and the start (1, 0)."""
    points = score_steps(df, **options).select(
        F.col("score").alias("threshold"),
        _precision(F.col("tp"), F.col("fp")).alias("precision"),
        _share("tp", "positives").alias("recall"),
    )
    return _with_start(points, (None, 1.0, 0.0))


# --- ranked positions --------------------------------------------------------------


def ranked_by_score(
    df: DataFrame,
    label: str = LABEL,
    score: str = "risk_score",
    key: str = "trans_num",
    rows_per_slice: int = ROWS_PER_SLICE,
    n: int | None = None,
) -> DataFrame:
    """``pos`` by descending score, equal scores by key."""
    narrow = df.select(
        F.col(key), F.col(label).cast("int").alias("y"), (-F.col(score).cast("double")).alias("__down")
    )
    return prefix_sum(narrow, ["__down", key], (), (), rows_per_slice, n=n)


def rank_scores(df: DataFrame, score: str = "risk_score", by: list[str] = (), key: str = "trans_num", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """1-based ``rank`` by descending score, within ``by``."""
    down = df.withColumn("__down", -F.col(score).cast("double"))
    placed = prefix_sum(down, ["__down", key], (), by, rows_per_slice)
    return placed.withColumn("rank", F.col("pos") + 1).drop("pos", "__down")


def _scores_written(df: DataFrame, label: str = LABEL, score: str = "risk_score", key: str = "trans_num", **_) -> DataFrame:
    """What ranks need of the rows, written once."""
    return written(df.select(*dict.fromkeys([key, label, LABEL, score])))


def precision_recall_at_k(df: DataFrame, fractions=TOP_FRACTIONS, **options) -> DataFrame:
    """Precision and recall among the top share of rows."""
    spark, df = df.sparkSession, _scores_written(df, **options)
    n, positives = df.agg(F.count(F.lit(1)), F.sum(F.col(LABEL).cast("int"))).first()
    sizes = {f: max(1, int(n * f)) for f in fractions}
    ranked = ranked_by_score(df, n=n, **options)
    hits = ranked.agg(
        *[F.sum(F.when(F.col("pos") < k, F.col("y"))).alias(f"h{i}") for i, k in enumerate(sizes.values())]
    ).first()
    schema = "k_frac double, k_abs long, precision_at_k double, recall_at_k double"
    rows = []
    for i, (f, k) in enumerate(sizes.items()):
        hit = hits[i] or 0
        # Fewer rows than k: the mean is over what is there.
        rows.append((f, k, hit / min(k, n) if n else None, hit / positives if positives else 0.0))
    return spark.createDataFrame(rows, schema)


def lift_table(df: DataFrame, bins: int = 10, **options) -> DataFrame:
    """Fraud rate per equal-count score bin against the overall rate, best bin first."""
    df = _scores_written(df, **options)
    n, positives = df.agg(F.count(F.lit(1)), F.sum(F.col(LABEL).cast("int"))).first()
    base = (positives or 0) / n if n else None
    ranked = ranked_by_score(df, n=n, **options)
    table = ranked.groupBy(equal_bin(F.col("pos"), F.lit(n).cast("long"), bins).alias("decile")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("fraud_rate"), F.sum("y").cast("long").alias("fraud_count")
    )
    lift = F.col("fraud_rate") / F.nullif(F.lit(base).cast("double"), F.lit(0.0))
    return table.withColumn("lift", lift).orderBy("decile")


# --- bundles -------------------------------------------------------------------------


def evaluation_report(tx: DataFrame, pred: DataFrame, batch_id: str | None = None, newest=NEWEST, within=(), **options) -> DataFrame:
    """Rows joined, fraud rate, precision, recall, F1 and PR-AUC in one row."""
    frame = evaluation_frame(tx, pred, batch_id, newest, within)
    return metrics_row(frame, **options).select("rows_joined", "fraud_rate", "precision", "recall", "f1", "pr_auc")


def metrics_row(frame: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """All threshold and ranking metrics in one row.

    The frame is read once: rows are merged per (score, label, prediction) and
    every metric works on those merged rows, held until they are done.
    """
    y, p = F.col(LABEL).cast("int"), F.col("prediction").cast("int")
    levels = frame.groupBy(F.col("risk_score").cast("double").alias("score"), y.alias("y"), p.alias("p"))
    levels = levels.agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        return _metrics_of_levels(levels, rows_per_slice)
    finally:
        levels.unpersist()


def _metrics_of_levels(levels: DataFrame, rows_per_slice: int) -> DataFrame:
    def size(y: int, p: int) -> Column:
        return F.coalesce(F.sum(F.when((F.col("y") == y) & (F.col("p") == p), F.col("n"))), F.lit(0))

    table = levels.agg(size(0, 0).alias("tn"), size(0, 1).alias("fp"), size(1, 0).alias("fn"), size(1, 1).alias("tp"))
    counts = table.select(
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("rows_joined"),
        _rate(F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("fraud_rate"),
        *[c.alias(name) for name, c in {**_prf_columns(), **_accuracy_columns()}.items()],
    ).first()
    steps = levels.groupBy("score").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("hits"),
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("misses"),
    )
    areas = _areas(placed_steps(steps, rows_per_slice)).first()
    values = {**counts.asDict(), **areas.asDict()}
    values["pr_auc"] = values["pr_auc_trapezoid"]
    schema = T.StructType(
        [T.StructField(k, T.LongType() if k == "rows_joined" else T.DoubleType()) for k in values]
    )
    return levels.sparkSession.createDataFrame([tuple(values.values())], schema)


def evaluate_model(model, test: DataFrame, threshold: float = 0.5, name: str = "model", fit_rows: int | None = None, fit_seconds: float | None = None) -> dict[str, DataFrame]:
    """Hold-out metrics of a fitted model, with precision at k, lift, scoring time and the scored rows.

    The model runs once: its scores are written to the shared folder, and all
    tables are worked out from there.
    """
    from cardwatch.operators.ml import score

    spark = test.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/scored-{uuid.uuid4().hex[:12]}"
    started = time.perf_counter()
    scored = score(model, test, threshold).select("trans_num", F.col(LABEL).cast("int").alias(LABEL), "risk_score", "prediction")
    scored.write.parquet(path)
    seconds = time.perf_counter() - started
    frame = spark.read.schema(scored.schema).parquet(path)
    row = metrics_row(frame)
    metrics = row.select(
        F.lit(name).alias("model"),
        F.lit(fit_rows).cast("long").alias("fit_rows"),
        F.lit(fit_seconds).cast("double").alias("fit_time_sec"),
        F.lit(seconds).alias("score_time_sec"),
        F.lit(float(threshold)).alias("threshold"),
        "roc_auc",
        F.col("average_precision").alias("pr_auc"),
        "f1",
        "recall",
        "precision",
        F.col("balanced_accuracy").alias("balanced_acc"),
        "mcc",
    )
    return {
        "metrics": metrics,
        "confusion": confusion(frame),
        "precision_at_k": precision_recall_at_k(frame),
        "lift": lift_table(frame),
        "scored": frame,
    }


# --- leaderboards --------------------------------------------------------------------


def leaderboard(results: DataFrame, by: tuple[str, ...] = ("pr_auc", "recall")) -> DataFrame:
    """Best model first."""
    return results.orderBy(*[F.col(c).desc_nulls_last() for c in by], "model")


def quality_per_minute(cv: DataFrame) -> DataFrame:
    """Cross-validated quality against the time it took."""
    minutes = F.col("cv_wall_time_sec") / 60
    out = cv.withColumns({"cv_time_min": minutes, "pr_auc_per_min": F.col("pr_auc_mean") / F.nullif(minutes, F.lit(0.0))})
    return out.orderBy(F.col("pr_auc_mean").desc_nulls_last(), F.col("pr_auc_per_min").desc_nulls_last(), "model")


def stack_versions(baseline: DataFrame, tuned: DataFrame) -> DataFrame:
    """Baseline and tuned hold-out results in one list, best first."""
    columns = ["model", "pr_auc", "recall", "precision", "fit_time_sec"]
    both = baseline.select(*columns, F.lit("baseline").alias("version")).unionByName(
        tuned.select(*columns, F.lit("tuned").alias("version"))
    )
    return leaderboard(both)


def compare_runs(cv: DataFrame, holdout: DataFrame, tuned: DataFrame) -> DataFrame:
    """Cross-validation, hold-out and tuned hold-out side by side with their differences."""
    out = (
        cv.select("model", "pr_auc_mean", "pr_auc_std")
        .join(holdout.select("model", F.col("pr_auc").alias("holdout_pr_auc")), "model", "left")
        .join(tuned.select("model", F.col("pr_auc").alias("tuned_holdout_pr_auc")), "model", "left")
    )
    return out.withColumns(
        {
            "delta_holdout_vs_cv": F.col("holdout_pr_auc") - F.col("pr_auc_mean"),
            "delta_tuned_vs_holdout": F.col("tuned_holdout_pr_auc") - F.col("holdout_pr_auc"),
        }
    ).orderBy(F.col("pr_auc_mean").desc_nulls_last(), "model")


def scoring_summary(df: DataFrame, seconds: float, target_ratio: float | None = None) -> DataFrame:
    """Size, fraud ratio and speed of a scoring run; ``seconds`` is the measured action time."""
    n = F.count(F.lit(1))
    frauds = F.coalesce(F.sum(F.col(LABEL).cast("int")), F.lit(0)).cast("long")
    target = None if target_ratio is None else min(max(target_ratio, 0.0), 1.0)
    return df.agg(
        n.alias("n_transactions"),
        F.lit(target).cast("double").alias("fraud_ratio_target"),
        _rate(frauds, n).alias("fraud_ratio_observed"),
        frauds.alias("fraud_count"),
        F.lit(float(seconds)).alias("total_time_sec"),
        (F.lit(seconds * 1000.0) / F.greatest(n, F.lit(1))).alias("avg_latency_ms"),
        (n / F.lit(max(seconds, 1e-9))).alias("throughput_txn_per_sec"),
    )
