"""Variable selection: column quality, mutual information, information value."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwatch.functions.columns import correlation, iv_band, ratio, seeded_order
from cardwatch.operators.profile import distinct_counts, long_format
from cardwatch.plans.prefix import equal_bin, exact_quantiles, prefix_sum
from cardwatch.plans.slices import ROWS_PER_SLICE
from cardwatch.schemas import DOMAIN_DROPS, ENGINEERED_PATTERN, LABEL
from cardwatch.session import written

TOP_VALUES = 25
OTHER = "OTHER"
MISSING = "nan"

# Thresholds of the drop rules.
HIGH_CARD_RATIO, HIGH_CARD_MI, HIGH_CARD_IV = 0.20, 0.003, 0.05
LOW_SIGNAL_MI, LOW_SIGNAL_IV = 0.0015, 0.02
SUSPICIOUS_AUC, SUSPICIOUS_MI = 0.95, 0.3
MIN_AUC_ROWS = 100


def is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def _per_feature(spark, values: dict[str, tuple], schema: str) -> DataFrame:
    """A small table with one row per column of the data."""
    return spark.createDataFrame([(k, *v) for k, v in values.items()], f"feature string, {schema}")


def column_quality(df: DataFrame, cols: list[str]) -> DataFrame:
    """Type, gaps, cardinality and share of the most frequent value (NULL counts as a value)."""
    types = dict(df.dtypes)
    counts = long_format(df, cols, "string").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = F.sum("n")
    out = counts.groupBy("feature").agg(
        (ratio(F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)), rows) * 100).alias("null_pct"),
        F.count("value").alias("n_unique"),
        ratio(F.count("value"), rows).alias("unique_ratio"),
        (ratio(F.max("n"), rows) * 100).alias("mode_pct"),
    )
    named = _per_feature(df.sparkSession, {c: (types[c],) for c in cols}, "dtype string")
    return named.join(out, "feature").orderBy(F.desc("null_pct"), F.desc("unique_ratio"), "feature")


def stratified_sample(
    df: DataFrame, label: str, n: int, seed: int, key: str = "trans_num", rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """At most n labelled rows with the ratio of all classes kept, in the seeded order of the key.

    Rows without a label are never part of the sample, whatever its size. A
    class gets its share of n rounded down; what is left over goes to the
    largest class other than 1.
    """
    labelled = df.where(F.col(label).isNotNull())
    sizes = {r[0]: r[1] for r in df.groupBy(label).agg(F.count(F.lit(1))).collect() if r[0] is not None}
    total = sum(sizes.values())
    if total <= n:
        return labelled
    quotas = {c: n * size // total for c, size in sizes.items()}
    rest = n - sum(quotas.values())
    for c in sorted(sizes, key=lambda c: (c == 1, -sizes[c])):
        extra = min(rest, sizes[c] - quotas[c])
        quotas[c], rest = quotas[c] + extra, rest - extra
    quota = F.lit(0)
    for c, q in quotas.items():
        quota = F.when(F.col(label) == F.lit(c), q).otherwise(quota)
    mixed = labelled.withColumn("__h", seeded_order(key, seed))
    placed = prefix_sum(mixed, ["__h", key], (), [label], rows_per_slice)
    return placed.where(F.col("pos") < quota).drop("__h", "pos")


# --- mutual information ---------------------------------------------------------------


def _class_counts(cells: DataFrame, label: str = "y") -> list[Column]:
    y = F.col(label)
    return [F.sum(y).cast("long").alias("bad"), F.sum(1 - y).cast("long").alias("good")]


def quantile_codes(df: DataFrame, cols: list[str], bins: int) -> dict[str, Column]:
    """Bin number of numeric columns by their exact quantiles; gaps take the median's bin."""
    if not cols:
        return {}
    probs = [i / bins for i in range(1, bins)]
    cells = long_format(df, cols).where("value is not null and not isnan(value)")
    cuts = {r["feature"]: r["quantiles"] for r in exact_quantiles(cells, "value", [*probs, 0.5], ["feature"]).collect()}
    codes = {}
    for c in cols:
        if c not in cuts:
            codes[c] = F.lit(0)
            continue
        filled = F.coalesce(F.col(c).cast("double"), F.lit(cuts[c][-1]))
        codes[c] = sum(((filled > F.lit(cut)).cast("int") for cut in cuts[c][:-1]), F.lit(0))
    return codes


def mutual_information(df: DataFrame, cols: list[str], label: str = LABEL, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of each column with a binary label.

    Texts use their values, numbers their quantile bin. With a class count per
    value, MI is a plain sum; only one row per column meets in the totals.
    """
    numeric = [c for c in cols if is_numeric(df, c)]
    codes = quantile_codes(df, numeric, bins)
    coded = df.select(
        F.col(label).cast("int").alias("y"),
        *[
            codes[c].cast("string").alias(c) if c in codes else F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c)
            for c in cols
        ],
    ).where("y is not null")
    table = long_format(coded, cols, "string", ["y"]).groupBy("feature", "value").agg(*_class_counts(coded))
    bad, good = coded.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    n = bad + good

    def term(part: Column, whole: int) -> Column:
        joint = part * float(n) / F.nullif((F.col("bad") + F.col("good")) * float(whole), F.lit(0.0))
        return F.when(part > 0, part * F.ln(joint)).otherwise(0.0)

    total = F.sum(term(F.col("bad"), bad) + term(F.col("good"), good)) / float(n or 1)
    return table.groupBy("feature").agg(F.greatest(total, F.lit(0.0)).alias("mi"))


# --- information value ------------------------------------------------------------------


def information_value(
    df: DataFrame,
    cols: list[str],
    label: str = LABEL,
    n_bins: int = 10,
    key: str = "trans_num",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Information value with +0.5 smoothing.

    Numbers with more than ``n_bins`` values go to equal-count bins (equal
    values ordered by ``key``), a gap is a bin of its own. Anything else uses
    its 25 most frequent values and OTHER. A constant column scores 0.
    """
    spark = df.sparkSession
    known = df.where(F.col(label).isNotNull()).withColumn("y", F.col(label).cast("int"))
    unique = {r["feature"]: r["n_unique"] for r in distinct_counts(known, cols).collect()}
    varied = [c for c in cols if unique[c] > 1]
    binned = [c for c in varied if is_numeric(df, c) and unique[c] > n_bins]
    named = [c for c in varied if c not in binned]
    tables = []
    if binned:
        cells = long_format(known.withColumnRenamed(key, "__key"), [("__key" if c == key else c) for c in binned], "double", ["y", "__key"])
        given = cells.where("value is not null")
        sizes = {r[0]: (r[1],) for r in given.groupBy("feature").agg(F.count(F.lit(1))).collect()}
        placed = prefix_sum(given, ["value", "__key"], (), ["feature"], rows_per_slice)
        # One row per column of the data: safe to broadcast.
        placed = placed.join(F.broadcast(_per_feature(spark, sizes, "__n long")), "feature")
        bins = placed.groupBy("feature", equal_bin(F.col("pos"), F.col("__n"), n_bins).cast("string").alias("bucket"))
        tables.append(bins.agg(*_class_counts(placed)))
        gaps = cells.where("value is null").groupBy("feature", F.lit(None).cast("string").alias("bucket"))
        tables.append(gaps.agg(*_class_counts(cells)))
    if named:
        cells = long_format(known, named, "string", ["y"]).fillna(MISSING, ["value"])
        counts = cells.groupBy("feature", "value").agg(*_class_counts(cells))
        order = Window.partitionBy("feature").orderBy((F.col("bad") + F.col("good")).desc(), "value")
        top = counts.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= TOP_VALUES)
        top = top.select("feature", "value", F.lit(True).alias("__top"))
        # At most 25 rows per column of the data: safe to broadcast.
        marked = counts.join(F.broadcast(top), ["feature", "value"], "left")
        bucket = F.when(F.col("__top"), F.col("value")).otherwise(F.lit(OTHER))
        tables.append(
            marked.groupBy("feature", bucket.alias("bucket")).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        )
    zeros = _per_feature(spark, {c: (0.0,) for c in cols if c not in varied}, "iv double")
    if not tables:
        return zeros
    table = tables[0]
    for t in tables[1:]:
        table = table.unionByName(t)
    everything = Window.partitionBy("feature")  # at most n_bins + 1 or 26 buckets
    slack = F.count(F.lit(1)).over(everything) * 0.5
    share_good = (F.col("good") + 0.5) / (F.sum("good").over(everything) + slack)
    share_bad = (F.col("bad") + 0.5) / (F.sum("bad").over(everything) + slack)
    terms = table.select("feature", ((share_good - share_bad) * F.ln(share_good / share_bad)).alias("t"))
    return terms.groupBy("feature").agg(F.sum("t").alias("iv")).unionByName(zeros)


# --- decisions ------------------------------------------------------------------------------


def selection_metrics(df: DataFrame, cols: list[str], label: str = LABEL, **options) -> DataFrame:
    mi = mutual_information(df, cols, label)
    iv = information_value(df, cols, label, **options)
    return mi.join(iv, "feature", "outer").withColumn("iv_band", iv_band("iv"))


def selection_report(quality: DataFrame, metrics: DataFrame, hard_drops=DOMAIN_DROPS) -> DataFrame:
    """Keep or drop per original column, with the reasons as flags."""
    mi, iv = F.coalesce("mi", F.lit(0.0)), F.coalesce("iv", F.lit(0.0))
    out = quality.join(metrics, "feature", "left")
    out = out.withColumns(
        {
            "hard_drop": F.col("feature").isin(*hard_drops),
            "constant": F.col("n_unique") <= 1,
            "high_card_low_signal": (F.col("unique_ratio") > HIGH_CARD_RATIO) & (mi < HIGH_CARD_MI) & (iv < HIGH_CARD_IV),
            "low_signal": (mi < LOW_SIGNAL_MI) & (iv < LOW_SIGNAL_IV),
        }
    )
    dropped = F.col("hard_drop") | F.col("constant") | F.col("high_card_low_signal")
    out = out.withColumn("decision", F.when(dropped, "DROP").otherwise("KEEP"))
    return out.orderBy("decision", F.col("mi").desc_nulls_last(), F.col("iv").desc_nulls_last(), "feature")


def model_input(df: DataFrame, report: DataFrame, label: str = LABEL) -> DataFrame:
    """Kept originals, then engineered columns, each sorted; the label last."""
    kept = {r["feature"] for r in report.where("decision = 'KEEP'").select("feature").collect()}
    engineered = sorted(c for c in df.columns if re.match(ENGINEERED_PATTERN, c))
    originals = sorted(c for c in df.columns if c in kept and c not in engineered and c != label)
    return df.select(*originals, *engineered, *([label] if label in df.columns else []))


# --- engineered columns ------------------------------------------------------------------------


def single_feature_auc(df: DataFrame, cols: list[str], label: str = LABEL, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """max(AUC, 1 - AUC) of each numeric column used alone as a score."""
    known = df.select(F.col(label).cast("int").alias("y"), *cols).where("y is not null")
    cells = long_format(known, cols, "double", ["y"]).where("value is not null")
    counts = written(cells.groupBy("feature", "value").agg(*_class_counts(cells)))
    placed = prefix_sum(counts, ["value"], ["good"], ["feature"], rows_per_slice)
    below = F.col("cum_good") - F.col("good")
    sums = placed.groupBy("feature").agg(
        F.sum(F.col("bad") * (below + F.col("good") / 2)).alias("__pairs"), F.sum("bad").alias("__b"), F.sum("good").alias("__g")
    )
    auc = F.col("__pairs") / F.nullif(F.col("__b") * F.col("__g"), F.lit(0)).cast("double")
    usable = (F.col("__b") + F.col("__g") > MIN_AUC_ROWS) & (F.col("__b") > 0) & (F.col("__g") > 0)
    return sums.select("feature", F.when(usable, F.greatest(auc, 1 - auc)).alias("single_feature_auc"))


def feature_signal(df: DataFrame, cols: list[str], label: str = LABEL, **options) -> DataFrame:
    """Correlation, single-feature AUC and mutual information of engineered columns.

    The columns are worked out once and written; all passes read them from there.
    """
    df = written(df.select(*dict.fromkeys([label, *cols])))
    numeric = [c for c in cols if is_numeric(df, c)]
    row = df.agg(*[correlation(c, label).alias(c) for c in numeric]).first()
    known = {c: (row[c],) for c in numeric}
    corr = _per_feature(df.sparkSession, {c: known.get(c, (None,)) for c in cols}, "corr_with_target double")
    corr = corr.withColumn("abs_corr_with_target", F.abs("corr_with_target"))
    out = corr.withColumn("family", F.substring("feature", 1, 1))
    out = out.join(single_feature_auc(df, numeric, label, **options), "feature", "left")
    out = out.join(mutual_information(df, cols, label).withColumnRenamed("mi", "mutual_info"), "feature", "left")
    return out.orderBy(F.col("mutual_info").desc_nulls_last(), F.col("abs_corr_with_target").desc_nulls_last(), "feature")


def suspicious(signal: DataFrame) -> DataFrame:
    """Columns whose signal is too good to be true."""
    auc, mi = F.coalesce("single_feature_auc", F.lit(0.0)), F.coalesce("mutual_info", F.lit(0.0))
    return signal.where((auc >= SUSPICIOUS_AUC) | (mi > SUSPICIOUS_MI))
