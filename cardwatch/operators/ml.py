"""Splits, preprocessing, resampling, model fitting and scoring with pyspark.ml."""

from __future__ import annotations

import random
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from statistics import mean, median, pstdev

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwatch.functions.columns import ratio, seeded_order
from cardwatch.operators import trees
from cardwatch.operators.knn import knn_join
from cardwatch.operators.profile import long_format
from cardwatch.plans.prefix import exact_quantiles, null_safe_join, prefix_sum
from cardwatch.plans.slices import ROWS_PER_SLICE
from cardwatch.schemas import LABEL, TS
from cardwatch.session import ensure_checkpoint_dir, written

MODEL_NAME = "gbt"

# Search spaces, in the parameter names of the Spark classifiers.
SEARCH_SPACES = {
    "gbt": {
        "maxIter": [220, 320, 420, 520],
        "maxDepth": [4, 6, 8],
        "stepSize": [0.03, 0.05, 0.08],
        "subsamplingRate": [0.7, 0.85, 1.0],
        "featureSubsetStrategy": ["0.6", "0.8", "1.0"],
        "minInstancesPerNode": [1, 5, 10],
    },
    "rf": {
        "numTrees": [250, 350, 500],
        "maxDepth": [12, 20],
        "minInstancesPerNode": [1, 2, 4],
        "featureSubsetStrategy": ["sqrt", "0.5", "all"],
    },
}


# --- splits -----------------------------------------------------------------------------


def temporal_split(
    df: DataFrame, train: float = 0.70, valid: float = 0.85, key: str = "trans_num", rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """``split`` = train, valid or test by position in time."""
    timed = df.where(F.col(TS).isNotNull()).withColumn("__us", F.unix_micros(F.col(TS).cast("timestamp")))
    n = timed.count()
    placed = prefix_sum(timed, ["__us", key], (), (), rows_per_slice, n=n)
    name = F.when(F.col("pos") < int(n * train), "train").when(F.col("pos") < int(n * valid), "valid").otherwise("test")
    return placed.withColumn("split", name).drop("__us", "pos")


def split_summary(split: DataFrame) -> DataFrame:
    frauds = F.coalesce(F.sum(F.col(LABEL).cast("long")), F.lit(0))
    got = split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(TS).alias("start"),
        F.max(TS).alias("end"),
        frauds.alias("frauds"),
        ratio(frauds, F.count(F.lit(1))).alias("fraud_rate"),
    )
    order = F.array_position(F.array(*map(F.lit, ("train", "valid", "test"))), F.col("split"))
    return got.orderBy(order)


def _shuffled(df: DataFrame, label: str, seed: int, key: str, rows_per_slice: int) -> DataFrame:
    """``pos`` within the class in a seeded order; ``df`` is read by several passes."""
    mixed = df.withColumn("__h", seeded_order(key, seed))
    return prefix_sum(mixed, ["__h", key], (), [label], rows_per_slice).drop("__h")


def stratified_split(
    df: DataFrame, label: str = LABEL, test: float = 0.2, seed: int = 42, key: str = "trans_num", rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """``split`` = train or test, each class cut at the same share.

    The rows are worked out once and written: sizes, cut points and places read them from there.
    """
    df = written(df)
    sizes = df.groupBy(label).agg(F.round(F.count(F.lit(1)) * F.lit(test)).cast("long").alias("__cut"))
    placed = null_safe_join(_shuffled(df, label, seed, key, rows_per_slice), sizes, [label])
    return placed.withColumn("split", F.when(F.col("pos") < F.col("__cut"), "test").otherwise("train")).drop("pos", "__cut")


def stratified_folds(
    df: DataFrame, label: str = LABEL, k: int = 4, seed: int = 42, key: str = "trans_num", rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """``fold`` 0..k-1 with the class ratio kept; the rows are worked out once and written."""
    placed = _shuffled(written(df), label, seed, key, rows_per_slice)
    return placed.withColumn("fold", (F.col("pos") % k).cast("int")).drop("pos")


# --- preprocessing --------------------------------------------------------------------------


def training_frame(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Integer label (gaps are 0), no date or time columns."""
    if label not in df.columns:
        raise ValueError(f"target column {label!r} is missing")
    timed = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    y = F.coalesce(F.col(label).cast("string").try_cast("double"), F.lit(0.0)).cast("int")
    if isinstance(df.schema[label].dataType, T.BooleanType):
        y = F.coalesce(F.col(label).cast("int"), F.lit(0))
    return df.drop(*timed).withColumn(label, y)


def split_columns(df: DataFrame, label: str = LABEL, exclude: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """Numeric and categorical feature columns; a date column must be handled first."""
    numeric, categorical = [], []
    for f in df.schema.fields:
        if f.name == label or f.name in exclude:
            continue
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            raise ValueError(f"column {f.name!r} is a date; convert or drop it before training")
        (numeric if isinstance(f.dataType, (T.NumericType, T.BooleanType)) else categorical).append(f.name)
    return numeric, categorical


def medians(train: DataFrame, cols: list[str]) -> dict[str, float]:
    cells = long_format(train, cols).where("value is not null")
    return {r["feature"]: r["quantiles"][0] for r in exact_quantiles(cells, "value", [0.5], ["feature"]).collect()}


def impute_median(train: DataFrame, cols: list[str], df: DataFrame | None = None) -> DataFrame:
    """Fill gaps with the training median (a column without values stays empty)."""
    fitted = medians(train, cols)
    df = train if df is None else df
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(fitted.get(c)).cast("double")) for c in cols})


def modes(train: DataFrame, cols: list[str]) -> dict[str, str]:
    """Most frequent value per column, the smallest among equals."""
    counts = long_format(train, cols, "string").where("value is not null").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("feature").agg(F.min_by("value", F.struct((-F.col("n")).alias("n"), "value")).alias("mode"))
    return {r["feature"]: r["mode"] for r in most.collect()}


def impute_mode(train: DataFrame, cols: list[str], df: DataFrame | None = None) -> DataFrame:
    fitted = modes(train, cols)
    df = train if df is None else df
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(fitted.get(c)).cast("string")) for c in cols})


def ordinal_codes(train: DataFrame, cols: list[str], rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """(feature, value, code): dense codes in lexicographic order."""
    values = long_format(train, cols, "string").where("value is not null").distinct()
    return prefix_sum(values, ["value"], (), ["feature"], rows_per_slice).withColumnRenamed("pos", "code")


def ordinal_encode(train: DataFrame, cols: list[str], df: DataFrame | None = None, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Replace texts by training codes; unknown and missing values become -1."""
    codes = ordinal_codes(train, cols, rows_per_slice)
    out = train if df is None else df
    for c in cols:
        mine = codes.where(F.col("feature") == c).select(F.col("value").alias(f"__{c}"), F.col("code").alias(f"__code_{c}"))
        out = out.join(mine, F.col(c).cast("string") == F.col(f"__{c}"), "left").drop(f"__{c}")
    return out.withColumns({c: F.coalesce(f"__code_{c}", F.lit(-1)).cast("int") for c in cols}).drop(*[f"__code_{c}" for c in cols])


def standardize(train: DataFrame, cols: list[str], df: DataFrame | None = None) -> DataFrame:
    """Zero mean, unit population deviation; a constant column is only centred."""
    row = train.agg(*[f(F.col(c).cast("double")).alias(f"{f.__name__}_{c}") for c in cols for f in (F.avg, F.stddev_pop)]).first()
    df = train if df is None else df
    scaled = {}
    for c in cols:
        mean, std = row[f"avg_{c}"], row[f"stddev_pop_{c}"]
        scaled[c] = (F.col(c).cast("double") - F.lit(mean).cast("double")) / F.lit(std if std else 1.0)
    return df.withColumns(scaled)


def minmax_score(df: DataFrame, raw: str = "raw_score", name: str = "risk_score") -> DataFrame:
    """Raw scores on a 0..1 scale; no spread gives 0."""
    low, high = df.agg(F.min(raw), F.max(raw)).first()
    if low is None or high - low < 1e-12:
        return df.withColumn(name, F.lit(0.0))
    return df.withColumn(name, (F.col(raw).cast("double") - F.lit(float(low))) / F.lit(float(high) - float(low)))


def balanced_weight(df: DataFrame, label: str = LABEL, name: str = "weight") -> DataFrame:
    """Weight rows so that both classes count the same."""
    sizes = {r[0]: r[1] for r in df.groupBy(F.col(label).cast("int")).agg(F.count(F.lit(1))).collect()}
    n = sum(sizes.values())
    weight = F.lit(None).cast("double")
    for y, size in sizes.items():
        weight = F.when(F.col(label).cast("int") == y, F.lit(n / (len(sizes) * size))).otherwise(weight)
    return df.withColumn(name, weight)


# --- resampling --------------------------------------------------------------------------------


def near_minority_filter(
    df: DataFrame, vec_col: str, label: str = LABEL, key: str = "vec_id", k: int = 5, q: float = 0.015, **options
) -> tuple[DataFrame, DataFrame]:
    """Drop the majority rows closest to the minority: likely wrong labels.

    Returns the kept rows and a one-row summary. The search runs once: the mean
    distances are written to the shared folder.
    """
    spark = df.sparkSession
    schema = "dropped_majority long, dropped_pct_over_train double, threshold double, k_neighbors int"
    is_minority = F.col(label).cast("int") == 1
    n, few = df.agg(F.count(F.lit(1)), F.count_if(is_minority)).first()
    if few < 2:
        return df, spark.createDataFrame([(0, 0.0, None, 0)], schema)
    k = min(k, few)
    pairs = knn_join(df.where(~is_minority), df.where(is_minority), vec_col, k, key, key, **options)
    found = pairs.groupBy("left_id").agg(F.avg("distance").alias("mean_distance"))
    path = f"{ensure_checkpoint_dir(spark)}/distances-{uuid.uuid4().hex[:12]}"
    found.write.parquet(path)
    distance = spark.read.schema(found.schema).parquet(path)
    limit = exact_quantiles(distance, "mean_distance", [q]).first()["quantiles"][0]
    noisy = distance.where(F.col("mean_distance") <= F.lit(limit)).select("left_id")
    kept = df.join(noisy, F.col(key) == F.col("left_id"), "left_anti")
    dropped = noisy.count()
    return kept, spark.createDataFrame([(dropped, dropped / n * 100, limit, k)], schema)


def mixed_neighbours(rows: DataFrame, num: list[str], cat: list[str], k: int, key: str = "trans_num") -> DataFrame:
    """The k nearest other rows over numbers and texts: left_id, rank, neighbour_id, distance.

    A differing text adds half the squared median deviation of the numbers to
    the squared distance. Missing numbers count as 0, missing texts as "".
    """
    spreads = rows.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in num]).first() if num else {}
    penalty = median(spreads[c] or 0.0 for c in num) if num else 1.0
    parts = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in num]
    codes = [F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cat]
    vectors = rows.select(F.col(key).alias("id"), F.array(*parts).alias("v"), F.array(*codes).cast("array<bigint>").alias("c"))
    options = dict(codes="c", penalty=penalty * penalty / 2) if cat else {}
    return knn_join(vectors, vectors, "v", k, "id", "id", exclude_self=True, **options)


def smote_nc(
    df: DataFrame, num: list[str], cat: list[str], label: str = LABEL, ratio: float = 0.15, k: int = 3, seed: int = 42, key: str = "trans_num"
) -> DataFrame:
    """Over-sample the minority to ``ratio`` of the majority.

    A synthetic row lies between a minority row and one of its k nearest
    minority neighbours (``mixed_neighbours``); its texts are the most frequent
    among the neighbours.
    """
    y = F.col(label).cast("int")
    few, many = df.agg(F.count_if(y == 1), F.count_if(y == 0)).first()
    wanted = int(many * ratio) - few
    if wanted <= 0 or few < 2:
        return df
    k = min(k, few - 1)
    minority = df.where(y == 1)
    pairs = mixed_neighbours(minority, num, cat, k, key)
    per_row, extra = divmod(wanted, few)
    numbered = prefix_sum(minority.select(key).withColumn("__h", F.xxhash64(key, F.lit(seed))), ["__h", key])
    copies = numbered.withColumn("__copies", F.lit(per_row) + (F.col("pos") < extra).cast("int")).where("__copies > 0")
    copies = copies.select(F.col(key).alias("__base"), F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy"))
    pick = F.pmod(F.xxhash64("__base", "__copy", F.lit(seed)), F.lit(k)).cast("int") + 1
    chosen = copies.withColumn("__rank", pick).join(
        pairs.select(F.col("left_id").alias("__base"), F.col("rank").alias("__rank"), "neighbour_id"), ["__base", "__rank"]
    )
    own = minority.select(F.col(key).alias("__base"), *[F.col(c).alias(f"__a_{c}") for c in num])
    other = minority.select(F.col(key).alias("neighbour_id"), *[F.col(c).alias(f"__b_{c}") for c in num])
    gap = F.pmod(F.xxhash64("__copy", "__base", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
    made = chosen.join(own, "__base").join(other, "neighbour_id").withColumn("__gap", gap)
    if cat:
        near = pairs.join(minority.select(F.col(key).alias("neighbour_id"), *cat), "neighbour_id")
        voted = near.groupBy(F.col("left_id").alias("__base")).agg(*[F.mode(c, True).alias(c) for c in cat])
        made = made.join(voted, "__base")
    fields = {f.name: f.dataType for f in df.schema.fields}
    built: list[Column] = []
    for c in df.columns:
        if c in num:
            built.append((F.col(f"__a_{c}") + F.col("__gap") * (F.col(f"__b_{c}") - F.col(f"__a_{c}"))).cast(fields[c]).alias(c))
        elif c in cat:
            built.append(F.col(c))
        elif c == label:
            built.append(F.lit(1).cast(fields[c]).alias(c))
        elif c == key:
            built.append(F.concat_ws("_", F.lit("syn"), "__base", "__copy").cast(fields[c]).alias(c))
        else:
            built.append(F.lit(None).cast(fields[c]).alias(c))
    return df.unionByName(made.select(*built))


# --- models ---------------------------------------------------------------------------------------

#: Files written for each task that runs at a time, and rows of a file at the most, about.
FILES_PER_TASK = 2
ROWS_PER_FILE = 500_000


def written_evenly(rows: DataFrame, key: str = "trans_num", path: str | None = None, n: int | None = None) -> DataFrame:
    """The same rows, worked out once, written to the shared folder in parts of about equal size and read again.

    ``n`` is their number, if the caller knows it; it only decides the number of parts.

    A split or a window leaves whole classes in single tasks; every pass of a
    fit would wait for them. Rows of a part are sorted by the key, so that
    draws that go by the place of a row repeat.
    """
    spark = rows.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/rows-{uuid.uuid4().hex[:12]}"
    n, slots = rows.count() if n is None else n, spark.sparkContext.defaultParallelism
    parts = max(FILES_PER_TASK * slots, -(-n // ROWS_PER_FILE))
    even = rows.repartition(parts, key).sortWithinPartitions(key) if key in rows.columns else rows.repartition(parts)
    even.write.parquet(path)
    return spark.read.schema(even.schema).parquet(path)


class TextCodes(Estimator, HasInputCols, HasOutputCols):
    """Texts as plain numbers: their codes in the training rows, of any number of values.

    A missing text takes the code of the most frequent one; unknown texts, and
    missing ones of a column without values, become -1.
    """

    def __init__(self, inputCols: list[str], outputCols: list[str]):
        super().__init__()
        self._set(inputCols=inputCols, outputCols=outputCols)

    def _fit(self, df: DataFrame) -> TextCodesModel:
        cols, spark = self.getInputCols(), df.sparkSession
        codes = ordinal_codes(df, cols).select("feature", "value", F.col("code").cast("double").alias("code"))
        path = f"{ensure_checkpoint_dir(spark)}/codes-{uuid.uuid4().hex[:12]}"
        codes.write.parquet(path)
        codes = spark.read.schema(codes.schema).parquet(path)
        most = spark.createDataFrame(list(modes(df, cols).items()), "feature string, value string")
        missing = codes.join(most, ["feature", "value"]).select("feature", F.lit(None).cast("string").alias("value"), "code")
        return self._copyValues(TextCodesModel(codes.unionByName(missing)))


class TextCodesModel(Model, HasInputCols, HasOutputCols, MLWritable, MLReadable):
    """(feature, value, code) of the training rows; a NULL value stands for missing texts."""

    def __init__(self, codes: DataFrame):
        super().__init__()
        self.codes = codes

    def _transform(self, df: DataFrame) -> DataFrame:
        for c, name in zip(self.getInputCols(), self.getOutputCols()):
            mine = self.codes.where(F.col("feature") == c).select(F.col("value").alias("__value"), F.col("code").alias("__code"))
            joined = df.join(mine, F.col(c).cast("string").eqNullSafe(F.col("__value")), "left")
            df = joined.withColumn(name, F.coalesce("__code", F.lit(-1.0))).drop("__value", "__code")
        return df

    def write(self) -> MLWriter:
        return _TextCodesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TextCodesReader()


class _TextCodesWriter(MLWriter):
    def __init__(self, model: TextCodesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.codes.write.parquet(f"{path}/codes")


class _TextCodesReader(MLReader):
    def load(self, path: str) -> TextCodesModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = TextCodesModel(self.sparkSession.read.parquet(f"{path}/codes"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def _preparation(df: DataFrame, label: str = LABEL, exclude: tuple[str, ...] = ()) -> Pipeline:
    """Median imputation, codes for texts, one vector."""
    numeric, categorical = split_columns(df, label, exclude)
    stages, inputs = [], []
    if numeric:
        filled = [f"{c}__num" for c in numeric]
        stages.append(Imputer(strategy="median", inputCols=numeric, outputCols=filled))
        inputs += filled
    if categorical:
        coded = [f"{c}__cat" for c in categorical]
        stages.append(TextCodes(inputCols=categorical, outputCols=coded))
        inputs += coded
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages)


def build_pipeline(df: DataFrame, classifier, label: str = LABEL, exclude: tuple[str, ...] = ()) -> Pipeline:
    """Median imputation, ordinal codes for texts, then the classifier."""
    return Pipeline(stages=[*_preparation(df, label, exclude).getStages(), classifier])


def _numbers_as_double(df: DataFrame, label: str) -> DataFrame:
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DecimalType, T.BooleanType)) and f.name != label]
    return df.withColumns({c: F.col(c).cast("double") for c in wide})


def gbt(**params) -> GBTClassifier:
    defaults = dict(maxIter=100, stepSize=0.05, maxDepth=6, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)
    return GBTClassifier(**{"labelCol": LABEL, "weightCol": "weight", "maxBins": 256, **defaults, **params})


def rf(**params) -> RandomForestClassifier:
    defaults = dict(numTrees=300, maxDepth=12, seed=42)
    return RandomForestClassifier(**{"labelCol": LABEL, "weightCol": "weight", "maxBins": 256, **defaults, **params})


def _fit(train: DataFrame, classifier, label: str, exclude: tuple[str, ...]) -> PipelineModel:
    """The preparation is fitted first; the classifier then reads its vectors, written once in even parts."""
    weighted = balanced_weight(_numbers_as_double(train, label), label)
    *preparation, last = build_pipeline(weighted, classifier, label, (*exclude, "weight")).getStages()
    ready = Pipeline(stages=preparation).fit(weighted)
    keys = [c for c in exclude if c in train.columns]
    vectors = ready.transform(weighted).select(*keys, label, "features", "weight")
    return PipelineModel([*ready.stages, trees.fit(last, written_evenly(vectors, *keys[:1], n=train.count()))])


def fit_gbt(train: DataFrame, params: dict | None = None, label: str = LABEL, exclude: tuple[str, ...] = ("trans_num",)) -> PipelineModel:
    return _fit(train, gbt(**(params or {})), label, exclude)


def fit_rf(train: DataFrame, params: dict | None = None, label: str = LABEL, exclude: tuple[str, ...] = ("trans_num",)) -> PipelineModel:
    return _fit(train, rf(**(params or {})), label, exclude)


def score(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add ``risk_score`` (probability of fraud) and ``prediction``."""
    ready = _numbers_as_double(df, LABEL)
    out = model.transform(ready)
    out = out.withColumn("risk_score", vector_to_array("probability")[1])
    out = out.withColumn("prediction", (F.col("risk_score") >= F.lit(float(threshold))))
    return out.select(*df.columns, "risk_score", "prediction")


def score_ranked(model: PipelineModel, df: DataFrame, threshold: float = 0.5, by: list[str] = ()) -> DataFrame:
    """``score`` with the rank of each score; the model runs once, ranks come from the written scores."""
    from cardwatch.operators.evaluate import rank_scores

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/ranked-{uuid.uuid4().hex[:12]}"
    scored = score(model, df, threshold)
    scored.write.parquet(path)
    return rank_scores(spark.read.schema(scored.schema).parquet(path), by=by)


# --- validation and search --------------------------------------------------------------------------


@dataclass(frozen=True)
class Fold:
    """One fold as written vectors: label, weight, features; the test rows keep their key."""

    name: object
    train: DataFrame
    test: DataFrame


def prepared_folds(
    df: DataFrame, fold_col: str = "fold", label: str = LABEL, exclude: tuple[str, ...] = ("trans_num",), key: str = "trans_num"
) -> list[Fold]:
    """Each fold's preparation fitted once, on its training rows, and its vectors written to the shared folder.

    All classifiers and all draws of a search read these vectors. The class
    weights are those of the training rows. The rows themselves are worked out
    once, before, and all folds read them.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/folds-{uuid.uuid4().hex[:12]}"
    data = written_evenly(_numbers_as_double(df, label), key, f"{folder}/rows")
    names = sorted(r[0] for r in data.select(fold_col).distinct().collect())  # a handful

    def prepare(name) -> Fold:
        train = data.where(F.col(fold_col) != name)
        test = data.where(F.col(fold_col) == name)
        ready = _preparation(train, label, (*exclude, fold_col)).fit(train)
        parts = []
        for part, rows in (("train", balanced_weight(ready.transform(train), label)), ("test", ready.transform(test))):
            columns = [label, "features", *(["weight"] if part == "train" else [key])]
            vectors = written_evenly(rows.select(key, *[c for c in columns if c != key]), key, f"{folder}/fold={name}/{part}", (train if part == "train" else test).count())
            parts.append(vectors.select(*columns))
        return Fold(name, *parts)

    return _side_by_side(spark, prepare, [(n,) for n in names], len(names))


def _side_by_side(spark: SparkSession, run, arguments: list[tuple], parallelism: int) -> list:
    """The results of several Spark jobs started from a pool of threads, in the order of their arguments."""
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(run), *a) for a in arguments]
        return [f.result() for f in started]


def fold_scores(
    folds: list[Fold], classifiers: dict[str, Estimator], label: str = LABEL, key: str = "trans_num", parallelism: int = 8
) -> tuple[DataFrame, list[tuple]]:
    """Every classifier fitted on every fold: the written test scores, and (name, fold, fit and score seconds).

    Scores have the columns classifier, fold, key, label and risk_score. The
    fits share a pool of threads, and classifiers with the same bins share those.
    """
    spark = folds[0].train.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/fold-scores-{uuid.uuid4().hex[:12]}"

    binned = {trees.binning(c): c for c in classifiers.values()}
    wanted = [(fold, how) for fold in folds for how in binned if how is not None]
    made = _side_by_side(spark, lambda fold, how: trees.binned(fold.train, binned[how]), wanted, parallelism)
    data = {(id(fold), how): bins for (fold, how), bins in zip(wanted, made)}

    fits = min(parallelism, len(classifiers) * len(folds))

    def one(name: str, fold: Fold) -> tuple:
        t0 = time.perf_counter()
        model = trees.fit(classifiers[name], fold.train, data.get((id(fold), trees.binning(classifiers[name]))), fits)
        t1 = time.perf_counter()
        scored = model.transform(fold.test).select(
            F.col(key), F.col(label), vector_to_array("probability")[1].alias("risk_score")
        )
        scored.write.parquet(f"{folder}/classifier={name}/fold={fold.name}")
        return name, fold.name, t1 - t0, time.perf_counter() - t1

    times = _side_by_side(spark, one, [(name, fold) for name in classifiers for fold in folds], parallelism)
    return spark.read.option("basePath", folder).parquet(folder), times


def cv_benchmark(
    df: DataFrame, classifiers: dict, fold_col: str = "fold", label: str = LABEL, threshold: float = 0.5, exclude=("trans_num",),
    parallelism: int = 8,
) -> DataFrame:
    """Mean and deviation of the metrics over the folds, best PR-AUC first."""
    from cardwatch.operators.evaluate import metrics_row

    wanted = {"pr_auc": "average_precision", "roc_auc": "roc_auc", "f1": "f1", "recall": "recall", "precision": "precision", "balanced_acc": "balanced_accuracy", "mcc": "mcc"}
    started = time.perf_counter()
    folds = prepared_folds(df, fold_col, label, tuple(exclude))
    scores, times = fold_scores(folds, classifiers, label, parallelism=parallelism)
    scores = scores.withColumn("prediction", F.col("risk_score") >= F.lit(float(threshold)))

    def measured(name: str, fold) -> dict:
        return metrics_row(scores.where((F.col("classifier") == name) & (F.col("fold") == fold))).first().asDict()

    results = _side_by_side(df.sparkSession, measured, [(name, fold) for name, fold, *_ in times], parallelism)
    rows = []
    for name in classifiers:
        mine = [(m, fit, scoring) for m, (n, _, fit, scoring) in zip(results, times) if n == name]
        row = [name]
        for source in wanted.values():
            values = [m[source] for m, *_ in mine if m[source] is not None]
            row += [mean(values), pstdev(values)] if values else [None, None]
        rows.append((*row, time.perf_counter() - started, mean(f for _, f, _ in mine), mean(t for *_, t in mine)))
    columns = ["model string", *[f"{m}_{s} double" for m in wanted for s in ("mean", "std")]]
    columns += ["cv_wall_time_sec double", "cv_fit_time_mean_sec double", "cv_score_time_mean_sec double"]
    out = df.sparkSession.createDataFrame(rows, ", ".join(columns))
    return out.orderBy(F.col("pr_auc_mean").desc_nulls_last(), "model")


def draws_from(space: dict[str, list], n_iter: int, seed: int) -> list[dict]:
    """Seeded draws; the same ones in every session."""
    rng = random.Random(seed)
    return [{p: rng.choice(values) for p, values in space.items()} for _ in range(n_iter)]


@dataclass(frozen=True)
class Search:
    """What a search found: every draw's exact average precision over the folds, and the scores behind it."""

    draws: dict[str, dict]  # name of the draw -> its parameters; names are kind-number
    scores: DataFrame
    average_precision: DataFrame  # classifier, fold, average_precision
    seconds: float

    def ranking(self) -> DataFrame:
        """(draw, kind, mean and deviation of the average precision, rank within its kind): the best first."""
        from pyspark.sql import Window

        means = self.average_precision.groupBy(F.col("classifier").alias("draw")).agg(
            F.avg("average_precision").alias("pr_auc_mean"), F.stddev_pop("average_precision").alias("pr_auc_std")
        )
        kind = F.regexp_extract("draw", "^(.*)-[0-9]+$", 1)
        number = F.regexp_extract("draw", "([0-9]+)$", 1).cast("int")
        best = Window.partitionBy("kind").orderBy(F.desc_nulls_last("pr_auc_mean"), "number")  # a handful of draws
        return means.withColumns({"kind": kind, "number": number}).withColumn("rank", F.row_number().over(best))


def search(
    df: DataFrame, kinds: tuple[str, ...] = ("gbt", "rf"), n_iter: int = 4, seed: int = 42, spaces: dict | None = None,
    fold_col: str = "fold", label: str = LABEL, exclude=("trans_num",), parallelism: int = 8,
) -> Search:
    """Random draws of several kinds of models, validated side by side on folds that are prepared once."""
    from cardwatch.operators.evaluate import grouped_average_precision

    started = time.perf_counter()
    makers = {"gbt": gbt, "rf": rf}
    spaces = spaces or SEARCH_SPACES
    draws = {f"{kind}-{i}": d for kind in kinds for i, d in enumerate(draws_from(spaces[kind], n_iter, seed))}
    classifiers = {name: makers[name.rsplit("-", 1)[0]](**d, labelCol=label) for name, d in draws.items()}
    folds = prepared_folds(df, fold_col, label, tuple(exclude))
    scores, _ = fold_scores(folds, classifiers, label, parallelism=parallelism)
    precision = grouped_average_precision(scores, ["classifier", "fold"], label)
    return Search(draws, scores, precision, time.perf_counter() - started)


def random_search(
    df: DataFrame, kind: str = "gbt", n_iter: int = 4, folds: int = 2, seed: int = 42, space: dict | None = None, fold_col: str = "fold",
    label: str = LABEL, exclude=("trans_num",), parallelism: int = 8,
) -> dict:
    """The best of some seeded draws by exact average precision, fitted again on all rows."""
    data = df if fold_col in df.columns else stratified_folds(df, label, folds, seed)
    found = search(data, (kind,), n_iter, seed, {kind: space or SEARCH_SPACES[kind]}, fold_col, label, exclude, parallelism)
    best = found.ranking().where("rank = 1").first()
    params = found.draws[best["draw"]]
    fit = {"gbt": fit_gbt, "rf": fit_rf}[kind]
    return {
        "model": kind,
        "best_model": fit(data.drop(fold_col), params, label, tuple(exclude)),
        "best_params": params,
        "best_cv_pr_auc": best["pr_auc_mean"],
        "tuning_time_sec": found.seconds,
        "n_iter": n_iter,
    }


# --- storage ----------------------------------------------------------------------------------------


def save_model(model: PipelineModel, path: str, spark: SparkSession, **meta) -> None:
    """Model and a one-row metadata table under one folder."""
    model.write().overwrite().save(f"{path}/model")
    row = {"created_at": datetime.now(timezone.utc).isoformat(), "name": MODEL_NAME, **meta}
    fields = {k: ",".join(map(str, v)) if isinstance(v, (list, tuple)) else v for k, v in row.items()}
    spark.createDataFrame([tuple(fields.values())], list(fields)).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_model(path: str, spark: SparkSession) -> tuple[PipelineModel, dict]:
    """The model and its metadata; ``features`` lists the expected columns."""
    meta = spark.read.json(f"{path}/meta").first().asDict()
    if isinstance(meta.get("features"), str):
        meta["features"] = meta["features"].split(",")
    meta.setdefault("name", MODEL_NAME)
    return PipelineModel.load(f"{path}/model"), meta


RUNS_SCHEMA = (
    "run_id string, experiment string, run_name string, start_time timestamp, params string, "
    "pr_auc double, roc_auc double, `precision` double, recall double, "
    "train_pr_auc double, train_roc_auc double, train_precision double, train_recall double, "
    "row_count long, feature_count int"
)


def append_run(spark: SparkSession, path: str, **run) -> None:
    """Add one training run to the registry folder."""
    schema = T._parse_datatype_string(RUNS_SCHEMA)
    spark.createDataFrame([tuple(run.get(f.name) for f in schema.fields)], schema).coalesce(1).write.mode("append").parquet(path)


def best_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    return runs.orderBy(F.col("pr_auc").desc_nulls_last(), F.col("start_time").desc_nulls_last()).limit(n)
