"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

Method: a document is its words weighted by how often they occur. For sample j
every word draws r and c from Gamma(2, 1) and b from [0, 1), all by hashing the
word, so that they are the same in every document. With weight w,

    t = floor(ln w / r + b),    a = c * exp(-r * (t - b) - r)

and the sample is the (word, t) of the smallest a. Two documents agree in a
sample with the probability of their generalised Jaccard similarity.
"""

from __future__ import annotations

import json
from math import exp, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwatch.llm.common import SPACES, Workspace, text_or_empty
from cardwatch.plans.slices import SlicePlan, with_slice

SAMPLES = 64
DIGITS = 8  # hexadecimal digits of a sample
LEVELS = 256
#: Samples taken of one row; the compiled code of more would be too long to be optimised.
TOGETHER = 32
#: Text of one bucket, so that the word counts of a task fit into memory.
BUCKET_BYTES = 6 << 20
MAX_BUCKETS = 20_000
_LOW = 0xFFFFFFFF


def gamma_levels(n: int = LEVELS) -> list[float]:
    """The middles of ``n`` equally likely cells of Gamma(2, 1), whose distribution is 1 - (1 + x) exp(-x)."""
    out, x = [], 0.05
    for i in range(n):
        p = (i + 0.5) / n
        lo, hi = 0.0, 60.0
        for _ in range(60):
            x = (lo + hi) / 2
            lo, hi = (x, hi) if 1 - (1 + x) * exp(-x) < p else (lo, x)
        out.append(x)
    return out


def _table(values: list[float]) -> Column:
    return F.from_json(F.lit(json.dumps([float(f"{v:.6g}") for v in values])), "array<double>")


def _sample(j: Column, word: Column, log_weight: Column, r_of: Column, log_c_of: Column) -> Column:
    """One 64-bit number for sample j: ln a in the upper half, so that the minimum finds it, and (word, t) in the lower."""
    h = F.xxhash64(word, j)
    r = F.get(r_of, h.bitwiseAND(LEVELS - 1).cast("int"))
    log_c = F.get(log_c_of, F.shiftright(h, 8).bitwiseAND(LEVELS - 1).cast("int"))
    b = F.shiftright(h, 16).bitwiseAND((1 << 20) - 1) * (1.0 / (1 << 20))
    t = F.when(log_weight == 0, F.lit(0)).otherwise(F.floor(log_weight / r + b))
    log_a = log_c - r * (t - b) - r
    which = F.shiftrightunsigned(h, 32).bitwiseXOR(t)
    return F.shiftleft(((log_a + 80.0) * float(1 << 23)).cast("long"), 32).bitwiseOR(which)


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples in which two fingerprints agree."""
    def same(j: Column) -> Column:
        at = j * DIGITS + 1
        return F.when(F.substr(a, at, F.lit(DIGITS)) == F.substr(b, at, F.lit(DIGITS)), 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.lit(samples - 1)), F.lit(0), lambda n, j: n + same(j)) / float(samples)


def _buckets(spark, docs: DataFrame) -> tuple[SlicePlan, int]:
    """Cut points of the id order: constants of the plan, at most ``MAX_BUCKETS``."""
    n, total = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (total or 0) // BUCKET_BYTES)
    parts = int(max(1, min(MAX_BUCKETS, wanted, n or 1)))
    cuts: list[int] = []
    if parts > 1:
        shares = F.lit([i / parts for i in range(1, parts)])
        cuts = sorted(set(docs.agg(F.percentile_approx("k", shares, 20 * parts)).first()[0]))
    schema = T.StructType([T.StructField("k", T.LongType())])
    return SlicePlan((), ("k",), n or 0, n or 0, [(c,) for c in cuts], schema), len(cuts) + 1


def fingerprints(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text replaces the last quarter of the code points by the first
    as many of the next document in id order (the first after the last).
    Words are maximal runs without white space. A text without words has a
    fingerprint of zeros, is like another such text (1) and unlike any other (0).

    A null text is empty; null ids come first; rows of one id are ordered by
    their text; an empty table gives no rows. Texts are shuffled once, by
    ranges of ids, and everything else happens inside these ranges; each range
    also gets the first document of the next one.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "fingerprint")
    lowest = -(1 << 63)
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("k"), text_or_empty(text_col).alias("text"))
    plan, parts = _buckets(spark, source)
    placed = with_slice(source, plan, "bucket")

    heads = placed.groupBy("bucket").agg(F.min("k").alias("k"))  # one row per bucket
    by_bucket = Window.orderBy("bucket")
    first_of_all = F.first("k").over(by_bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("bucket", F.coalesce(F.lead("k").over(by_bucket), first_of_all).alias("k"))
    after = source.join(F.broadcast(heads), "k").groupBy("bucket", "k").agg(F.min("text").alias("text"))
    after = work.write(after, "heads")
    rows = placed.select("bucket", "k", "text", F.lit(False).alias("ghost")).unionByName(
        after.select("bucket", "k", "text", F.lit(True).alias("ghost"))
    )

    # From here to the result every step is partitioned by bucket.
    dealt = rows.repartition(parts, "bucket")
    inside = Window.partitionBy("bucket").orderBy("ghost", "k", "text")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next", F.lit(1), quarter))
    pairs = dealt.select(
        "bucket", "k", "ghost", "text", F.row_number().over(inside).alias("row"), F.lead("text").over(inside).alias("next")
    )
    pairs = pairs.withColumn("edited", F.when(~F.col("ghost"), edited))
    # The words before the edit are split once for both texts: up to the last white space of the part that stays.
    whole = F.when(F.col("ghost"), F.lit("")).otherwise(
        F.regexp_extract(F.substring("text", F.lit(1), n - quarter), r"(?s)^(.*[\x20\x09-\x0D])", 1)
    )
    key = ["bucket", "row", "k", "ghost", "n", "sha"]
    pairs = pairs.select(
        "bucket",
        "row",
        "k",
        "ghost",
        n.cast("long").alias("n"),
        F.unhex(F.sha2(F.col("edited").cast("binary"), 256)).alias("sha"),
        "text",
        "edited",
        whole.alias("whole"),
    )
    rest = F.length("whole") + 1
    segments = F.array(
        F.struct(F.lit(1).alias("here"), F.lit(1).alias("there"), F.col("whole").alias("t")),
        F.struct(F.lit(1).alias("here"), F.lit(0).alias("there"), F.substring("text", rest, n).alias("t")),
        F.struct(F.lit(0).alias("here"), F.lit(1).alias("there"), F.substring("edited", rest, F.length("edited")).alias("t")),
    )
    words = pairs.select(*key, F.inline(segments)).select(*key, "here", "there", F.explode(F.split("t", SPACES)).alias("w"))
    words = words.select(*key, "here", "there", F.when(F.col("w") != "", F.xxhash64("w")).alias("word"))
    counts = words.groupBy(*key, "word").agg(F.sum("here").alias("here"), F.sum("there").alias("there"))

    # One row for each weight of a word: mostly it weighs the same in both texts (kind 3).
    def weighing(weight: str, kind: int) -> Column:
        return F.struct(F.log(F.col(weight).cast("double")).alias("lw"), F.lit(kind).alias("kind"))

    weights = F.when(F.col("here") == F.col("there"), F.array(weighing("here", 3))).otherwise(
        F.array(weighing("here", 1), weighing("there", 2))
    )
    turns = -(-samples // TOGETHER)
    spread = counts.select(*key, "word", F.inline(weights)).where("word is null or lw is not null")
    spread = spread.select(*key, "word", "lw", "kind", F.explode(F.array(*map(F.lit, range(turns)))).alias("turn"))
    levels = gamma_levels()
    r_of, log_c_of = _table(levels), _table([log(x) for x in levels])
    word, lw = F.col("word"), F.col("lw")
    drawn = [
        F.min(F.when(word.isNotNull(), _sample(F.col("turn") * TOGETHER + i, word, lw, r_of, log_c_of))).alias(f"s{i}")
        for i in range(TOGETHER)
    ]
    sampled = spread.groupBy(*key, "turn", "kind").agg(*drawn)
    sampled = sampled.groupBy(*key, "turn").agg(
        *[F.min(F.when(F.col("kind") != 2, F.col(f"s{i}"))).alias(f"a{i}") for i in range(TOGETHER)],
        *[F.min(F.when(F.col("kind") != 1, F.col(f"s{i}"))).alias(f"b{i}") for i in range(TOGETHER)],
    )

    def printed(side: str) -> Column:
        low = [F.coalesce(F.col(f"{side}{i}").bitwiseAND(_LOW), F.lit(0)) for i in range(TOGETHER)]
        return F.concat(*[F.lpad(F.hex(x), DIGITS, "0") for x in low])

    part = sampled.select(*key, "turn", printed("a").alias("a"), printed("b").alias("b"))
    line = Window.partitionBy("bucket").orderBy("row", "turn")

    def ahead(column: str, skip: int) -> Column:
        return F.substring(F.concat(*[F.lead(column, skip + i).over(line) for i in range(turns)]), 1, samples * DIGITS)

    lined = part.select(
        "k",
        "ghost",
        "turn",
        "n",
        F.col("sha").alias("edited_sha"),
        ahead("a", 0).alias("fp"),
        ahead("b", 0).alias("edited_fp"),
        ahead("a", turns).alias("next_fp"),
    ).where("turn = 0 and not ghost")
    return lined.select(
        F.nullif(F.col("k"), F.lit(lowest)).alias("doc_id"),
        F.col("n").alias("n_chars"),
        F.lower(F.hex("edited_sha")).alias("edited_sha256"),
        F.col("fp").alias("fingerprint"),
        F.col("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp"), samples).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp"), samples).alias("near_next"),
    )
