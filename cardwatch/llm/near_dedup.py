"""Near duplicates by fast similarity sketches, banding and exact verification.

Method: a sketch has T coordinates. In round i < T every shingle hashes to one
coordinate and offers the value (i, hash); in round T + i all shingles offer to
coordinate i. A coordinate keeps its smallest offer, so rounds stop as soon as
all are filled, which they are after 2T rounds at the latest. Bands of
coordinates propose candidates. Candidates form families (connected through
shared bands), and inside families the full shingle sets are compared, in
blocks, so every link is exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardwatch.llm.common import Workspace, arrow_limits, blocks, has_id_in, mix, text_or_empty, utf8_view, without_ids, word_hashes
from cardwatch.llm.components import components

WORDS = 5
SIMILARITY = 75  # per cent
COORDINATES, ROWS_PER_BAND = 128, 4
BANDS = COORDINATES // ROWS_PER_BAND
#: Documents of a family compared at a time; two blocks meet in one task.
FAMILY_BLOCK = 100
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACES = mix(np.arange(1, 2 * WORDS + 2, dtype=np.uint64)) | np.uint64(1)
_ROUNDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) << np.uint64(20))
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, offsets: np.ndarray):
    """The sorted distinct 64-bit shingle hashes of each text of one block of bytes."""
    x = _LOWER[data[offsets[0] : offsets[-1]]]
    o = offsets - offsets[0]
    n = len(o) - 1
    if not len(x):
        return [np.zeros(0, np.uint64)] * n
    gap = _SPACE[x]
    begin = ~gap
    begin[1:] &= gap[:-1]
    inner = o[:-1][(o[:-1] < o[1:])]
    begin[inner] = ~gap[inner]
    last = ~gap
    last[:-1] &= gap[1:]
    ends_at = inner[1:] - 1
    last[ends_at] = ~gap[ends_at]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    words = word_hashes(x, start, end)
    first = np.searchsorted(start, o)
    long = np.zeros(0, np.uint64)
    if len(words) >= WORDS:
        m = len(words) - WORDS + 1
        long = words[:m] * _PLACES[0]
        for k in range(1, WORDS):
            long = long + words[k : k + m] * _PLACES[k]
        long = mix(long)
    out = []
    for i in range(n):
        a, z = first[i], first[i + 1]
        if z - a >= WORDS:
            out.append(np.unique(long[a : z - WORDS + 1]))
        elif z > a:
            w = words[a:z] * _PLACES[WORDS : WORDS + z - a]
            out.append(mix(w.sum(keepdims=True) + _PLACES[-1:] * np.uint64(z - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(shingles: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """T values; equal coordinates of two sketches estimate the similarity of the sets."""
    s = np.full(t, _EMPTY, np.uint64)
    for i in range(t):
        h = mix(shingles ^ _ROUNDS[i])
        offer = np.uint64(i) << np.uint64(56) | h & np.uint64((1 << 56) - 1)
        at = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(s, at, offer)
        if (s != _EMPTY).all():
            return s
    for i in np.flatnonzero(s == _EMPTY):
        h = mix(shingles ^ _ROUNDS[t + i])
        s[i] = np.uint64(t + i) << np.uint64(48) | h.min() >> np.uint64(16)
    return s


def band_keys(s: np.ndarray) -> np.ndarray:
    rows = s.reshape(BANDS, ROWS_PER_BAND)
    h = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS_PER_BAND):
        h = mix(h * _PLACES[0] + rows[:, k])
    return h.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a digest of the whole set, and the band keys (none for an empty set)."""
    arrow_limits(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, offsets = utf8_view(batch.column("text"))
            counts, digests, keys = [], [], []
            for i, j in blocks(offsets):
                for s in shingle_sets(data, offsets[i : j + 1]):
                    counts.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    keys.append(band_keys(sketch(s)) if len(s) else np.zeros(0, np.int64))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(np.cumsum([0, *map(len, keys)], dtype=np.int32), flat),
                ],
                names=["doc_id", "n_shingles", "digest", "bands"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the exact links between two groups of sets (positions in ``sets``)."""
    ids = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, times = np.unique(ids, return_inverse=True, return_counts=True)
    shared = times[code] > 1
    code, owner = code[shared], owner[shared]
    columns, code = np.unique(code, return_inverse=True)
    both = np.zeros((len(left), len(right)), np.float32)
    place = np.full(len(sets), -1)
    place[left] = np.arange(len(left))
    other = np.full(len(sets), -1)
    other[right] = np.arange(len(right))
    for c in range(0, len(columns), 4096):
        inside = (code >= c) & (code < c + 4096)
        a = np.zeros((len(left), 4096), np.float32)
        b = np.zeros((len(right), 4096), np.float32)
        o, k = owner[inside], code[inside] - c
        a[place[o][place[o] >= 0], k[place[o] >= 0]] = 1
        b[other[o][other[o] >= 0], k[other[o] >= 0]] = 1
        both += a @ b.T
    size = np.array([len(s) for s in sets])
    inter = both.astype(np.int64)
    linked = 100 * inter >= percent * (size[left][:, None] + size[right][None] - inter)
    parent = list(range(len(sets)))

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for i, j in zip(*np.nonzero(linked)):
        u, v = int(left[i]), int(right[j])
        if u != v and (a := root(u)) != (b := root(v)):
            parent[a] = b
            out.append((u, v))
    return out


def _verified(families: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between members of a family: rows (family, i, j, block, id, text), one task at a time for each (family, i, j)."""

    def run(batches):
        key, ids, side, sets = None, [], [], []

        def done():
            if len(ids) < 2:
                return []
            at = np.array(side)
            left = np.flatnonzero(at == key[1])
            right = left if key[1] == key[2] else np.flatnonzero(at == key[2])
            return [(ids[u], ids[v]) for u, v in _links(sets, left, right, percent)]

        for batch in batches:
            found = []
            data, offsets = utf8_view(batch.column("text"))
            row_keys = list(zip(*(batch.column(c).to_pylist() for c in ("family", "i", "j"))))
            block, doc = batch.column("block").to_pylist(), batch.column("id").to_pylist()
            r = 0
            for a, z in blocks(offsets):
                for s in shingle_sets(data, offsets[a : z + 1]):
                    if row_keys[r] != key:
                        found += done()
                        key, ids, side, sets = row_keys[r], [], [], []
                    ids.append(doc[r])
                    side.append(block[r])
                    sets.append(s)
                    r += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"]
            )
        found = done()
        yield pa.RecordBatch.from_arrays(
            [pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"]
        )

    return families.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, percent: int = SIMILARITY, family_block: int = FAMILY_BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents whose sets of five-word shingles have ``100 * intersection >=
    percent * union`` are linked; ``component_id`` is the smallest id reachable.
    Equal sets are one candidate, whatever their number. A pair at exactly 75 %
    shares no band with a probability of 5e-6; no other loss occurs. All
    members of a family are compared in blocks of ``family_block`` texts, each
    task sends back only a spanning forest of its links.

    A null or empty text has no shingles and is linked with nothing; a null id
    is linked with nothing, its component is null and it is kept; rows that
    repeat id and text get equal rows; ids are otherwise taken to be unique; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "near-dedup")
    sketched = work.write(sketches(docs), "sketches")
    full = sketched.where("digest is not null and doc_id is not null")
    classes = work.write(
        full.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")), "classes"
    )
    banded = classes.select("id", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    near = banded.join(buckets.hint("merge"), "bucket").select(F.col("id").alias("u"), F.col("hub").alias("v"))
    family_of = work.write(components(near, work, "families"), "family-of")

    # Members are numbered within salted parts of their family, then cut into blocks.
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = family_of.select("id", F.col("root").alias("family"), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    parts = salted.groupBy("family", "salt").agg(F.count(F.lit(1)).alias("n"))
    by_family = Window.partitionBy("family")
    earlier = by_family.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "family", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("carried"), F.sum("n").over(by_family).alias("members")
    )
    number = F.row_number().over(Window.partitionBy("family", "salt").orderBy("id")) - 1
    numbered = salted.withColumn("number", number).join(parts, ["family", "salt"])
    numbered = numbered.select(
        "id",
        "family",
        F.call_function("div", F.col("number") + F.col("carried"), F.lit(family_block)).alias("block"),
        F.call_function("div", F.col("members") - 1, F.lit(family_block)).alias("last"),
    )
    numbered = work.write(numbered, "numbered")
    texts = has_id_in(docs, numbered.select("id"), "doc_id").select(
        F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text")
    )
    members = numbered.join(texts.hint("merge"), "id").dropDuplicates(["id"])
    met = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    met = met.select(
        "family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "text"
    )
    arranged = met.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    links = work.write(_verified(arranged, percent), "links")
    root_of = components(links, work, "components")

    membership = full.select("doc_id", "digest").join(
        classes.select("digest", "id").hint("merge"), "digest"
    ).select("doc_id", "id").distinct()
    joined = membership.join(root_of.hint("merge"), "id", "left").select(
        F.col("doc_id").alias("__id"), F.coalesce("root", "id").alias("root")
    )
    result = sketched.join(joined.hint("merge"), F.col("doc_id") == F.col("__id"), "left")
    component = F.coalesce("root", "doc_id")
    return result.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def without_near_duplicates(docs: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """The documents that stay, one of each component, with all their columns, whatever their names.

    Null and empty texts and null ids stay; rows that share id and text stay or
    go together; whole texts of any length count; an empty table gives no rows.
    """
    return without_ids(docs, near_duplicates(docs, percent).where("not kept").select("doc_id"))
