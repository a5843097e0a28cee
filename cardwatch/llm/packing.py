"""Documents packed into as few sequences of a fixed number of tokens as possible.

Method (best-two-fit): a sequence is filled greedily with the longest pieces
that fit; then its smallest piece is replaced by two unpacked ones that fill
the widened gap more tightly. Only lengths matter for this, so it runs over the
histogram of lengths (at most ``capacity`` numbers): a filling is repeated as
often as its lengths last, and pieces are dealt to the fillings by their rank
among the pieces of equal length.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardwatch.llm.common import Workspace, arrow_limits, text_or_empty
from cardwatch.llm.tokens import byte_vocabulary

CAPACITY = 1024
END_ID = 2
#: Fixed value: how the tokenizer splits text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of the tokenizer file; plain Latin texts go through the faster of two equal libraries."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        vocabulary, _, self.special = byte_vocabulary(path)
        self.exact = Tokenizer.from_file(path)
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens=self.special)
        self.allowed = set(self.special)

    def ids(self, text: str) -> np.ndarray:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:  # characters on whose classes the libraries' tables may differ
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        try:
            return self.fast.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())
        except ValueError:  # its pattern engine gives up on very long runs of white space
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: its ids and the end id, cut only if longer than ``capacity``.

    Of a longer document the first piece takes what is left over and all others
    are full. ``with_ids`` adds the ids themselves.
    """
    arrow_limits(docs.sparkSession)

    def run(batches):
        encoder = Encoder(tokenizer_path)
        for batch in batches:
            rows = ([], [], [], [], [], [])
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(encoder.ids(text), np.uint32(end_id)).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or min(capacity, len(ids)), len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for column, value in zip(rows, (doc, k, a, b - a, zlib.crc32(ids[a:b]), ids[a:b])):
                        column.append(value)
            doc, k, a, n, crc, ids = rows
            columns = [
                pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(a, pa.int64()),
                pa.array(n, pa.int64()), pa.array(crc, pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids array<long>" if with_ids else ""))


def fillings(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how often, lengths from long to short) for all pieces of a histogram of lengths."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    out = []
    while left.any():
        bin_, gap, free = [], capacity, left.copy()
        while gap and (fit := np.flatnonzero(free[1 : gap + 1])).size:
            n = int(fit[-1]) + 1
            take = int(min(free[n], gap // n))
            bin_ += [n] * take
            gap -= n * take
            free[n] -= take
        while gap and len(bin_) > 1 and (two := _two(free, gap + bin_[-1], bin_[-1])):
            free[bin_[-1]] += 1
            gap += bin_.pop() - sum(two)
            for n in two:
                free[n] -= 1
            bin_ = sorted([*bin_, *two], reverse=True)
        lengths, times = np.unique(bin_, return_counts=True)
        often = int((left[lengths] // times).min())
        left[lengths] -= times * often
        out.append((often, bin_))
    return out


def _two(free: np.ndarray, gap: int, more_than: int) -> tuple[int, int] | None:
    """The two free lengths of the largest sum in (more_than, gap]; the more even of equal sums is not preferred."""
    a = np.flatnonzero(free[: gap + 1])
    a = a[a > 0]
    if not a.size:
        return None
    at = np.searchsorted(a, np.minimum(gap - a, a), side="right") - 1
    same = (at >= 0) & (a[np.maximum(at, 0)] == a) & (free[a] < 2)
    at = np.where(same, at - 1, at)
    total = np.where(at >= 0, a + a[np.maximum(at, 0)], 0)
    best = int(len(total) - 1 - np.argmax(total[::-1]))
    return (int(a[best]), int(a[at[best]])) if total[best] > more_than else None


def allotments(filled: list[tuple[int, list[int]]]) -> list[dict]:
    """For each length: from which rank on pieces go to which sequences, at which offset."""
    rank: dict[int, int] = {}
    by_length: dict[int, list[dict]] = {}
    sequence = 0
    for often, lengths in filled:
        offset = 0
        for n in dict.fromkeys(lengths):
            copies = lengths.count(n)
            row = {"first": rank.get(n, 0), "sequence": sequence, "copies": copies, "offset": offset}
            by_length.setdefault(n, []).append(row)
            rank[n] = rank.get(n, 0) + often * copies
            offset += n * copies
        sequence += often
    return [{"length": n, "lots": lots} for n, lots in sorted(by_length.items())]


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, order: DataFrame | None = None
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone; rows that repeat are packed as
    often as they occur; an empty table gives no rows; null ids stay.

    ``order`` has the columns doc_id, slot and place, as ``mixing.interleave``
    returns them. Pieces of equal length are then dealt in that order, and
    sequences are numbered by the earliest place of their pieces. Rows that
    share an id share its first place; a document without a place comes last.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    cut = work.write(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    lots = json.dumps(allotments(fillings(counts, capacity)))
    schema = "array<struct<length:bigint,lots:array<struct<first:bigint,sequence:bigint,copies:bigint,offset:bigint>>>>"
    plan = spark.range(1).select(F.inline(F.from_json(F.lit(lots), schema)))

    # Many pieces may have one length (a third of all, or all that are full): rank them in groups,
    # by a salt or, in a given order, by the range of places they fall into.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["doc_id", "piece", "start", "ids_crc32"]
    if order is None:
        grouped = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    else:
        keys = ["slot", "place", *keys]
        ranged = _with_place(cut, order).repartitionByRange(parts, *keys)
        grouped = work.write(ranged.withColumn("part", F.spark_partition_id()), "ranged")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    carry = groups.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("carried"))
    within = Window.partitionBy("length", "part").orderBy(*keys)
    ranked = grouped.withColumn("rank", F.row_number().over(within) - 1).join(carry, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("carried"))
    dealt = ranked.join(F.broadcast(plan), "length")  # at most ``capacity`` rows
    dealt = dealt.withColumn("lot", F.expr("element_at(filter(lots, x -> x.first <= rank), -1)"))
    inside = F.col("rank") - F.col("lot.first")
    dealt = dealt.select(
        *grouped.columns,
        (F.col("lot.sequence") + F.call_function("div", inside, F.col("lot.copies"))).alias("sequence_id"),
        (F.col("lot.offset") + inside % F.col("lot.copies") * F.col("length")).alias("offset"),
    )
    if order is not None:
        dealt = _numbered_by_place(work.write(dealt, "dealt"), keys)
    return dealt.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _with_place(cut: DataFrame, order: DataFrame) -> DataFrame:
    """The pieces with the first (slot, place) of their document; without one they come last."""
    first = order.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min(F.struct("slot", "place")).alias("__at"))
    placed = cut.join(first, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    last = F.lit((1 << 63) - 1)
    return placed.select(*cut.columns, *[F.coalesce(F.col(f"__at.{c}").cast("long"), last).alias(c) for c in ("slot", "place")])


def _numbered_by_place(dealt: DataFrame, keys: list[str]) -> DataFrame:
    """Sequences numbered from 0 in the order of their first piece; ``part`` is the range of places of a piece."""
    first = dealt.groupBy("sequence_id").agg(F.min(F.struct("part", *keys)).alias("at"))
    first = first.select("sequence_id", "at", F.col("at.part").alias("part"))
    # A part has no more sequences than pieces; the sums over parts are one row a shuffle partition.
    sizes = first.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("carried"))
    number = F.row_number().over(Window.partitionBy("part").orderBy("at", "sequence_id")) - 1
    numbered = first.withColumn("number", number).join(carry, "part")
    numbered = numbered.select("sequence_id", (F.col("number") + F.col("carried")).alias("number"))
    return dealt.join(numbered, "sequence_id").withColumn("sequence_id", F.col("number"))


def sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The packed ids themselves: sequence_id and at most ``capacity`` ids; ids of documents are taken to be unique."""
    at = pack(docs, tokenizer_path, capacity, end_id).select("doc_id", "piece", "sequence_id", "offset")
    whole = pieces(docs, tokenizer_path, capacity, end_id, with_ids=True).select("doc_id", "piece", "ids")
    joined = whole.join(at, ["doc_id", "piece"])
    filled = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return filled.select("sequence_id", F.flatten(F.col("x.ids")).alias("ids"))
