"""What several corpus operators share: the shared work folder, byte views of Arrow text, hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwatch.session import ensure_checkpoint_dir, ship_package

#: White space of the text contracts: the space and the control characters from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
FOLDS = 5
BATCH_ROWS = 1_000
BLOCK_BYTES = 1 << 20
#: A filter of ids never takes more than 2**27 bits = 16 MB, whatever the input.
MAX_FILTER_BITS = 27
_CHUNK = 32_768


class Workspace:
    """Tables written to the shared folder: they cut the lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def arrow_limits(spark: SparkSession) -> None:
    """Small Arrow batches, so that a worker holds few whole texts at a time; the workers get this package."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id is not in the only column of ``gone``; null ids stay."""
    name = spare(docs, "__gone")
    return docs.join(gone.toDF(name), F.col(id_col).cast("long") == F.col(name), "left_anti")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def n_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def held_out(doc_id: Column) -> Column:
    """Every fifth document by the checksum of its id; a missing id is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def share_of_rows(cap: int, n: int, *identity: Column) -> Column:
    """A repeatable choice of about ``cap`` of ``n`` rows, by a hash of what identifies a row."""
    return F.pmod(F.xxhash64(*identity), F.lit(1 << 30)) < int(min(1.0, cap / max(1, n)) * (1 << 30))


def has_id_in(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id may be among ``ids``: all that are, and a few more.

    Saves shuffling the texts of documents that a later exact join would drop
    anyway. The bitmap has 16 bits for each id up to a fixed size; beyond that
    it merely lets more rows through.
    """
    spark = docs.sparkSession
    bits = min(MAX_FILTER_BITS, max(15, int(ids.count()).bit_length() + 4))
    place = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(1 << bits))
    at = ids.toDF(id_col).select(place.alias("h"))
    rows = (
        at.groupBy(F.expr(f"h div {_CHUNK}").alias("b"))
        .agg(F.bitmap_construct_agg(F.col("h") % _CHUNK).alias("m"))
        .collect()
    )
    table = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        table[r["b"] * (_CHUNK // 8) : (r["b"] + 1) * (_CHUNK // 8)] = np.frombuffer(bytes(r["m"]), np.uint8)
    sent = spark.sparkContext.broadcast(table)

    @F.pandas_udf(T.BooleanType())
    def among(h):
        import pandas as pd

        v = h.to_numpy(dtype=np.int64)
        return pd.Series((sent.value[v >> 3] >> (v & 7)) & 1 > 0)

    return docs.where(F.col(id_col).isNotNull()).where(among(place))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with the columns of their group; ``groups`` has one row for each key and ``size``, its number of rows.

    Groups above the mean size of a shuffle partition meet their rows through
    a broadcast: there are fewer of them than partitions, whatever the input.
    All other rows are shuffled by ``key``. Null keys match nothing.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = groups.agg(F.sum(size)).first()[0] or 0
    large = groups.where(F.col(size) * parts > total)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(groups.hint("merge"), key)
    return rows.join(F.broadcast(large), key).unionByName(rest)


# --- bytes of Arrow text -------------------------------------------------------------------


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column (null: empty) and the offsets of its rows, without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), o.astype(np.int64)


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# --- hashing -------------------------------------------------------------------------------

_RNG = np.random.default_rng(20_240_229)
#: One random odd-looking 64-bit value for each byte.
BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= BLOCK_BYTES * 4:
            _POWERS[name] = have
    return have[:n]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words (start, end), where ``data[start:end]`` one after the other are all bytes that count.

    Each place of a word has a random factor of its own. Powers of one base
    would do for no input at all: words made for it (a Thue-Morse word and its
    complement) agree for every base modulo a power of two.
    """
    length = end - start
    if not len(length):
        return np.zeros(0, np.uint64)
    first = np.cumsum(length) - length
    place = np.arange(int(first[-1] + length[-1])) - np.repeat(first, length)
    factors = mix(np.arange(1, int(length.max()) + 1, dtype=np.uint64) * _BASE)
    sums = np.add.reduceat(BYTE_VALUES[data[place + np.repeat(start, length)]] * factors[place], first)
    return mix(sums ^ mix(length.astype(np.uint64)))


class RunningHash:
    """Hashes of any stretch of a byte block in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * _powers("up", _BASE, n), out=self.sums[1:])
        self.down = _powers("down", _INVERSE, n + 1)

    def fixed(self, length: int) -> np.ndarray:
        """The hash of each stretch of one length."""
        d = self.sums[length:] - self.sums[:-length]
        return mix(d * self.down[: len(d)])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))
