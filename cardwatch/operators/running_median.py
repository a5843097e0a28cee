"""Exact median of all earlier values of a key.

A wavelet matrix over the ranks of the values answers "the k-th smallest of the
first p values" for all rows at once: one step for each binary digit, each a
few array operations, no loop over rows. A history that fits one task is one
such matrix. A longer one is cut by time and by value: first each time slice
finds, with the counts of all earlier slices, the value range that holds each
row's median; then each range answers the rows that fell into it. Both steps
use the same descent. NULL values are skipped, as in ``percentile``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cardwatch.plans.prefix import null_safe_join
from cardwatch.plans.slices import plan_slices, with_slice
from cardwatch.session import written

#: Value ranges of all cut histories together: the length of the vector of counts a time slice carries.
VALUE_RANGES = 1024


class WaveletMatrix:
    """A sequence of numbers below 2**bits that finds order statistics of its stretches, many at a time."""

    def __init__(self, numbers: np.ndarray, bits: int):
        self.levels = []
        for bit in reversed(range(bits)):
            zero = (numbers >> bit) & 1 == 0
            self.levels.append((bit, np.concatenate([[0], np.cumsum(zero)])))
            numbers = np.concatenate([numbers[zero], numbers[~zero]])

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray, more: np.ndarray | None = None):
        """The k-th smallest number (from 0) between positions low and high.

        Returns it, its place among equal numbers, and how many equal ones the
        stretch has. ``more[v]`` counts further numbers below v that belong to
        every stretch.
        """
        number = np.zeros(len(k), np.int64)
        for bit, zeros in self.levels:
            low0, high0 = zeros[low], zeros[high]
            left = high0 - low0
            if more is not None:
                left = left + more[number + (1 << bit)] - more[number]
            right = k >= left
            low = np.where(right, zeros[-1] + low - low0, low0)
            high = np.where(right, zeros[-1] + high - high0, high0)
            k = np.where(right, k - left, k)
            number = number + (right.astype(np.int64) << bit)
        equal = high - low
        if more is not None:
            equal = equal + more[number + 1] - more[number]
        return number, k, equal


def _bits(n: int) -> int:
    return max(1, int(n - 1).bit_length())


def order_statistics(values: np.ndarray, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th smallest of ``values[low:high]``, for each query."""
    order = np.argsort(values, kind="stable")
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    found, _, _ = WaveletMatrix(rank, _bits(len(values))).kth(low, high, k)
    return values[order[found]]


def prior_medians(values: np.ndarray, missing: np.ndarray, starts: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Median of the values before each row of its history; NaN without any.

    Histories lie one after the other and begin at ``starts``; ``earlier`` are
    the values of the first history that came before these rows.
    """
    there = ~missing
    pool = np.concatenate([earlier, values[there]])
    out = np.full(len(values), np.nan)
    count = len(earlier) + np.concatenate([[0], np.cumsum(there)[:-1]])  # values of any history before the row
    first = count[starts]
    first[0] = 0
    low = np.repeat(first, np.diff(np.append(starts, len(values))))
    n = count - low
    some = np.flatnonzero(n)
    if len(some):
        low, high, n = low[some], count[some], n[some]
        smaller = order_statistics(pool, np.tile(low, 2), np.tile(high, 2), np.concatenate([(n - 1) // 2, n // 2]))
        out[some] = (smaller[: len(some)] + smaller[len(some) :]) / 2
    return out


def _numbers(column) -> tuple[np.ndarray, np.ndarray]:
    """Values as doubles and which are missing."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    missing = column.is_null().to_numpy(zero_copy_only=False)
    return pc.fill_null(column.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False), missing


def _with_median_field(df: DataFrame, name: str) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])


def median_of_whole_histories(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str, clustered: bool = False
) -> DataFrame:
    """Running prior median where every history fits one task.

    ``clustered`` says that the rows are already laid out by key. They stream
    through Arrow in key order, many keys per batch; of a history that
    continues in the next batch the values are remembered until it ends.
    """

    def run(batches):
        open_key, seen = None, np.empty(0)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            values, missing = _numbers(batch[value])
            starts = _key_starts(batch, keys)
            if open_key != tuple(batch[k][0].as_py() for k in keys):
                seen = np.empty(0)
            medians = prior_medians(values, missing, starts, seen)
            last = starts[-1]
            kept = values[last:][~missing[last:]]
            seen = np.concatenate([seen, kept]) if len(starts) == 1 else kept
            open_key = tuple(batch[k][len(values) - 1].as_py() for k in keys)
            column = pa.array(medians, mask=np.isnan(medians))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])

    rows = df if clustered else df.repartition(*keys)
    return rows.sortWithinPartitions(*keys, *order).mapInArrow(run, _with_median_field(df, name))


def _key_starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Row numbers where a new key begins."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        column = batch[k]
        differs = pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
        null = column.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= differs & ~(null[1:] & null[:-1])
    return np.flatnonzero(new)


def median_of_sliced_histories(
    df: DataFrame,
    plain: DataFrame,
    keys: list[str],
    slice_col: str,
    order: list[str],
    value: str,
    name: str,
    rows_per_slice: int,
    few: bool = True,
) -> DataFrame:
    """Running prior median where histories are cut into slices; ``plain`` has the rows of ``df`` with fewer columns.

    ``few`` says that a table with a few rows for each slice can be broadcast.

    A task gets one time slice and a count for each value range, or the rows of
    one value range and the rows of one time slice whose median lies in it.
    Every row is sent about three times, however long its history is: a range
    is sent again to each time slice that asks for it, so slices much shorter
    than a value range are handled together.
    """
    line = [*order, "__v"]  # rows that agree in all of this are interchangeable
    rows = plain.select(*keys, slice_col, *order, F.col(value).cast("double").alias("__v"))
    given = rows.where(F.col("__v").isNotNull())
    cuts = plan_slices(given, ["__v", *order], keys, rows_per_slice=rows_per_slice, max_slices=VALUE_RANGES)
    together = -(-max(rows_per_slice, -(-cuts.total // VALUE_RANGES)) // rows_per_slice)
    of_slice, slice_col = F.floor(F.col(slice_col) / together).cast("long"), "__ts"
    segment = [*keys, slice_col]
    rows, given, df = (d.withColumn(slice_col, of_slice) for d in (rows, given, df))
    rows, given = (d.select(*segment, *line) for d in (rows, given))
    # Both slice numbers cost a search for each row: they are worked out once and written.
    without = rows.where("__v is null").withColumn("__vs", F.lit(0))
    rows = written(with_slice(given, cuts, "__vs").unionByName(without))
    known = rows.where(F.col("__v").isNotNull())

    # Counts for each time slice and value range of a key: (older, own).
    cells = known.groupBy(*segment, "__vs").agg(F.count(F.lit(1)).alias("__own"))
    ranges = cells.groupBy(*keys).agg(F.collect_set("__vs").alias("__ranges"))
    grid = null_safe_join(rows.select(*segment).distinct(), ranges, keys, "inner").withColumn("__vs", F.explode("__ranges"))
    grid = null_safe_join(grid.drop("__ranges"), cells, [*segment, "__vs"]).fillna(0, ["__own"])
    earlier = Window.partitionBy(*keys, "__vs").orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("__older", F.coalesce(F.sum("__own").over(earlier), F.lit(0)))
    carried = grid.groupBy(*segment).agg(F.sort_array(F.collect_list(F.struct("__vs", "__older"))).alias("__carried"))

    # The ranges that can hold a median of the slice: a few for each.
    through = Window.partitionBy(*segment).orderBy("__vs").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*segment)
    reach = grid.select(
        *segment, "__vs",
        (F.sum("__older").over(through) - F.col("__older")).alias("__below"),
        (F.sum("__older").over(through) + F.sum("__own").over(through)).alias("__upto"),
        F.sum("__older").over(every).alias("__n"),
        F.sum("__own").over(every).alias("__m"),
    )
    reach = reach.where("__below * 2 <= __n + __m and __upto * 2 > __n - 1")
    reach = reach.select(*keys, "__vs", F.col(slice_col).alias("__for"))

    def arrow(fields: list[T.StructField]) -> pa.Schema:
        return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])

    ids = [rows.schema[c] for c in segment]
    asked = T.StructType([*ids, *(T.StructField(c, T.LongType()) for c in ("__row", "__vs", "__k", "__first"))])
    answered = T.StructType([*ids, T.StructField("__row", T.LongType()), T.StructField("__x", T.DoubleType())])
    asked_arrow, answered_arrow = arrow(asked.fields), arrow(answered.fields)

    def locate(key, mine: pa.Table, counts: pa.Table) -> pa.Table:
        """For each row of a slice the range that holds its median, the place in it, and how many values it had by then."""
        if not mine.num_rows or not counts.num_rows:
            return asked_arrow.empty_table()
        mine = mine.sort_by([(c, "ascending") for c in line])
        _, missing = _numbers(mine["__v"])
        carried_now = pc.list_flatten(counts["__carried"])  # of one row
        names, older = (pc.struct_field(carried_now, c).to_numpy().astype(np.int64) for c in ("__vs", "__older"))
        bits = _bits(len(names) + 1)
        more = np.full((1 << bits) + 1, older.sum(), np.int64)
        more[: len(older) + 1] = np.concatenate([[0], np.cumsum(older)])
        own = np.searchsorted(names, mine["__vs"].to_numpy()[~missing])
        before = np.concatenate([[0], np.cumsum(~missing)])[:-1]
        n = before + older.sum()
        row = np.flatnonzero(n)
        row = np.concatenate([row, row[n[row] % 2 == 0]])  # an even number of values has two middle ones
        k = (n[row] - 1) // 2
        k[np.count_nonzero(n) :] += 1
        found, place, had = WaveletMatrix(own, bits).kth(np.zeros(len(row), np.int64), before[row], k, more)
        columns = [pa.array([key[i]] * len(row), asked_arrow.field(i).type) for i in range(len(segment))]
        return pa.table([*columns, pa.array(row), pa.array(names[found]), pa.array(place), pa.array(had)], schema=asked_arrow)

    def answer(key, queries: pa.Table, held: pa.Table) -> pa.Table:
        """The values at the places asked for, among the first so many of a range."""
        if not queries.num_rows:
            return answered_arrow.empty_table()
        values, _ = _numbers(held.sort_by([(c, "ascending") for c in (slice_col, *line)])["__v"])
        k, high = queries["__k"].to_numpy(), queries["__first"].to_numpy()
        x = order_statistics(values, np.zeros(len(k), np.int64), high, k)
        return pa.table([*(queries[c] for c in (*segment, "__row")), pa.array(x)], schema=answered_arrow)

    def grouped(table: DataFrame, by: list[str]):
        """Groups of a table that stems from the same rows as the other one: its columns get names of their own."""
        return table.withColumnsRenamed({c: f"__g_{c}" for c in by}).groupBy(*[f"__g_{c}" for c in by])

    questions = rows.groupBy(*segment).cogroup(grouped(carried, segment)).applyInArrow(locate, asked)
    # ``reach`` has a few rows for each slice.
    held = null_safe_join(known, reach, [*keys, "__vs"], "inner", small=few).where(F.col(slice_col) <= F.col("__for"))
    held = held.withColumn("__vs", F.col("__vs").cast("long"))
    mine = questions.groupBy(*keys, "__vs", slice_col)
    answers = mine.cogroup(grouped(held, [*keys, "__vs", "__for"])).applyInArrow(answer, answered)
    medians = answers.groupBy(*segment, "__row").agg(F.avg("__x").alias(name))

    place = Window.partitionBy(*segment).orderBy(*order, F.col(value).cast("double").asc_nulls_last())
    numbered = df.withColumn("__row", F.row_number().over(place).cast("long") - 1)
    return null_safe_join(numbered, medians, [*segment, "__row"]).drop("__row", slice_col)
