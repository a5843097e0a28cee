"""Exact nearest neighbours of every row of one set in another, with pivots and the triangle inequality.

Points are dealt to the nearest of some pivots; a cell knows how near and how
far its points lie from its pivot. Each row first looks into the cells nearest
to it that hold enough points, which bounds its k-th distance from above. Then
it visits only those other cells that can hold a nearer point: a point x of
cell p has d(q, x) >= |d(q, p) - d(p, x)|, and it lies on p's side of the plane
between p and the row's own pivot. Cells are cut into blocks of bounded size
and meet the rows in groups of bounded size, so a cell with a third of all
points or rows is as good as any other. Nothing passes through the driver but
the pivots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

PIECE_BYTES = 64 << 20
BLOCK_ROWS = 2_048
#: Pivots are a bounded sample of the points: what every task gets.
MAX_PIVOTS = 512
#: Cells of a distance matrix, and numbers of exact differences, held at a time.
CELLS = 1 << 22
_EPS = float(np.finfo(np.float64).eps)
#: Bounds are widened by this share of the distances they come from: far more than rounding.
_SLACK = 1e-9


def _matrix(column, dtype: str = "float64") -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(rows) == 0:
        return np.empty((0, 0))
    return rows.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(rows), -1)


def _mismatches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += a[:, j][:, None] != b[:, j][None, :]
    return out


def nearest(queries, points, k: int, query_codes=None, point_codes=None, penalty: float = 0.0, skip=None):
    """(query, point, distance) of the k nearest points per query, nearest first, equal distances by point.

    Each differing code adds ``penalty`` to the squared distance. ``skip`` has
    (query, point) index pairs that do not count.
    """
    # Matrix products find candidates fast. They are off by rounding, so every
    # point within the rounding bound of the k-th is measured exactly.
    centre = points.mean(0)
    q, p = queries - centre, points - centre
    q_length, p_length = (q**2).sum(1), (p**2).sum(1)
    rough = q_length[:, None] - 2 * q @ p.T + p_length[None, :]
    extra = None
    if query_codes is not None:
        extra = penalty * _mismatches(query_codes, point_codes)
        rough = rough + extra
    if skip is not None:
        rough[skip] = np.inf
    width, reach = queries.shape[1], np.sqrt(q_length) + np.sqrt(p_length.max())
    largest = max(np.abs(queries).max(initial=0), np.abs(points).max(initial=0))
    slack = 4 * _EPS * ((width + 8) * reach**2 + 4 * np.sqrt(width) * largest * reach + (extra.max() if extra is not None else 0))
    slack += (4 * _EPS * largest) ** 2 * width
    last = np.partition(rough, min(k, len(points)) - 1, axis=1)[:, min(k, len(points)) - 1]
    query, point = np.nonzero((rough <= (last + 2 * slack)[:, None]) & np.isfinite(rough))
    squared = np.empty(len(query))
    step = max(1, CELLS // max(1, width))
    for at in range(0, len(query), step):
        i, j = query[at : at + step], point[at : at + step]
        squared[at : at + step] = ((queries[i] - points[j]) ** 2).sum(1)
    if extra is not None:
        squared += extra[query, point]
    distance = np.sqrt(squared)
    order = np.lexsort((point, distance, query))
    query, point, distance = query[order], point[order], distance[order]
    first = np.searchsorted(query, np.arange(len(queries)))
    best = np.arange(len(query)) - first[query] < k
    return query[best], point[best], distance[best]


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances (row, pivot) from plain differences, as exact as doubles are."""
    out = np.empty((len(rows), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(((rows - p) ** 2).sum(1))
    return out


def cells_within(to_pivots: np.ndarray, limit: np.ndarray, low: np.ndarray, high: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Which cells (row, pivot) may hold a point within ``limit`` of the row.

    ``low`` and ``high`` bound the distances of a cell's points from its
    pivot, ``between`` are the distances of the pivots.
    """
    nearest_one = to_pivots.argmin(1)
    own = to_pivots[np.arange(len(to_pivots)), nearest_one]
    reach = limit[:, None] + _SLACK * (to_pivots + limit[:, None] + high[None])
    ring = (to_pivots - high[None] <= reach) & (low[None] - to_pivots <= reach)
    # A point of another cell lies beyond the plane half way between the two pivots.
    gap = between[nearest_one]
    gap = np.where(gap > 0, 2 * gap, np.inf)
    squares, rounding = to_pivots**2 - own[:, None] ** 2, 1e-13 * (to_pivots**2 + own[:, None] ** 2)
    return ring & ((squares - rounding) / gap <= reach)


def _pivots(points: DataFrame, n: int, max_pivots: int) -> np.ndarray:
    """About the square root of n points, chosen by a hash of their ids, without repeats."""
    wanted = int(max(1, min(max_pivots, np.sqrt(n) / 2)))
    share = min(1.0, 3 * wanted / max(1, n))
    mark = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    sample = points.where(mark < int(share * (1 << 30)) + 1).select(mark.alias("m"), "v")
    rows = sample.orderBy("m").limit(wanted).collect() or points.select("v").limit(1).collect()  # at most ``max_pivots``
    return np.unique(np.array([r["v"] for r in rows], np.float64).reshape(len(rows), -1), axis=0)


class CellIndex:
    """Points dealt to pivots: what a search needs, and how many distances it measures."""

    def __init__(self, points: DataFrame, n: int, block_rows: int, max_pivots: int):
        self.spark, self.block_rows = points.sparkSession, block_rows
        self.pivots = _pivots(points, n, max_pivots)
        sent = self.spark.sparkContext.broadcast(self.pivots)

        def deal(batches):
            for batch in batches:
                rows = _matrix(batch.column("v"))
                cell, far = np.zeros(len(rows), np.int32), np.zeros(len(rows))
                for a in range(0, len(rows), BLOCK_ROWS):
                    d = distances(rows[a : a + BLOCK_ROWS], sent.value)
                    cell[a : a + BLOCK_ROWS] = d.argmin(1)
                    far[a : a + BLOCK_ROWS] = d.min(1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"]
                )

        schema = T.StructType([*points.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])
        self.points = points.mapInArrow(deal, schema)
        rows = self.points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()
        size, low, high = np.zeros(len(self.pivots), np.int64), np.zeros(len(self.pivots)), np.zeros(len(self.pivots))
        for r in rows:  # one row for each pivot
            size[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
        self.size, self.low, self.high = size, low, high
        self.blocks = np.maximum(1, -(-size // block_rows))
        names = [(int(c), int(b)) for c, b in enumerate(self.blocks) if b > 1]
        # Large cells are cut by a hash of the id; others are one block.
        cut = F.lit(1)
        if names:
            table = self.spark.createDataFrame(names, "cell int, cuts int")
            self.points = self.points.join(F.broadcast(table), "cell", "left")  # at most one row for each pivot
            cut = F.coalesce("cuts", F.lit(1))
        self.points = self.points.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), cut).cast("int")).drop("cuts")

    def visits(self, queries: DataFrame, k: int, bounded: bool) -> DataFrame:
        """``queries`` once for each block of each cell to be searched.

        Without ``bounded`` these are the nearest cells that hold ``k`` points
        together; with it, the column ``limit`` bounds the k-th distance and
        all other cells within reach are visited.
        """
        about = (self.pivots, self.size, self.low, self.high, self.blocks)
        sent = self.spark.sparkContext.broadcast(about)

        def choose(batches):
            pivots, size, low, high, blocks = sent.value
            between = distances(pivots, pivots)
            for batch in batches:
                rows = _matrix(batch.column("v"))
                for a in range(0, len(rows), BLOCK_ROWS):
                    part = batch.slice(a, BLOCK_ROWS)
                    d = distances(rows[a : a + BLOCK_ROWS], pivots)
                    order = np.argsort(d, axis=1, kind="stable")
                    before = np.cumsum(size[order], axis=1) - size[order]
                    home = np.zeros(d.shape, bool)
                    np.put_along_axis(home, order, before < k, axis=1)
                    home &= size[None] > 0
                    chosen = home
                    if bounded:
                        limit = part.column("limit").to_numpy(zero_copy_only=False)
                        chosen = cells_within(d, limit, low, high, between) & ~home & (size[None] > 0)
                    row, cell = np.nonzero(chosen)
                    times = blocks[cell]
                    row, cell = np.repeat(row, times), np.repeat(cell, times)
                    block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    taken = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [*taken.columns, pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int32))],
                        names=[*taken.schema.names, "cell", "block"],
                    )

        extra = [T.StructField("cell", T.IntegerType()), T.StructField("block", T.IntegerType())]
        return queries.mapInArrow(choose, T.StructType([*queries.schema.fields, *extra]))


def _ready(df: DataFrame, vec: str, id_col: str, codes: str | None) -> DataFrame:
    # Single precision is widened by the searches: half the bytes to send, the same numbers.
    single = isinstance(getattr(df.schema[vec].dataType, "elementType", None), T.FloatType)
    parts = [F.col(vec).alias("v") if single else F.col(vec).cast("array<double>").alias("v")]
    if codes:
        parts.append(F.col(codes).cast("array<bigint>").alias("c"))
    return df.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), *parts)


def knn_join(
    left: DataFrame,
    right: DataFrame,
    vec: str,
    k: int,
    left_id: str = "vec_id",
    right_id: str = "vec_id",
    exclude_self: bool = False,
    codes: str | None = None,
    penalty: float = 0.0,
    piece_bytes: int = PIECE_BYTES,
    max_pivots: int = MAX_PIVOTS,
    measured: list[DataFrame] | None = None,
) -> DataFrame:
    """(left id, neighbour id, distance, rank): the k nearest right rows of every left row.

    Equal distances go to the smaller right id. ``exclude_self`` skips the
    row's own id when a set is joined with itself. ``codes`` names an array of
    long codes; each differing one adds ``penalty`` to the squared distance,
    which only widens distances, so the bounds stay true. Rows without a vector
    have no neighbours and are nobody's neighbour. ``measured`` receives two
    tables of the (row, block) meetings, for a look at the work.
    """
    queries, points = _ready(left, vec, left_id, codes), _ready(right, vec, right_id, codes)
    id_type = points.schema["id"].dataType
    fields = [("left_id", queries.schema["id"].dataType), ("neighbour_id", id_type), ("distance", T.DoubleType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    n, width = points.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    if not n:
        return left.sparkSession.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())]))
    index = CellIndex(points, n, max(1, piece_bytes // (8 * max(1, width))), max_pivots)
    search = _searcher(k, schema, exclude_self, bool(codes), penalty)

    def met(visits: DataFrame) -> DataFrame:
        """The k best of each meeting of a row with a block; the rows of a block come in groups of bounded size."""
        sizes = visits.groupBy("cell", "block").agg(F.count(F.lit(1)).alias("rows"))
        groups = sizes.select("cell", "block", F.ceil(F.col("rows") / (8 * BLOCK_ROWS)).cast("int").alias("groups"))
        # One row for each block that is visited, of which there are as many as pieces of the points: a broadcast,
        # so that the visits, the bulk of the work, are dealt out once, to their groups.
        groups = F.broadcast(groups)
        mine = visits.join(groups, ["cell", "block"]).withColumn("g", F.pmod(F.xxhash64("id", F.lit(3)), F.col("groups")))
        others = index.points.join(groups.withColumnsRenamed({"cell": "c_", "block": "b_"}), (F.col("cell") == F.col("c_")) & (F.col("block") == F.col("b_")))
        others = others.withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        key = [F.col("cell"), F.col("block"), F.col("g").cast("int").alias("g")]
        mine = mine.select(*key, *queries.columns)
        others = others.select(*key, *points.columns)
        at = ("cell", "block", "g")
        return mine.groupBy(*at).cogroup(others.groupBy(*at)).applyInArrow(search, schema)

    first = met(index.visits(queries, k + exclude_self, False))
    limits = first.groupBy("left_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("distance")).alias("d"))
    # Too few points nearby (or only the row itself): every cell may hold a neighbour.
    limit = F.when(F.col("n") >= k, F.element_at("d", k)).otherwise(F.lit(float("inf")))
    limits = limits.select(F.col("left_id").alias("id"), limit.alias("limit"))
    bounded = queries.join(limits, "id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    rest = index.visits(bounded, k + exclude_self, True)
    if measured is not None:
        sizes = index.points.groupBy("cell", "block").agg(F.count(F.lit(1)).alias("points"))
        measured += [v.select("id", "cell", "block").join(sizes, ["cell", "block"]) for v in (index.visits(queries, k + exclude_self, False), rest)]
    found = first.unionByName(met(rest.drop("limit")))
    best = Window.partitionBy("left_id").orderBy("distance", "neighbour_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _searcher(k: int, schema: T.StructType, exclude_self: bool, with_codes: bool, penalty: float):
    """The search of one group of rows in one block of points."""
    arrow_types = [to_arrow_type(f.dataType) for f in schema.fields]

    def search(mine: pa.Table, others: pa.Table) -> pa.Table:
        found: list[tuple] = []
        others = others.sort_by("id")
        if mine.num_rows and others.num_rows:
            point_ids = others["id"]
            vectors, point_codes = _matrix(others["v"]), _matrix(others["c"], "int64") if with_codes else None
            places: dict = {}
            if exclude_self:
                for i, name in enumerate(point_ids.to_pylist()):
                    places.setdefault(name, []).append(i)
            step = max(1, min(BLOCK_ROWS, CELLS // others.num_rows))
            for at in range(0, mine.num_rows, step):
                part = mine.slice(at, step)
                skip = None
                if exclude_self:
                    same = [(i, j) for i, name in enumerate(part["id"].to_pylist()) for j in places.get(name, ())]
                    skip = tuple(np.array(same, np.int64).reshape(-1, 2).T)
                query, point, distance = nearest(
                    _matrix(part["v"]), vectors, k, _matrix(part["c"], "int64") if with_codes else None, point_codes, penalty, skip
                )
                found.append((query + at, point, distance))
        query, point, distance = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        columns = [mine["id"].take(pa.array(query)), others["id"].take(pa.array(point)), pa.array(distance)]
        return pa.table([c.cast(t) for c, t in zip(columns, arrow_types)], names=schema.names)

    return search
