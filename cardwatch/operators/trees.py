"""Forests and boosted trees of Spark's classifiers, grown on binned rows.

The methods are those of ``RandomForestClassifier`` and ``GBTClassifier``:
thresholds from a sample, at most ``maxBins`` bins a column, drawn rows for each
tree, drawn columns for each node, Gini or variance gain, pruned trees, residuals
of the logistic loss. The results are Spark's models, saved and loaded in its format.

Spark keeps every row as an object with its numbers as integers and a count for
each tree, and leads all rows through all trees in each pass. Here a row is one
byte a column, in blocks of columns; draws are a function of (seed, tree, block)
and never kept; and rows that have reached a leaf leave the pass. A pass adds up
counts of a level's nodes in blocks and tasks, and only sums leave a task. Rows
that fit one task are not passed over by a job for each level: trees of a
forest, or the whole boosting, then run in tasks of their own.
"""

from __future__ import annotations

import json
import math
import re
import time
import uuid
from dataclasses import dataclass, field
from functools import lru_cache
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark import RDD, Broadcast, StorageLevel, TaskContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch.session import ensure_checkpoint_dir

#: Rows of a block at the most.
BLOCK_ROWS = 65_536
#: Bytes of binned rows up to which one task takes all of them.
LOCAL_BYTES = 32 << 20
#: The same for a whole boosting among fits that keep the cores busy side by side; with the scores of the rows half as much again.
BOOST_BYTES = 256 << 20
#: Bytes of sums that a task holds in a pass, and of sums that are added up together.
PASS_BYTES = 96 << 20
PART_BYTES = 1 << 20
#: (label, weight) pairs at the most; rows of other weights are left to Spark's own fit.
KINDS = 16
#: Bytes of sums of all tasks that the driver adds up itself.
DRIVER_BYTES = 48 << 20
#: Boosted trees between two checkpoints of the rows' scores.
CHECKPOINT_TREES = 10
#: Gains below this share of the impurity are rounding.
ROUNDING = 1e-13


@dataclass
class Block:
    """Binned rows, column after column, and the kind of each row."""

    number: int
    rows: int
    cells: np.ndarray
    kind: np.ndarray

    def cells_by_kind(self, kinds: int) -> np.ndarray:
        """Bin and kind of each cell as one number."""
        both = self.cells.astype(np.uint16).reshape(-1, self.rows)
        both *= kinds
        both += self.kind
        return both.reshape(-1)


def _opened(r) -> Block:
    return Block(r[0], r[1], np.frombuffer(r[2], np.uint8), np.frombuffer(r[3], np.uint8))


@dataclass
class Binned:
    table: DataFrame  # of blocks, read from the shared folder
    rows: int
    thresholds: list[np.ndarray]
    kinds: list[tuple[int, float]]  # class and weight
    counts: list[int]
    lock: Lock = field(default_factory=Lock)
    sent: Broadcast | None = None

    @property
    def blocks(self) -> RDD:
        return self.table.rdd.map(_opened)

    def everywhere(self) -> Broadcast:
        """All blocks as one value for the tasks of every fit; only for rows that fit one task."""
        with self.lock:
            self.sent = self.sent or self.table.sparkSession.sparkContext.broadcast(self.blocks.collect())
            return self.sent

    @property
    def columns(self) -> int:
        return len(self.thresholds)

    @property
    def bins(self) -> int:
        return max(2, 1 + max(len(t) for t in self.thresholds))

    @property
    def local(self) -> bool:
        return self.rows * self.columns <= LOCAL_BYTES


@dataclass
class Tree:
    """Nodes as parallel lists; the right child follows the left one, a leaf has feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [-1.0])
    stats: list = field(default_factory=lambda: [None])  # rows of each kind, with the sum of residuals when boosting

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature, np.int64), np.array(self.bin, np.int16), np.array(self.left, np.int64)

    def split(self, node: int, feature: int, at: int, gain: float, left, right) -> tuple[int, int]:
        child = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.gain[node] = feature, at, child, gain
        for stats in (left, right):
            self.feature.append(-1), self.bin.append(0), self.left.append(0), self.gain.append(-1.0), self.stats.append(stats)
        return child, child + 1


# --- bins -----------------------------------------------------------------------------


def thresholds_of(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """Between neighbouring values: all, if they are at most ``most``, else those that cut the weight about evenly."""
    there = ~np.isnan(values)
    distinct, place = np.unique(values[there], return_inverse=True)
    if len(distinct) < 2:
        return np.empty(0)
    middles = distinct[:-1] / 2 + distinct[1:] / 2
    if len(middles) <= most:
        return middles
    counts = np.bincount(place, weights=weights[there])
    reached = np.cumsum(counts).tolist()
    stride = reached[-1] / (most + 1)
    target, chosen = stride, []
    for i in range(1, len(reached)):
        if abs(reached[i - 1] - target) < abs(reached[i] - target):
            chosen.append(i - 1)
            target += stride
    return middles[chosen[:most]]


def binned(train: DataFrame, classifier) -> Binned | None:
    """The rows in blocks below the shared folder; None if their weights are too many for kinds."""
    spark, label = train.sparkSession, classifier.getLabelCol()
    weight = F.col(classifier.getWeightCol()) if classifier.isDefined(classifier.weightCol) and classifier.getWeightCol() else F.lit(1.0)
    rows = train.select(F.col(label).cast("double").alias("y"), weight.cast("double").alias("w"), vector_to_array(classifier.getFeaturesCol()).alias("x"))
    sizes = rows.groupBy("y", "w").agg(F.count(F.lit(1)).alias("n")).orderBy("y", "w").limit(KINDS + 1).collect()
    usable = all(r["y"] is not None and r["y"] >= 0 and r["y"] == int(r["y"]) and r["w"] is not None and r["w"] > 0 for r in sizes)
    if not sizes or len(sizes) > KINDS or not usable or max(r["y"] for r in sizes) < 1:
        return None
    n, most = sum(r["n"] for r in sizes), classifier.getMaxBins()
    if most > 256:
        return None
    kinds = {(r["y"], r["w"]): i for i, r in enumerate(sizes)}

    wanted = max(most * most, 10_000)
    sample = rows if wanted >= n else rows.sample(fraction=wanted / n, seed=classifier.getSeed())
    got = sample.select("w", "x").toArrow()
    x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in got["x"].chunks]).reshape(got.num_rows, -1)
    weights = got["w"].to_numpy()
    thresholds = [thresholds_of(x[:, f], weights, min(most, n) - 1) for f in range(x.shape[1])]

    def pack(batches):
        """Blocks of at most so many rows; numbered by their place in the written input."""
        held, size, number = [], 0, TaskContext.get().partitionId() << 24

        def block() -> pa.RecordBatch:
            y, w, cells = (np.concatenate([h[i] for h in held], axis=-1) for i in range(3))
            kind = np.zeros(len(y), np.uint8)
            for (a, b), i in kinds.items():
                kind[(y == a) & (w == b)] = i
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([len(y)]), pa.array([np.ascontiguousarray(cells).tobytes()], pa.binary()), pa.array([kind.tobytes()], pa.binary())],
                names=["number", "rows", "cells", "kind"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                if size and size + part.num_rows > BLOCK_ROWS:
                    yield block()
                    held, size, number = [], 0, number + 1
                values = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                if not np.isfinite(values).all():  # as Spark's own fits
                    raise ValueError("vector values must not be NaN or infinite")
                cells = np.stack([np.searchsorted(t, values[:, f]).astype(np.uint8) for f, t in enumerate(thresholds)])
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), cells))
                size += part.num_rows
        if size:
            yield block()

    path = f"{ensure_checkpoint_dir(spark)}/blocks-{uuid.uuid4().hex[:12]}"
    rows.mapInArrow(pack, "number long, rows long, cells binary, kind binary").write.parquet(path)
    table = spark.read.schema("number long, rows long, cells binary, kind binary").parquet(path)
    return Binned(table, n, thresholds, [(int(r["y"]), r["w"]) for r in sizes], [r["n"] for r in sizes])


def columns_per_node(strategy: str, columns: int, auto: str) -> int:
    strategy = auto if strategy == "auto" else strategy
    names = {"all": columns, "sqrt": math.ceil(math.sqrt(columns)), "log2": max(1, math.ceil(math.log2(columns))), "onethird": math.ceil(columns / 3)}
    if strategy in names:
        return names[strategy]
    if re.fullmatch(r"[0-9]+", strategy):
        return min(columns, int(strategy))
    return math.ceil(float(strategy) * columns)


# --- rows in trees --------------------------------------------------------------------


def drawn(seed: int, tree: int, block: Block, rate: float, again: bool) -> np.ndarray:
    """How often each row of a block is drawn for a tree: a Poisson number with replacement, else 0 or 1; in steps of 1/65536."""
    if not again and rate >= 1:
        return np.ones(block.rows, np.uint8)
    dice = np.random.default_rng([seed & 0xFFFFFFFF, tree, block.number]).integers(0, 65_536, block.rows, np.uint16)
    if not again:
        return (dice < round(rate * 65_536)).astype(np.uint8)
    return _poisson_numbers(rate)[dice]


@lru_cache
def _poisson_numbers(rate: float) -> np.ndarray:
    chances = np.cumsum([math.exp(-rate) * rate**k / math.factorial(k) for k in range(40)])
    return np.searchsorted(chances * 65_536, np.arange(65_536) + 0.5).astype(np.uint8)


def arrive(block: Block, tree, rows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that get so deep into a tree, and their nodes there."""
    feature, at, left = tree
    if not depth:
        return rows, np.zeros(len(rows), np.int64)
    start = feature * block.rows
    if feature[0] < 0:
        return rows[:0], rows[:0]
    node = left[0] + (block.cells[start[0] : start[0] + block.rows].take(rows) > at[0])
    for _ in range(depth - 1):
        column = start.take(node)
        if (feature < 0).any():
            inner = np.flatnonzero(column >= 0)
            if len(inner) < len(rows):
                rows, node, column = rows.take(inner), node.take(inner), column.take(inner)
        column += rows
        beyond = block.cells.take(column) > at.take(node)
        node = left.take(node)
        node += beyond
    return rows, node


def leaves(block: Block, tree) -> np.ndarray:
    """The leaf of every row."""
    feature, at, left = tree
    out = np.zeros(block.rows, np.int64)
    rows = np.arange(block.rows)
    while len(rows):
        f = feature[out[rows]]
        rows, f = rows[f >= 0], f[f >= 0]
        node = out[rows]
        out[rows] = left[node] + (block.cells[f * block.rows + rows] > at[node])
    return out


# --- forest ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Growth:
    """What decides how trees of a forest grow."""

    seed: int
    rate: float
    again: bool
    depth: int
    per_node: int
    columns: int
    bins: int
    kinds: tuple
    least_rows: int
    least_gain: float
    least_weight: float

    def chosen(self, tree: int, node: int) -> np.ndarray:
        if self.per_node >= self.columns:
            return np.arange(self.columns)
        return np.sort(np.random.default_rng([self.seed & 0xFFFFFFFF, tree, node, 1]).choice(self.columns, self.per_node, replace=False))

    @property
    def node_bytes(self) -> int:
        return self.per_node * self.bins * len(self.kinds) * 8

    def class_weights(self) -> np.ndarray:
        out = np.zeros((len(self.kinds), 1 + max(y for y, _ in self.kinds)))
        for i, (y, w) in enumerate(self.kinds):
            out[i, y] = w
        return out


def level_counts(block: Block, both: np.ndarray, g: Growth, tree: int, shape, depth: int, nodes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Drawn rows by (drawn column, node, bin, kind) for some nodes of one level; ``both`` are the block's ``cells_by_kind``."""
    draws = drawn(g.seed, tree, block, g.rate, g.again)
    rows, node = arrive(block, shape, np.flatnonzero(draws), depth)
    slot_of = np.full(len(shape[0]), -1, np.int64)
    slot_of[nodes] = np.arange(len(nodes))
    slot = slot_of.take(node)
    here = np.flatnonzero(slot >= 0)
    if len(here) < len(rows):
        rows, slot = rows.take(here), slot.take(here)
    k = len(g.kinds)
    weights = draws.take(rows).astype(np.float64)
    base = slot * (g.bins * k)
    size = len(nodes) * g.bins * k
    one = g.per_node >= g.columns or len(nodes) == 1  # one column for all rows
    starts = np.ascontiguousarray(chosen.T) * block.rows
    out = np.empty((g.per_node, size))
    for j in range(g.per_node):
        if one:
            cells = both[starts[j, 0] : starts[j, 0] + block.rows].take(rows)
        else:
            place = starts[j].take(slot)
            place += rows
            cells = both.take(place)
        out[j] = np.bincount(base + cells, weights=weights, minlength=size)
    return out.reshape(g.per_node, len(nodes), g.bins, k)


def best_class_splits(counts: np.ndarray, g: Growth, whole: float):
    """For each node: gain, drawn column, bin, rows of each kind on the left and in all; gain 0 without a split."""
    weigh = g.class_weights()
    through = np.moveaxis(counts, 3, 0).cumsum(3)  # kinds first: sums over a few of them are sums of arrays
    total, left = through[..., -1], through[..., :-1]
    ln, n = sum(left), sum(total)[..., None]
    lw = rw = l_squares = r_squares = squares = 0.0
    for w in weigh.T:  # class by class
        lc, tc = (sum(x * float(v) for x, v in zip(part, w) if v) for part in (left, total[..., None]))
        rc = tc - lc
        lw, rw, l_squares, r_squares, squares = lw + lc, rw + rc, l_squares + lc * lc, r_squares + rc * rc, squares + tc * tc
    tw = lw[..., :1] + rw[..., :1]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (l_squares / lw + r_squares / rw - squares / tw) / tw
    least = max(g.least_rows, 1)
    fine = (ln >= least) & (n - ln >= least)
    if g.least_weight:
        fine &= (lw >= g.least_weight * whole) & (rw >= g.least_weight * whole)
    gain = np.where(fine & (gain > ROUNDING) & (gain >= g.least_gain), gain, 0.0)
    by_node = gain.transpose(1, 0, 2).reshape(counts.shape[1], -1)
    best = by_node.argmax(1)
    j, at = best // gain.shape[2], best % gain.shape[2]
    node = np.arange(counts.shape[1])
    return by_node[node, best], j, at, left[:, j, node, at].T, total[:, 0].T


def grow(trees: dict[int, Tree], g: Growth, whole: float, run_pass, pass_nodes: int) -> None:
    """Level by level; ``run_pass`` finds the splits of some nodes of one level: (tree, nodes, drawn columns) for each tree."""
    pure = g.class_weights().argmax(1)
    frontier = {t: [0] for t in trees}
    for depth in range(g.depth):
        todo = [(t, node) for t, nodes in frontier.items() for node in nodes]
        frontier = {t: [] for t in trees}
        for start in range(0, len(todo), pass_nodes):
            wanted: dict[int, list[int]] = {}
            for t, node in todo[start : start + pass_nodes]:
                wanted.setdefault(t, []).append(node)
            work = [(t, trees[t].arrays(), np.array(nodes), np.stack([g.chosen(t, node) for node in nodes])) for t, nodes in wanted.items()]
            for (t, _, nodes, chosen), (gain, j, at, left, total) in zip(work, run_pass(work, depth)):
                tree = trees[t]
                for i, node in enumerate(nodes.tolist()):
                    tree.stats[node] = total[i]
                    if gain[i] <= 0:
                        continue
                    right = total[i] - left[i]
                    children = tree.split(node, int(chosen[i, j[i]]), int(at[i]), float(gain[i]), left[i], right)
                    for child, kinds in zip(children, (left[i], right)):
                        if len(set(pure[kinds > 0].tolist())) > 1:
                            frontier[t].append(child)


def _splits_in_task(blocks: list[Block], g: Growth, whole: float):
    both = [b.cells_by_kind(len(g.kinds)) for b in blocks]

    def run_pass(work, depth: int):
        for t, shape, nodes, chosen in work:
            yield best_class_splits(sum(level_counts(b, x, g, t, shape, depth, nodes, chosen) for b, x in zip(blocks, both)), g, whole)

    return run_pass


def _splits_by_job(data: Binned, g: Growth, whole: float):
    """One job: each task adds up its blocks, sums of a part of a tree's nodes meet, and only splits reach the driver."""
    sc = data.table.sparkSession.sparkContext
    per_part = max(1, PART_BYTES // g.node_bytes)
    blocks_of_pass = data.blocks
    kind_of_sum = np.int32 if data.rows < 1 << 27 else np.int64

    def run_pass(work, depth: int):
        held = sc.broadcast(work)

        def add_up(blocks):
            sums = {}
            for block in blocks:
                both = block.cells_by_kind(len(g.kinds))
                for t, shape, nodes, chosen in held.value:
                    counts = level_counts(block, both, g, t, shape, depth, nodes, chosen).astype(kind_of_sum)
                    if t in sums:
                        sums[t] += counts
                    else:
                        sums[t] = counts
            for t, counts in sums.items():
                for i in range(0, counts.shape[1], per_part):
                    yield (t, i), np.ascontiguousarray(counts[:, i : i + per_part])

        added = blocks_of_pass.mapPartitions(add_up).reduceByKey(lambda a, b: a + b, 2 * sc.defaultParallelism)
        found = dict(added.mapValues(lambda counts: best_class_splits(counts, g, whole)).collect())
        held.unpersist()
        for t, _, nodes, _ in work:
            parts = [found[t, i] for i in range(0, len(nodes), per_part)]
            yield tuple(np.concatenate(x) for x in zip(*parts))

    return run_pass


def fit_forest(classifier: RandomForestClassifier, train: DataFrame, data: Binned | None = None) -> RandomForestClassificationModel:
    """The forest that the classifier's parameters describe."""
    data = (data or binned(train, classifier)) if classifier.getImpurity() == "gini" else None
    if data is None:
        return classifier.fit(train)
    n_trees = classifier.getNumTrees()
    g = Growth(
        classifier.getSeed(), classifier.getSubsamplingRate(), classifier.getBootstrap(), classifier.getMaxDepth(),
        columns_per_node(classifier.getFeatureSubsetStrategy(), data.columns, "sqrt" if n_trees > 1 else "all"),
        data.columns, data.bins, tuple(data.kinds), classifier.getMinInstancesPerNode(), classifier.getMinInfoGain(), classifier.getMinWeightFractionPerNode(),
    )
    whole = sum(n * w for n, (_, w) in zip(data.counts, data.kinds))
    pass_nodes = max(1, PASS_BYTES // g.node_bytes)
    if data.local:
        sc, held = data.table.sparkSession.sparkContext, data.everywhere()

        def in_task(numbers):
            trees = {t: Tree() for t in numbers}
            splits = _splits_in_task(held.value, g, whole)
            for t in trees:
                grow({t: trees[t]}, g, whole, splits, max(1, pass_nodes // 4))
            return trees.items()

        trees = dict(sc.parallelize(range(n_trees), min(n_trees, 3 * sc.defaultParallelism)).mapPartitions(in_task).collect())
    else:
        trees = {t: Tree() for t in range(n_trees)}
        grow(trees, g, whole, _splits_by_job(data, g, whole), pass_nodes)

    weigh = g.class_weights()

    def leaf_of(stats):
        c = stats @ weigh
        w = c.sum()
        return float(c.argmax()), float(1 - (c / w * (c / w)).sum()) if w else 0.0, c.tolist(), int(stats.sum())

    more = {"numFeatures": data.columns, "numClasses": weigh.shape[1], "numTrees": n_trees}
    nodes = [(t, *row) for t in range(n_trees) for row in _saved_nodes(trees[t], data.thresholds, leaf_of)]
    return _as_model(train.sparkSession, classifier, RandomForestClassificationModel, "DecisionTreeClassificationModel", nodes, [1.0] * n_trees, more)


# --- boosting -------------------------------------------------------------------------


@dataclass(frozen=True)
class Boosting:
    """What decides how boosted trees grow."""

    seed: int
    rate: float
    trees: int
    step: float
    depth: int
    per_node: int
    columns: int
    bins: int
    kinds: tuple
    least_rows: int
    least_gain: float
    least_weight: float

    def chosen(self, tree: int, node: int) -> np.ndarray:
        out = np.zeros(self.columns, bool)
        out[np.random.default_rng([self.seed & 0xFFFFFFFF, tree, node, 1]).choice(self.columns, self.per_node, replace=False)] = True
        return out

    def signs(self) -> np.ndarray:
        return np.array([2.0 * y - 1 for y, _ in self.kinds])

    def weights(self) -> np.ndarray:
        return np.array([w for _, w in self.kinds])


def level_sums(block: Block, residual: np.ndarray, g: Boosting, number: int, shape, depth: int, nodes: np.ndarray):
    """Rows by (node, column, bin, kind) and weighted residuals by (node, column, bin) for some nodes of one level."""
    rows, node = arrive(block, shape, np.flatnonzero(drawn(g.seed, number, block, g.rate, False)), depth)
    slot_of = np.full(len(shape[0]), -1, np.int64)
    slot_of[nodes] = np.arange(len(nodes))
    slot = slot_of.take(node)
    here = np.flatnonzero(slot >= 0)
    if len(here) < len(rows):
        rows, slot = rows.take(here), slot.take(here)
    kind, size, k = block.kind[rows], len(nodes) * g.bins, len(g.kinds)
    weighted = residual[rows] * g.weights()[kind]
    counts, sums = np.empty((g.columns, size, k), np.int64), np.empty((g.columns, size))
    base = slot * g.bins
    packed = np.where(kind == 1, 2.0**26, 1.0) if k == 2 else None  # a block has fewer rows: both counts in one number
    for f in range(g.columns):
        key = base + block.cells[f * block.rows : (f + 1) * block.rows].take(rows)
        sums[f] = np.bincount(key, weights=weighted, minlength=size)
        if k == 2:
            both = np.bincount(key, weights=packed, minlength=size).astype(np.int64)
            counts[f, :, 1] = both >> 26
            counts[f, :, 0] = both & ((1 << 26) - 1)
        else:
            counts[f] = np.bincount(key * k + kind, minlength=size * k).reshape(size, k)
    shaped = (g.columns, len(nodes), g.bins)
    return counts.reshape(*shaped, k).swapaxes(0, 1), sums.reshape(shaped).swapaxes(0, 1)


def best_residual_split(counts: np.ndarray, sums: np.ndarray, chosen: np.ndarray, g: Boosting, whole: float):
    """Of one node: gain, column, bin, and (rows of each kind, sum) on the left and in all; None without a split."""
    through, summed = counts.cumsum(1), sums.cumsum(1)
    total, sum_of_all = through[0, -1], summed[0, -1]
    left, ls = through[:, :-1], summed[:, :-1]
    lw, tw = left @ g.weights(), float(total @ g.weights())
    rw, rs = tw - lw, sum_of_all - ls
    ln = left.sum(-1)
    rn = total.sum() - ln
    least = max(g.least_rows, 1)
    fine = chosen[:, None] & (ln >= least) & (rn >= least) & (lw >= g.least_weight * whole) & (rw >= g.least_weight * whole)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (ls * ls / lw + rs * rs / rw - sum_of_all * sum_of_all / tw) / tw
        scale = 4.0 * (sum_of_all / tw) ** 2 if tw else 0.0
    gain = np.where(fine & (gain > ROUNDING * max(scale, 1e-12)) & (gain >= g.least_gain), gain, 0.0)
    best = int(gain.argmax())
    f, at = divmod(best, gain.shape[1])
    if gain[f, at] <= 0:
        return None
    return float(gain[f, at]), f, at, (left[f, at], float(ls[f, at]))


def grow_boosted(number: int, g: Boosting, whole: float, run_level) -> Tree:
    """One tree on the residuals; ``run_level`` adds up some nodes of a level, their siblings follow by subtraction."""
    tree = Tree()
    level, held = [0], {}
    for depth in range(g.depth):
        # Of two siblings the one with fewer rows is added up.
        asked = [n for n in level if depth == 0 or n not in held]
        counts, sums = run_level(number, tree.arrays(), depth, np.array(asked))
        now = {n: (counts[i], sums[i]) for i, n in enumerate(asked)}
        for n, (sibling, parent) in held.items():
            now[n] = (parent[0] - now[sibling][0], parent[1] - now[sibling][1])
        following, held = [], {}
        for n in level:
            c, s = now[n]
            if depth == 0:
                tree.stats[0] = (c[0].sum(0), float(s[0].sum()))
            found = best_residual_split(c, s, g.chosen(number, n), g, whole)
            if found is None:
                continue
            gain, f, at, left = found
            total = tree.stats[n]
            right = (total[0] - left[0], total[1] - left[1])
            a, b = tree.split(n, f, at, gain, left, right)
            following += [a, b]
            small, large = (a, b) if left[0].sum() <= right[0].sum() else (b, a)
            held[large] = (small, (c, s))
        level = following
        if not level:
            break
    return tree


def leaf_values(tree: Tree, g: Boosting) -> np.ndarray:
    """The weighted mean residual of each node."""
    return np.array([s / float(c @ g.weights()) if c.sum() else 0.0 for c, s in tree.stats])


@dataclass
class Scored:
    """A block with the score of each row so far; the residual follows from it."""

    block: Block
    score: np.ndarray
    residual: np.ndarray


def first_scores(block: Block, g: Boosting) -> Scored:
    return Scored(block, np.zeros(block.rows), g.signs()[block.kind])


def with_tree(scored: Scored, shape, values: np.ndarray, step: float, g: Boosting) -> Scored:
    score = scored.score + step * values[leaves(scored.block, shape)]
    y = g.signs()[scored.block.kind]
    return Scored(scored.block, score, 4.0 * y / (1.0 + np.exp(np.minimum(2.0 * y * score, 700.0))))


def _add_up(scored, g: Boosting, number: int, shape, depth: int, nodes: np.ndarray):
    total = None
    for s in scored:
        found = level_sums(s.block, s.residual, g, number, shape, depth, nodes)
        total = found if total is None else (total[0] + found[0], total[1] + found[1])
    return total


def boost_in_task(blocks: list[Block], g: Boosting, whole: float) -> list[Tree]:
    scored, trees = [first_scores(b, g) for b in blocks], []
    for number in range(g.trees):
        tree = grow_boosted(number, g, whole, lambda *a: _add_up(scored, g, *a))
        trees.append(tree)
        shape, values = tree.arrays(), leaf_values(tree, g)
        scored = [with_tree(s, shape, values, g.step if number else 1.0, g) for s in scored]
    return trees


def boost_by_jobs(data: Binned, g: Boosting, whole: float) -> list[Tree]:
    """A job for each level; the scores of the rows stay with the blocks."""
    blocks = data.blocks
    columns = np.array_split(np.arange(g.columns), min(g.columns, 2 * blocks.context.defaultParallelism))
    tasks = blocks.getNumPartitions()
    node_bytes = g.columns * g.bins * 8 * (len(g.kinds) + 1)
    state = blocks.map(lambda b: first_scores(b, g)).persist(StorageLevel.MEMORY_AND_DISK)
    old, trees = [], []

    def run_level(number, shape, depth, nodes):
        few = tasks * len(nodes) * node_bytes <= DRIVER_BYTES

        def add_up(scored):
            total = _add_up(scored, g, number, shape, depth, nodes)
            if total is not None:
                for i, some in enumerate([slice(None)] if few else columns):
                    yield i, (total[0][:, some], total[1][:, some])

        sums = state.mapPartitions(add_up)
        sums = sums if few else sums.reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), len(columns))
        found: dict[int, tuple] = {}
        for i, (counts, residuals) in sums.collect():
            found[i] = (found[i][0] + counts, found[i][1] + residuals) if i in found else (counts, residuals)
        while old:  # the scores after the last tree are there now
            old.pop().unpersist()
        return tuple(np.concatenate([found[i][x] for i in sorted(found)], axis=1) for x in (0, 1))

    for number in range(g.trees):
        tree = grow_boosted(number, g, whole, run_level)
        trees.append(tree)
        shape, values, step = tree.arrays(), leaf_values(tree, g), g.step if number else 1.0
        old.append(state)
        state = state.map(lambda s, shape=shape, values=values, step=step: with_tree(s, shape, values, step, g)).persist(StorageLevel.MEMORY_AND_DISK)
        if number % CHECKPOINT_TREES == CHECKPOINT_TREES - 1:
            state.checkpoint()
    for last in (*old, state):
        last.unpersist()
    return trees


def fit_boosted(classifier: GBTClassifier, train: DataFrame, data: Binned | None = None, fits: int = 1) -> GBTClassificationModel:
    """The boosted trees that the classifier's parameters describe; leaves keep no variance. ``fits`` run side by side."""
    plain = classifier.getImpurity() == "variance" and not classifier.isDefined(classifier.validationIndicatorCol)
    data = (data or binned(train, classifier)) if plain else None
    if data is None or max(y for y, _ in data.kinds) > 1:
        return classifier.fit(train)
    g = Boosting(
        classifier.getSeed(), classifier.getSubsamplingRate(), classifier.getMaxIter(), classifier.getStepSize(), classifier.getMaxDepth(),
        columns_per_node(classifier.getFeatureSubsetStrategy(), data.columns, "all"),
        data.columns, data.bins, tuple(data.kinds), classifier.getMinInstancesPerNode(), classifier.getMinInfoGain(), classifier.getMinWeightFractionPerNode(),
    )
    whole = sum(n * w for n, (_, w) in zip(data.counts, data.kinds))
    if data.local:
        sc, held = data.table.sparkSession.sparkContext, data.everywhere()
        trees = sc.parallelize([0], 1).flatMap(lambda _: boost_in_task(held.value, g, whole)).collect()
    elif data.rows * data.columns <= BOOST_BYTES and 2 * fits >= data.table.sparkSession.sparkContext.defaultParallelism:
        trees = data.table.coalesce(1).rdd.map(_opened).mapPartitions(lambda blocks: boost_in_task(list(blocks), g, whole)).collect()
    else:
        trees = boost_by_jobs(data, g, whole)

    def leaf_of(stats):
        counts, total = stats
        w = float(counts @ g.weights())
        return (total / w if w else 0.0), 0.0, [w, total, 0.0], int(counts.sum())

    more = {"numFeatures": data.columns, "numTrees": g.trees}
    nodes = [(t, *row) for t, tree in enumerate(trees) for row in _saved_nodes(tree, data.thresholds, leaf_of)]
    return _as_model(train.sparkSession, classifier, GBTClassificationModel, "DecisionTreeRegressionModel", nodes, [1.0, *[g.step] * (g.trees - 1)], more)


def binning(classifier) -> tuple | None:
    """What decides the bins of some rows: classifiers alike in it can share them."""
    if type(classifier) not in (RandomForestClassifier, GBTClassifier):
        return None
    weight = classifier.getWeightCol() if classifier.isDefined(classifier.weightCol) else None
    return classifier.getFeaturesCol(), classifier.getLabelCol(), weight, classifier.getMaxBins(), classifier.getSeed()


def fit(classifier, train: DataFrame, data: Binned | None = None, fits: int = 1):
    """The classifier's model of written vectors, of ``data`` if they are binned already; classifiers of other or derived classes fit themselves.

    ``fits`` says how many of them run side by side.
    """
    if type(classifier) is RandomForestClassifier:
        return fit_forest(classifier, train, data)
    if type(classifier) is GBTClassifier:
        return fit_boosted(classifier, train, data, fits)
    return classifier.fit(train)


# --- Spark's models -------------------------------------------------------------------


def _saved_nodes(tree: Tree, thresholds: list[np.ndarray], leaf_of) -> list[tuple]:
    """Nodes from the root on, left before right, as Spark saves them; leaves of one parent that predict the same are one."""
    said = [leaf_of(s) for s in tree.stats]
    leaf = [f < 0 for f in tree.feature]
    for node in reversed(range(len(leaf))):
        if not leaf[node]:
            a, b = tree.left[node], tree.left[node] + 1
            leaf[node] = leaf[a] and leaf[b] and said[a][0] == said[b][0]
    rows: list = []
    todo = [(0, None, False)]
    while todo:
        node, parent, right = todo.pop()
        number = len(rows)
        if parent is not None:
            rows[parent][6 if right else 5] = number
        prediction, impurity, stats, count = said[node]
        if leaf[node]:
            rows.append([number, prediction, impurity, stats, count, -1, -1, -1.0, (-1, [], -1)])
        else:
            f = tree.feature[node]
            rows.append([number, prediction, impurity, stats, count, -1, -1, tree.gain[node], (f, [float(thresholds[f][tree.bin[node]])], -1)])
            todo += [(tree.left[node] + 1, number, True), (tree.left[node], number, False)]
    return [(r[0], r[1], r[2], r[3], r[4], r[7], r[5], r[6], r[8]) for r in rows]


_NODE = pa.struct(
    [
        ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())),
        ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
        ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])),
    ]
)


def _as_model(spark: SparkSession, classifier, kind: type, tree_kind: str, nodes: list[tuple], weights: list[float], more: dict):
    """Spark's model with these trees, through the format in which it saves models."""
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex[:12]}"

    def about(name: str, uid: str, extra: dict, without: tuple[str, ...] = ()) -> str:
        def named(values: dict) -> dict:
            return {p.name: v for p, v in values.items() if p.name not in without}

        head = {"class": f"org.apache.spark.ml.{name}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid}
        return json.dumps({**head, "paramMap": named(classifier._paramMap), "defaultParamMap": named(classifier._defaultParamMap), **extra})

    whole_only = ("numTrees", "maxIter", "stepSize", "lossType", "subsamplingRate", "featureSubsetStrategy", "bootstrap", "validationTol", "validationIndicatorCol")
    family = "classification" if "Classification" in tree_kind else "regression"
    if family == "regression":
        whole_only += ("probabilityCol", "rawPredictionCol", "thresholds")
    spark.createDataFrame([(about(f"classification.{kind.__name__}", classifier.uid, more),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    of_trees = [(i, about(f"{family}.{tree_kind}", f"tree_{uuid.uuid4().hex[:12]}", {}, whole_only), w) for i, w in enumerate(weights)]
    spark.createDataFrame(of_trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    names = [f.name for f in _NODE]
    values = []
    for row in nodes:
        node = dict(zip(names, row[1:]))
        node["split"] = dict(zip(("featureIndex", "leftCategoriesOrThreshold", "numCategories"), node["split"]))
        values.append(node)
    table = pa.table({"treeID": pa.array([row[0] for row in nodes], pa.int32()), "nodeData": pa.array(values, _NODE)})
    spark.createDataFrame(table).write.parquet(f"{path}/data")
    return kind.load(path)
