"""Prefix trie of rebuilt conversations, with what a cache of shared prefixes would save.

Method: a turn is a 128-bit id and a conversation a row of ids. The rows are
dealt into range shards by their ids; inside a shard, blocks of rows become
padded matrices of turn ids, ordered by lexsort. Where a column differs from
the row above, every deeper column starts a new node too (an OR accumulated
over the columns), and one reduceat over the cells, depth by depth, aggregates
all nodes of the block. Nodes on the path of a block's first or last row may
reach into other blocks: they are written as parts and put together by key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardwatch.llm.common import Workspace, arrow_limits

ID_BYTES = 16
#: Cells (rows x longest conversation) of one matrix; a single longer conversation is a matrix of its own.
BLOCK_CELLS = 400_000
GROUP = 100
HEADS = 6
NO_ENDS = hashlib.sha256(b"").hexdigest()
PIECES = (
    "block long, key binary, parent_key binary, side int, conv_id long, depth long, parent_conv_id long, n_convs long,"
    " n_children long, n_leaves long, saved_tokens long, chars long, ends_sha256 string, ends binary, first_end long"
)
_PIECES = pa.schema(
    [
        (name, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[kind])
        for name, kind in (column.split() for column in PIECES.split(", "))
    ]
)
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _ordered_turns(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and its turns (turn, id, chars) by turn, null first, ties by id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)  # the length keeps role and text apart
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.substring(F.sha2(named, 256), 1, 2 * ID_BYTES).alias("id"),
            F.char_length(text).alias("chars"),
        ).alias("t"),
    )
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame, work: Workspace) -> DataFrame:
    """One row per conversation: conv_id, path (its turns' ids, one after the other) and chars (of each turn's text).

    The first h turns come from the first conversation of the group of 100,
    the others are its own, h being a checksum of the id.
    """
    own = work.write(_ordered_turns(conversations), "turns")
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(GROUP))
    heads = own.where(base == F.col("conv_id")).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    taken = F.when(F.col("head").isNull(), F.slice("turns", F.lit(1), F.lit(0))).otherwise(F.slice("head", F.lit(1), h))
    joined = own.withColumns({"base": base, "h": h}).join(heads, "base", "left")  # at most 100 rows for each base
    turns = F.concat(taken, F.slice("turns", F.col("h") + 1, F.size("turns")))
    return joined.select("conv_id", turns.alias("turns")).select(
        "conv_id",
        F.unhex(F.array_join(F.col("turns.id"), "")).alias("path"),
        F.col("turns.chars").alias("chars"),
    )


def _keys(path: bytes) -> list[bytes]:
    """The keys of all nodes on a path, from the root on."""
    digest, keys = hashlib.sha256(), []
    for at in range(0, len(path) + 1, ID_BYTES):
        keys.append(digest.copy().digest()[:ID_BYTES])
        digest.update(path[at : at + ID_BYTES])
    return keys


def block_nodes(conv: np.ndarray, paths: list[bytes], chars: np.ndarray, block: int) -> list[pa.RecordBatch]:
    """All nodes of the trie over some rows that are neighbours in the order of their paths.

    ``chars`` holds the lengths of all texts, row after row. Nodes of the first
    and of the last row are parts: they have a key and count only what lies
    below them in this block outside other parts.
    """
    n = len(conv)
    length = np.array([len(p) // ID_BYTES for p in paths], np.int64)
    deep = int(length.max())
    valid = np.arange(deep)[None] < length[:, None]
    ids = np.zeros((n, deep, 2), np.uint64)
    ids[valid] = np.frombuffer(b"".join(paths), ">u8").reshape(-1, 2)
    size = np.zeros((n, deep + 1), np.int64)
    size[:, 1:][valid] = chars
    if n > 1:
        flat = ids.reshape(n, -1)
        order = np.lexsort((conv, length, *flat.T[::-1]))
        conv, length, ids, size, valid = conv[order], length[order], ids[order], size[order], valid[order]
        paths = [paths[i] for i in order]

    # A cell (depth, row) starts a node if the row above is another one in this column or in any before.
    starts = np.ones((n, deep + 1), bool)
    starts[1:, 0] = False
    if n > 1:
        changed = (ids[1:] != ids[:-1]).any(2) | ~valid[:-1]
        starts[1:, 1:] = np.logical_or.accumulate(changed, axis=1)
    here = np.concatenate([np.ones((n, 1), bool), valid], axis=1).T  # depth by depth from here on
    depth_of, row_of = np.nonzero(here)
    first = np.flatnonzero(starts.T[here])  # each node's first cell
    count = np.diff(np.append(first, len(row_of)))
    node = np.full(here.shape, -1, np.int64)
    node[here] = np.repeat(np.arange(len(first)), count)
    depth, row = depth_of[first], row_of[first]
    parent = np.where(depth > 0, node[np.maximum(depth - 1, 0), row], -1)
    smallest = np.minimum.reduceat(conv[row_of], first)

    sides = [node[: length[0] + 1, 0], node[: length[-1] + 1, -1]]
    part = np.zeros(len(first), bool)
    part[sides[0]] = part[sides[1]] = True
    children = np.bincount(parent[1:], minlength=len(first))
    whole_children = np.bincount(parent[1:][~part[1:]], minlength=len(first))

    def below(value: np.ndarray) -> np.ndarray:
        """Each node's sum of ``value`` over the nodes of its subtree: a node counts in its first row, from its depth upwards."""
        cells = np.zeros(here.shape, np.int64)
        cells[depth, row] = value
        return np.add.reduceat(np.cumsum(cells[::-1], axis=0)[::-1][here], first)

    leaves = below(np.where(part, 0, children == 0))
    saved = below(np.where(part, 0, (count - 1) * size[row, depth]))

    ends, first_end, sha = {}, {}, [NO_ENDS] * len(first)
    last = node[length, np.arange(n)]  # rows that end in one node are neighbours, smaller ids first
    cut = np.flatnonzero(np.append(True, last[1:] != last[:-1]))
    for a, z in zip(cut, np.append(cut[1:], n)):
        joined = ",".join(map(str, conv[a:z].tolist())).encode()
        if part[last[a]]:
            ends[int(last[a])], first_end[int(last[a])] = joined, int(conv[a])
        else:
            sha[last[a]] = hashlib.sha256(joined).hexdigest()

    keys = [_keys(paths[0]), _keys(paths[-1])]
    rows = []
    for side, (at, own) in enumerate(zip(sides, keys)):
        fresh = ~np.isin(at, sides[0]) if side else np.ones(len(at), bool)  # a node of both paths counts on the first
        rows.append(
            {
                "key": own,
                "parent_key": [None, *own[:-1]],
                "side": np.full(len(at), side),
                "conv_id": smallest[at],
                "depth": np.arange(len(at)),
                "n_convs": count[at] * fresh,
                "n_children": whole_children[at] * fresh,
                "n_leaves": leaves[at] * fresh,
                "saved_tokens": saved[at] * fresh,
                "chars": size[row[at], depth[at]],
                "ends": [ends.get(v) if f else None for v, f in zip(at.tolist(), fresh)],
                "first_end": pa.array([first_end.get(v) if f else None for v, f in zip(at.tolist(), fresh)], pa.int64()),
            }
        )
    inner = np.flatnonzero(~part)
    above = parent[inner]
    key_of = {int(v): k for at, own in zip(sides, keys) for v, k in zip(at, own)}
    rows.append(
        {
            "parent_key": [key_of.get(v) for v in above.tolist()],
            "conv_id": smallest[inner],
            "depth": depth[inner],
            "parent_conv_id": pa.array(smallest[above], pa.int64(), mask=part[above]),
            "n_convs": count[inner],
            "n_children": children[inner],
            "n_leaves": leaves[inner],
            "saved_tokens": saved[inner],
            "ends_sha256": [sha[v] for v in inner.tolist()],
        }
    )
    return [_batch(r, block) for r in rows]


def _batch(columns: dict, block: int) -> pa.RecordBatch:
    """Columns as one batch; those not named are null."""
    n = len(columns["conv_id"])
    columns = {"block": np.full(n, block), **columns}
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _PIECES], schema=_PIECES
    )


def _blocks(batches, limit: int):
    """The trie pieces of consecutive rows, as many at a time as one matrix may hold."""
    block = TaskContext.get().partitionId() << 32
    conv, paths, chars, deep = [], [], [], 0
    for batch in batches:
        values = batch.column("chars")
        offsets = np.asarray(values.offsets)
        flat = np.asarray(values.values, np.int64)
        for k, (c, p) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("path").to_pylist())):
            n = len(p) // ID_BYTES + 1
            if conv and (len(conv) + 1) * max(deep, n) > limit:
                yield from block_nodes(np.array(conv), paths, np.concatenate(chars), block)
                block += 1
                conv, paths, chars, deep = [], [], [], 0
            conv.append(c)
            paths.append(p)
            chars.append(flat[offsets[k] : offsets[k + 1]])
            deep = max(deep, n)
    if conv:
        yield from block_nodes(np.array(conv), paths, np.concatenate(chars), block)


def _digests(batches):
    """The digest of each key's pieces, which arrive in order: a node's ids are hashed as a stream, never held."""
    key, digest = None, None
    done: tuple[list, list] = ([], [])
    for batch in batches:
        for k, piece in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if k != key:
                if digest is not None:
                    done[0].append(key)
                    done[1].append(digest.hexdigest())
                key, digest = k, hashlib.sha256(piece)
            else:
                digest.update(b",")
                digest.update(piece)
        if len(done[0]) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1])], names=["key", "ends_sha256"])
            done = ([], [])
    if digest is not None:
        done[0].append(key)
        done[1].append(digest.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], names=["key", "ends_sha256"])


def prefix_trie(conversations: DataFrame, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """One row per node of the trie over all rebuilt conversations.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves (childless nodes in its subtree), saved_tokens (code
    points of repeated last texts, summed over its subtree), ends_sha256 (of
    the ids of the conversations that end here, ascending, joined by commas).

    Turns are ordered by turn, null first, ties by their content; repeated
    rows are repeated turns. Null role or text is an empty one. Rows without a
    conv_id belong to no conversation and are left out. A conversation without
    turns ends in the root. An empty table gives no rows; other columns are
    ignored. Texts are never shuffled, only ids of 16 bytes and lengths. Equal
    conversations are spread over shards by their id. A conversation's own ids
    are one row, as a document's text is.
    """
    spark = conversations.sparkSession
    arrow_limits(spark)
    work = Workspace(spark, "prefix-trie")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = work.write(rebuilt(conversations, work), "rebuilt")
    shards = whole.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    pieces = work.write(shards.mapInArrow(lambda batches: _blocks(batches, block_cells), PIECES), "pieces")

    shared = pieces.where(F.col("key").isNotNull())  # two paths a block
    seen = F.col("n_convs") > 0
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    nodes = shared.groupBy("key").agg(
        *sums,
        *[F.max(c).alias(c) for c in ("parent_key", "depth", "chars")],
        F.min("conv_id").alias("conv_id"),
        F.min(F.struct("block", "side")).alias("owner"),
    )
    children = nodes.where(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    nodes = work.write(nodes.drop("more"), "shared")

    # Each shared node's own share stands once, on one of its paths; sums from the depths up carry it to all above it.
    owned = F.when(F.col("owner") == F.struct("block", "side"), 1).otherwise(0)
    up = Window.partitionBy("block", "side").orderBy(F.desc("depth"))
    carried = (
        shared.select("key", "block", "side", "depth")
        .join(nodes.select("key", "owner", "n_convs", "n_children", "chars"), "key")
        .select(
            "key",
            F.sum(owned * (F.col("n_children") == 0).cast("long")).over(up).alias("leaves_up"),
            F.sum(owned * (F.col("n_convs") - 1) * F.col("chars")).over(up).alias("saved_up"),
        )
        .groupBy("key")
        .agg(F.sum("leaves_up").alias("leaves_up"), F.sum("saved_up").alias("saved_up"))
    )
    ends = shared.where(F.col("ends").isNotNull()).select("key", "first_end", "ends").repartition(parts, "key")
    ends = ends.sortWithinPartitions("key", "first_end").mapInArrow(_digests, "key binary, ends_sha256 string")
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    top = (
        nodes.join(carried, "key")
        .join(ends, "key", "left")
        .join(parents, "parent_key", "left")
        .withColumns(
            {
                "n_leaves": F.col("n_leaves") + F.col("leaves_up"),
                "saved_tokens": F.col("saved_tokens") + F.col("saved_up"),
                "ends_sha256": F.coalesce("ends_sha256", F.lit(NO_ENDS)),
            }
        )
    )
    # A node below a shared one finds it within its block, so that no common prefix meets all its children in one task.
    inner = pieces.where(F.col("key").isNull())
    local = shared.where(seen).select("block", F.col("key").alias("parent_key")).join(
        nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("shared_parent")), "parent_key"
    )
    inner = inner.join(local, ["block", "parent_key"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "shared_parent"))
    return top.select(*OUT).unionByName(inner.select(*OUT))
