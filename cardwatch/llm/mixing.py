"""Sources interleaved to target weights by Pfair scheduling, with DataFrame functions only.

Method: a source is a sequence of blocks of about ``block_bytes``. With integer
weights w that add to W, block k of a source may start at slot floor(k * W / w)
and must be placed before slot ceil((k + 1) * W / w); serving the released
block with the earliest deadline keeps every source within one block of its
share at every slot. The pattern repeats after W slots, so it is worked out
once for the weights and looked up for the rows. When a source runs out, the
next phase starts with the others.
"""

from __future__ import annotations

import heapq
import json
from functools import reduce
from math import gcd, isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardwatch.llm.common import Workspace, n_bytes, spare, text_or_empty

BLOCK_BYTES = 64 << 10
#: Largest default weight; the pattern of a phase is no longer than sources times this.
RESOLUTION = 100


def pattern(weights: dict[str, int]) -> dict[str, list[int]]:
    """The slots of one period (the sum of the weights), for each source in block order."""
    period = sum(weights.values())
    waiting = [(0, s, 0) for s in sorted(weights)]  # (release, source, block)
    ready: list[tuple[int, str, int]] = []  # (deadline, source, block)
    slots: dict[str, list[int]] = {s: [] for s in weights}
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // weights[s]), s, k))
        _, s, k = heapq.heappop(ready)
        slots[s].append(slot)
        if k + 1 < weights[s]:
            heapq.heappush(waiting, ((k + 1) * period // weights[s], s, k + 1))
    return slots


def phases(weights: dict[str, int], blocks: dict[str, int]) -> dict[str, list[dict]]:
    """For each source its stretches of blocks: from which block, at which slot, by which pattern."""
    done = dict.fromkeys(blocks, 0)
    out: dict[str, list[dict]] = {s: [] for s in blocks}
    base = 0
    while active := {s: weights[s] for s in blocks if done[s] < blocks[s]}:
        shared = reduce(gcd, active.values())
        active = {s: w // shared for s, w in active.items()}
        period, slots = sum(active.values()), pattern(active)

        def slot_of(s: str, k: int) -> int:
            return k // active[s] * period + slots[s][k % active[s]]

        length = min(slot_of(s, blocks[s] - done[s] - 1) + 1 for s in active)
        for s in active:
            out[s].append({"first": done[s], "base": base, "weight": active[s], "period": period, "slots": slots[s]})
            whole, rest = divmod(length, period)
            done[s] += whole * active[s] + sum(x < rest for x in slots[s])
        base += length
    return out


def default_weights(totals: dict[str, int]) -> dict[str, int]:
    """Square roots of the sources' bytes, as integers up to ``RESOLUTION``: small sources gain."""
    top = max(totals.values(), default=1)
    return {s: max(1, isqrt(RESOLUTION * RESOLUTION * n // max(1, top))) for s, n in totals.items()}


def interleave(
    docs: DataFrame,
    weights: dict[str, int] | None = None,
    block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, source, size, block, weight, slot, release, deadline, place.

    Reading by (slot, place) gives the mix: after any slot each source has had
    its weight's share of the slots of the phase, to within one block. A block
    is a stretch of ``block_bytes`` of a source in id order; a document counts
    its UTF-8 bytes plus one and belongs to the block its first byte falls in.
    ``release`` and ``deadline`` are the window of the block's slot.

    Weights are positive integers; a source without one raises ValueError.
    Every row is placed once. A null source is the source "", a null text is
    empty, null ids come first; equal rows take neighbouring places; an empty
    table gives no rows. The schedule has one row per source, which is the
    size of ``weights``.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "mixing")
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        (n_bytes(text) + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("mark"),
    )
    order = ["doc_id", "size", "mark"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A hot source is summed in pieces: the ranges of ids it falls into.
    ranged = work.write(
        rows.repartitionByRange(parts, *order, "source").withColumn("part", F.spark_partition_id()), "ranged"
    )
    totals = work.write(ranged.groupBy("source", "part").agg(F.sum("size").alias("bytes")), "totals")
    sums = {r["source"]: r["bytes"] for r in totals.groupBy("source").agg(F.sum("bytes").alias("bytes")).collect()}
    weights = default_weights(sums) if weights is None else weights
    if missing := sorted(s for s in sums if weights.get(s, 0) < 1):
        raise ValueError(f"no positive weight for sources {missing[:5]}")
    plan = phases(weights, {s: -(-n // block_bytes) for s, n in sums.items()})

    schema = (
        "array<struct<source:string,stretches:array<struct<"
        "first:bigint,base:bigint,weight:bigint,period:bigint,slots:array<bigint>>>>>"
    )
    text_of_plan = json.dumps([{"source": s, "stretches": x} for s, x in sorted(plan.items())])
    schedule = spark.range(1).select(F.inline(F.from_json(F.lit(text_of_plan), schema)))

    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("source", "part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("carried"))
    here = Window.partitionBy("source", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("size").over(here) - F.col("size")
    placed = ranged.withColumn("before", before).join(carry, ["source", "part"])
    placed = placed.withColumn("before", F.col("before") + F.col("carried"))
    placed = placed.withColumn("block", F.call_function("div", F.col("before"), F.lit(block_bytes)))
    placed = placed.join(F.broadcast(schedule), "source")  # one row per source
    placed = placed.withColumn("s", F.expr("element_at(filter(stretches, x -> x.first <= block), -1)"))
    turn = F.col("block") - F.col("s.first")
    cycle = F.call_function("div", turn, F.col("s.weight"))
    inner = (turn % F.col("s.weight")).cast("int")
    window_of = F.call_function("div", turn * F.col("s.period"), F.col("s.weight"))
    due = F.call_function("div", (turn + 1) * F.col("s.period") + F.col("s.weight") - 1, F.col("s.weight"))
    return placed.select(
        "doc_id",
        "source",
        "size",
        "block",
        F.col("s.weight").alias("weight"),
        (F.col("s.base") + cycle * F.col("s.period") + F.get(F.col("s.slots"), inner)).alias("slot"),
        (F.col("s.base") + window_of).alias("release"),
        (F.col("s.base") + due).alias("deadline"),
        (F.col("before") % block_bytes).alias("place"),
    )


def mixed(docs: DataFrame, weights: dict[str, int] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All documents with their columns, whatever their names, sorted by their place in the mix.

    Rows that share an id share a place; null sources, texts and ids, ties and
    empty tables are handled as by ``interleave``.
    """
    at, key = spare(docs, "__at"), spare(docs, "__id")
    first = interleave(docs, weights, block_bytes).groupBy(F.col("doc_id").alias(key)).agg(F.min(F.struct("slot", "place")).alias(at))
    joined = docs.join(first, F.col("doc_id").cast("long").eqNullSafe(F.col(key)), "left")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [f"{at}.slot", f"{at}.place", "doc_id"]
    return joined.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop(at, key)
