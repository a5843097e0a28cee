"""Removal of repeated passages through suffix arrays.

A passage is any string of ``length`` bytes (100). Every start of a passage
belongs to an anchor: the smallest hash among the 32-byte strings inside it, so
equal passages have equal anchors. Consecutive starts whose first anchor is at
one place are a run.

Runs whose anchor occurs once hold nothing repeated, and of runs with equal
bytes all but the earliest are repeated as a whole; both are settled by hashes.
What is left are runs that share an anchor but differ, the edges of repeats.
Their bytes are gathered by anchor and sorted as suffixes in two stages: only
suffixes smaller than their successors are sorted directly, all others are
induced from them by scanning the buckets of first bytes. Adjacent suffixes
with a common prefix of at least ``length`` are equal passages.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.common import RunningHash, Workspace, arrow_limits, has_id_in, n_bytes, text_or_empty, utf8_view

LENGTH = 100
ANCHOR = 32
#: Runs of one anchor that are sorted together; more are sorted in parts and compared by digest afterwards.
GROUP_RUNS = 256
SORT_BYTES = 1 << 19
RUNS = "anchor long, span long, doc_id long, start long, starts int, settled boolean"


# --- suffix sorting in two stages ------------------------------------------------------------


def _words(x: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes at every position as a number that sorts like them; zeros follow the end."""
    padded = np.concatenate([x, np.zeros(depth + 16, np.uint8)])
    w = np.zeros(len(padded) - 8, np.uint64)
    for k in range(8):
        w = w << np.uint64(8) | padded[k : k + len(w)]
    return w


def descending(x: np.ndarray) -> np.ndarray:
    """Whether each suffix is larger than its successor (the end of the text is smallest)."""
    n = len(x)
    nxt = np.concatenate([x[1:], [0]]).astype(np.int16)
    step = np.sign(x.astype(np.int16) - nxt)
    step[-1] = 1
    # Inside a run of equal bytes the first different one decides.
    at = np.where(step != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[np.minimum(at, n - 1)] > 0


def _direct(w: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by ``depth`` bytes, eight at a time; only ties go on to the next eight."""
    order = at[np.argsort(w[at], kind="stable")]
    new = np.concatenate([[True], w[order][1:] != w[order][:-1]])
    group = np.cumsum(new)
    for d in range(8, depth, 8):
        _, first, size = np.unique(group, return_index=True, return_counts=True)
        tied = np.repeat(size > 1, size)
        if not tied.any():
            break
        where = np.flatnonzero(tied)
        key = w[order[where] + d]
        o = np.lexsort((key, group[where]))
        order[where] = order[where][o]
        key, g = key[o], group[where]
        split = np.concatenate([[False], (key[1:] != key[:-1]) & (g[1:] == g[:-1])])
        bump = np.zeros(len(order), np.int64)
        bump[where] = split
        group = group + np.cumsum(bump)
    return order


def suffix_array(x: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """All suffixes of ``x`` in the order of their first ``depth`` bytes at least."""
    n = len(x)
    if n == 0:
        return np.zeros(0, np.int64)
    w = _words(x, depth)
    down = descending(x)
    direct = _direct(w, np.flatnonzero(~down), depth) if (~down).any() else np.zeros(0, np.int64)
    sizes_up = np.bincount(x[direct], minlength=256)
    ends = np.concatenate([[0], np.cumsum(sizes_up)])
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[x[-1]].append(np.array([n - 1]))  # the last suffix is larger than its empty successor
    out = []
    for c in range(256):
        # Suffixes of this bucket whose successor lies in an earlier bucket, in the order of these successors.
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        bucket = [wave]
        while len(wave):
            before = wave[wave > 0] - 1
            wave = before[(x[before] == c) & down[before]]
            bucket.append(wave)
        bucket.append(direct[ends[c] : ends[c + 1]])
        here = np.concatenate(bucket)
        out.append(here)
        before = here[here > 0] - 1
        before = before[down[before] & (x[before] > c)]
        if len(before):
            by = np.argsort(x[before], kind="stable")
            chars = x[before][by]
            cut = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
            for a, part in zip(chars[cut], np.split(before[by], cut[1:])):
                waiting[a].append(part)
    return np.concatenate(out)


def same_prefix(x: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix but the first shares ``length`` bytes with the one before it."""
    w = _words(x, length)
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), bool)
    for d in range(0, length - 7, 8):
        same &= w[a + d] == w[b + d]
    if length % 8:
        tail = np.uint64(8 * (8 - length % 8))
        d = length - length % 8
        same &= w[a + d] >> tail == w[b + d] >> tail
    return same & (a + length <= len(x)) & (b + length <= len(x))


# --- runs ------------------------------------------------------------------------------------


def _window_minimum(h: np.ndarray, width: int) -> np.ndarray:
    m, have = h, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def _runs(data: np.ndarray, length: int):
    """(anchor, span hash, start, starts) of the runs of one text."""
    if len(data) < length:
        return None
    running = RunningHash(data)
    hashes = running.fixed(ANCHOR)
    anchor = _window_minimum(hashes, length - ANCHOR + 1)
    # A run ends where its anchor's place changes, also if the same anchor follows: no passage occurs twice in a run.
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (hashes[: len(anchor) - 1] == anchor[:-1])])
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [len(anchor)]]))
    span = running.spans(first, first + size + length - 1)
    return anchor[first], span, first, size


def _all_runs(docs: DataFrame, length: int) -> DataFrame:
    """Runs of all texts."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8_view(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            parts = []
            for i in range(len(offsets) - 1):
                if (r := _runs(data[offsets[i] : offsets[i + 1]], length)) is not None:
                    parts.append((*r, np.full(len(r[0]), ids[i])))
            if not parts:
                continue
            anchor, span, start, size, doc = (np.concatenate(c) for c in zip(*parts))
            # Of equal runs of a batch all but the earliest are settled here, so a hot run is sent once by each batch.
            by = np.lexsort((start, doc, span, anchor))
            first = np.concatenate([[True], (anchor[by][1:] != anchor[by][:-1]) | (span[by][1:] != span[by][:-1])])
            lead = by[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]
            settled = np.zeros(len(by), bool)
            settled[by] = ~first & ((doc[by] != doc[lead]) | (start[by] != start[lead]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor.view(np.int64)),
                    pa.array(span.view(np.int64)),
                    pa.array(doc),
                    pa.array(start.astype(np.int64)),
                    pa.array(size.astype(np.int32)),
                    pa.array(settled),
                ],
                names=["anchor", "span", "doc_id", "start", "starts", "settled"],
            )

    return docs.mapInArrow(run, RUNS)


def _sift(runs: DataFrame, length: int, group_runs: int) -> DataFrame:
    """Runs, the settled ones first, then by (anchor, span, doc_id, start) -> repeated stretches and runs still to be compared.

    ``part`` is -1 for a stretch that is repeated as a whole, else the number
    of the comparison group among those of its anchor. A batch of rows is all
    that is held, besides the run last seen.
    """

    def run(batches):
        last = None  # the latest row: anchor, span, doc, start, starts; whether it is the first of its span
        leader = None  # the earliest row of the current span
        kinds = 0  # spans of the current anchor sent for comparison
        for batch in batches:
            done = batch.filter(batch.column("settled"))
            if done.num_rows:
                ready = [done.column(c).cast(pa.int64()) for c in ("anchor", "doc_id", "start", "starts")]
                ready.insert(1, pa.array(np.full(done.num_rows, -1)))
                yield pa.RecordBatch.from_arrays(ready, names=["anchor", "part", "doc_id", "start", "starts"])
                batch = batch.filter(pc.invert(batch.column("settled")))
            a, s, d, p, m = (batch.column(c).to_numpy() for c in ("anchor", "span", "doc_id", "start", "starts"))
            if last is not None:
                a, s, d, p, m = (np.concatenate([[v], x]) for v, x in zip(last, (a, s, d, p, m)))
            if not len(a):
                continue
            new_anchor = np.concatenate([[last is None], a[1:] != a[:-1]])
            new_span = new_anchor | np.concatenate([[last is None], s[1:] != s[:-1]])
            span_at = np.maximum.accumulate(np.where(new_span, np.arange(len(a)), -1))
            lead_d = np.where(span_at >= 0, d[span_at], leader[0] if leader else 0)
            lead_p = np.where(span_at >= 0, p[span_at], leader[1] if leader else 0)
            again = ~new_span & ((d != lead_d) | (p != lead_p))
            if last is not None:
                again[0] = False
            # A span is compared if its anchor has another one: the first of a pair is sent when the second appears.
            other = new_span & ~new_anchor
            index = np.flatnonzero(other)
            send_d, send_p, send_m, send_a, send_part = [], [], [], [], []
            if len(index):
                anchor_at = np.maximum.accumulate(np.where(new_anchor, np.arange(len(a)), -1))
                for_span = np.cumsum(other)
                base = np.where(anchor_at >= 0, for_span[np.maximum(anchor_at, 0)], 0)
                start_kinds = np.where(anchor_at >= 0, 0, kinds)
                number = for_span - base + start_kinds  # 1 for the second span of an anchor
                previous = index - 1
                opens = number[index] == 1
                send_a = np.concatenate([a[index[opens]], a[index]])
                send_d = np.concatenate([lead_d[previous[opens]], d[index]])
                send_p = np.concatenate([lead_p[previous[opens]], p[index]])
                lead_m = np.where(span_at >= 0, m[span_at], leader[2] if leader else 0)
                send_m = np.concatenate([lead_m[previous[opens]], m[index]])
                send_part = np.concatenate([np.zeros(opens.sum(), np.int64), number[index] // group_runs])
                kinds = int(number[-1])
            opened = np.flatnonzero(new_anchor)
            if len(opened) and not (len(index) and index[-1] > opened[-1]):
                kinds = 0
            leader = (int(lead_d[-1]), int(lead_p[-1]), int(m[span_at[-1]]) if span_at[-1] >= 0 else leader[2])
            last = (a[-1], s[-1], d[-1], p[-1], m[-1])
            k = int(again.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([a[again], send_a]).astype(np.int64)),
                    pa.array(np.concatenate([np.full(k, -1), send_part]).astype(np.int64)),
                    pa.array(np.concatenate([d[again], send_d]).astype(np.int64)),
                    pa.array(np.concatenate([p[again], send_p]).astype(np.int64)),
                    pa.array(np.concatenate([m[again], send_m]).astype(np.int64)),
                ],
                names=["anchor", "part", "doc_id", "start", "starts"],
            )

    return runs.mapInArrow(run, "anchor long, part long, doc_id long, start long, starts long")


def _cut_spans(found: DataFrame, length: int) -> DataFrame:
    """The bytes of each run to be compared, from rows with a text and its runs."""

    def run(batches):
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            data, offsets = utf8_view(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for i, runs in enumerate(batch.column("runs").to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                for r in runs:
                    piece = text[r["start"] : r["start"] + r["starts"] + length - 1].tobytes()
                    for column, v in zip(rows, (r["anchor"], r["part"], ids[i], r["start"], piece)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in rows[:4]), pa.array(rows[4], pa.binary())],
                names=["anchor", "part", "doc_id", "start", "bytes"],
            )

    return found.mapInArrow(run, "anchor long, part long, doc_id long, start long, bytes binary")


def _compare(spans: DataFrame, length: int) -> DataFrame:
    """Equal passages inside each (anchor, part), rows sorted by it: every start but the earliest is repeated.

    Rows with ``digest`` are the earliest starts of anchors that were cut into
    parts, to be compared across parts.
    """

    def resolve(pieces, ids, starts, split):
        x = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(b) for b in pieces])
        at = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.repeat(np.arange(len(pieces)), sizes)
        local = np.arange(len(x)) - at[owner]
        begins = local + length <= sizes[owner]
        order = suffix_array(x, length)
        order = order[begins[order]]
        if not len(order):
            return []
        group = np.concatenate([[0], np.cumsum(~same_prefix(x, order, length))])
        doc, start = np.array(ids)[owner[order]], np.array(starts)[owner[order]] + local[order]
        by = np.lexsort((start, doc, group))
        first = np.concatenate([[True], group[by][1:] != group[by][:-1]])
        lead = np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
        repeat = ~first & ((doc[by] != doc[by][lead]) | (start[by] != start[by][lead]))
        out = list(zip(doc[by][repeat].tolist(), start[by][repeat].tolist(), [None] * int(repeat.sum())))
        keep = first & np.array(split)[owner[order[by]]]
        for o in np.flatnonzero(keep):
            q = int(order[by[o]])
            out.append((int(doc[by[o]]), int(start[by[o]]), hashlib.blake2b(x[q : q + length].tobytes(), digest_size=16).digest()))
        return out

    def run(batches):
        pieces, ids, starts, split, size, key = [], [], [], [], 0, None

        def rows(found):
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in found], pa.int64()),
                    pa.array([r[1] for r in found], pa.int64()),
                    pa.array([r[2] for r in found], pa.binary()),
                ],
                names=["doc_id", "start", "digest"],
            )

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("anchor", "part", "doc_id", "start", "bytes", "split"))
            for anchor, part, doc, start, piece, cut in zip(*columns):
                if (anchor, part) != key and size > SORT_BYTES:
                    yield rows(resolve(pieces, ids, starts, split))
                    pieces, ids, starts, split, size = [], [], [], [], 0
                key = (anchor, part)
                pieces.append(piece)
                ids.append(doc)
                starts.append(start)
                split.append(cut)
                size += len(piece)
        if pieces:
            yield rows(resolve(pieces, ids, starts, split))

    return spans.mapInArrow(run, "doc_id long, start long, digest binary")


def _cut_out(rows: DataFrame) -> DataFrame:
    """Texts and their repeated stretches -> what is left of them."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8_view(batch.column("text"))
            removed, spans, left = [], [], []
            for i, ranges in enumerate(batch.column("ranges").to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                edge = np.zeros(len(text) + 1, np.int64)
                a = np.minimum([r["start"] for r in ranges], len(text))
                z = np.minimum([r["end"] for r in ranges], len(text))
                np.add.at(edge, a, 1)
                np.add.at(edge, z, -1)
                gone = np.cumsum(edge)[:-1] > 0
                removed.append(int(gone.sum()))
                spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                left.append(text[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(left, pa.binary())],
                names=["doc_id", "n_removed", "n_spans", "kept_bytes"],
            )

    return rows.mapInArrow(run, "doc_id long, n_removed long, n_spans long, kept_bytes binary")


def repeated_stretches(docs: DataFrame, work: Workspace, length: int = LENGTH, group_runs: int = GROUP_RUNS) -> DataFrame:
    """(doc_id, start, end): stretches of bytes covered by passages that also start earlier; they may overlap."""
    spark = docs.sparkSession
    arrow_limits(spark)
    source = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    spread = F.when(F.col("settled"), F.xxhash64("doc_id", "start")).otherwise(F.col("anchor"))
    runs = _all_runs(source, length).repartition(spread)
    runs = runs.sortWithinPartitions(F.col("settled").desc(), "anchor", "span", "doc_id", "start")
    sifted = work.write(_sift(runs, length, group_runs), "sifted")
    whole = sifted.where("part < 0").select("doc_id", "start", (F.col("start") + F.col("starts") + length - 1).alias("end"))

    open_ = sifted.where("part >= 0")
    by_doc = open_.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "part", "start", "starts")).alias("runs"))
    texts = has_id_in(source, open_.select("doc_id").distinct())
    spans = _cut_spans(texts.join(by_doc.hint("merge"), "doc_id").select("doc_id", "text", "runs"), length)
    cut_anchors = open_.where("part = 1").select("anchor").distinct().withColumn("split", F.lit(True))
    spans = spans.join(cut_anchors, "anchor", "left").withColumn("split", F.coalesce("split", F.lit(False)))
    compared = work.write(
        _compare(spans.repartition("anchor", "part").sortWithinPartitions("anchor", "part"), length), "compared"
    )
    across = compared.where("digest is not null")
    earliest = across.groupBy("digest").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
    later = across.join(earliest.where("n > 1").hint("merge"), "digest").where(
        (F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start"))
    )
    edges = compared.where("digest is null").select("doc_id", "start").unionByName(later.select("doc_id", "start"))
    return whole.unionByName(edges.select("doc_id", "start", (F.col("start") + length).alias("end")))


def without_repeats(docs: DataFrame, length: int = LENGTH, group_runs: int = GROUP_RUNS) -> DataFrame:
    """One row per document that loses bytes: doc_id, n_removed, n_spans, kept_bytes.

    A byte is removed if a passage of ``length`` bytes covers it that also
    starts earlier, in a document of a smaller id or before it in the same one;
    passages are judged on the input.

    A null text is empty; a null id takes no part and loses nothing; rows that
    repeat an id are taken to repeat its text, are one document and get equal
    rows; an empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "suffix-dedup")
    stretches = work.write(repeated_stretches(docs, work, length, group_runs), "stretches")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ranges = stretches.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    hit = has_id_in(source, stretches.select("doc_id").distinct())
    cut = _cut_out(hit.join(ranges.hint("merge"), "doc_id").select("doc_id", "text", "ranges"))
    return cut


def repeats_removed(docs: DataFrame, length: int = LENGTH, group_runs: int = GROUP_RUNS) -> DataFrame:
    """One row per document, whole ones too: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    cut = without_repeats(docs, length, group_runs).select(
        F.col("doc_id").alias("__id"), "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept")
    ).dropDuplicates(["__id"])
    plain = source.select("doc_id", n_bytes(F.col("text")).alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("all"))
    joined = plain.join(cut.hint("merge"), F.col("doc_id") == F.col("__id"), "left")
    return joined.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept", "all").alias("kept_sha256"),
    )
