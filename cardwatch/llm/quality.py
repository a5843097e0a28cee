"""Quality scores from a small byte-level convolutional network, trained and run with NumPy.

Method: bytes are embedded, learned filters slide over them, each chunk keeps
the largest response of every filter, chunks overlap by half and cover the
whole document, and the mean and the maximum over all chunks are combined into
one probability.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.common import arrow_limits, blocks, held_out, share_of_rows, utf8_view

#: Labelled documents learnt from, for each label: the bound of the training sample.
SAMPLE_PER_LABEL = 1_200
#: Chunks whose windows are held at a time while learning.
CHUNKS_AT_ONCE = 1_024
HOPS_AT_ONCE = 256
THRESHOLD = 0.3
KERNEL, STRIDE, EMBED, FILTERS = 8, 4, 4, 40
HOP = 256  # bytes; a chunk is two hops, so neighbours overlap by one
CHUNK = 2 * HOP
_WINDOWS = HOP // STRIDE
OUT = "doc_id long, held_out boolean, score double, predicted int"


@dataclass
class QualityNet:
    embed: np.ndarray
    filters: np.ndarray  # (kernel * embed, filter)
    shift: np.ndarray
    weights: np.ndarray  # (2 * filter,)
    bias: np.ndarray
    moments: dict = field(default_factory=dict)

    @staticmethod
    def start(seed: int = 5) -> QualityNet:
        rng = np.random.default_rng(seed)
        f = np.float32
        return QualityNet(
            rng.normal(0, 1, (256, EMBED)).astype(f),
            rng.normal(0, 1 / np.sqrt(KERNEL * EMBED), (KERNEL * EMBED, FILTERS)).astype(f),
            np.zeros(FILTERS, f),
            rng.normal(0, 0.1, 2 * FILTERS).astype(f),
            np.zeros(1, f),
        )

    def hop_maxima(self, rows: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each hop; a row is a hop and the bytes the last window reaches beyond it."""
        e = self.embed[rows].reshape(len(rows), -1)
        view = np.lib.stride_tricks.sliding_window_view(e, KERNEL * EMBED, axis=1)[:, :: STRIDE * EMBED]
        flat = np.ascontiguousarray(view).reshape(-1, KERNEL * EMBED)
        return (flat @ self.filters).reshape(-1, _WINDOWS, FILTERS).max(1) + self.shift

    def probability(self, hops: np.ndarray, first: np.ndarray) -> np.ndarray:
        """From the maxima of all hops and each document's first hop (with the end appended)."""
        last = first[1:] - 1
        pairs = np.maximum(hops[:-1], hops[1:]) if len(hops) > 1 else hops
        pairs = np.concatenate([pairs, hops[-1:]])[: len(hops)]
        pairs[last] = np.where((last > first[:-1])[:, None], pairs[np.maximum(last - 1, 0)], hops[last])
        act = np.maximum(pairs, 0)
        mean = np.add.reduceat(act, first[:-1], axis=0) / np.diff(first)[:, None]
        top = np.maximum.reduceat(act, first[:-1], axis=0)
        z = (np.concatenate([mean, top], axis=1) * self.weights).sum(1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _hops(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's hops, zero-filled, with what follows in the same document; each document's first hop."""
    lengths = np.diff(offsets)
    count = np.maximum(1, -(-lengths // HOP))
    first = np.concatenate([[0], np.cumsum(count)])
    flat = np.zeros(first[-1] * HOP, np.uint8)
    for i, n in enumerate(lengths):
        s = first[i] * HOP
        flat[s : s + n] = data[offsets[i] : offsets[i + 1]]
    rows = np.zeros((first[-1], HOP + KERNEL - STRIDE), np.uint8)
    rows[:, :HOP] = flat.reshape(-1, HOP)
    rows[:-1, HOP:] = rows[1:, : KERNEL - STRIDE]
    rows[first[1:] - 1, HOP:] = 0
    return rows, first


def _windows(embed: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(chunk, window, bytes of the window as numbers)."""
    flat = embed[rows].reshape(len(rows), -1)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, KERNEL * EMBED, axis=1)[:, :: STRIDE * EMBED])


def fit(texts: list[list[bytes]], labels: list[int], steps: int = 520, batch: int = 64, rate: float = 0.01) -> QualityNet:
    """Adam on the cross entropy, about ``steps`` times; a document is all its chunks."""
    epochs = max(1, -(-steps * batch // max(1, len(texts))))
    net = QualityNet.start()
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        net.weights[:] = 0
        net.bias[:] = 0.0 if not labels else (4.0 if labels[0] else -4.0)
        return net
    rng = np.random.default_rng(3)
    chunk_rows = [np.zeros((max(1, len(t)), CHUNK + KERNEL - STRIDE), np.uint8) for t in texts]
    for rows, t in zip(chunk_rows, texts):
        for r, c in zip(rows, t):
            r[: len(c)] = np.frombuffer(c, np.uint8)
    names = ("embed", "filters", "shift", "weights", "bias")
    state = {n: (np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))) for n in names}
    balance = np.where(y > 0, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean())).astype(np.float32)
    step, per = 0, 2 * _WINDOWS
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            ids = order[at : at + batch]
            rows = np.concatenate([chunk_rows[i] for i in ids])
            first = np.concatenate([[0], np.cumsum([len(chunk_rows[i]) for i in ids])])
            where = np.zeros((len(rows), FILTERS), np.int64)
            peak = np.zeros((len(rows), FILTERS), np.float32)
            for c in range(0, len(rows), CHUNKS_AT_ONCE):
                some = slice(c, c + CHUNKS_AT_ONCE)
                resp = _windows(net.embed, rows[some]).reshape(-1, KERNEL * EMBED) @ net.filters
                resp = resp.reshape(-1, per, FILTERS)
                where[some] = resp.argmax(1)
                peak[some] = np.take_along_axis(resp, where[some][:, None], 1)[:, 0] + net.shift
            act = np.maximum(peak, 0)
            size = np.diff(first)[:, None].astype(np.float32)
            mean, top = np.add.reduceat(act, first[:-1], axis=0) / size, np.maximum.reduceat(act, first[:-1], axis=0)
            feats = np.concatenate([mean, top], axis=1)
            p = 1 / (1 + np.exp(-np.clip(feats @ net.weights + net.bias, -30, 30)))
            g = (p - y[ids]) * balance[ids] / len(ids)
            owner = np.repeat(np.arange(len(ids)), np.diff(first))
            back = g[:, None] * net.weights[None]
            g_act = (back[:, :FILTERS] / size)[owner] + back[:, FILTERS:][owner] * (act == top[owner])
            g_peak = (g_act * (peak > 0)).astype(np.float32)
            g_emb, g_filters = np.zeros_like(net.embed), np.zeros_like(net.filters)
            kernels = net.filters.T.reshape(FILTERS, KERNEL, EMBED)[None]
            for c in range(0, len(rows), CHUNKS_AT_ONCE):
                some = slice(c, c + CHUNKS_AT_ONCE)
                bytes_at = where[some][:, :, None] * STRIDE + np.arange(KERNEL)
                touched = rows[some][np.arange(len(rows[some]))[:, None, None], bytes_at]  # (chunk, filter, byte)
                picked = net.embed[touched].reshape(len(touched), FILTERS, -1)
                g_filters += np.einsum("cfw,cf->wf", picked, g_peak[some])
                grads_in = g_peak[some][:, :, None, None] * kernels
                for k in range(EMBED):
                    g_emb[:, k] += np.bincount(touched.ravel(), grads_in[..., k].ravel(), minlength=256)
            grads = {
                "embed": g_emb,
                "filters": g_filters,
                "shift": g_peak.sum(0),
                "weights": feats.T @ g + 1e-4 * net.weights,
                "bias": np.array([g.sum()], np.float32),
            }
            step += 1
            speed = rate * (0.2 if epoch >= 0.75 * epochs else 1.0)
            for n in names:
                m, v = state[n]
                m += 0.1 * (grads[n] - m)
                v += 0.01 * (grads[n] ** 2 - v)
                p_ = getattr(net, n)
                p_ -= (speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def training_sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> tuple[list[list[bytes]], list[int]]:
    """About ``per_label`` documents of each label that are not held out, with all their chunks."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select(F.col("doc_id").cast("long").alias("labelled_id"), F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    chosen = F.lit(False)
    for label, n in sorted(counts.items()):
        chosen = chosen | ((F.col("quality") == label) & share_of_rows(per_label, n, F.col("labelled_id")))
    every = F.expr(
        f"transform(sequence(0, int((greatest(octet_length(text), 1) - 1) div {CHUNK})),"
        f" i -> substring(cast(text as binary), 1 + i * {CHUNK}, {CHUNK}))"
    )
    sample = usable.where(chosen)  # about 2 * per_label rows: small enough to send to every task
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .join(F.broadcast(sample), F.col("doc_id") == F.col("labelled_id"))
        .select("doc_id", "quality", every.alias("pieces"))
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], r["quality"]))
    return [[bytes(c) for c in r["pieces"]] for r in rows], [r["quality"] for r in rows]


def score(docs: DataFrame, net: QualityNet, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Whole texts are scored; null counts as empty and still gets a score; equal
    texts get equal scores; an empty table gives no rows; null ids stay.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    sent = spark.sparkContext.broadcast(net)

    def run(batches):
        net = sent.value
        for batch in batches:
            data, offsets = utf8_view(batch.column("text"))
            p = np.zeros(batch.num_rows)
            for i, j in blocks(offsets, 1 << 18):
                rows, first = _hops(data, offsets[i : j + 1])
                # Products of one shape only: a row's last digits would else depend on how many rows stand beside it.
                full = np.concatenate([rows, np.zeros((-len(rows) % HOPS_AT_ONCE, rows.shape[1]), np.uint8)])
                hops = [net.hop_maxima(full[h : h + HOPS_AT_ONCE]) for h in range(0, len(full), HOPS_AT_ONCE)]
                hops = np.concatenate(hops)[: len(rows)]
                p[i:j] = net.probability(hops, first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, OUT)


def quality_scores(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, threshold: float = THRESHOLD) -> DataFrame:
    """Learn from the labelled documents that are not held out, then score all of them."""
    return score(docs, fit(*training_sample(docs, labels, per_label)), threshold)
