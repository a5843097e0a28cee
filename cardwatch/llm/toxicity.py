"""Toxicity scores of texts whose disguised words are restored first.

Method: a noisy channel. A writer's letter may have been sent as a digit or
sign that looks like it, several times over, or with gaps between the letters
of a word. Where a text shows such signs, the stretch becomes a lattice of what
each character may stand for; a Viterbi search finds the reading that is most
likely under a character language model (with the cost of the channel), and
the restored text is scored by a classifier over words. The language model
counts all 4-grams of letters of the whole corpus.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.common import Workspace, arrow_limits, blocks, held_out, share_of_rows, utf8_view

#: Labelled documents learnt from, for each label: the bound of the training sample.
SAMPLE_PER_LABEL = 3_000
#: Words the classifier may know: the bound of the model.
LEXICON = 1_000
THRESHOLD = 0.5
SURE = 5.0  # standard deviations by which a word must be commoner in toxic texts
ORDER = 4
#: Symbols of the language model: 0 a gap, 1-26 the letters, 27 any byte of another script.
SYMBOLS = 28
_FOLD = np.array([27 if b >= 128 else (b | 32) - 96 if chr(b).isalpha() else 0 for b in range(256)], np.int64)
_BLANK = bytes(b if b >= 128 else b | 32 if chr(b).isalpha() else 32 for b in range(256))

# Fixed values of the channel: what a sign may stand for, and costs in nats.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "*": "aeiou",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s",
}
COST_SIGN = 1.5
COST_REPEAT = 1.0
COST_GAP = 1.0
COST_LITERAL = 4.0
#: A longer stretch without a gap is a key, a link or a digest, and stays.
LONGEST_WORD = 64

_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_SIGN = "[" + re.escape("".join(c for c in LOOKS_LIKE if c != "!")) + "]|!(?=[A-Za-z0-9@$])"
#: Stretches with signs of a disguise: single characters with gaps, a word with a look-alike, a letter three times.
_GAPPED = rf"(?<![^\W_])(?:(?:[A-Za-z]|{_SIGN})[ .\-_~]){{2,}}(?:[A-Za-z]|{_SIGN})(?![^\W_])"
_DISGUISED = re.compile(
    rf"(?P<gapped>{_GAPPED})"
    rf"|(?<![A-Za-z])[A-Za-z]*+(?:{_SIGN})(?:[A-Za-z]|{_SIGN})*+"
    r"|(?<![A-Za-z])[A-Za-z]*?([A-Za-z])\2\2[A-Za-z]*+",
    re.IGNORECASE,
)
OUT = "doc_id long, held_out boolean, score double, predicted int"


# --- the character language model ----------------------------------------------------------


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): how often each 4-gram of symbols occurs in all texts, gaps merged into one."""

    def count(batches):
        total = np.zeros(SYMBOLS**ORDER, np.int64)
        for batch in batches:
            data, offsets = utf8_view(batch.column("text"))
            for i, j in blocks(offsets):
                flat = np.zeros(int(offsets[j] - offsets[i]) + (j - i) + ORDER, np.int64)  # a gap before each text
                at = offsets[i : j + 1] - offsets[i]
                where = np.ones(len(flat), bool)
                where[at[:-1] + np.arange(j - i)] = False
                where[len(flat) - ORDER :] = False
                flat[where] = _FOLD[data[offsets[i] : offsets[j]]]
                flat = flat[np.append(True, (flat[1:] > 0) | (flat[:-1] > 0))]
                code = np.zeros(max(0, len(flat) - ORDER + 1), np.int64)
                for k in range(ORDER):
                    code = code * SYMBOLS + flat[k : len(flat) - ORDER + 1 + k]
                total += np.bincount(code, minlength=SYMBOLS**ORDER)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["gram", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "gram int, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts: np.ndarray) -> np.ndarray:
    """Costs (negative log probabilities) of a symbol after three others, each order smoothed by the one below it."""
    probability = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, ORDER + 1):
        table = counts.reshape(-1, SYMBOLS**order).sum(0).reshape(-1, SYMBOLS).astype(np.float64)
        below = probability.reshape(-1, SYMBOLS)  # by the context without its first symbol
        below = np.tile(below, (len(table) // len(below), 1))
        probability = ((table + 2.0 * below) / (table.sum(1, keepdims=True) + 2.0)).ravel()
    return -np.log(probability).astype(np.float32)


def fit_language_model(docs: DataFrame) -> np.ndarray:
    """The model of all texts; at most 28**4 counts reach the driver, whatever the corpus."""
    counts = np.zeros(SYMBOLS**ORDER, np.int64)
    rows = gram_counts(docs).toArrow()
    counts[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    return language_model(counts)


# --- the decoder ---------------------------------------------------------------------------


def _lattice(stretch: str) -> Iterator[list[tuple[str, float]]]:
    """For each run of one character: (what it may stand for, the cost of that)."""
    for run in re.finditer(r"(.)\1*", stretch.lower(), re.DOTALL):
        c, n = run.group(1), run.end() - run.start()
        if "a" <= c <= "z":
            yield [(c * min(n, 2), COST_REPEAT * (n > 2))] + [(c, COST_REPEAT)] * (n > 1)
        elif c in LOOKS_LIKE:
            once = [(x, COST_SIGN + COST_REPEAT * (n > 1)) for x in LOOKS_LIKE[c]]
            twice = [(x + x, COST_SIGN + COST_REPEAT * (n > 2)) for x in LOOKS_LIKE[c] if n > 1]
            yield once + twice + [(" ", COST_LITERAL * n)]
        else:
            yield [(" ", COST_GAP), ("", 0.0)]


class Decoder:
    """The most likely reading of disguised stretches, each worked out once."""

    def __init__(self, costs: np.ndarray, remember: int = 100_000):
        self.costs, self.remember, self.known = costs.tolist(), remember, {}

    def restore(self, stretch: str) -> str:
        read = self.known.get(stretch)
        if read is None:
            if len(self.known) >= self.remember:
                self.known.clear()
            read = self.known[stretch] = self._viterbi(stretch)
        return read

    def _viterbi(self, stretch: str) -> str:
        keep = SYMBOLS ** (ORDER - 1)
        best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}  # after three gaps; a path is (letters, path before)
        for options in [*_lattice(stretch), [(" ", 0.0)]]:
            step: dict[int, tuple[float, tuple]] = {}
            for state, (cost, path) in best.items():
                for letters, extra in options:
                    s, total = state, cost + extra
                    for x in letters:
                        symbol = 0 if x == " " else ord(x) - 96
                        if symbol == 0 and s % SYMBOLS == 0:
                            continue  # gaps merge
                        total += self.costs[s * SYMBOLS + symbol]
                        s = (s * SYMBOLS + symbol) % keep
                    old = step.get(s)
                    if old is None or total < old[0]:
                        step[s] = (total, (letters, path))
            best = step
        path = min(best.values(), key=lambda b: b[0])[1]
        letters = []
        while path:
            letters.append(path[0])
            path = path[1]
        return "".join(reversed(letters)).strip()

    def text(self, text: str) -> str:
        """A text with its disguised stretches restored; all else stays as it is."""
        return _DISGUISED.sub(self._replace, _INVISIBLE.sub("", text))

    def _replace(self, match: re.Match) -> str:
        stretch = match.group()
        if match["gapped"] is None and (len(stretch) > LONGEST_WORD or not _LETTER.search(stretch)):
            return stretch
        return self.restore(stretch)


_LETTER = re.compile("[A-Za-z]")
_KIND = np.zeros(256, np.uint8)  # 1 a letter, 2 a sign, 4 the exclamation mark, 8 a first byte of signs of other scripts
for _b in range(128):
    _KIND[_b] = 1 if chr(_b).isalpha() else 4 if chr(_b) == "!" else 2 if chr(_b) in LOOKS_LIKE else 0
_KIND[[0xC2, 0xD0, 0xD1, 0xE2, 0xEF]] = 8


def suspicious(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts of a block may hold a disguised stretch: no text with one is left out."""
    flat = np.zeros(int(offsets[-1] - offsets[0]) + 6, np.uint8)
    flat[3:-3] = data[offsets[0] : offsets[-1]]
    kind, n = _KIND[flat], len(flat) - 6
    letter, sign = kind == 1, (kind & 6) > 0
    mid = slice(3, n + 3)
    low = flat | 32
    hit = kind[mid] == 8
    hit |= ((kind[mid] & 2) > 0) & (letter[2 : n + 2] | letter[4 : n + 4])
    hit |= (kind[mid] == 4) & (letter[4 : n + 4] | sign[4 : n + 4])
    hit |= letter[mid] & (low[mid] == low[4 : n + 4]) & (low[mid] == low[5 : n + 5])
    single = letter | sign  # single characters with gaps: such a one at every second place
    hit |= single[1 : n + 1] & single[mid] & single[5 : n + 5] & ~letter[2 : n + 2] & ~letter[4 : n + 4]
    sums = np.concatenate([[0], np.cumsum(hit)])
    at = offsets - offsets[0]
    return sums[at[1:]] > sums[at[:-1]]


def decoded_words(decoder: Decoder, column: pa.Array) -> Iterator[list[bytes]]:
    """The lower-case words of each restored text; anything but ASCII letters and other scripts parts them."""
    data, offsets = utf8_view(column)
    for i, j in blocks(offsets):
        for k, restore in enumerate(suspicious(data, offsets[i : j + 1]).tolist(), i):
            text = data[offsets[k] : offsets[k + 1]].tobytes()
            if restore:
                text = decoder.text(text.decode()).encode()
            yield text.translate(_BLANK).split()


# --- the classifier ------------------------------------------------------------------------

#: Besides whole words their first bytes count as stems, so that an insult is known in its other forms.
STEMS = (4, 5, 6)


def with_stems(words: list[bytes]) -> Iterator[bytes]:
    """The words and the stems of longer ones, marked by a star."""
    yield from words
    for n in STEMS:
        for w in words:
            if len(w) > n:
                yield w[:n] + b"*"


@dataclass(frozen=True)
class ToxicityModel:
    costs: np.ndarray
    weights: dict[bytes, float]
    bias: float

    def score(self, words: list[bytes]) -> float:
        known = self.weights
        found = Counter(w for w in with_stems(words) if w in known)
        z = self.bias + sum(known[w] * math.log1p(n) for w, n in sorted(found.items()))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _sample(labels: DataFrame, per_label: int) -> tuple[DataFrame, dict[int, int]]:
    """About ``per_label`` ids of each label that are not held out, (labelled_id, toxic), and how many there are of each."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select(F.col("doc_id").cast("long").alias("labelled_id"), F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}  # two rows
    chosen: Column = F.lit(False)
    for label, n in sorted(counts.items()):
        chosen = chosen | ((F.col("toxic") == label) & share_of_rows(per_label, n, F.col("labelled_id")))
    return usable.where(chosen), counts


def _sample_words(docs: DataFrame, sample: DataFrame, costs: np.ndarray) -> DataFrame:
    """(doc_id, toxic, copy, word, n) of the restored whole texts of the sample; word null once for each document.

    ``copy`` is equal for copies, and for most near copies: the smallest checksum of five words in a row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(costs)

    def run(batches):
        decoder = Decoder(sent.value)
        for batch in batches:
            known = zip(batch.column("doc_id").to_pylist(), batch.column("toxic").to_pylist())
            for (doc_id, toxic), found in zip(known, decoded_words(decoder, batch.column("text"))):
                counts = Counter(with_stems(found))
                n = len(counts) + 1
                copy = min((zlib.crc32(b" ".join(found[k : k + 5])) for k in range(max(1, len(found) - 4))))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc_id] * n, pa.int64()),
                        pa.array([toxic] * n, pa.int32()),
                        pa.array([copy] * n, pa.int64()),
                        pa.array([None, *counts], pa.binary()),
                        pa.array([0, *counts.values()], pa.int64()),
                    ],
                    names=["doc_id", "toxic", "copy", "word", "n"],
                )

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).join(
        F.broadcast(sample), F.col("doc_id") == F.col("labelled_id")  # about 2 * per_label rows
    )
    return rows.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, copy long, word binary, n long")


def _lexicon(words: DataFrame, toxic: int, clean: int, size: int) -> list[bytes]:
    """The words that are most surely commoner in toxic texts, by the likelihood ratio against equal shares.

    Words that speak for a clean text are left out: no number of them excuses an insult.
    """
    seen = words.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(F.lit(1) - F.col("toxic")).alias("c"))
    t, c = F.col("t"), F.col("c")
    share = (t + c) / (toxic + clean)

    def term(n, expected):
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    ratio = 2 * (
        term(t, toxic * share) + term(c, clean * share)
        + term(toxic - t, toxic * (1 - share)) + term(clean - c, clean * (1 - share))
    )
    sure = seen.select("word", ratio.alias("z")).where((t * clean > c * toxic) & (F.col("z") >= SURE**2))
    return [bytes(r["word"]) for r in sure.orderBy(F.desc("z"), "word").limit(size).collect()]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 0.05, steps: int = 60) -> np.ndarray:
    """Weights and bias by Newton's method with a quadratic penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    w, pull = np.zeros(x.shape[1]), np.full(x.shape[1], decay)
    pull[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + pull * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        move = np.linalg.solve(curve, gradient)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, lexicon: int = LEXICON) -> ToxicityModel:
    """The language model of all texts, and a classifier learnt from a bounded sample of labelled whole texts."""
    spark = docs.sparkSession
    arrow_limits(spark)
    costs = fit_language_model(docs)
    work = Workspace(spark, "toxicity")
    sample, counts = _sample(labels, per_label)
    words = work.write(_sample_words(docs, sample, costs), "words")
    # Of copies with one label the smallest id is learnt from: many copies are one piece of evidence.
    first = words.where("word is null").groupBy("copy", "toxic").agg(F.min("doc_id").alias("doc_id"))
    rows = sorted((r["doc_id"], r["toxic"]) for r in first.select("doc_id", "toxic").collect())  # about 2 * per_label
    toxic = sum(t for _, t in rows)
    if toxic in (0, len(rows)):
        return ToxicityModel(costs, {}, -4.0 if not toxic else 4.0)
    words = words.where("word is not null").join(F.broadcast(first), ["copy", "toxic", "doc_id"]).drop("copy").distinct()
    known = _lexicon(words, toxic, len(rows) - toxic, lexicon)
    row_of, column_of = {k: i for i, k in enumerate(rows)}, {w: i for i, w in enumerate(known)}
    x = np.zeros((len(rows), len(known)))
    if known:
        listed = spark.createDataFrame([(w,) for w in known], "word binary")
        for r in words.join(F.broadcast(listed), "word").collect():  # at most rows x lexicon
            x[row_of[r["doc_id"], r["toxic"]], column_of[bytes(r["word"])]] = math.log1p(r["n"])
    y = np.array([t for _, t in rows], float)
    drawn = {1: toxic, 0: len(rows) - toxic}
    weight = np.array([counts[t] / drawn[t] for _, t in rows])  # as often as in all labels
    w = _logistic(x, y, weight * len(rows) / weight.sum())
    return ToxicityModel(costs, dict(zip(known, w[:-1].tolist())), float(w[-1]))


# --- the operator --------------------------------------------------------------------------


def restored(docs: DataFrame, costs: np.ndarray) -> DataFrame:
    """(doc_id, restored): every text with its disguised words restored; null becomes empty."""
    spark = docs.sparkSession
    arrow_limits(spark)
    sent = spark.sparkContext.broadcast(costs)

    def run(batches):
        decoder = Decoder(sent.value)
        for batch in batches:
            texts = pa.array([decoder.text(t.as_py() or "") for t in batch.column("text")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], names=["doc_id", "restored"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, restored string")


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Whole texts are restored and scored; null counts as empty and still gets a
    score; equal texts get equal scores; repeated rows give repeated rows; an
    empty table gives no rows; null ids stay and count as held out; other
    columns are ignored.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        decoder = Decoder(model.costs)
        for batch in batches:
            p = np.array([model.score(words) for words in decoded_words(decoder, batch.column("text"))], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, OUT)


def toxicity_scores(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, threshold: float = THRESHOLD) -> DataFrame:
    """Learn from the labelled documents that are not held out, then score all of them; see ``score``."""
    return score(docs, fit(docs, labels, per_label), threshold)
