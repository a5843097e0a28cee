"""Language identification with error-correcting output codes.

Method: every language gets a codeword of bits; one binary classifier over
hashed byte n-grams predicts each bit; a text belongs to the language whose
codeword loses least against the predicted bits, each bit weighted by how
reliably it was learnt for that language. If the second language loses hardly
more, the text is flagged as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.common import arrow_limits, blocks, held_out, share_of_rows, utf8_view, without_ids

#: Documents learnt from, for each language: the bound of the training sample.
SAMPLE_PER_LANGUAGE = 400
UNDETERMINED = "und"
AMBIGUOUS_BELOW = 0.6
_BIGRAM_BITS, _TRIGRAM_BITS = 12, 13
_WIDTH = (1 << _BIGRAM_BITS) + (1 << _TRIGRAM_BITS)
_DOCS_AT_ONCE = 128
#: Letters keep their bytes, in lower case; digits, punctuation and controls are one blank.
_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)
OUT = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean, second string"


def codewords(n: int) -> np.ndarray:
    """+1/-1 matrix (language, bit): all splits up to five languages, beyond that the best of seeded draws."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 5:
        return np.array([[1.0] * n, *[c for c in product((1.0, -1.0), repeat=n) if c[0] == 1 and -1.0 in c]], np.float32)[1:].T
    bits = max(15, int(np.ceil(10 * np.log2(n))))
    rng, best, far = np.random.default_rng(11), None, -1
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (n, bits)).astype(np.float32)
        if (abs(m.sum(0)) == n).any():
            continue
        apart = (m[:, None] != m[None]).sum(2) + bits * np.eye(n)
        if apart.min() > far:
            best, far = m, apart.min()
    return best


def _features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of n-gram counts, scaled to length 1: (text, hashed n-gram)."""
    out = np.zeros((len(offsets) - 1, _WIDTH), np.float32)
    x = _FOLD[data[offsets[0] : offsets[-1]]].astype(np.uint32)
    o = offsets - offsets[0]
    if len(x) >= 2:
        two = ((x[:-1] << np.uint32(8) | x[1:]) * np.uint32(2654435761)) >> np.uint32(32 - _BIGRAM_BITS)
        three = np.zeros(0, np.uint32)
        if len(x) >= 3:
            three = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(2246822519)
            three = (three ^ three >> np.uint32(15)) * np.uint32(3266489917) >> np.uint32(32 - _TRIGRAM_BITS)
        for i in range(len(out)):
            s, e = o[i], o[i + 1]
            if e - s >= 2:
                out[i, : 1 << _BIGRAM_BITS] = np.bincount(two[s : e - 1], minlength=1 << _BIGRAM_BITS)
            if e - s >= 3:
                out[i, 1 << _BIGRAM_BITS :] = np.bincount(three[s : e - 2], minlength=1 << _TRIGRAM_BITS)
    np.sqrt(out, out=out)
    out /= np.maximum(1e-9, np.sqrt(np.einsum("ij,ij->i", out, out)))[:, None]
    return out


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    codes: np.ndarray  # (language, bit)
    weights: np.ndarray  # (n-gram, bit)
    bias: np.ndarray
    trust: np.ndarray  # (language, bit): how often the bit was right, rows add to 1

    def losses(self, features: np.ndarray) -> np.ndarray:
        margins = features @ self.weights + self.bias
        agree = margins[:, None, :] * self.codes[None]
        return (np.logaddexp(0, -agree) * self.trust[None]).sum(2)

    def decode(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The two nearest languages and the share of belief in the nearest."""
        loss = self.losses(features)
        order = np.argsort(loss, axis=1, kind="stable")
        belief = np.exp(-(loss - loss.min(1, keepdims=True)))
        first = order[:, 0]
        second = order[:, 1] if loss.shape[1] > 1 else first
        return first, second, belief[np.arange(len(first)), first] / belief.sum(1)


def fit(texts: list[bytes], langs: list[str], steps: int = 150, rate: float = 40.0) -> LanguageModel:
    """One logistic classifier for each bit, all by the same gradient steps."""
    names = tuple(sorted(set(langs)))
    codes = codewords(len(names))
    if not names:
        return LanguageModel((), codes, np.zeros((_WIDTH, 1), np.float32), np.zeros(1, np.float32), codes)
    offsets = np.cumsum([0, *map(len, texts)])
    x = _features(np.frombuffer(b"".join(texts), np.uint8), offsets)
    at = np.searchsorted(names, langs)
    y = codes[at]
    share = (1 / np.bincount(at, minlength=len(names))[at] / len(names)).astype(np.float32)[:, None]
    w, b = np.zeros((_WIDTH, codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    for _ in range(steps):
        g = -y * share / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        w -= rate * (x.T @ g + 1e-5 * w)
        b -= rate * 0.05 * g.sum(0)
    right = (np.sign(x @ w + b) == y).astype(np.float64)
    trust = np.array([right[at == i].mean(0) for i in range(len(names))]) + 1e-6
    return LanguageModel(names, codes, w, b, trust / trust.sum(1, keepdims=True) * codes.shape[1])


def training_sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[bytes], list[str]]:
    """About ``per_language`` learnable documents of each language, chosen by a hash, with their whole texts."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return [], []
    chosen = F.lit(False)
    for lang, n in sorted(counts.items()):
        chosen = chosen | ((F.col("lang") == lang) & share_of_rows(per_language, n, F.col("doc_id"), F.col("lang")))
    rows = learn.where(chosen).select("lang", F.col("text").cast("binary").alias("text"), F.xxhash64("doc_id", "lang").alias("h")).collect()
    rows.sort(key=lambda r: (r["lang"], r["h"], bytes(r["text"])))  # the same sums in any order of tasks
    return [bytes(r["text"]) for r in rows], [r["lang"] for r in rows]


def identify(docs: DataFrame, model: LanguageModel, ambiguous_below: float = AMBIGUOUS_BELOW) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous, second.

    ``lang_pred`` is ``und`` (score 0) if the text is null or has no letter, or
    if nothing was learnt. ``ambiguous`` is true where the nearest codeword
    gets less than ``ambiguous_below`` of the belief. Whole texts count; equal
    texts get equal answers; an empty table gives no rows; null ids stay.
    """
    return _decisions(docs, model, ambiguous_below).drop("has_letter")


def _decisions(docs: DataFrame, model: LanguageModel, ambiguous_below: float = AMBIGUOUS_BELOW) -> DataFrame:
    """The columns of ``identify`` and has_letter, which does not depend on the model."""
    spark = docs.sparkSession
    arrow_limits(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            column = batch.column("text")
            data, offsets = utf8_view(column)
            first = np.zeros(len(column), np.int64)
            second, score = np.zeros(len(column), np.int64), np.zeros(len(column))
            if m.languages:
                for i, j in blocks(offsets):
                    for a in range(i, j, _DOCS_AT_ONCE):
                        z = min(a + _DOCS_AT_ONCE, j)
                        first[a:z], second[a:z], score[a:z] = m.decode(_features(data, offsets[a : z + 1]))
            letters = np.array([bool(t) and any(map(str.isalpha, t)) for t in column.to_pylist()], bool)
            known = letters & bool(m.languages)
            names = np.array([*m.languages, UNDETERMINED], object)
            none = len(m.languages)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(names[np.where(known, first, none)].tolist(), pa.string()),
                    pa.array(np.where(known, score, 0.0)),
                    pa.array(~known | (score < ambiguous_below)),
                    pa.array(names[np.where(known, second, none)].tolist(), pa.string()),
                    pa.array(letters),
                ],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous", "second", "has_letter"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"{OUT}, has_letter boolean")


def identify_languages(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Learn from the documents that are not held out, then predict all of them."""
    return identify(docs, fit(*training_sample(docs, per_language)))


def with_language(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """The documents whose text has a letter, with all their columns, whatever their names.

    A language is decided for all of them if any could be learnt, but neither
    it nor a missing model removes a document. Predictions run over (id, text);
    the ids that go are few and are removed by an anti-join. Null and empty
    texts have no letter and go; rows that share an id share a text; null ids
    stay; texts of any length are read whole; an empty table gives no rows.
    """
    gone = _decisions(docs, fit(*training_sample(docs, per_language))).where(~F.col("has_letter"))
    return without_ids(docs, gone.where(F.col("doc_id").isNotNull()).select("doc_id"))
