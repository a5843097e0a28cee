"""Toxicity: held-out labels, planted disguises, and the decoder and language model against plain versions."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cardwatch.llm import queries, toxicity

SCHEMA = "doc_id long, text string, word string, n long, toxic int, copy long, gram int"
INSULTS = ["idiot", "clown", "worthless", "moron", "pathetic"]
DISGUISES = [
    "1d10t", "i d i o t", "idiiiiot", "cl0wn", "c.l.o.w.n", "m0r0n", "moooron", "p@thet1c", "w-o-r-t-h-l-e-s-s", "w0rthless", "!diot", "id\u200biot", "m\u043er\u043en",
]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    syllables = ["the", "an", "re", "ing", "ou", "st", "er", "ble", "ha", "ti", "on", "id", "io", "cl", "ow"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(400)]

    def prose(n):
        return [rng.choice(words) for _ in range(n)]

    rows = []
    for i in range(900):
        text, toxic = prose(rng.randint(5, 60)), int(i % 5 == 0)
        for _ in range(toxic * 3):
            text.insert(rng.randrange(len(text)), rng.choice(INSULTS))
        rows.append((i, " ".join(text).capitalize() + ".", toxic))
    hidden = [(1000 + k, " ".join([*prose(9), *(rng.choice(DISGUISES) for _ in range(3)), *prose(9)]), 1) for k in range(40)]
    return rows, hidden


@pytest.fixture(scope="module")
def tables(spark, corpus):
    rows, hidden = corpus
    docs = spark.createDataFrame([(i, t, "w", 1, 2, 3, 4) for i, t, _ in rows + hidden], SCHEMA)
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id long, quality int, toxic int")
    return docs, labels


@pytest.fixture(scope="module")
def costs(tables):
    return toxicity.fit_language_model(tables[0])


def test_counts_cover_all_texts(tables):
    docs, _ = tables
    want = Counter()
    texts = [r["text"] or "" for r in docs.select("text").collect()]
    for t in texts:
        folded = [27 if b >= 128 else (b | 32) - 96 if chr(b).isalpha() else 0 for b in t.encode()]
        want.update(g for g in zip(*([0, *folded, 0][k:] for k in range(4))) if (0, 0) not in itertools.pairwise(g))
    got = {r["gram"]: r["n"] for r in toxicity.gram_counts(docs).collect()}
    for g, n in want.items():
        code = ((g[0] * 28 + g[1]) * 28 + g[2]) * 28 + g[3]
        assert got[code] >= n and (0 in g or got[code] == n)


def test_language_model_adds_up(costs):
    shares = np.exp(-costs.astype(np.float64)).reshape(-1, 28).sum(1)
    assert np.allclose(shares, 1, atol=1e-4)
    empty = np.exp(-toxicity.language_model(np.zeros(28**4, np.int64)))
    assert np.allclose(empty, 1 / 28)


def test_disguises_are_restored(costs):
    decoder = toxicity.Decoder(costs)
    for disguise in DISGUISES:
        read = decoder.text(f"You {disguise}, really").lower()
        assert any(re.search(rf"\b{w}\b", read) for w in INSULTS), (disguise, read)


def test_plain_text_stays(costs):
    decoder = toxicity.Decoder(costs)
    for text in ["", "The letters of a book, 1984.", "WHAT!! REALLY!", "naïve — 漢字 2023", "a1" * 50]:
        assert decoder.text(text) == text


def test_best_reading_is_the_least_cost(costs):
    """The Viterbi search against all readings."""
    decoder = toxicity.Decoder(costs)
    rng = random.Random(2)

    def cost(options):
        state, total = 0, 0.0
        for letters, extra in [*options, (" ", 0.0)]:
            total += extra
            for x in letters:
                symbol = 0 if x == " " else ord(x) - 96
                if symbol or state % 28:
                    total += decoder.costs[state * 28 + symbol]
                    state = (state * 28 + symbol) % 28**3
        return total

    for _ in range(150):
        stretch = "".join(rng.choice("idot10@5!llss") for _ in range(rng.randint(2, 7)))
        if rng.random() < 0.3:
            stretch = " ".join(stretch[:4])
        readings = list(itertools.product(*toxicity._lattice(stretch)))
        least = min(map(cost, readings))
        found = decoder._viterbi(stretch)
        assert any(math.isclose(cost(r), least, abs_tol=1e-4) and "".join(x for x, _ in r).strip() == found for r in readings)


def test_no_disguise_is_overlooked():
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab1!$ .é\u200bо*") for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += DISGUISES
    column = pa.array(texts)
    data, offsets = toxicity.utf8_view(column)
    seen = toxicity.suspicious(data, offsets)
    for t, s in zip(texts, seen):
        if not s:
            decoder = toxicity.Decoder(np.zeros(28**4, np.float32))
            assert decoder.text(t) == t, t


def test_planted_texts(tables, corpus):
    docs, labels = tables
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    rows, hidden = corpus
    for i, _, toxic in rows + hidden:
        assert got[i]["predicted"] == toxic, got[i]
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == (got[i]["score"] >= 0.5)


def test_held_out_labels(spark, small):
    got = queries.op11_toxicity(spark, small).toPandas()
    labels = spark.read.parquet(f"{small}/labels.parquet").toPandas()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.toxic).mean() > 0.9
    assert not ((held.predicted == 1) & (held.toxic == 0)).any()


def test_awkward_texts(spark, tables):
    docs, labels = tables
    odd = [None, "", " \n", "word " * 30_000, "a " * 30_000, "x" * 300_000, "1a" * 40_000, "1 2 3 4", "é à ü", "same idiot text", "same idiot text"]
    rows = [(None if k == 3 else 2000 + k, t, "w", 1, 2, 3, 4) for k, t in enumerate(odd)]
    rows.append(rows[-1])
    df = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by_text = {}
    for r, (i, t, *_) in zip(sorted(got, key=str), sorted(rows, key=str)):
        by_text.setdefault(i, set()).add(r["score"])
    same = [r["score"] for r in got if r["doc_id"] in (2009, 2010)]
    assert len(same) == 3 and len(set(same)) == 1
    assert [r["restored"] for r in toxicity.restored(df.where("doc_id = 2000"), model.costs).collect()] == [""]
    assert toxicity.score(df.where("false"), model).collect() == []
    assert toxicity.toxicity_scores(df.where("false"), labels).collect() == []
    unlabelled = toxicity.toxicity_scores(df, labels.where("false")).collect()
    assert len(unlabelled) == len(rows) and not any(r["predicted"] for r in unlabelled)
    nulls = labels.withColumn("toxic", F.lit(None).cast("int"))
    assert toxicity.toxicity_scores(docs, nulls).count() == docs.count()
