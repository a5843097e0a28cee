"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from cardwatch.llm import periodic_runs, queries

SCHEMA = "doc_id long, text string, start long, length long, period long, words string"


def brute_runs(words, least=6, periods=4):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            z = i
            while z < n and words[z] == words[z - q]:
                z += 1
            stretch = (i - q, z - i + q)
            if stretch[1] >= max(least, periods * q):
                found.setdefault(stretch, q)  # a smaller period of the same stretch came first
            i = z
    return sorted((a, n, q) for (a, n), q in found.items())


def brute_report(doc_id, text, tails=True):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if tails and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    first = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    exponent = 1000 * first[1] // first[2] if runs else None
    return (len(runs), *first, exponent, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, left)))


def test_every_run_is_found():
    rng = random.Random(3)
    for k in range(1500):
        letters = rng.choice([1, 2, 2, 3, 5])
        words = [rng.randrange(letters) for _ in range(rng.randrange(1, 40))]
        for _ in range(rng.randrange(3)):
            a = rng.randrange(len(words))
            words += words[a : a + rng.randrange(1, 6)] * rng.randrange(1, 7)
        assert sorted(set(periodic_runs.squares_to_runs(words))) == brute_runs(words, 2, 2), words
        assert len(periodic_runs.squares_to_runs(words)) == len(brute_runs(words, 2, 2))
        assert periodic_runs.periodic_runs(np.array(words)) == brute_runs(words), words


def test_classic_words():
    fibonacci = [0, 1]
    while len(fibonacci) < 300:
        fibonacci = fibonacci + fibonacci[: len(fibonacci) * 2 // 3]
    thue_morse = [bin(i).count("1") % 2 for i in range(256)]
    for words in (fibonacci, thue_morse, [7] * 200, [1, 2] * 100 + [1], [1, 2, 3] * 3):
        assert sorted(periodic_runs.squares_to_runs(words)) == brute_runs(words, 2, 2)


def awkward():
    rng = random.Random(8)
    texts = [None, "", " \t\n", "one", "a a a a a", "a a a a a a", "A a a a a a\x0ba", "x y x y x y x", "x y x y x y x y z", "ä\x1fä ä b é é é é é é"]
    texts += [" ".join(rng.choice("ab") for _ in range(60)) for _ in range(60)]
    texts += [" ".join(f"w{rng.randrange(9)}" for _ in range(30)) + " l1 l2 l3" * rng.randrange(9) for _ in range(40)]
    texts += [" ".join(f"w{k * 7919 % 977}" for k in range(6000)), "y " * 30_000, "z" * 300_000]
    return [(None if k == 7 else k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("tails", [True, False])
def test_report(spark, tails):
    rows = awkward()
    df = spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in [*rows, rows[5]]], SCHEMA)
    got = sorted((tuple(r) for r in periodic_runs.run_report(df, tails).collect()), key=str)
    long_ones = {"y " * 30_000}  # quadratic for the plain search: known answer
    want = []
    for i, t in [*rows, rows[5]]:
        if t in long_ones:
            text = " ".join(["y"] * 30_000)
            one = ("0,30000,1\n", "y")
            want.append((i, 1, 0, 30_000, 1, 30_000_000, *(hashlib.sha256(x.encode()).hexdigest() for x in one)))
            assert text.split() == t.split()
        else:
            want.append((i, *brute_report(i, t, tails)))
    assert got == sorted(want, key=str)
    assert periodic_runs.run_report(df.where("false")).collect() == []


def test_listed_runs(spark):
    df = spark.createDataFrame([(1, "s " + "a b " * 5 + "a e", 1, 2, 3, "x"), (2, None, 1, 2, 3, "x")], SCHEMA)
    assert [tuple(r) for r in periodic_runs.runs(df).collect()] == [(1, 1, 11, 2, ["a", "b"])]


def test_query(spark, tiny):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, tiny).collect()}
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    short = [(r["doc_id"], r["text"]) for r in docs if len((r["text"] or "").split()) < 1500]
    assert len(got) == len(docs) and len(short) > 150
    for i, t in short:
        assert got[i] == brute_report(i, t)
