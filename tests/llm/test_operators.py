"""The corpus operators against brute force, on the small tables and on a table of awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cardwatch.llm import exact_dedup, fingerprint, language, mixing, near_dedup, packing, quality, queries, sharding, suffix_dedup, tokens
from cardwatch.llm.common import Workspace
from cardwatch.llm.components import components

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, size long, shard int, bucket long"
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark, rows):
    """Rows (id, text, source) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, 1, 7, 7, 7, 7) for i, t, s in rows], SCHEMA)


LONG = " ".join(f"w{k * 7919 % 977}" for k in range(6000))
AWKWARD = [
    (1, "", "a"), (2, None, None), (3, "one two", "a"), (4, "One  two", "b"), (5, " \t\n", "a"), (6, LONG, "a"),
    (7, LONG, "b"), (8, LONG[:-1] + "x", "a"), (9, "12 34 !!", "a"), (10, "été naïve — 漢字 \x1f end", "b"),
    (11, "x" * 5000, "a"), (12, "ab" * 300, "a"), (13, "say <|endoftext|> now", "a"), (None, "no id at all here", "a"), (15, "one two", "a"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return documents(spark, AWKWARD)


@pytest.fixture(scope="module")
def nothing(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


def rows(df):
    return [r.asDict() for r in df.collect()]


def by_id(df):
    return {r["doc_id"]: r for r in rows(df)}


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").orderBy("doc_id").collect()]


def test_shards(spark, docs, awkward, nothing):
    for df, n in ((docs, 24), (awkward, 3), (awkward, 1)):
        got = rows(sharding.shard_by_bytes(df, n))
        want = {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts(df)}
        assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == want
        slots, order = defaultdict(list), sorted(got, key=lambda r: (-1 if r["doc_id"] is None else r["doc_id"]))
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert [r["shard"] for r in order] == sorted(r["shard"] for r in order)
        target, largest = sum(r["size"] for r in got) / n, max(r["size"] for r in got)
        sums = Counter()
        for r in got:
            sums[r["shard"]] += r["size"]
        assert all(abs(s - target) <= largest for s in sums.values())
    assert rows(sharding.shard_by_bytes(nothing)) == []
    with pytest.raises(ValueError):
        sharding.shard_by_bytes(docs, 0)


def shingles(text):
    words = [w for w in re.split(SPACE, re.sub("[A-Z]", lambda m: m.group().lower(), text)) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(items, percent=75):
    sets = {i: shingles(t) for i, t in items}
    root = {i: i for i in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    inside = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inside[x].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in inside[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates(spark, docs, awkward, nothing):
    rng = random.Random(2)
    base = [f"v{rng.randrange(400)}" for _ in range(120)]
    near = []
    for i in range(230):  # one family over several blocks, most pairs close to the limit
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        near.append((100 + i, " ".join(w), "a"))
    for df in (docs, awkward, documents(spark, near)):
        got = by_id(near_dedup.near_duplicates(df))
        for i, (n, component) in brute_components([x for x in texts(df) if x[0] is not None]).items():
            assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, component, i == component)
    lost = by_id(near_dedup.near_duplicates(awkward))[None]
    assert lost["kept"] and lost["component_id"] is None
    assert rows(near_dedup.near_duplicates(nothing)) == []
    kept = near_dedup.without_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 5, 6, 9, 10, 11, 12, 13, None}


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 5000):
        s = near_dedup.sketch(rng.integers(0, 1 << 62, n).astype(np.uint64))
        assert (s != near_dedup._EMPTY).all()
    pool = rng.integers(0, 1 << 62, 600).astype(np.uint64)
    hits = [np.mean(near_dedup.sketch(np.sort(p[:400])) == near_dedup.sketch(np.sort(p[100:500]))) for p in (rng.permutation(pool) for _ in range(40))]
    assert abs(np.mean(hits) - 0.6) < 0.03


def test_components_of_a_path(spark):
    links = spark.range(1, 60).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = components(links, Workspace(spark, "path"), "c").collect()
    assert {r["id"] for r in got} == set(range(1, 61)) and {r["root"] for r in got} == {1}


def test_exact_duplicates(spark, docs, awkward, nothing):
    for df in (docs, awkward):
        groups = defaultdict(list)
        for i, t in texts(df):
            groups[hashlib.sha256(re.sub(SPACE, " ", t).encode()).hexdigest()].append(i)
        got = by_id(exact_dedup.exact_duplicates(df))
        for digest, ids in groups.items():
            keep = min((i for i in ids if i is not None), default=None)
            for i in ids:
                r = got[i]
                assert (r["text_sha256"], r["group_size"], r["keep_id"], r["kept"]) == (digest, len(ids), keep, i == keep)
    assert rows(exact_dedup.exact_duplicates(nothing)) == []
    assert exact_dedup.without_exact_duplicates(awkward).columns == awkward.columns


def test_digest_index_keeps_earlier_batches(spark):
    work = Workspace(spark, "index")
    index = exact_dedup.DigestIndex(spark, f"index_{work.folder[-12:]}", f"{work.folder}/index", 3)
    first, second = documents(spark, [(5, "a", "x"), (6, "b", "x")]), documents(spark, [(1, "a", "x"), (2, "c", "x"), (3, "c", "x")])
    exact_dedup.exact_duplicates(first, index).collect()
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in rows(exact_dedup.exact_duplicates(second, index))}
    assert got == {1: (5, False), 2: (2, True), 3: (2, False)}
    index.add(exact_dedup.digests(second))
    assert index.read().count() == 3


def test_quality(spark, small, awkward, nothing):
    net_scores = queries.op4_quality_classifier(spark, small).toPandas()
    labels = spark.read.parquet(f"{small}/labels.parquet").toPandas()
    held = net_scores[net_scores.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.9
    assert (net_scores.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in net_scores.doc_id]).all()
    labels = spark.createDataFrame([(3, 1), (6, 0), (7, 1), (8, None), (None, 1), (11, 0)], "doc_id long, quality int")
    got = rows(quality.quality_scores(awkward, labels))
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert rows(quality.quality_scores(nothing, labels)) == [] and len(rows(quality.quality_scores(awkward, labels.where("false")))) == len(AWKWARD)


def test_languages(spark, small, awkward, nothing):
    got = queries.op5_language_id(spark, small).toPandas()
    truth = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang").toPandas()
    held = got[got.held_out].merge(truth, on="doc_id")
    assert (held.lang == held.lang_pred).mean() > 0.97
    odd = by_id(language.identify_languages(awkward))
    assert {i for i, r in odd.items() if r["lang_pred"] == "und"} == {1, 2, 5, 9}
    assert rows(language.identify_languages(nothing)) == []
    assert set(r["lang_pred"] for r in rows(language.identify_languages(awkward.withColumn("lang", F.lit(None).cast("string"))))) == {"und"}
    assert {r["doc_id"] for r in language.with_language(awkward).collect()} == {3, 4, 6, 7, 8, 10, 11, 12, 13, None, 15}


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9):
        m = language.codewords(n)
        assert m.shape[0] == n and min((m[i] != m[j]).sum() for i in range(n) for j in range(i)) >= max(1, m.shape[1] // 4)


def test_token_counts(spark, docs, awkward, nothing):
    library = Tokenizer.from_file(PATH)
    for df in (docs, awkward):
        got = by_id(tokens.token_counts(df, PATH))
        for i, t in texts(df):
            n = len(library.encode(t, add_special_tokens=False).ids)
            assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len(t.encode()), n > 1024)
            if n > 1024:
                head = t.encode()[: got[i]["bytes_within_limit"]].decode()
                assert len(library.encode(head, add_special_tokens=False).ids) <= 1024
    assert rows(tokens.token_counts(nothing, PATH)) == []


def test_every_prefix_has_its_count():
    library, counter = Tokenizer.from_file(PATH), tokens.PrefixCounter(PATH)
    rng = random.Random(4)
    samples = ["it's we'll 'll x''s  a\n\n b\t c  ", "naïve — 漢字 ²³ ½", "a <|endoftext|> b", "====== 1234567 ..."]
    samples += ["".join(rng.choice(" \n'stllreé1a-,") for _ in range(60)) for _ in range(60)]
    for t in samples:
        want = [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
        assert counter.prefix_counts(t).tolist() == want, t


def test_fingerprints(spark, docs, awkward, nothing):
    for df in (docs, awkward):
        got = by_id(fingerprint.fingerprints(df))
        order = texts(df)
        errors = []
        for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
            q = len(t) // 4
            edited = t[: len(t) - q] + following[:q]
            r = got[i]
            assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            a, b = (Counter(w for w in re.split(SPACE, x) if w) for x in (t, edited))
            union = sum((a | b).values())
            errors.append(r["near_edited"] - (sum((a & b).values()) / union if union else 1))
        assert abs(np.mean(errors)) < 0.06 and np.std(errors) < 0.15
    same = by_id(fingerprint.fingerprints(awkward))
    assert same[6]["fingerprint"] == same[7]["fingerprint"] and same[3]["fingerprint"] == same[15]["fingerprint"]
    assert same[1]["near_next"] == 1.0 and same[2]["near_next"] == 0.0
    assert rows(fingerprint.fingerprints(nothing)) == []


def check_packing(df):
    library = Tokenizer.from_file(PATH)
    got = rows(packing.pack(df, PATH))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in texts(df):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(-(-len(ids) // 1024)))
        assert all(r["length"] == 1024 for r in pieces[1:]) and sum(r["length"] for r in pieces) == len(ids)
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]])
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by_sequence), sum(r["length"] for r in got)


def test_packing(spark, docs, awkward, nothing):
    sequences, total = check_packing(docs)
    assert sequences <= -(-total // 1024) * 1.02 + 1
    check_packing(awkward)
    assert rows(packing.pack(nothing, PATH)) == []
    ids = packing.sequences(docs, PATH).collect()
    assert len(ids) == sequences and sum(len(r["ids"]) for r in ids) == total


def test_two_replace_the_smallest():
    filled = packing.fillings({60: 1, 30: 1, 20: 2, 19: 1}, 100)
    assert filled[0] == (1, [60, 20, 20])
    counts = Counter()
    for often, lengths in packing.fillings({7: 50, 5: 90, 3: 11}, 16):
        assert sum(lengths) <= 16
        for n in lengths:
            counts[n] += often
    assert counts == {7: 50, 5: 90, 3: 11}


def test_every_slot_keeps_within_one_block():
    for weights in ({"a": 1}, {"a": 3, "b": 2, "c": 7}, {"a": 50, **{f"s{k}": 1 for k in range(50)}}, {"a": 97, "b": 89, "c": 1}):
        slots, period = mixing.pattern(weights), sum(weights.values())
        assert sorted(x for s in slots.values() for x in s) == list(range(period))
        for s, w in weights.items():
            done = np.searchsorted(slots[s], np.arange(period), side="right")
            assert (abs(done - (np.arange(period) + 1) * w / period) < 1).all()


def test_mixing(spark, docs, awkward, nothing):
    for df, weights, block in ((docs, None, 4096), (awkward, {"a": 3, "b": 1, "": 2}, 512)):
        got = rows(mixing.interleave(df, weights, block))
        assert len(got) == df.count()
        assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
        owner = {}
        for r in got:
            assert owner.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])
        for source in {r["source"] for r in got}:
            own = sorted((r for r in got if r["source"] == source), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
            before = 0
            for r in own:
                assert (r["block"], r["place"]) == divmod(before, block)
                before += r["size"]
    with pytest.raises(ValueError):
        mixing.interleave(awkward, {"a": 1})
    assert rows(mixing.interleave(nothing)) == []
    ordered = mixing.mixed(awkward, {"a": 3, "b": 1, "": 2}, 512)
    assert ordered.columns == awkward.columns and ordered.count() == len(AWKWARD)


def brute_removed(items, length):
    seen, out = set(), {}
    for i, t in items:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("group_runs", [256, 2])
def test_repeats(spark, docs, awkward, nothing, group_runs):
    line = "".join(random.Random(9).choice("abcdefgh ij") for _ in range(150))
    shared = [(k, f"{k * 7919} front {line} back {k * 104729}" * (1 + k % 2), "a") for k in range(40)]
    for df in (docs, awkward, documents(spark, shared)):
        got = by_id(suffix_dedup.repeats_removed(df, group_runs=group_runs))
        for i, want in brute_removed([x for x in texts(df) if x[0] is not None], 100).items():
            assert tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == want
    assert rows(suffix_dedup.repeats_removed(nothing)) == []


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(150):
        x = bytes(rng.choice(b"\x00ab\xff") if rng.random() < 0.8 else 97 for _ in range(rng.randint(1, 150)))
        a = np.frombuffer(x, np.uint8)
        want = sorted(range(len(x)), key=lambda i: x[i:])
        order = suffix_dedup.suffix_array(a, 300)
        assert order.tolist() == want
        n = rng.choice([3, 8, 11])
        pairs = [x[i : i + n] == x[j : j + n] and i + n <= len(x) and j + n <= len(x) for i, j in zip(want, want[1:])]
        assert suffix_dedup.same_prefix(a, order, n).tolist() == pairs


def test_rows_that_repeat(spark):
    twice = documents(spark, [(1, LONG, "a"), (1, LONG, "a"), (2, "a few plain words here", "b")])
    assert sharding.shard_by_bytes(twice, 2).count() == 3
    assert [r["component_id"] for r in rows(near_dedup.near_duplicates(twice).orderBy("doc_id"))] == [1, 1, 2]
    assert [r["keep_id"] for r in rows(exact_dedup.exact_duplicates(twice).orderBy("doc_id"))] == [1, 1, 2]
    assert fingerprint.fingerprints(twice).count() == 3 and mixing.interleave(twice).count() == 3
    assert packing.pack(twice, PATH).where("doc_id = 2").count() == 1
    assert {r["n_removed"] for r in rows(suffix_dedup.repeats_removed(twice)) if r["doc_id"] == 1} == {brute_removed([(1, LONG)], 100)[1][1]}
    assert tokens.token_counts(twice, PATH).count() == 3


def test_tokens_stay_apart_as_in_the_plain_encoder():
    counter = tokens.PrefixCounter(PATH)
    rng, names = random.Random(9), sorted(counter.ids)
    back = {i: t for t, i in counter.ids.items()}

    def encoded(data):
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            ranks = [(counter.ids.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            if not ranks or (low := min(ranks))[0] == 1 << 30:
                return [counter.ids[p] for p in parts]
            parts[low[1] : low[1] + 2] = [parts[low[1]] + parts[low[1] + 1]]

    pairs = [(counter.ids[rng.choice(names)], counter.ids[rng.choice(names)]) for _ in range(1_500)]
    pairs += [(a, b) for m in rng.sample(sorted(counter.halves), 300) for a, b in [counter.halves[m]]]
    for word in rng.sample(names, 1_500):  # every way to cut a token in two known ones
        pairs += [(counter.ids[word[:k]], counter.ids[word[k:]]) for k in range(1, len(word)) if word[:k] in counter.ids and word[k:] in counter.ids]
    for a, b in pairs:
        assert counter._no_merge_across(a, b) == (encoded(back[a] + back[b]) == [a, b]), (back[a], back[b])
