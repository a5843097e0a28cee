"""Any text and any column: very long runs, words made to collide, columns that clash with names used inside."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cardwatch.llm import near_dedup, packing, quality, tokens
from cardwatch.llm.common import word_hashes

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["__gone", "__id", "__at", "__GONE_", "id", "root", "digest", "slot", "place", "part", "bucket", "size", "source_"]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_made_to_collide(spark):
    one = thue_morse(4096)
    other = one.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((one + other).encode(), np.uint8)
    a, b = word_hashes(data, np.array([0, 4096]), np.array([4096, 8192]))
    assert a != b
    docs = spark.createDataFrame([(1, one, "en", "a", 1), (2, other, "en", "a", 1), (3, one, "en", "a", 1)], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_equal_words_hash_alike_anywhere():
    text = b"aa b aa  ccc b aa"
    data = np.frombuffer(text, np.uint8)
    spans = [(0, 2), (3, 4), (5, 7), (9, 12), (13, 14), (15, 17)]
    h = word_hashes(data, np.array([s for s, _ in spans]), np.array([z for _, z in spans]))
    assert h[0] == h[2] == h[5] and h[1] == h[4] and len(set(h.tolist())) == 3


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" + "\n" * 1_000_000 + "b", "x" * 1_000_000], ids=["spaces", "lines", "word"])
def test_very_long_runs(spark, text):
    docs = spark.createDataFrame([(1, text, "en", "a", 1)], SCHEMA)
    n = len(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids)
    assert tokens.token_counts(docs, PATH).first()["n_tokens"] == n
    rows = packing.pack(docs, PATH).collect()
    assert sum(r["length"] for r in rows) == n + 1


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_clashing_columns(spark, tiny, name, stage):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").where("doc_id < 60")
    wide = docs.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)})
    plain, got = stage(spark, docs, tiny), stage(spark, wide, tiny)
    if name != "packing":
        assert got.columns == wide.columns
    keys = [c for c in plain.columns if c in ("doc_id", "piece", "text")]
    assert sorted(map(str, got.select(*keys).collect())) == sorted(map(str, plain.select(*keys).collect()))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_and_empty_tables(spark, tiny, name, stage):
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t", "en", "a", 2), (None, "words without an id", "en", None, 4),
        (5, "a text that comes twice here", "en", "a", 3), (5, "a text that comes twice here", "en", "a", 3),
        (6, "word " * 50_000, "en", "b", 9), (7, "x" * 200_000, None, "b", 9),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = stage(spark, docs, tiny)
    ids = [r["doc_id"] for r in got.select("doc_id").collect()]
    assert {None, 5, 6, 7} <= set(ids) and (name == "packing" or ids.count(5) == 2)
    assert stage(spark, docs.where("false"), tiny).count() == 0


def test_whole_texts_are_learnt_from(spark):
    """What decides the label stands at the end of texts of 60 chunks."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(240):
        prose = " ".join(rng.choice(["the", "of", "and", "to", "in"], 7000))
        rows.append((i, prose + (" ZZQQ##ZZQQ##ZZQQ##" if i % 2 else " and of the same"), "en", "a", i % 2))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(y)) for i, *_, y in rows], "doc_id long, quality int")
    texts, _ = quality.training_sample(docs, labels)
    assert {sum(map(len, t)) for t in texts} <= {len(r[1].encode()) for r in rows} and min(map(len, texts)) > 40
    got = {r["doc_id"]: r["predicted"] for r in quality.quality_scores(docs, labels).collect()}
    assert np.mean([got[i] == i % 2 for i in got]) > 0.9
