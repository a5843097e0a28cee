"""The order of the mix decides how the pipeline packs."""

from collections import defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cardwatch.llm import mixing, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def two_sources(spark):
    """60 documents of a block or more, half of each source, of few different lengths."""
    rows = [(i, " ".join([f"w{i % 7}"] * (40_000 if i % 5 else 25_000)), "ab"[i % 2]) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").cache()


def key(r):
    return tuple((x is not None, x or 0) for x in (r["doc_id"], r["piece"], r["start"], r["ids_crc32"]))


@pytest.mark.parametrize("weights", [{"a": 1, "b": 9}, {"a": 9, "b": 1}])
def test_dealt_and_numbered_in_order(spark, two_sources, weights):
    order = mixing.interleave(two_sources, weights)
    place = {r["doc_id"]: (r["slot"], r["place"]) for r in order.collect()}
    plain, got = packing.pack(two_sources, PATH).collect(), packing.pack(two_sources, PATH, order=order).collect()
    assert sorted(key(r) for r in plain) == sorted(key(r) for r in got)
    counts = defaultdict(int)
    for r in got:
        counts[r["length"]] += 1
    lots = {x["length"]: x["lots"] for x in packing.allotments(packing.fillings(counts, packing.CAPACITY))}
    by_length, wanted, first = defaultdict(list), {}, {}
    for r in got:
        by_length[r["length"]].append((place[r["doc_id"]], key(r)))
    for length, found in by_length.items():
        for rank, (at, k) in enumerate(sorted(found)):
            lot = [x for x in lots[length] if x["first"] <= rank][-1]
            turn, copy = divmod(rank - lot["first"], lot["copies"])
            wanted[k] = (lot["sequence"] + turn, lot["offset"] + copy * length)
            first[wanted[k][0]] = min(first.get(wanted[k][0], (at, k)), (at, k))
    number = {s: n for n, s in enumerate(sorted(first, key=first.get))}
    assert {key(r): (r["sequence_id"], r["offset"]) for r in got} == {k: (number[s], o) for k, (s, o) in wanted.items()}


def test_repeated_missing_and_unplaced_ids(spark):
    docs = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (3, "z")], "doc_id long, text string")
    order = spark.createDataFrame([(1, 5, 0), (1, 2, 0), (None, 3, 0)], "doc_id long, slot long, place long")
    got = packing.pack(docs, PATH, capacity=2, order=order).orderBy("sequence_id").collect()
    assert [(r["doc_id"], r["sequence_id"], r["offset"]) for r in got] == [(1, 0, 0), (1, 1, 0), (None, 2, 0), (3, 3, 0)]
    assert packing.pack(docs.limit(0), PATH, order=order.limit(0)).collect() == []


def test_weights_reach_the_result_of_the_pipeline(spark, two_sources, tmp_path, monkeypatch):
    texts = two_sources.withColumn("text", F.concat(F.col("doc_id").cast("string"), F.lit(" is the number "), F.substring("text", 1, 70_000)))
    share = {}
    for weights in ({"a": 1, "b": 9}, {"a": 9, "b": 1}):
        monkeypatch.setattr(corpus_pipeline, "WEIGHTS", weights)
        stages = dict(corpus_pipeline.STAGES)
        folder = str(tmp_path / f"mixed-{weights['a']}")
        stages["mixing"](spark, texts, str(tmp_path)).write.parquet(folder)
        docs = spark.read.parquet(folder)
        got = stages["packing"](spark, docs, str(tmp_path))
        early = got.where("sequence_id < 200").join(docs.select("doc_id", "source"), "doc_id")
        share[weights["a"]] = early.agg(F.avg((F.col("source") == "a").cast("int"))).first()[0]
    assert share[1] < 0.25 and share[9] > 0.75
