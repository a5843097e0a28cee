"""The pipeline stage by stage against brute force."""

import re

import corpus_pipeline
from test_operators import brute_components, check_packing, texts


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    before = texts(docs)
    kept = [x for x in before if any(map(str.isalpha, x[1]))]
    seen, exact = set(), []
    for i, t in kept:
        if (n := re.sub(r"[\x20\x09-\x0D]+", " ", t)) not in seen:
            seen.add(n)
            exact.append((i, t))
    root = brute_components(exact)
    near = [(i, t) for i, t in exact if root[i][1] == i]
    wanted = [kept, exact, near, near]
    for (name, stage), want in zip(corpus_pipeline.STAGES, wanted):
        out = stage(spark, docs, tiny)
        assert out.columns == docs.columns, name
        assert texts(out) == want, name
        docs = out.cache()
    sequences, total = check_packing(docs)
    assert sequences <= -(-total // 1024) * 1.02 + 1


def test_run(spark, tiny):
    assert corpus_pipeline.run(spark, tiny).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
