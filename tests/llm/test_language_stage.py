"""The language stage where no language can be learnt."""

from pyspark.sql import functions as F

import corpus_pipeline
from cardwatch.llm import language
from cardwatch.llm.common import held_out


def test_documents_stay_without_labels(spark, tiny):
    rows = [(1, "some words", "en"), (2, "12 34 !!", "en"), (3, None, None), (4, "漢字", "zh"), (None, "no id", "en"), (5, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    only_held_out = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), F.col("lang")))
    for table in (docs, unlabelled, only_held_out):
        assert {r["doc_id"] for r in stage(spark, table, tiny).collect()} == {1, 4, None}
    assert language.identify_languages(unlabelled).columns == ["doc_id", "held_out", "lang_pred", "score", "ambiguous", "second"]
