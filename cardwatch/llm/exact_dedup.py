"""Exact duplicates through a persistent index of digests.

Method: the index is a table bucketed and sorted by digest. New documents are
reduced to one row per digest, compared with the index by a sort-merge
anti-join, and what is new is appended to it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch.llm.common import SPACES, Workspace, join_groups, text_or_empty, without_ids

INDEX_COLUMNS = "digest binary, keep_id long"


def normalised(text_col: str = "text") -> Column:
    """The text with every run of white space replaced by one space; null is empty."""
    return F.regexp_replace(text_or_empty(text_col), SPACES, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(normalised(text_col).cast("binary"), 256)).alias("digest"),
    )


class DigestIndex:
    """(digest, keep_id) of every text seen so far, in ``buckets`` sorted buckets."""

    def __init__(self, spark: SparkSession, table: str, path: str, buckets: int):
        self.spark, self.table, self.path, self.buckets = spark, table, path, buckets
        if not spark.catalog.tableExists(table):
            self._append(spark.createDataFrame([], INDEX_COLUMNS))

    def _append(self, rows: DataFrame) -> None:
        (
            rows.select("digest", "keep_id")
            .write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .mode("append")
            .format("parquet")
            .saveAsTable(self.table)
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, digests: DataFrame) -> None:
        """Append the digests not yet present, each with its smallest document id."""
        batch = digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
        # The index side is read bucket by bucket, without a shuffle; a repeated batch adds nothing.
        new = batch.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        self._append(new.repartition(self.buckets, "digest"))


def exact_duplicates(
    docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    With an ``index`` of earlier batches ``keep_id`` may be an earlier
    document; without one a fresh index is made, and the smallest id of equal
    texts stays. ``group_size`` counts the rows of this batch.

    A null text equals an empty one. Null ids lose against any id; if all ids
    of a group are null, ``keep_id`` is null and the rows are kept. Rows that
    repeat both id and text are one document and share its decision. An empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "exact-dedup")
    found = work.write(digests(docs, id_col, text_col), "digests")
    if index is None:
        name = f"digest_index_{uuid.uuid4().hex[:12]}"
        buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        index = DigestIndex(spark, name, f"{work.folder}/index", buckets)
    index.add(found)
    sizes = found.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = work.write(sizes.join(index.read().hint("merge"), "digest"), "groups")
    # A digest with very many copies is not shuffled.
    return join_groups(found, groups, "digest", "group_size").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns, whatever their names.

    Of equal texts (null is an empty text) the smallest id stays. Ids are taken
    to be unique: rows that share id and text stay together. Null ids are kept;
    texts may have any length; an empty table gives no rows.
    """
    dropped = exact_duplicates(docs, None, id_col, text_col).where(~F.col("kept") & F.col("doc_id").isNotNull())
    # Written first: an aggregate or join above would keep a digest with very many copies from being split.
    dropped = Workspace(docs.sparkSession, "exact-dropped").write(dropped.select("doc_id"), "ids")
    return without_ids(docs, dropped, id_col)
