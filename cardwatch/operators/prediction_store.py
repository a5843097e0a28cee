"""A predictions store that grows by batches and always knows the newest version of each transaction.

Layout below one shared folder:

``versions/batch_id=...``  the rows of one batch, written once
``headers/batch_id=...``   one row: hash, model, threshold, size, first time stored
``pending/batch_id=...``   batches that are not yet part of the newest table
``newest/g00000007``       the newest version of each transaction, bucketed and sorted by ``trans_num``

Storing a batch reads at most the folder of that batch. ``merge`` joins the
newest table with the pending batches bucket by bucket: the table is already
laid out by key, so only the pending rows are shuffled. Reading the newest
versions is a plain scan. Each step writes into a folder of its own and counts
from the moment its ``_SUCCESS`` file exists; a repeated step changes nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwatch.operators.store import batch_hash, evolve_predictions, insert_new
from cardwatch.operators.versions import keep_first
from cardwatch.schemas import PAYLOAD_TYPES, PREDICTION_BATCHES, PREDICTIONS, RISK_TYPE

BUCKETS = 64
_KEEP_GENERATIONS = 2


class Folder:
    """Existence, listing and removal below a path of any file system Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self._conf), path

    def exists(self, name: str) -> bool:
        system, path = self._at(name)
        return system.exists(path)

    def complete(self, name: str) -> bool:
        return self.exists(f"{name}/_SUCCESS")

    def names(self, name: str = "") -> list[str]:
        system, path = self._at(name)
        return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []

    def mark(self, name: str) -> None:
        system, path = self._at(name)
        system.mkdirs(path)

    def remove(self, name: str) -> None:
        system, path = self._at(name)
        system.delete(path, True)


def _age(created_at: Column, row_id: Column) -> Column:
    """Larger is newer; a missing time or id counts as the newest, as in a descending sort with NULLs first."""
    return F.struct(created_at.isNull(), created_at, row_id.isNull(), row_id)


class PredictionStore:
    """One store; any session may open it again by its folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.files = Folder(spark, self.folder)
        self._name = "newest_" + hashlib.sha256(self.folder.encode()).hexdigest()[:16]

    # --- batches ---------------------------------------------------------------------------

    def persist(self, scored: DataFrame, model: str, threshold: float, created_at=None) -> tuple[str, DataFrame]:
        """Store one scored batch; returns its id and the rows that were not stored before.

        The id is the content hash. Of rows that repeat a transaction within
        the batch the first in the order of the other columns stays, and a
        batch that is stored again stores nothing.
        """
        for c in ("trans_num", "risk_score", "prediction"):
            if c not in scored.columns:
                raise ValueError(f"scored rows need {c}")
        now = F.lit(created_at).cast("timestamp") if created_at is not None else F.current_timestamp()
        payload = [c for c in PAYLOAD_TYPES if c in scored.columns]
        head = batch_hash(scored.select("trans_num", *payload), model, threshold).first()
        batch_id = head["batch_hash"]
        rows = evolve_predictions(
            scored.select(
                F.sha2(F.concat_ws("|", F.lit(batch_id), F.col("trans_num")), 256).alias("id"),
                F.lit(batch_id).alias("batch_id"),
                F.col("trans_num").cast("string").alias("trans_num"),
                *[F.col(c).cast(PAYLOAD_TYPES[c]).alias(c) for c in payload],
                F.col("risk_score").cast(RISK_TYPE).alias("risk_score"),
                F.col("prediction").cast("int").cast("boolean").alias("prediction"),
                now.alias("created_at"),
            )
        ).select(*PREDICTIONS.fieldNames())
        part = f"versions/batch_id={batch_id}"
        if self.files.complete(part):
            stored = self._batch(batch_id)
            fresh = insert_new(stored.select("trans_num"), rows, ["trans_num"])
            if not fresh.isEmpty():  # only if hashes of different batches collide
                fresh.drop("batch_id").write.mode("append").parquet(f"{self.folder}/{part}")
                self.files.mark(f"pending/batch_id={batch_id}")
            return batch_id, fresh
        once = insert_new(self.spark.createDataFrame([], PREDICTIONS), rows, ["batch_id", "trans_num"])
        self.files.mark(f"pending/batch_id={batch_id}")  # before the rows: a lost driver leaves no batch unmerged
        once.drop("batch_id").write.mode("overwrite").parquet(f"{self.folder}/{part}")
        header = self.spark.createDataFrame([(batch_id, model, float(threshold), head["total_transactions"])], "h string, m string, t double, n long")
        header.select(
            F.col("h").alias("id"), F.col("h").alias("batch_hash"), F.col("m").alias("model"),
            F.col("t").cast("decimal(10,4)").alias("threshold"), F.col("n").cast("int").alias("total_transactions"), now.alias("created_at"),
        ).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/headers/batch_id={batch_id}")
        return batch_id, self._batch(batch_id)

    def _batch(self, batch_id: str) -> DataFrame:
        schema = T.StructType([f for f in PREDICTIONS.fields if f.name != "batch_id"])
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/versions/batch_id={batch_id}")
        return rows.withColumn("batch_id", F.lit(batch_id)).select(*PREDICTIONS.fieldNames())

    def versions(self) -> DataFrame:
        """All stored rows; a filter on ``batch_id`` reads only that batch."""
        if not self.files.names("versions"):
            return self.spark.createDataFrame([], PREDICTIONS)
        return self.spark.read.schema(PREDICTIONS).parquet(f"{self.folder}/versions").select(*PREDICTIONS.fieldNames())

    def batches(self) -> DataFrame:
        """One row per stored batch."""
        if not self.files.names("headers"):
            return self.spark.createDataFrame([], PREDICTION_BATCHES)
        return self.spark.read.schema(PREDICTION_BATCHES).parquet(f"{self.folder}/headers").select(*PREDICTION_BATCHES.fieldNames())

    # --- newest versions ---------------------------------------------------------------------

    def pending(self) -> list[str]:
        """Batches that were stored since the last merge."""
        return [n.removeprefix("batch_id=") for n in self.files.names("pending")]

    def _generation(self) -> int:
        """The latest complete generation of the newest table, 0 for none."""
        done = [n for n in self.files.names("newest") if self.files.complete(f"newest/{n}")]
        return max((int(n[1:]) for n in done), default=0)

    def _table(self, generation: int) -> DataFrame:
        """One generation with its layout, through the catalogue of this session."""
        name = f"{self._name}_{generation}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in PREDICTIONS.fields)
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (trans_num) SORTED BY (trans_num)"
                f" INTO {self.buckets} BUCKETS LOCATION '{self.folder}/newest/g{generation:08d}'"
            )
        return self.spark.table(name)

    def merging(self) -> DataFrame:
        """The newest table with all pending batches merged in, as a plan; rows without a ``trans_num`` are left out."""
        pending = [b for b in self.pending() if self.files.complete(f"versions/batch_id={b}")]
        generation = self._generation()
        added = self.versions().where(F.col("batch_id").isin(pending) & F.col("trans_num").isNotNull())
        if len(pending) > 1:  # within one batch ids are unique
            added = keep_first(added, ["trans_num"], [F.col(c).desc_nulls_first() for c in ("created_at", "id")])
        if not generation:
            return added.repartition(self.buckets, "trans_num")
        old, new = self._table(generation).alias("o"), added.alias("n")
        joined = old.join(new, F.col("o.trans_num") == F.col("n.trans_num"), "full_outer")
        newer = F.col("n.trans_num").isNotNull() & (
            F.col("o.trans_num").isNull()
            | (_age(F.col("n.created_at"), F.col("n.id")) > _age(F.col("o.created_at"), F.col("o.id")))
        )
        return joined.select(*[F.when(newer, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in PREDICTIONS.fieldNames()])

    def merge(self) -> None:
        """Write the next generation of the newest table; without pending batches nothing happens."""
        pending = [b for b in self.pending() if self.files.complete(f"versions/batch_id={b}")]
        if not pending:
            return
        generation = self._generation() + 1
        name, path = f"{self._name}_{generation}", f"newest/g{generation:08d}"
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.files.remove(path)  # what a lost driver may have left
        try:
            writer = self.merging().write.format("parquet").bucketBy(self.buckets, "trans_num").sortBy("trans_num")
            writer.option("path", f"{self.folder}/{path}").saveAsTable(name)
        finally:  # the files stay: the tables lie outside the warehouse
            for g in (generation - 1, generation):
                self.spark.sql(f"DROP TABLE IF EXISTS {self._name}_{g}")
        for batch_id in pending:
            self.files.remove(f"pending/batch_id={batch_id}")
        for old in range(1, generation - _KEEP_GENERATIONS + 1):
            self.files.remove(f"newest/g{old:08d}")

    def newest(self) -> DataFrame:
        """The newest version of each transaction as of the last merge: a plain scan."""
        generation = self._generation()
        if not generation:
            return self.spark.createDataFrame([], PREDICTIONS)
        return self.spark.read.schema(PREDICTIONS).parquet(f"{self.folder}/newest/g{generation:08d}")
