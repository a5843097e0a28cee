"""The predictions store: schema growth, backfill and idempotent batches.

Every function returns the new table; the caller decides where to write it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.operators.versions import dedupe_first
from cardwatch.schemas import PAYLOAD_TYPES, RISK_TYPE, STORED_NAMES

HASH_WORDS = 4
WORD_HEX = 15


def evolve_predictions(df: DataFrame) -> DataFrame:
    """Add the payload columns an older predictions table lacks."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in PAYLOAD_TYPES.items() if c not in df.columns})


def backfill_predictions(pred: DataFrame, tx: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Overwrite the payload of predictions whose transaction is known.

    Transactions are reduced to one row per id first: a repeated id would
    otherwise multiply predictions. ``order_by`` declares which row wins.
    """
    pred = evolve_predictions(pred)
    present = [c for c in PAYLOAD_TYPES if STORED_NAMES.get(c, c) in tx.columns or c in tx.columns]

    def stored(c: str) -> str:
        return STORED_NAMES[c] if STORED_NAMES.get(c) in tx.columns else c

    one = dedupe_first(tx, "trans_num", order_by or [stored(c) for c in present])
    known = one.select(
        F.col("trans_num").alias("__id"), *[F.col(stored(c)).cast(PAYLOAD_TYPES[c]).alias(f"__{c}") for c in present]
    )
    joined = pred.join(known, F.col("trans_num") == F.col("__id"), "left")
    matched = F.col("__id").isNotNull()
    filled = {c: F.when(matched, F.col(f"__{c}")).otherwise(F.col(c)) for c in present}
    return joined.withColumns(filled).select(*pred.columns)


def batch_hash(df: DataFrame, model: str, threshold: float, by: list[str] = ()) -> DataFrame:
    """Content hash of each batch, independent of row order.

    Rows are hashed one by one and the hashes are *added* word by word, a
    multiset hash whose state is four numbers; collecting and sorting the
    batch would put it into one task. The model name and the rounded threshold
    are part of the final digest, scores are not.
    """
    by = list(by)
    content = [c for c in sorted(df.columns) if c not in by and c not in ("risk_score", "prediction")]
    # Each value is tagged as given or NULL, so a NULL and an empty text differ.
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in content]
    hashed = df.withColumn("__h", F.sha2(F.concat_ws("|", *parts), 256))
    words = [
        F.sum(F.conv(F.substring("__h", 1 + i * WORD_HEX, WORD_HEX), 16, 10).cast("decimal(20,0)")).alias(f"__w{i}")
        for i in range(HASH_WORDS)
    ]
    totals = hashed.groupBy(*by).agg(F.count(F.lit(1)).alias("total_transactions"), *words)
    text = F.concat_ws(
        "|",
        F.lit(str(model)),
        F.lit(f"{round(float(threshold), 6):.6f}"),
        F.col("total_transactions").cast("string"),
        *[F.coalesce(F.col(f"__w{i}"), F.lit(0)).cast("string") for i in range(HASH_WORDS)],
    )
    return totals.select(*by, F.sha2(text, 256).alias("batch_hash"), "total_transactions")


def upsert_batches(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert new batch headers; known hashes get the incoming model, threshold and size."""
    updated = ("model", "threshold", "total_transactions")
    old, new = existing.alias("o"), incoming.alias("n")
    joined = old.join(new, F.col("o.batch_hash") == F.col("n.batch_hash"), "full_outer")
    columns = []
    for c in existing.columns:
        first, second = ("n", "o") if c in updated else ("o", "n")
        columns.append(F.coalesce(F.col(f"{first}.{c}"), F.col(f"{second}.{c}")).alias(c))
    return joined.select(*columns)


def insert_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The incoming rows whose key is not stored yet; the first of repeated incoming rows wins."""
    rest = [F.col(c).asc_nulls_last() for c in sorted(incoming.columns) if c not in keys]
    once = dedupe_first(incoming, keys, rest)
    stored = existing.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    condition = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{k}") for k in keys])
    return once.join(stored, condition, "left_anti")


def persist_batch(
    batches: DataFrame, preds: DataFrame, scored: DataFrame, model: str, threshold: float, created_at=None
) -> tuple[DataFrame, DataFrame]:
    """Headers and rows after storing one scored batch; storing it twice changes nothing.

    Ids derive from the content hash, so a retry writes the same ones.
    """
    for c in ("trans_num", "risk_score", "prediction"):
        if c not in scored.columns:
            raise ValueError(f"scored rows need {c}")
    now = F.lit(created_at).cast("timestamp") if created_at is not None else F.current_timestamp()
    payload = [c for c in PAYLOAD_TYPES if c in scored.columns]
    content = scored.select("trans_num", *payload)
    header = batch_hash(content, model, threshold).select(
        F.col("batch_hash").alias("id"),
        "batch_hash",
        F.lit(str(model)).alias("model"),
        F.lit(float(threshold)).cast("decimal(10,4)").alias("threshold"),
        F.col("total_transactions").cast("int").alias("total_transactions"),
        now.alias("created_at"),
    )
    digest = header.first()["batch_hash"]
    rows = scored.select(
        F.sha2(F.concat_ws("|", F.lit(digest), F.col("trans_num")), 256).alias("id"),
        F.lit(digest).alias("batch_id"),
        F.col("trans_num").cast("string").alias("trans_num"),
        *[F.col(c).cast(PAYLOAD_TYPES[c]).alias(c) for c in payload],
        F.col("risk_score").cast(RISK_TYPE).alias("risk_score"),
        F.col("prediction").cast("int").cast("boolean").alias("prediction"),
        now.alias("created_at"),
    )
    rows = evolve_predictions(rows).select(*preds.columns)
    fresh = insert_new(preds, rows, ["batch_id", "trans_num"])
    return upsert_batches(batches, header.select(*batches.columns)), preds.unionByName(fresh)
