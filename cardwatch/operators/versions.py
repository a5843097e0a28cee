"""Versioned predictions: the newest row per transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEWEST = ("created_at", "id")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in the given order.

    The rank filter lets Spark keep only each map task's best row per key
    before the shuffle, so a key with very many versions does not pile up.
    """
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__rank") == 1).drop("__rank")


def latest_predictions(pred: DataFrame, newest: tuple[str, ...] = NEWEST, within: tuple[str, ...] = ()) -> DataFrame:
    """Newest version per ``trans_num``; later columns of ``newest`` break ties.

    ``within`` names columns that are the same for all versions of an id: rows
    that are already dealt out by them need no shuffle by the id.
    """
    return keep_first(pred, [*within, "trans_num"], [F.col(c).desc_nulls_first() for c in newest])


def dedupe_first(df: DataFrame, key: str | list[str], order: list[str | Column]) -> DataFrame:
    """Drop duplicates by key, keeping the first row of a declared order."""
    keys = [key] if isinstance(key, str) else list(key)
    return keep_first(df, keys, [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order])
