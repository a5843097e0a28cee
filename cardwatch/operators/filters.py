"""Optional predicates shared by the monitoring reads."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardwatch.schemas import TS


def not_blank(c: str) -> Column:
    return F.col(c).isNotNull() & (F.trim(F.col(c)) != "")


def since(c: str, day: date | str) -> Column:
    return F.col(c) >= F.lit(day).cast("date")


def through(c: str, day: date | str) -> Column:
    """Up to and including the whole day."""
    return F.col(c) < F.date_add(F.lit(day).cast("date"), 1)


def prediction_filters(
    *,
    start_date: date | str | None = None,
    end_date: date | str | None = None,
    created_start_date: date | str | None = None,
    created_end_date: date | str | None = None,
    min_risk_score: float | None = None,
    merchant: str | None = None,
    category: str | None = None,
    only_fraud: bool = False,
) -> Column:
    """Conjunction of the given predicates; an empty text means no filter.

    Apply it after choosing the latest versions: filtering first would change
    which version is the latest.
    """
    clauses = []
    if start_date is not None:
        clauses.append(since(TS, start_date))
    if end_date is not None:
        clauses.append(through(TS, end_date))
    if created_start_date is not None:
        clauses.append(since("created_at", created_start_date))
    if created_end_date is not None:
        clauses.append(through("created_at", created_end_date))
    if min_risk_score is not None:
        clauses.append(F.col("risk_score").cast("double") >= F.lit(float(min_risk_score)))
    if merchant:
        clauses.append(F.col("merchant") == merchant)
    if category:
        clauses.append(F.col("category") == category)
    if only_fraud:
        clauses.append(F.col("prediction"))
    return reduce(lambda a, b: a & b, clauses, F.lit(True))
