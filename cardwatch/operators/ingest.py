"""Cleaning, validation and column contracts at the edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch.operators.versions import dedupe_first
from cardwatch.schemas import API_FIELDS, LABEL, STORED_NAMES, TRANSACTION_COLUMNS, TRANSACTIONS_RAW, TS

# Numeric range (lower, upper) and text length (lower, upper) rules per field.
RANGES = {
    "cc_num": (1, None),
    "amt": (0, None),
    "zip": (0, None),
    "lat": (-90, 90),
    "long": (-180, 180),
    "city_pop": (0, None),
    "unix_time": (0, None),
    "merch_lat": (-90, 90),
    "merch_long": (-180, 180),
    "merch_zipcode": (0, None),
}
LENGTHS = {
    "merchant": (1, None),
    "category": (1, None),
    "first": (1, None),
    "last": (1, None),
    "gender": (1, 1),
    "street": (1, None),
    "city": (1, None),
    "state": (1, 2),
    "job": (1, None),
    "trans_num": (1, None),
}
OPTIONAL = ("trans_num", "merch_zipcode")
FILLED_WITH_ZERO = ("amt", "city_pop")


def missing_columns(df: DataFrame) -> list[str]:
    present = {STORED_NAMES.get(c, c) for c in df.columns}
    return [c for c in TRANSACTION_COLUMNS if c not in present]


def clean_transactions(df: DataFrame, order_by: list[str | Column]) -> DataFrame:
    """Loader cleaning: known columns, one row per id, typed dates, filled gaps.

    ``order_by`` declares which of several rows with one id is kept; a file's
    row order does not exist here.
    """
    df = df.withColumnsRenamed({k: v for k, v in STORED_NAMES.items() if k in df.columns})
    # The kept row is chosen before projecting, so the order may use any column.
    if "trans_num" in df.columns:
        df = dedupe_first(df, "trans_num", order_by)
    df = df.select(*[c for c in TRANSACTION_COLUMNS if c in df.columns])
    changes = {}
    if LABEL in df.columns:
        changes[LABEL] = F.col(LABEL).try_cast("double") != 0
    if TS in df.columns:
        changes[TS] = F.col(TS).try_cast("timestamp")
    if "dob" in df.columns:
        changes["dob"] = F.col("dob").try_cast("date")
    for c in FILLED_WITH_ZERO:
        if c in df.columns:
            changes[c] = F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType))
    return df.withColumns(changes)


def select_api_fields(df: DataFrame) -> DataFrame:
    """Request columns in request order; the stored name of ``long`` is accepted."""
    back = {stored: name for name, stored in STORED_NAMES.items() if stored in df.columns and name not in df.columns}
    df = df.withColumnsRenamed(back)
    missing = [c for c in API_FIELDS if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*API_FIELDS)


def validate_transactions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split records into valid (typed) and rejected (with their list of errors).

    Columns beyond the known fields are refused as a whole.
    """
    extra = [c for c in df.columns if c not in API_FIELDS]
    if extra:
        raise ValueError(f"unexpected columns: {', '.join(extra)}")
    raw = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in API_FIELDS])
    types = {f.name: f.dataType for f in TRANSACTIONS_RAW.fields}
    source = {c: F.col(c) for c in API_FIELDS}
    zipcode = F.regexp_replace(F.trim(F.col("merch_zipcode").cast("string")), ",", "")
    source["merch_zipcode"] = F.nullif(zipcode, F.lit(""))
    typed = {c: source[c].try_cast(types[c]) for c in API_FIELDS}

    problems = []

    def rule(c: str, text: str, broken: Column) -> None:
        problems.append(F.when(broken, F.lit(f"{c}: {text}")))

    for c in API_FIELDS:
        given = source[c].isNotNull()
        if c not in OPTIONAL:
            rule(c, "required", ~given)
        rule(c, "wrong type", given & typed[c].isNull())
        if c in RANGES:
            low, high = RANGES[c]
            if low is not None:
                rule(c, f"below {low}", typed[c] < low)
            if high is not None:
                rule(c, f"above {high}", typed[c] > high)
        if c in LENGTHS:
            low, high = LENGTHS[c]
            rule(c, f"shorter than {low}", F.length(typed[c]) < low)
            if high is not None:
                rule(c, f"longer than {high}", F.length(typed[c]) > high)
    checked = raw.withColumn("errors", F.filter(F.array(*problems), lambda e: e.isNotNull()))
    valid = checked.where(F.size("errors") == 0).select(*[typed[c].alias(c) for c in API_FIELDS])
    return valid, checked.where(F.size("errors") > 0)


def row_digest(df: DataFrame) -> Column:
    """SHA-256 over a row's columns in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)


def ensure_trans_num(df: DataFrame, prefix: str = "srv_") -> DataFrame:
    """Fill missing ids from the row's content, so a retry gives the same id."""
    given = F.nullif(F.col("trans_num"), F.lit("")) if "trans_num" in df.columns else F.lit(None).cast("string")
    rest = df.select(*[c for c in df.columns if c != "trans_num"])
    return df.withColumn("trans_num", F.coalesce(given, F.concat(F.lit(prefix), row_digest(rest))))


def assert_model_schema(df: DataFrame, expected: list[str]) -> DataFrame:
    """Exactly the expected columns, in their order."""
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise ValueError(f"missing model columns: {', '.join(missing)}")
    return df.select(*expected)
