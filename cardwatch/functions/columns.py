"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardwatch.schemas import LABEL

EARTH_RADIUS_KM = 6371.0

# Day part names, upper hour bound inclusive.
HOUR_BANDS = ((5, "madrugada"), (11, "manana"), (17, "tarde"), (23, "noche"))

# Information-value bands, upper bound exclusive.
IV_BANDS = ((0.02, "inutil"), (0.10, "debil"), (0.30, "medio"), (0.50, "fuerte"))
IV_TOP_BAND = "muy_fuerte_o_leakage"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, NULL when b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def positives(label: str = LABEL) -> Column:
    return F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in kilometres."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.asin(F.sqrt(F.least(chord, F.lit(1.0)))) * (2 * EARTH_RADIUS_KM)


def hour_band(hour: str | Column) -> Column:
    """Day part of an hour 0..23; NULL outside."""
    h = _col(hour)
    band = F.when(h < 0, F.lit(None))
    for upper, name in HOUR_BANDS:
        band = band.when(h <= upper, F.lit(name))
    return band


def iv_band(iv: str | Column) -> Column:
    v = _col(iv)
    band = F.when(v.isNull() | F.isnan(v), F.lit("na"))
    for upper, name in IV_BANDS:
        band = band.when(v < upper, F.lit(name))
    return band.otherwise(F.lit(IV_TOP_BAND))


def prediction_label(flag: str | Column) -> Column:
    p = _col(flag)
    return F.when(p, "fraud").when(~p, "legit").otherwise("pending")


def skewness_corrected(c: str | Column) -> Column:
    """Sample skewness with the small-sample correction (NULL below 3 values)."""
    n = F.count(c).cast("double")
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def seconds(ts: str | Column) -> Column:
    """Whole seconds since the epoch, rounded down."""
    return F.floor(F.unix_micros(_col(ts)) / F.lit(1_000_000)).cast("long")


def correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation over rows where both are known; NULL if one is constant."""
    x, y = _col(a).cast("double"), _col(b).cast("double")
    spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))


def seeded_order(key: str, seed: int) -> Column:
    """A text that puts keys into a repeatable random order, one that any SQL engine can follow."""
    return F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))), 256)
