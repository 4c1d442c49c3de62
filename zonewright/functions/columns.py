"""Scalar functions as column expressions: they run in generated code and can be pushed into any plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(x: Column | str, digits: int = 0) -> Column:
    """Round half towards plus infinity: floor(x * 10^d + 0.5) / 10^d."""
    scale = float(10**digits)
    return F.floor(col(x) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def micro(x: Column | str) -> Column:
    """Six decimals, so that sums taken in another order give the same value."""
    return half_up(x, 6)


def number_or_zero(x: Column | str) -> Column:
    """A text as a number; what is missing, no number or NaN is 0."""
    return F.coalesce(F.nanvl(col(x).try_cast("double"), F.lit(0.0)), F.lit(0.0))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance; null if a coordinate is null."""
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    s = F.pow(F.sin(dlat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.when(s > 1, 1.0).otherwise(s)))


def logistic(z: Column) -> Column:
    """1 / (1 + e^-z) without overflow for large |z|."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def equirectangular(lat: Column, lng: Column, west: float, north: float, scale: float) -> tuple[Column, Column]:
    """x and y on a plane whose origin is the north-west corner."""
    return (lng - F.lit(west)) * F.lit(scale), (F.lit(north) - lat) * F.lit(scale)


def month_key(d: Column | str) -> Column:
    return F.date_format(col(d), "yyyy-MM")


def add_months_key(month: Column | str, k: int) -> Column:
    """A 'yyyy-MM' key k months later; null if the key is malformed."""
    m = col(month)
    ok = m.rlike(r"^\d{4}-(0[1-9]|1[0-2])$")
    return F.when(ok, F.date_format(F.add_months(F.to_date(F.when(ok, F.concat(m, F.lit("-01")))), k), "yyyy-MM"))


def months_between_keys(later: Column, earlier: Column) -> Column:
    """Whole calendar months: year * 12 + month, days do not matter."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def end_of_month(month: Column | str) -> Column:
    """The last second of a 'yyyy-MM' month."""
    return F.timestamp_seconds(F.unix_timestamp(F.add_months(F.to_date(F.concat(col(month), F.lit("-01"))), 1).cast("timestamp")) - 1)


def excel_date(serial: Column | str) -> Column:
    return F.date_add(F.lit("1899-12-30").cast("date"), col(serial).cast("int"))


def compact_timestamp_date(s: Column | str) -> Column:
    """'20260930T000000Z' as a date."""
    return F.to_date(F.try_to_timestamp(col(s), F.lit("yyyyMMdd'T'HHmmss'Z'")))


def iso_date(s: Column | str) -> Column:
    """A zero-padded ISO date, else null."""
    return F.when(col(s).rlike(r"^\d{4}-\d{2}-\d{2}$"), col(s).try_cast("date"))


def risk_band(index: Column) -> Column:
    return F.when(index >= 75, "critical").when(index >= 60, "elevated").when(index >= 45, "watch").otherwise("baseline")


def rank_of(c: Column, order: list[str]) -> Column:
    """The place of a text in a fixed order; what is not in it comes last."""
    out = F.lit(len(order))
    for k, x in reversed(list(enumerate(order))):
        out = F.when(c == x, k).otherwise(out)
    return out
