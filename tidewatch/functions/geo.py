"""Distances, bearings and projections as column expressions; angles in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KM, NM = 6371.0, 3440.065  # radii of the Earth


def rounded(x: Column, places: int) -> Column:
    """Half up on the scaled double, which other engines can repeat to the bit."""
    return F.floor(x * F.lit(float(10**places)) + F.lit(0.5)).cast("double") / F.lit(float(10**places))


def planar(lat1, lon1, lat2, lon2, per_degree: float) -> Column:
    """Distance on a plate: degrees by a factor, without scaling of longitude."""
    a, b = lat1 - lat2, lon1 - lon2
    return F.sqrt(a * a + b * b) * F.lit(per_degree)


def _half_chord(lat1, lon1, lat2, lon2) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    s, t = F.sin((q - p) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return s * s + F.cos(p) * F.cos(q) * t * t


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a = _half_chord(lat1, lon1, lat2, lon2)
    return F.lit(2 * KM) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def haversine_nm(lat1, lon1, lat2, lon2) -> Column:
    return F.lit(2 * NM) * F.asin(F.sqrt(_half_chord(lat1, lon1, lat2, lon2)))


def modulo(x: Column, m: float) -> Column:
    """x modulo m, not negative."""
    return x - F.floor(x / F.lit(m)) * F.lit(m)


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing, from 0 up to 360."""
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return modulo(F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))) + 360, 360.0)


def ahead_nm(lat, lon, course, distance) -> tuple[Column, Column]:
    """Dead reckoning by nautical miles."""
    c = F.radians(course)
    return lat + distance * F.cos(c) / 60, lon + distance * F.sin(c) / (60 * F.cos(F.radians(lat)) + F.lit(1e-9))


def ahead_km(lat, lon, course, distance) -> tuple[Column, Column]:
    c = F.radians(course)
    return lat + distance * F.cos(c) / F.lit(111.32), lon + distance * F.sin(c) / (F.lit(111.32) * F.cos(F.radians(lat)) + F.lit(1e-9))


def wrapped(lon: Column) -> Column:
    """Longitude in -180 to 180; both ends stay as they are."""
    return F.when(F.abs(lon) <= 180, lon).otherwise(modulo(lon + 180, 360.0) - 180)


def inside(lat: Column, lon: Column, zone: str = "") -> Column:
    return lat.between(F.col(f"{zone}min_lat"), F.col(f"{zone}max_lat")) & lon.between(F.col(f"{zone}min_lon"), F.col(f"{zone}max_lon"))


def valid(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def polar(u: Column, v: Column) -> tuple[Column, Column]:
    """Speed and direction of a vector."""
    return F.hypot(u, v), modulo(F.degrees(F.atan2(u, v)) + 360, 360.0)


def vector(speed: Column, direction: Column) -> tuple[Column, Column]:
    return speed * F.sin(F.radians(direction)), speed * F.cos(F.radians(direction))
