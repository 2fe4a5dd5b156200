"""Geographic Column expressions on WGS84 degrees. They stay in whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere radius, kilometres in a degree (local plane), Mercator radius in metres.
EARTH_KM, DEG_LON_KM, DEG_LAT_KM, FLAT_DEG_KM, MERCATOR_M = 6371.0088, 111.32, 110.574, 111.32, 6378137.0


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(F.lit(1.0), a))) * (2 * EARTH_KM)


def rhumb_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance along a line of constant bearing."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dpsi = F.log(F.tan(p2 / 2 + F.lit(3.141592653589793 / 4)) / F.tan(p1 / 2 + F.lit(3.141592653589793 / 4)))
    q = F.when(F.abs(dpsi) > 1e-12, (p2 - p1) / dpsi).otherwise(F.cos(p1))
    return F.sqrt(F.pow(p2 - p1, 2) + F.pow(q * F.radians(lon2 - lon1), 2)) * EARTH_KM


def plane_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance on the plane about the first point's latitude."""
    dx = (lon2 - lon1) * F.cos(F.radians(lat1)) * DEG_LON_KM
    return F.sqrt(dx * dx + F.pow((lat2 - lat1) * DEG_LAT_KM, 2))


def flat_degrees_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Plain degrees times 111.32: no cosine."""
    return F.sqrt(F.pow(lon2 - lon1, 2) + F.pow(lat2 - lat1, 2)) * FLAT_DEG_KM


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * MERCATOR_M, F.log(F.tan(F.radians(lat) / 2 + F.lit(3.141592653589793 / 4))) * MERCATOR_M


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / MERCATOR_M), F.degrees(F.atan(F.exp(y / MERCATOR_M)) * 2 - F.lit(3.141592653589793 / 2))


def ground_scale(y: Column) -> Column:
    """Ground metres, on the mean sphere, in a Mercator metre at northing y."""
    return F.lit(EARTH_KM * 1000 / MERCATOR_M) / F.cosh(y / MERCATOR_M)


def lon_km(lat: Column) -> Column:
    """Kilometres in a degree of longitude."""
    return F.cos(F.radians(lat)) * DEG_LON_KM


def segment_t(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column, k: Column | None = None) -> Column:
    """Where on a segment (0 to 1) the foot of a point lies, on the plane about the point; k: its lon_km, if at hand."""
    k = lon_km(py) if k is None else k
    ax, ay, bx, by = (x1 - px) * k, (y1 - py) * DEG_LAT_KM, (x2 - px) * k, (y2 - py) * DEG_LAT_KM
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / n))).otherwise(0.0)


def segment_km(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column, k: Column | None = None) -> Column:
    """Distance of a point to a segment, on the plane about the point; k: its lon_km, if at hand."""
    k = lon_km(py) if k is None else k
    ax, ay, bx, by = (x1 - px) * k, (y1 - py) * DEG_LAT_KM, (x2 - px) * k, (y2 - py) * DEG_LAT_KM
    t = segment_t(px, py, x1, y1, x2, y2, k)
    return F.sqrt(F.pow(ax + t * (bx - ax), 2) + F.pow(ay + t * (by - ay), 2))


def segment_degrees(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point to a segment in plain degrees."""
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / n))).otherwise(0.0)
    return F.sqrt(F.pow(px - x1 - t * dx, 2) + F.pow(py - y1 - t * dy, 2))


def atan2(y: Column, x: Column) -> Column:
    """The angle with the sign of a zero kept, as in IEEE 754 and in DuckDB: minus pi for (-0.0, -1). Spark's own takes -0.0 as 0.0,
    so that turns back along a parallel or a meridian all go to one side."""
    below = lambda c: c.cast("string") == "-0.0"
    return F.when((y == 0) & ((x < 0) | below(x)), F.when(below(y), -math.pi).otherwise(math.pi)).otherwise(F.atan2(y, x))


def round_half_up(x: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: ties go up, also below zero."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def inside_bounds(lon: Column, lat: Column, west=-20.0, south=-5.0, east=60.0, north=50.0) -> Column:
    return lon.between(west, east) & lat.between(south, north)


def scaled(x: Column, k: float = 1000.0) -> Column:
    """A whole number of 1/k units."""
    return F.floor(x * k + 0.5).cast("long")
