"""Geodesy and tiling maths as Column expressions. Angles are in degrees, lengths in metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid, the limit of web mercator, the mean radius for the curvature bulge.
WGS84_A = 6378137.0
WGS84_B = 6356752.314245
WGS84_F = 1 / 298.257223563
WGS84_E2 = 2 * WGS84_F - WGS84_F * WGS84_F
MERCATOR_LAT = 85.05112877980659
MEAN_RADIUS = 6371008.8


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; a plain Python variable would copy its expression at every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def xyz(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def deg_to_rad(c: Column) -> Column:
    return c * F.lit(math.pi / 180)


def rad_to_deg(c: Column) -> Column:
    return c * F.lit(180 / math.pi)


def geodetic_to_ecef(lon: Column, lat: Column, h: Column) -> Column:
    """Struct x, y, z of a point on the ellipsoid."""
    lam, phi = deg_to_rad(lon), deg_to_rad(lat)
    n = WGS84_A / F.sqrt(1 - WGS84_E2 * F.sin(phi) * F.sin(phi))
    return xyz((n + h) * F.cos(phi) * F.cos(lam), (n + h) * F.cos(phi) * F.sin(lam), (n * (1 - WGS84_E2) + h) * F.sin(phi))


def ecef_to_geodetic(p: Column) -> Column:
    """Struct lon, lat, h; five fixed-point steps, as one fold over a struct so that no expression is copied. Poles are at 90 degrees; the centre gives NaN or no height."""
    return let(p, _to_geodetic)


def _to_geodetic(p: Column) -> Column:
    flat = F.sqrt(p.x * p.x + p.y * p.y)
    radius = lambda phi: WGS84_A / F.sqrt(1 - WGS84_E2 * F.sin(phi) * F.sin(phi))
    phi = F.aggregate(F.sequence(F.lit(1), F.lit(5)), F.atan2(p.z, flat), lambda f, _: F.atan2(p.z + WGS84_E2 * radius(f) * F.sin(f), flat))
    done = F.transform(F.array(phi), lambda f: F.struct(rad_to_deg(F.atan2(p.y, p.x)).alias("lon"), rad_to_deg(f).alias("lat"), F.when(F.abs(F.cos(f)) > 1e-10, flat / F.cos(f) - radius(f)).otherwise(F.abs(p.z) / F.abs(F.sin(f)) - radius(f) * (1 - WGS84_E2)).alias("h")))
    return F.get(done, F.lit(0))


def ellipsoid_scaled(p: Column) -> Column:
    return let(p, lambda q: xyz(q.x / WGS84_A, q.y / WGS84_A, q.z / WGS84_B))


def magnitude(p: Column) -> Column:
    return let(p, lambda q: F.sqrt(q.x * q.x + q.y * q.y + q.z * q.z))


def normalised(p: Column) -> Column:
    """Unit vector; (0, 0, 1) for a vector shorter than 1e-10."""
    unit = lambda q: F.when(q.m < 1e-10, xyz(F.lit(0.0), F.lit(0.0), F.lit(1.0))).otherwise(xyz(q.p.x / q.m, q.p.y / q.m, q.p.z / q.m))
    return let(let(p, lambda q: F.struct(q.alias("p"), F.sqrt(q.x * q.x + q.y * q.y + q.z * q.z).alias("m"))), unit)


def distance(p: Column, q: Column) -> Column:
    return let(F.struct(p.alias("p"), q.alias("q")), lambda s: magnitude(xyz(s.p.x - s.q.x, s.p.y - s.q.y, s.p.z - s.q.z)))


def bounds(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.struct(west.cast("double").alias("west"), south.cast("double").alias("south"), east.cast("double").alias("east"), north.cast("double").alias("north"))


def width(b: Column) -> Column:
    return b.east - b.west


def height(b: Column) -> Column:
    return b.north - b.south


def centre(b: Column) -> Column:
    return F.struct(((b.west + b.east) / 2).alias("lon"), ((b.south + b.north) / 2).alias("lat"))


def tile_count(z: Column) -> Column:
    """Tiles along one side of web mercator; also rows of the geodetic scheme."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), z.cast("int"))


def geodetic_columns(z: Column) -> Column:
    return F.call_function("shiftleft", F.lit(2).cast("long"), z.cast("int"))


def _clamped(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(v, F.lit(high)))


def _index(v: Column, n: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(F.floor(v).cast("long"), n - 1))


def mercator_fraction(lat: Column) -> Column:
    """Share of the way from the north edge of web mercator to the south one."""
    return (1 - F.asinh(F.tan(deg_to_rad(_clamped(lat, -MERCATOR_LAT, MERCATOR_LAT)))) / math.pi) / 2


def lonlat_to_xyz(lon: Column, lat: Column, z: Column) -> Column:
    """Tile of web mercator with y growing to the south."""
    n = tile_count(z)
    return F.struct(_index((_clamped(lon, -180.0, 180.0) + 180) / 360 * n, n).alias("x"), _index(mercator_fraction(lat) * n, n).alias("y"))


def flip_y(y: Column, z: Column) -> Column:
    return tile_count(z) - 1 - y


def lonlat_to_tms(lon: Column, lat: Column, z: Column) -> Column:
    t = lonlat_to_xyz(lon, lat, z)
    return F.struct(t.x.alias("x"), flip_y(t.y, z).alias("y"))


def xyz_bounds(x: Column, y: Column, z: Column) -> Column:
    n = tile_count(z)
    edge = lambda i: rad_to_deg(F.atan(F.sinh(math.pi * (1 - 2 * i / n))))
    return bounds(x / n * 360 - 180, edge(y + 1), (x + 1) / n * 360 - 180, edge(y))


def tms_bounds(x: Column, y: Column, z: Column) -> Column:
    return xyz_bounds(x, flip_y(y, z), z)


def lonlat_to_geodetic(lon: Column, lat: Column, z: Column) -> Column:
    """Tile of the geodetic scheme, two columns at level 0, y growing to the north."""
    nx, ny = geodetic_columns(z), tile_count(z)
    return F.struct(_index((_clamped(lon, -180.0, 180.0) + 180) / 360 * nx, nx).alias("x"), _index((_clamped(lat, -90.0, 90.0) + 90) / 180 * ny, ny).alias("y"))


def geodetic_bounds(x: Column, y: Column, z: Column) -> Column:
    step = 180 / tile_count(z)
    return bounds(x * step - 180, y * step - 90, (x + 1) * step - 180, (y + 1) * step - 90)


def curvature_bulge(x: Column, y: Column, cells: int, b: Column) -> Column:
    """Height of the sphere over the flat cell at grid post (x, y); zero at the corners."""
    u, v = x / cells, y / cells
    dlat, dlon = deg_to_rad(height(b)), deg_to_rad(width(b)) * F.cos(deg_to_rad(centre(b).lat))
    return MEAN_RADIUS / 2 * (dlat * dlat * v * (1 - v) + dlon * dlon * u * (1 - u))
