"""Height range, quantised vertices and the tile header, row by row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geo

STEPS = 32767


def height_range(vertices: Column) -> Column:
    """Struct lo, hi over mesh vertices without NaN; 0 and 0 if there are none."""
    h = F.filter(F.transform(vertices, lambda p: p.h), lambda x: ~F.isnan(x))
    return geo.let(h, lambda h: F.struct(F.coalesce(F.array_min(h), F.lit(0.0)).alias("lo"), F.coalesce(F.array_max(h), F.lit(0.0)).alias("hi")))


def _steps(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.round(F.when(F.isnan(x), 0.0).otherwise(x) * STEPS), F.lit(STEPS))).cast("int")


def quantised(vertices: Column, lo: Column, hi: Column) -> Column:
    """Struct of arrays u, v, height in 0..32767; a flat tile has height 0."""
    made = lambda s: F.struct(
        F.transform(s.p, lambda p: _steps(p.u)).alias("u"), F.transform(s.p, lambda p: _steps(p.v)).alias("v"),
        F.transform(s.p, lambda p: F.when(s.hi > s.lo, _steps((p.h - s.lo) / (s.hi - s.lo))).otherwise(0)).alias("height"),
    )
    return geo.let(F.struct(vertices.alias("p"), lo.alias("lo"), hi.alias("hi")), made)


def dequantised(q: Column, lo: Column, hi: Column) -> Column:
    return lo + q / STEPS * (hi - lo)


def bounding_sphere(b: Column, lo: Column, hi: Column) -> Column:
    """Struct centre, radius: the middle of the tile at middle height, and the farthest of twelve samples."""
    mid = geo.centre(b)
    c = geo.geodetic_to_ecef(mid.lon, mid.lat, (lo + hi) / 2)
    corners = [(x, y, h) for x in (b.west, b.east) for y in (b.south, b.north) for h in (lo, hi)]
    middles = [(b.west, mid.lat, hi), (b.east, mid.lat, hi), (mid.lon, b.south, hi), (mid.lon, b.north, hi)]
    samples = F.array(*[geo.geodetic_to_ecef(*s) for s in corners + middles])
    return geo.let(c, lambda o: F.struct(o.alias("centre"), F.array_max(F.transform(samples, lambda p: geo.distance(p, o))).alias("radius")))


def occlusion_magnitude(p: Column, direction: Column) -> Column:
    """How far along the direction a point hides behind the horizon; null if it never does, or isn't known."""
    def hidden(q):
        s, d = q.s, q.d
        cross = geo.xyz(s.y * d.z - s.z * d.y, s.z * d.x - s.x * d.z, s.x * d.y - s.y * d.x)
        cos_a = (s.x * d.x + s.y * d.y + s.z * d.z) / q.l
        sin_a = geo.magnitude(cross) / q.l
        return cos_a / q.m - sin_a * F.sqrt(F.greatest(q.m * q.m - 1, F.lit(0.0))) / q.m

    scaled = geo.let(F.struct(geo.ellipsoid_scaled(p).alias("s"), direction.alias("d")), lambda q: F.struct(q.s.alias("s"), q.d.alias("d"), F.greatest(geo.magnitude(q.s), F.lit(1.0)).alias("m")))
    # below the surface the unit vector is taken with the clamped length
    return geo.let(geo.let(scaled, lambda q: hidden(q.withField("l", q.m))), lambda x: F.when((x > 0) & ~F.isnan(x), 1 / x))


def horizon_point(b: Column, lo: Column, hi: Column, ecef: Column | None = None) -> Column:
    """Horizon occlusion point in ellipsoid-scaled space over an array of ECEF points, or over thirteen samples of the bounds."""
    mid = geo.centre(b)
    corners = [(x, y, h) for x in (b.west, b.east) for y in (b.south, b.north) for h in (lo, hi)]
    half = (lo + hi) / 2
    middles = [(b.west, mid.lat, half), (b.east, mid.lat, half), (mid.lon, b.south, half), (mid.lon, b.north, half), (mid.lon, mid.lat, hi)]
    samples = F.array(*[geo.geodetic_to_ecef(*s) for s in corners + middles])
    points = samples if ecef is None else F.when(F.size(ecef) > 0, ecef).otherwise(samples)

    def along(direction):
        most = F.array_max(F.transform(points, lambda p: occlusion_magnitude(p, direction)))
        scale = geo.let(most, lambda m: F.when((m > 0) & (m < math.inf), m).otherwise(1.0))
        return geo.let(scale, lambda k: geo.xyz(direction.x * k, direction.y * k, direction.z * k))

    return geo.let(geo.normalised(geo.ellipsoid_scaled(geo.geodetic_to_ecef(mid.lon, mid.lat, half))), along)


def vertex_ecef(vertices: Column, b: Column) -> Column:
    at = lambda b: lambda p: geo.geodetic_to_ecef(b.west + p.u * (b.east - b.west), b.south + p.v * (b.north - b.south), p.h)
    return geo.let(F.struct(vertices.alias("p"), b.alias("b")), lambda s: F.transform(s.p, at(s.b)))


def header(b: Column, lo: Column, hi: Column, ecef: Column | None = None) -> Column:
    """The tile header as a struct; heights are in single precision."""
    mid = geo.centre(b)
    made = lambda sphere: F.struct(
        geo.geodetic_to_ecef(mid.lon, mid.lat, (lo + hi) / 2).alias("center"), lo.cast("float").alias("min_height"), hi.cast("float").alias("max_height"),
        sphere.centre.alias("sphere_center"), sphere.radius.alias("sphere_radius"), horizon_point(b, lo, hi, ecef).alias("horizon_point"),
    )
    return geo.let(bounding_sphere(b, lo, hi), made)
