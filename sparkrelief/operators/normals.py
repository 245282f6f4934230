"""Vertex normals in ECEF: area-weighted faces by join and aggregate, and gradients of a halo grid row by row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..sources.tilebytes import lists
from . import kernels


def face_normals(vertex: DataFrame, triangle: DataFrame, keys: list[str]) -> DataFrame:
    """keys, vid, nx, ny, nz from vertex(keys, vid, px, py, pz) and triangle(keys, tid, a, b, c).

    Cross products are summed without being normalised, so larger faces weigh more; a sum of no length gives
    (0, 0, 1).
    """
    t = triangle
    for corner in "abc":
        t = t.join(vertex.select(*keys, F.col("vid").alias(corner), *[F.col(f"p{x}").alias(f"{corner}{x}") for x in "xyz"]), [*keys, corner])
    d = lambda p, x: F.col(f"{p}{x}") - F.col(f"a{x}")
    cross = {"nx": d("b", "y") * d("c", "z") - d("b", "z") * d("c", "y"), "ny": d("b", "z") * d("c", "x") - d("b", "x") * d("c", "z"), "nz": d("b", "x") * d("c", "y") - d("b", "y") * d("c", "x")}
    each = t.select(*keys, F.explode(F.array("a", "b", "c")).alias("vid"), *[v.cast("float").cast("double").alias(k) for k, v in cross.items()])
    total = each.groupBy(*keys, "vid").agg(*[F.sum(k).alias(k) for k in cross])
    m = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    fallback = {"nx": 0.0, "ny": 0.0, "nz": 1.0}
    return total.select(*keys, "vid", *[F.when(m > 1e-6, F.col(k) / m).otherwise(z).alias(k) for k, z in fallback.items()])


def blend(a: Column, b: Column, t: Column) -> Column:
    """Linear blend; a NaN end gives way to the other."""
    mixed = lambda s: F.when(F.isnan(s.a), s.b).when(F.isnan(s.b), s.a).otherwise(s.a + (s.b - s.a) * s.t)
    return geo.let(F.struct(a.alias("a"), b.alias("b"), t.alias("t")), mixed)


def _height(halo: Column, side: int, x: Column, y: Column) -> Column:
    """Bilinear height in a grid of ``side`` posts, clamped to it; no data gives 0."""
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(v, F.lit(side - 1.0)))

    def at(p):
        x0, y0 = F.floor(p.x).cast("int"), F.floor(p.y).cast("int")
        x1, y1 = F.least(x0 + 1, F.lit(side - 1)), F.least(y0 + 1, F.lit(side - 1))
        h = lambda i, j: F.get(halo, j * side + i)
        return blend(blend(h(x0, y0), h(x1, y0), p.x - x0), blend(h(x0, y1), h(x1, y1), p.x - x0), p.y - y0)

    found = geo.let(F.struct(clamp(x).alias("x"), clamp(y).alias("y")), at)
    return geo.let(found, lambda h: F.when(F.isnan(h), 0.0).otherwise(h))


def gradient_normal(u: Column, v: Column, b: Column, halo: Column, cells: int, buffer: int) -> Column:
    """Unit normal of a vertex from the slopes of a grid with ``buffer`` more posts on each side."""
    side = cells + 1 + 2 * buffer
    halo = F.when(F.size(halo) == side * side, halo).otherwise(F.raise_error(F.lit(f"a halo needs {side * side} heights")))
    per_lat = geo.deg_to_rad(F.lit(geo.WGS84_A))
    per_lon = per_lat * F.cos(geo.deg_to_rad(geo.centre(b).lat))
    fx, fy = buffer + u * cells, buffer + (1 - v) * cells
    dx = (_height(halo, side, fx + 0.5, fy) - _height(halo, side, fx - 0.5, fy)) / (geo.width(b) / cells * per_lon)
    dy = (_height(halo, side, fx, fy - 0.5) - _height(halo, side, fx, fy + 0.5)) / (geo.height(b) / cells * per_lat)
    lam, phi = geo.deg_to_rad(b.west + u * geo.width(b)), geo.deg_to_rad(b.south + v * geo.height(b))

    def turned(p):
        e = -p.dx * -F.sin(p.lam) + -p.dy * (-F.sin(p.phi) * F.cos(p.lam)) + F.cos(p.phi) * F.cos(p.lam)
        n = -p.dx * F.cos(p.lam) + -p.dy * (-F.sin(p.phi) * F.sin(p.lam)) + F.cos(p.phi) * F.sin(p.lam)
        return geo.normalised(geo.xyz(e, n, -p.dy * F.cos(p.phi) + F.sin(p.phi)))

    return geo.let(F.struct(dx.alias("dx"), dy.alias("dy"), lam.alias("lam"), phi.alias("phi")), turned)


def grid_normals(tiles: DataFrame, keys: list[str], cells: int, buffer: int) -> DataFrame:
    """keys and ``normals``, a unit vector for each grid post, from ``bounds`` and ``halo``; in Arrow batches, for grids of any size."""
    side, vector = cells + 1, T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"])

    def run(batches):
        u, v = np.tile(np.arange(side) / cells, side), np.repeat(1 - np.arange(side) / cells, side)
        for batch in batches:
            bounds = [tuple(r[c] for c in ("west", "south", "east", "north")) for r in batch["bounds"].to_pylist()]
            made = [kernels.gradient_normals(u, v, b, h, cells, buffer) for b, h in zip(bounds, lists(batch["halo"]), strict=True)]
            flat = np.concatenate(made) if made else np.empty((0, 3))
            vectors = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["x", "y", "z"])
            at = pa.array(np.arange(len(made) + 1) * side * side, pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in keys], pa.ListArray.from_arrays(at, vectors)], [*keys, "normals"])

    return tiles.select(*keys, "bounds", "halo").mapInArrow(run, T.StructType([*[tiles.schema[k] for k in keys], T.StructField("normals", T.ArrayType(vector))]))
