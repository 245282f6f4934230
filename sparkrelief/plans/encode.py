"""Whole pipelines: grids to tile bytes, and rasters to tiles."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec, geo
from ..operators import kernels, quantize, resample, rtin, streams
from ..operators import normals as nrm
from ..sources import png, tilebytes


@dataclass(frozen=True)
class Options:
    """How tiles are made; ``normals`` is none, face or gradient."""

    max_error: float = 1.0
    level: int = 6
    normals: str = "none"
    buffer: int = 1

    def __post_init__(self):
        if self.normals not in ("none", "face", "gradient"):
            raise ValueError(f"unknown normals: {self.normals}")


def meshes(tiles: DataFrame, cells: int, options: Options | None = None) -> DataFrame:
    """``tiles`` (with ``bounds`` and ``heights`` of (cells+1)²) with vertices, indices, lo, hi, q, edges and header.

    The mesh follows the height over the sphere; the vertices keep the true heights. No row leaves its partition.
    """
    options = options or Options()
    side = cells + 1
    whole = F.when(F.size("heights") == side * side, F.col("heights")).otherwise(F.raise_error(F.lit(f"a grid needs {side * side} heights")))
    bulge = lambda b: lambda h, i: h + geo.curvature_bulge(i % side, F.floor(i / side), cells, b)
    curve = geo.let(F.struct(F.col("heights").alias("h"), F.col("bounds").alias("b")), lambda s: F.transform(s.h, bulge(s.b)))
    curved = tiles.withColumn("heights", whole).withColumn("_curved", curve)
    out = rtin.mesh(curved, cells, options.max_error, error_heights="_curved").withColumn("vertices", rtin.vertices(F.col("posts"), F.col("heights"), cells)).drop("_curved", "posts")
    out = out.withColumn("_r", quantize.height_range(F.col("vertices"))).withColumn("lo", F.col("_r.lo")).withColumn("hi", F.col("_r.hi")).drop("_r")
    out = out.withColumn("q", quantize.quantised(F.col("vertices"), F.col("lo"), F.col("hi"))).withColumn("edges", streams.edge_indices(F.col("q.u"), F.col("q.v")))
    out = out.withColumn("_ecef", quantize.vertex_ecef(F.col("vertices"), F.col("bounds"))).withColumn("header", quantize.header(F.col("bounds"), F.col("lo"), F.col("hi"), F.col("_ecef"))).drop("_ecef")
    if options.normals == "gradient":
        normal = F.transform(F.transform("vertices", lambda p: nrm.gradient_normal(p.u, p.v, F.col("bounds"), F.col("halo"), cells, options.buffer)), codec.oct_encode)
        out = out.withColumn("normals", F.unhex(F.array_join(F.transform(normal, lambda o: F.concat(F.lpad(F.hex(o.a), 2, "0"), F.lpad(F.hex(o.b), 2, "0"))), "")))
    return out


def with_face_normals(mesh: DataFrame, keys: list[str]) -> DataFrame:
    """``mesh`` with ``normals`` of its faces as bytes; the only stage that joins, on the tile's keys."""
    whole = lambda v: v / F.lit(float(quantize.STEPS))
    at = F.transform(F.arrays_zip("q.u", "q.v", "q.height"), lambda p: F.struct(geo.geodetic_to_ecef(F.col("bounds.west") + whole(p.u) * geo.width(F.col("bounds")), F.col("bounds.south") + whole(p.v) * geo.height(F.col("bounds")), F.col("lo") + whole(p.height) * (F.col("hi") - F.col("lo"))).alias("p")))
    vertex = mesh.select(*keys, F.posexplode(at).alias("vid", "s")).select(*keys, "vid", *[F.col(f"s.p.{c}").alias(f"p{c}") for c in "xyz"])
    tri = mesh.select(*keys, "indices", F.explode(F.sequence(F.lit(0), (F.size("indices") / 3).cast("int") - 1)).alias("tid"))
    triangle = tri.select(*keys, "tid", *[F.get("indices", F.col("tid") * 3 + i).alias(c) for i, c in enumerate("abc")])
    each = nrm.face_normals(vertex, triangle, keys).withColumn("o", codec.oct_encode(F.struct(F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("nz").alias("z"))))
    text = F.concat(F.lpad(F.hex("o.a"), 2, "0"), F.lpad(F.hex("o.b"), 2, "0"))
    packed = each.groupBy(*keys).agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("vid", text.alias("t")))), lambda s: s.t), "")).alias("normals"))
    return mesh.join(packed, keys)


def encode_terrain(tiles: DataFrame, cells: int, keys: list[str], options: Options | None = None) -> DataFrame:
    """keys and ``content`` of each tile (``bounds``, ``heights`` of (cells+1)², for gradient normals ``halo``).

    One Arrow step from heights to bytes by numpy kernels, without a shuffle, for grids of any size; optional columns
    ``mask`` and ``metadata`` go into the bytes. ``meshes`` is the same work in columns.
    """
    options = options or Options()
    side = cells + 1
    more = [c for c in ("mask", "metadata") if c in tiles.columns]
    used = [*keys, "bounds", "heights", *(["halo"] if options.normals == "gradient" else []), *more]

    def run(batches):
        tri = kernels.triangles(cells)
        for batch in batches:
            bounds = [tuple(r[c] for c in ("west", "south", "east", "north")) for r in batch["bounds"].to_pylist()]
            heights = tilebytes.lists(batch["heights"])
            if any(len(h) != side * side for h in heights):
                raise ValueError(f"a grid needs {side * side} heights")
            halos = tilebytes.lists(batch["halo"]) if options.normals == "gradient" else [None] * len(heights)
            for k, rows in tilebytes.slices(batch, side * side):
                rest, made = {c: rows[c].to_pylist() for c in more}, []
                some = np.array(heights[k : k + rows.num_rows], float).reshape(-1, side * side)
                curved = some + np.array([kernels.bulge(cells, b) for b in bounds[k : k + rows.num_rows]])
                for i, (h, e) in enumerate(zip(some, tri.errors(curved), strict=True)):
                    parts = kernels.tile(h, e, bounds[k + i], cells, options.max_error, options.normals, halos[k + i], options.buffer)
                    made.append(tilebytes.encode_tile(parts["header"], parts["u"], parts["v"], parts["height"], parts["indices"], parts["edges"], parts.get("normals"), level=options.level, **{c: rest[c][i] for c in more}))
                yield pa.RecordBatch.from_arrays([*[rows[c] for c in keys], pa.array(made, pa.binary())], [*keys, "content"])

    doubles = F.transform("heights", lambda h: F.coalesce(h.cast("double"), F.lit(float("nan"))))
    source = tiles.withColumn("heights", doubles)
    if options.normals == "gradient":
        source = source.withColumn("halo", F.transform("halo", lambda h: F.coalesce(h.cast("double"), F.lit(float("nan")))))
    schema = T.StructType([*[tiles.schema[k] for k in keys], T.StructField("content", T.BinaryType())])
    return source.select(*used).mapInArrow(run, schema)


def encode_columns(tiles: DataFrame, cells: int, keys: list[str], options: Options | None = None) -> DataFrame:
    """The same bytes by the column forms, for grids up to about 32 cells; the kernels are held against it."""
    options = options or Options()
    made = meshes(tiles, cells, options)
    if options.normals == "face":
        made = with_face_normals(made, keys)
    return tilebytes.encode_tiles(made, keys, options.level)


def _buffer(options: Options) -> int:
    return options.buffer if options.normals == "gradient" else 0


def encode_rasters(boxes: DataFrame, rasters: DataFrame, tile_size: int, cells: int, keys: list[str], options: Options | None = None) -> DataFrame:
    """keys and ``content`` of the tiles over ``boxes`` (keys, ``bounds``, ``z`` of the rasters to take), with heights from mercator ``rasters`` (z, x, y, heights)."""
    options = options or Options()
    return encode_terrain(resample.geodetic_grids(boxes, rasters, tile_size, cells + 1, keys, _buffer(options)), cells, keys, options)


def verified(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, and what the bytes of each ``content`` decode to in short: vertices, triangles, height range, bytes of normals; a message if they are no tile."""
    d = tilebytes.decode_tiles(tiles, keys, strict=False, sections=["header", "u", "indices", "normals"])
    return d.select(*keys, F.size("u").cast("long").alias("vertices"), (F.size("indices") / 3).cast("long").alias("triangles"), F.col("header.min_height").alias("lo"), F.col("header.max_height").alias("hi"), F.length("normals").alias("normal_bytes"), "corrupt")


def reproject(boxes: DataFrame, images: DataFrame, tile_size: int, cells: int, keys: list[str], options: Options | None = None, fmt: str = "terrarium") -> DataFrame:
    """The whole job: images (z, x, y, content) of mercator heights in, terrain tiles of ``boxes`` out, as keys and ``content``.

    Only images under a box are decoded, each once, apart from the stage that reads them.
    """
    options = options or Options()
    asked = resample.under(boxes, images, cells + 1, _buffer(options))
    return encode_rasters(boxes, png.image_heights(asked, ["z", "x", "y"], fmt, tile_size), tile_size, cells, keys, options)
