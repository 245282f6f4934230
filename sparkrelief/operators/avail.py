"""Availability, water masks and the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

# Fixed values of the manifest format.
TERRAIN_FORMATS = {"heightmap": "heightmap-1.0", "mesh": "quantized-mesh-1.0"}
MANIFEST_DEFAULTS = {"tilejson": "2.1.0", "format": "quantized-mesh-1.0", "version": "1.0.0", "scheme": "tms", "tile": "{z}/{x}/{y}.terrain"}
MASK_BYTES = 65536


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The manifest's order of fields."""
    return F.struct(*[c.cast("long").alias(n) for c, n in ((x0, "startX"), (y0, "startY"), (x1, "endX"), (y1, "endY"))])


def metadata_range(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The order of fields inside a tile's metadata."""
    return F.struct(*[c.cast("long").alias(n) for c, n in ((x0, "startX"), (x1, "endX"), (y0, "startY"), (y1, "endY"))])


def full_level(z: Column, geodetic: bool = True) -> Column:
    return rectangle(F.lit(0), F.lit(0), (geo.geodetic_columns(z) if geodetic else geo.tile_count(z)) - 1, geo.tile_count(z) - 1)


def range_of_bounds(b: Column, z: Column, scheme: str = "geodetic") -> Column:
    """Tiles over a box in the scheme ``geodetic``, ``xyz`` or ``tms``."""
    to_tile = {"geodetic": geo.lonlat_to_geodetic, "xyz": geo.lonlat_to_xyz, "tms": geo.lonlat_to_tms}[scheme]
    low, high = to_tile(b.west, b.south, z), to_tile(b.east, b.north, z)
    return rectangle(low.x, F.least(low.y, high.y), high.x, F.greatest(low.y, high.y))


def descendants(x: Column, y: Column, z: Column, max_z: Column) -> Column:
    """For each level below, the ranges of descendants: array<array<struct>>; empty at the last level."""
    def level(d):
        n = F.call_function("shiftleft", F.lit(1).cast("long"), d)
        return F.array(metadata_range(x * n, y * n, (x + 1) * n - 1, (y + 1) * n - 1))

    return F.when(max_z > z, F.transform(F.sequence(F.lit(1), (max_z - z).cast("int")), level)).otherwise(F.array().cast("array<array<struct<startX:bigint,endX:bigint,startY:bigint,endY:bigint>>>"))


def available(tiles: DataFrame) -> DataFrame:
    """z, start_x, start_y, end_x, end_y of the tiles(z, x, y) that exist."""
    return tiles.groupBy("z").agg(F.min("x").alias("start_x"), F.min("y").alias("start_y"), F.max("x").alias("end_x"), F.max("y").alias("end_y"))


def collapsed_mask(values: Column) -> Column:
    """Struct kind, uniform, grid of water-mask values: one value for all if they are equal; too few count as land."""
    some = F.slice(values, 1, MASK_BYTES)
    short = F.size(values) < MASK_BYTES
    flat = F.array_min(some) == F.array_max(some)
    return F.struct(F.when(short | flat, "uniform").otherwise("grid").alias("kind"), F.when(short, 0).when(flat, F.array_min(some)).alias("uniform"), F.when(~short & ~flat, some).alias("grid"))


def collapsed(least: Column, most: Column) -> Column:
    """Struct kind, uniform of a mask of which only the least and the most value are known, as aggregates give them."""
    return F.struct(F.when(least == most, "uniform").otherwise("grid").alias("kind"), F.when(least == most, least).alias("uniform"))


def manifest(available_levels: Column, minzoom: Column, maxzoom: Column, bounds: Column, extensions: Column, metadata_availability: Column | None = None, attribution: Column | None = None, scheme: str = "tms", terrain: str = "mesh") -> Column:
    """The manifest as JSON text; what is null or empty is left out."""
    d = MANIFEST_DEFAULTS
    full = lambda c: F.when(F.size(c) > 0, c)
    fields = {
        "tilejson": F.lit(d["tilejson"]), "format": F.lit(TERRAIN_FORMATS[terrain]), "version": F.lit(d["version"]), "scheme": F.lit(scheme), "tiles": F.array(F.lit(d["tile"])),
        "available": full(available_levels), "attribution": attribution if attribution is not None else F.lit(None).cast("string"), "minzoom": minzoom, "maxzoom": maxzoom, "bounds": bounds,
        "extensions": full(extensions), "metadataAvailability": metadata_availability if metadata_availability is not None else F.lit(None).cast("int"),
    }
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"pretty": "true"})


MANIFEST_SCHEMA = "tilejson string, format string, version string, scheme string, tiles array<string>, available array<array<struct<startX:bigint,startY:bigint,endX:bigint,endY:bigint>>>, attribution string, minzoom int, maxzoom int, bounds array<double>, extensions array<string>, metadataAvailability int"


def read_manifest(text: Column) -> Column:
    """A manifest from JSON; unknown keys are ignored, missing lists are empty."""
    m = F.from_json(text, MANIFEST_SCHEMA)
    return m.withField("available", F.coalesce(m.available, F.array())).withField("extensions", F.coalesce(m.extensions, F.array()))
