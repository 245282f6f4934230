"""Mercator rasters to geodetic grids: covering tiles, bilinear samples by an equi-join on tile keys, halo padding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..sources.tilebytes import lists, slices
from . import kernels
from .normals import blend


def covering(b: Column, z: Column) -> Column:
    """Struct x0, y0, tiles_x, tiles_y of the XYZ tiles over a box; edges are inclusive."""
    nw, se = geo.lonlat_to_xyz(b.west, b.north, z), geo.lonlat_to_xyz(b.east, b.south, z)
    return F.struct(nw.x.alias("x0"), nw.y.alias("y0"), (se.x - nw.x + 1).alias("tiles_x"), (se.y - nw.y + 1).alias("tiles_y"))


def _axis(value: Column, low: Column, high: Column) -> Column:
    """Struct p0, p1, t of a pixel position: neighbours clamped to the block, and the way between them."""
    i = F.floor(value).cast("long")
    clamp = lambda p: F.greatest(low, F.least(p, high))
    return F.struct(clamp(i).alias("p0"), clamp(i + 1).alias("p1"), (value - i).alias("t"))


def pixel_axes(lon: Column, lat: Column, z: Column, tile_size: int, block: Column) -> tuple[Column, Column]:
    """Positions along both axes; ``block`` has the inclusive pixel limits x_lo, x_hi, y_lo, y_hi."""
    world = geo.tile_count(z) * tile_size
    return _axis((lon + 180) / 360 * world - 0.5, block.x_lo, block.x_hi), _axis(geo.mercator_fraction(lat) * world - 0.5, block.y_lo, block.y_hi)


def sample(points: DataFrame, rasters: DataFrame, tile_size: int, keys: list[str], zoom: str = "z") -> DataFrame:
    """``points`` (keys, ``zoom``, structs ``ax`` and ``ay``) with ``h`` from rasters(z, x, y, heights); tiles that are missing count as NaN.

    A point joins the tiles that hold its four pixels, one as a rule and four at most, and an aggregate by its keys
    brings the pixels together. A raster has one row for each tile.
    """
    corners = [(i, F.col(f"ax.{x}"), F.col(f"ay.{y}")) for i, (x, y) in enumerate((x, y) for y in ("p0", "p1") for x in ("p0", "p1"))]
    tile_of = lambda p: F.floor(p / tile_size).cast("long")
    tiles = F.array_distinct(F.array(*[F.struct(tile_of(px).alias("x"), tile_of(py).alias("y")) for _, px, py in corners]))
    asked = points.withColumn("_t", F.explode(tiles)).withColumn("_x", F.col("_t.x")).withColumn("_y", F.col("_t.y")).drop("_t")
    found = asked.join(rasters.select(F.col("z").alias(zoom), F.col("x").cast("long").alias("_x"), F.col("y").cast("long").alias("_y"), F.col("heights").alias("_grid")), [zoom, "_x", "_y"], "left")
    here = lambda px, py: F.when((tile_of(px) == F.col("_x")) & (tile_of(py) == F.col("_y")), F.get("_grid", ((py % tile_size) * tile_size + px % tile_size).cast("int")).cast("double"))
    picked = found.select(*points.columns, *[here(px, py).alias(f"_h{i}") for i, px, py in corners])
    rest = [c for c in points.columns if c not in keys]
    one = picked.groupBy(*keys).agg(*[F.first(c).alias(c) for c in rest], *[F.max(f"_h{i}").alias(f"_h{i}") for i, _, _ in corners])
    h = [F.coalesce(f"_h{i}", F.lit(float("nan"))) for i in range(4)]
    return one.withColumn("h", blend(blend(h[0], h[1], F.col("ax.t")), blend(h[2], h[3], F.col("ax.t")), F.col("ay.t"))).drop("_h0", "_h1", "_h2", "_h3")


def geodetic_posts(boxes: DataFrame, grid_size: int, buffer: int = 0) -> DataFrame:
    """``boxes`` with one row for each post: gx, gy (from -buffer), lon, lat; rows from north to south."""
    if grid_size < 2:
        raise ValueError("a grid needs two posts a side at least")
    span = F.sequence(F.lit(-buffer), F.lit(grid_size - 1 + buffer))
    b, n = F.col("bounds"), grid_size - 1
    rows = boxes.withColumn("gy", F.explode(span)).withColumn("lat", b.north - F.col("gy") * (geo.height(b) / n))
    return rows.withColumn("gx", F.explode(span)).withColumn("lon", b.west + F.col("gx") * (geo.width(b) / n))


def _blocks(boxes: DataFrame, grid_size: int, keys: list[str], buffer: int) -> DataFrame:
    """keys, ``bounds``, ``_z`` and the block ``c`` of each box, with a row for each of its raster tiles, tx and ty."""
    b, n = F.col("bounds"), grid_size - 1
    wide = geo.bounds(b.west - geo.width(b) / n * buffer, b.south - geo.height(b) / n * buffer, b.east + geo.width(b) / n * buffer, b.north + geo.height(b) / n * buffer)
    asked = boxes.select(*keys, "bounds", F.col("z").alias("_z"), covering(wide, F.col("z")).alias("c"))
    return asked.withColumn("tx", F.explode(F.expr("sequence(c.x0, c.x0 + c.tiles_x - 1)"))).withColumn("ty", F.explode(F.expr("sequence(c.y0, c.y0 + c.tiles_y - 1)")))


def under(boxes: DataFrame, rasters: DataFrame, grid_size: int, buffer: int = 0) -> DataFrame:
    """The rows of ``rasters`` (z, x, y, any others) that ``geodetic_grids`` takes for ``boxes``, each once, dealt by these keys.

    So what is costly a raster, such as decoding, comes after this, in a stage of its own and only for these.
    """
    if grid_size < 2:
        raise ValueError("a grid needs two posts a side at least")
    asked = _blocks(boxes, grid_size, [], buffer).select(F.col("_z").alias("z"), F.col("tx").alias("x"), F.col("ty").alias("y"))
    whole = rasters.withColumn("x", F.col("x").cast("long")).withColumn("y", F.col("y").cast("long"))
    return whole.join(asked, ["z", "x", "y"], "left_semi").repartition("z", "x", "y")


def geodetic_grids(boxes: DataFrame, rasters: DataFrame, tile_size: int, grid_size: int, keys: list[str], buffer: int = 0) -> DataFrame:
    """``boxes`` (keys, ``bounds``, ``z``) with ``heights`` at grid_size² posts and, with a ``buffer``, ``halo`` at (grid_size + 2 buffer)², north to south.

    Heights come from mercator rasters(z, x, y, heights of tile_size²) of the box's zoom. The block of a box is its
    covering tiles, with those under the buffer; places beyond it take its edge, tiles that are missing are NaN. One
    join on the tile key and one aggregate by box bring a block together; its axes are then computed once a row and
    once a column.
    """
    if grid_size < 2:
        raise ValueError("a grid needs two posts a side at least")
    if tile_size < 1:
        raise ValueError("a raster tile needs pixels")
    asked = _blocks(boxes, grid_size, keys, buffer)
    source = rasters.select(F.col("z").alias("_z"), F.col("x").cast("long").alias("tx"), F.col("y").cast("long").alias("ty"), F.transform("heights", lambda h: F.coalesce(h.cast("double"), F.lit(float("nan")))).alias("grid"))
    tile = F.struct("tx", "ty", F.coalesce("grid", F.array().cast("array<double>")).alias("grid"))
    blocks = asked.join(source, ["_z", "tx", "ty"], "left").groupBy(*keys).agg(F.first("bounds").alias("bounds"), F.first("_z").alias("_z"), F.first("c").alias("c"), F.collect_list(tile).alias("tiles"))

    def run(batches):
        side = grid_size + 2 * buffer
        column = lambda rows, size: pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * size * size, pa.int32()), pa.array(np.concatenate(rows), pa.float64()))
        for batch in batches:
            for _, some in slices(batch, side * side):
                inner, outer = [], []
                made = zip(some["bounds"].to_pylist(), some["_z"].to_pylist(), some["c"].to_pylist(), some["tiles"], strict=True)
                for bounds, z, block, tiles in made:
                    whole = np.full((block["tiles_y"] * tile_size, block["tiles_x"] * tile_size), np.nan)
                    parts = tiles.values
                    for x, y, grid in zip(parts.field("tx").to_pylist(), parts.field("ty").to_pylist(), lists(parts.field("grid")), strict=True):
                        if len(grid) not in (0, tile_size * tile_size):
                            raise ValueError(f"a raster tile has {len(grid)} samples, not {tile_size * tile_size}")
                        if len(grid):
                            i, j = (x - block["x0"]) * tile_size, (y - block["y0"]) * tile_size
                            whole[j : j + tile_size, i : i + tile_size] = grid.reshape(tile_size, tile_size)
                    box = tuple(bounds[k] for k in ("west", "south", "east", "north"))
                    h = kernels.resampled(whole, block["x0"] * tile_size, block["y0"] * tile_size, (1 << z) * tile_size, box, grid_size, buffer)
                    outer.append(h.ravel())
                    inner.append(h[buffer : buffer + grid_size, buffer : buffer + grid_size].ravel())
                more = [column(outer, side)] if buffer else []
                yield pa.RecordBatch.from_arrays([*[some[k] for k in keys], column(inner, grid_size), *more], [*keys, "heights", *["halo"] * bool(buffer)])

    grid = T.ArrayType(T.DoubleType())
    schema = T.StructType([*[boxes.schema[k] for k in keys], T.StructField("heights", grid), *[T.StructField("halo", grid)] * bool(buffer)])
    return boxes.join(blocks.mapInArrow(run, schema), keys)


def padded(tiles: DataFrame, size: int, keys: list[str] | None = None) -> DataFrame:
    """tiles(keys, x, y, heights of size²) with ``heights`` of (size+1)²: the first posts of the neighbours to the east and south, or the own edge again.

    ``keys`` name what tiles must share to be neighbours, such as a zoom. A tile sends only its first column, first
    row and first post; one aggregate by tile brings these together.
    """
    keys, own, last = keys or [], F.col("heights"), size - 1
    column = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda j: F.get(own, j * size))
    sent = lambda dx, dy, name, v: F.struct((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.lit(name).alias("side"), v.alias("v"))
    parts = tiles.select(*keys, F.explode(F.array(sent(1, 0, "e", column), sent(0, 1, "s", F.slice(own, 1, size)), sent(1, 1, "se", F.slice(own, 1, 1)))).alias("p"))
    met = parts.groupBy(*keys, "p.x", "p.y").agg(*[F.max(F.when(F.col("p.side") == side, F.col("p.v"))).alias(f"_{side}") for side in ("e", "s", "se")])
    out = tiles.join(met, [*keys, "x", "y"], "left")
    row = lambda j: F.concat(F.slice(own, j * size + 1, F.lit(size)), F.array(F.coalesce(F.get(F.col("_e"), j), F.get(own, j * size + last))))
    body = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(last)), row))
    below = F.concat(F.coalesce(F.col("_s"), F.slice(own, last * size + 1, size)), F.array(F.coalesce(F.get(F.col("_se"), F.lit(0)), F.get(F.col("_s"), F.lit(last)), F.get(F.col("_e"), F.lit(last)), F.get(own, F.lit(size * size - 1)))))
    return out.withColumn("heights", F.concat(body, below)).drop("_e", "_s", "_se")


def halo(tiles: DataFrame, size: int, buffer: int, keys: list[str] | None = None) -> DataFrame:
    """tiles(keys, x, y, heights of size²) with ``halo``: (size + 1 + 2 buffer)² posts from the eight neighbours, y growing to the south.

    ``keys`` name what tiles must share to be neighbours, such as a zoom.

    Where the diagonal neighbour is missing, the nearest post of the one to the north or south counts, then of the
    one to the west or east, then of the tile itself.
    """
    if not 0 <= buffer < size:
        raise ValueError("the halo ends inside the next tile")
    step = lambda name: F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias(name)
    keys = keys or []
    sent = tiles.select(*keys, "x", "y", "heights", step("dx")).select("*", step("dy"))
    near = sent.groupBy(*keys, (F.col("x") - F.col("dx")).alias("x"), (F.col("y") - F.col("dy")).alias("y")).agg(F.collect_list(F.struct(((F.col("dy") + 1) * 3 + F.col("dx") + 1).alias("o"), F.col("heights").alias("h"))).alias("n"))
    nine = lambda n: F.transform(F.sequence(F.lit(0), F.lit(8)), lambda o: F.get(F.filter(n, lambda e: e.o == o), F.lit(0)).h)

    def post(t, x, y):
        last = size - 1
        side = lambda v: -1 if v < 0 else 1 if v >= size else 0
        inside = lambda v: max(0, min(v, last))
        dx, dy = side(x), side(y)
        at = lambda ex, ey: F.get(F.get(t, F.lit((ey + 1) * 3 + ex + 1)), F.lit((y - ey * size if ey == dy else inside(y)) * size + (x - ex * size if ex == dx else inside(x))))
        return F.coalesce(*[at(*e) for e in dict.fromkeys(((dx, dy), (0, dy), (dx, 0), (0, 0)))])

    span = range(-buffer, size + 1 + buffer)
    made = F.transform(F.array(nine(F.col("n"))), lambda t: F.array(*[post(t, x, y) for y in span for x in span]))
    return tiles.join(near, [*keys, "x", "y"]).withColumn("halo", F.get(made, F.lit(0))).drop("n")
