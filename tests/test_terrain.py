"""Every registered query against its SQL oracle at the smallest scale, and the byte codecs by round trips."""

import math
import random
import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkrelief import queries
from sparkrelief.functions import codec, geo, rgb
from sparkrelief.operators import avail, kernels, normals, resample, rtin
from sparkrelief.plans import encode
from sparkrelief.sources import datasource, files, png, tilebytes
from sparkrelief.streaming import arrivals

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    r = duck.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in r.description].index(c) for c in cols]
    assert got == sorted(str(tuple(x[i] for i in at)) for x in r.fetchall())


@pytest.mark.parametrize("cells", [2, 4, 16])
def test_tree_equals_recursion(cells):
    """The filter form against plain recursion on random heights."""
    rng = random.Random(cells)
    side = cells + 1
    h = [rng.random() for _ in range(side * side)]
    rows, closed = rtin.triangle_tree(cells)
    own = [0 if r["mid"] is None else abs((h[r["a"]] + h[r["b"]]) / 2 - h[r["mid"]]) for r in rows]
    err = {p: max(own[i] for i in s) for p, s in closed.items()}
    kept = {(r["a"], r["b"], r["c"]) for r in rows if (r["parent_mid"] is None or err[r["parent_mid"]] > 0.4) and (r["mid"] is None or err[r["mid"]] <= 0.4)}
    found = set()

    def split(a, b, c):
        m = ((a[0] + b[0]) // 2, (a[1] + b[1]) // 2)
        at = lambda p: p[1] * side + p[0]
        if abs(a[0] - c[0]) + abs(a[1] - c[1]) > 1 and err[at(m)] > 0.4:
            split(c, a, m)
            split(b, c, m)
        else:
            found.add((at(a), at(b), at(c)))

    split((0, 0), (cells, cells), (cells, 0))
    split((cells, cells), (0, 0), (0, cells))
    assert kept == found
    with pytest.raises(ValueError):
        rtin.triangle_tree(6)


def test_tile_roundtrip_and_errors():
    head = {"center": dict(x=1.0, y=2.0, z=3.0), "min_height": 0.0, "max_height": 5.0, "sphere_center": dict(x=1.0, y=2.0, z=3.0), "sphere_radius": 9.0, "horizon_point": dict(x=0.0, y=0.0, z=1.0)}
    edges = {"west": [0, 2], "south": [0, 1], "east": [1, 3], "north": [2, 3]}
    args = (head, [0, 32767, 0, 32767], [0, 0, 32767, 32767], [0, 0, 0, 7], [0, 1, 2, 1, 3, 2], edges)
    for level in (0, 6):
        d = tilebytes.decode_tile(tilebytes.encode_tile(*args, normals=b"\1" * 8, mask=b"\xff", metadata='{"a":1}', level=level))
        assert (d["u"].tolist(), d["indices"].tolist(), {e: x.tolist() for e, x in d["edges"].items()}, d["header"]) == (args[1], args[4], edges, head)
        assert (d["normals"], d["mask"], d["metadata"]) == (b"\1" * 8, b"\xff", '{"a":1}')
    whole = tilebytes.encode_tile(*args)
    for bad in (b"short", whole[:100], whole[:-1], b"\x1f\x8bno"):
        with pytest.raises(tilebytes.TileError):
            tilebytes.decode_tile(bad)
    with pytest.raises(tilebytes.TileError, match="two bytes"):
        tilebytes.encode_tile(*args, normals=b"\1" * 7)
    # only what is asked for
    assert set(tilebytes.decode_tile(whole, {"v"})) == {"v"} and set(tilebytes.decode_tile(whole, {"metadata"})) == {"metadata"}


def test_extensions_that_are_cut_unknown_or_repeated():
    ext = lambda number, payload: struct.pack("<BI", number, len(payload)) + payload
    read = lambda data: tilebytes._extensions(data, 0, 2)
    none = {"normals": None, "mask": None, "metadata": None}
    assert read(b"") == read(b"\1\1") == read(ext(1, b"abcd")[:-1]) == read(ext(9, b"zz")) == none
    assert read(ext(9, b"zz") + ext(1, b"abcdEXTRA"))["normals"] == b"abcd"
    assert read(ext(1, b"abcd") + ext(1, b"wxyz"))["normals"] == b"wxyz"
    assert read(ext(2, b"abc"))["mask"] == b"\0"
    with pytest.raises(tilebytes.TileError):
        read(ext(4, struct.pack("<I", 9) + b"{}"))


def test_more_vertices_than_16_bits():
    n = 70_000
    u = np.arange(n) % 32768
    args = ({"center": dict(x=1.0, y=2.0, z=3.0), "min_height": 0.0, "max_height": 5.0, "sphere_center": dict(x=1.0, y=2.0, z=3.0), "sphere_radius": 9.0, "horizon_point": dict(x=0.0, y=0.0, z=1.0)}, u, u, u, np.arange(69_999), {e: [n - 1] for e in tilebytes.EDGES})
    d = tilebytes.decode_tile(tilebytes.encode_tile(*args, level=1))
    assert (d["u"] == u).all() and (d["indices"] == args[4]).all() and d["edges"]["north"].tolist() == [n - 1]


def test_png():
    data = bytes(random.Random(1).randrange(256) for _ in range(4 * 6 * 4))
    rgb, w, h = png.read_png(png.write_png(data, 6, 4, 4))
    assert (w, h) == (6, 4) and rgb == bytes(x for i, x in enumerate(data) if i % 4 < 3)
    with pytest.raises(png.Unsupported):
        png.write_container("image/webp", data, 6, 4, 4)


def test_u16_bytes(spark):
    rows = [([4096, 300, 0, 65535],), ([],)]
    made = spark.createDataFrame(rows, "v array<int>").select("v", codec.u16_bytes(F.col("v")).alias("c"))
    back = made.select("v", "c", codec.u16_values(F.col("c")).alias("b"), codec.u16_values(F.concat("c", F.unhex(F.lit("07")))).alias("odd")).collect()
    assert all(r.b == r.v == r.odd for r in back) and bytes(back[0].c) == b"\x00\x10\x2c\x01\0\0\xff\xff"
    with pytest.raises(Exception, match="at least 5"):
        made.select(codec.u16_bytes(F.col("v"), 5)).collect()


def _grids(spark, n=2):
    """Tiles of 5 by 5 posts with a spike in each."""
    rows = [(k, 3, k, 1, [float(k * 10 + (i == 12) * 900) for i in range(25)]) for k in range(n)]
    t = spark.createDataFrame(rows, "k long, z int, x int, y int, heights array<double>")
    return t.withColumn("bounds", geo.geodetic_bounds(F.col("x").cast("long"), F.col("y").cast("long"), F.col("z")))


def test_normals_reach_the_bytes(spark):
    """Face and gradient normals of tiles, decoded again, point out of the ellipsoid."""
    halo = F.array_repeat(F.lit(7.0), 49)
    for mode in ("face", "gradient"):
        made = encode.encode_terrain(_grids(spark).withColumn("halo", halo), 4, ["z", "x", "y"], encode.Options(max_error=5.0, normals=mode))
        for r in made.collect():
            d = tilebytes.decode_tile(r["content"])
            assert len(d["normals"]) == 2 * len(d["u"]) > 8
            c = d["header"]["center"]
            c = [c[x] for x in "xyz"]
            # a flat halo gives the up vector; of a gentle spike's faces all still face outwards
            for a, b in zip(d["normals"][::2], d["normals"][1::2], strict=True):
                x, y = a / 255 * 2 - 1, b / 255 * 2 - 1
                z = 1 - abs(x) - abs(y)
                if z < 0:
                    x, y = (1 - abs(y)) * (1 if x >= 0 else -1), (1 - abs(x)) * (1 if y >= 0 else -1)
                assert sum(p * q for p, q in zip((x, y, z), c, strict=True)) > 0
    with pytest.raises(ValueError):
        encode.Options(normals="other")


def test_tile_tree(spark, tmp_path):
    tiles = encode.encode_terrain(_grids(spark), 4, ["z", "x", "y"], encode.Options(max_error=5.0))
    files.write_tree(tiles, str(tmp_path / "tree"))
    key = lambda df: sorted((r.z, r.x, r.y, bytes(r.content)) for r in df.select("z", "x", "y", "content").collect())
    assert key(files.read_tree(spark, str(tmp_path / "tree"))) == key(tiles)
    files.write_table(tiles, str(tmp_path / "table"))
    assert key(spark.read.parquet(str(tmp_path / "table"))) == key(tiles)


def test_stream_equals_batch(spark, tmp_path):
    """Tiles that arrive in two lots, with a restart between them, give the rows of the batch plan, once each."""
    grids, source, sink = _grids(spark, 4), str(tmp_path / "in"), str(tmp_path / "out")
    for part in ("k < 2", "k >= 2"):
        grids.where(part).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(grids.schema).parquet(source)
        arrivals.encode_stream(arriving, 4, ["k"], sink, str(tmp_path / "log"), encode.Options(max_error=5.0)).awaitTermination(120)
    key = lambda df: sorted((r.k, bytes(r.content)) for r in df.collect())
    assert key(spark.read.parquet(sink)) == key(encode.encode_terrain(grids, 4, ["k"], encode.Options(max_error=5.0)))


def test_manifest_roundtrip(spark):
    m = spark.range(1).select(avail.manifest(F.array().cast("array<array<struct<startX:bigint>>>"), F.lit(0), F.lit(3), F.array(F.lit(0.0)), F.array().cast("array<string>")).alias("t"))
    text = m.first().t
    assert "available" not in text and "attribution" not in text
    back = m.select(avail.read_manifest(F.col("t")).alias("m")).select("m.*").first()
    assert (back.maxzoom, back.available, back.extensions, back.scheme) == (3, [], [], "tms")


def _height_at(pixels, gx, gy):
    """Brute force: bilinear height in a dict of (px, py), clamped to its limits; NaN gives way."""
    lim = [(min(a), max(a)) for a in zip(*pixels)]
    cl = lambda v, k: max(lim[k][0], min(v, lim[k][1]))
    mix = lambda a, b, t: b if math.isnan(a) else a if math.isnan(b) else a + (b - a) * t
    ix, iy = math.floor(gx), math.floor(gy)
    at = lambda i, j: pixels.get((cl(ix + i, 0), cl(iy + j, 1)), math.nan)
    return mix(mix(at(0, 0), at(1, 0), gx - ix), mix(at(0, 1), at(1, 1), gx - ix), gy - iy)


def _pixel_position(lon, lat, world=1024):
    return (lon + 180) / 360 * world - 0.5, (1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * world - 0.5


def _written_tiles(spark, folder, ids):
    """embeddings with the tiles ``ids``, and their pixels."""
    rng = random.Random(3)
    rows = [(v, [rng.randrange(-500, 500) / 1000 for _ in range(64)]) for v in ids]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{folder}/embeddings.parquet")
    return {(v % 20 * 8 + i % 8, v // 20 * 8 + i // 8): 1000 * e for v, h in rows for i, e in enumerate(h)}


def test_mercator_sample_uses_all_tiles(spark, tmp_path):
    """More than 500 tiles, with ten rows of tiles missing: the block has all of them, and points without pixels stay."""
    pixels = _written_tiles(spark, tmp_path, [v for v in range(1400) if not 30 <= v // 20 < 40])
    spark.createDataFrame([(k,) for k in range(1, 151)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.k: r.h for r in queries.mercator_sample(spark, str(tmp_path)).collect()}
    want = {k: _height_at(pixels, *_pixel_position(k * 2654435761 % 3600001 / 10000 - 180, k * 40503 % 1700001 / 10000 - 85)) for k in range(1, 151)}
    assert sum(map(math.isnan, want.values())) > 0 and got == pytest.approx(want, abs=2e-3, nan_ok=True)


def test_rasters_become_tiles(spark, tmp_path):
    """Tile bytes from images equal those from grids and halos sampled by brute force, at two zooms, with a raster tile missing."""
    pixels = {7: _written_tiles(spark, tmp_path, [v for v in range(600) if v != 45])}
    pixels[6] = {p: h / 2 + 100 for p, h in pixels[7].items()}
    spark.createDataFrame([(k,) for k in range(3)], "n_nationkey int").write.parquet(f"{tmp_path}/nation.parquet")
    boxes, options = queries._boxes(spark, str(tmp_path)), encode.Options(max_error=50.0, normals="gradient")
    rows = []
    for r in boxes.collect():
        world = 8 << r.z

        def at(n, b):
            edge = lambda lon, lat: [math.floor(v + 0.5) // 8 for v in _pixel_position(lon, lat, world)]  # noqa: E731, B023
            (x0, y0), (x1, y1) = edge(b.west - n * 0.25, b.north + n * 0.25), edge(b.east + n * 0.25, b.south - n * 0.25)
            block = {(x, y): pixels[r.z].get((x, y), math.nan) for x in range(x0 * 8, x1 * 8 + 8) for y in range(y0 * 8, y1 * 8 + 8)}  # noqa: B023
            return [_height_at(block, *_pixel_position(b.west + i * 0.25, b.north - j * 0.25, world)) for j in range(-n, 9 + n) for i in range(-n, 9 + n)]  # noqa: B023

        halo = at(1, r.bounds)
        rows.append((r.k, r.z, tuple(r.bounds), [halo[j * 11 + i] for j in range(1, 10) for i in range(1, 10)], halo))
    grids = spark.createDataFrame(rows, "k long, z int, bounds struct<west:double,south:double,east:double,north:double>, heights array<double>, halo array<double>")
    made = encode.encode_rasters(boxes, queries._rasters(spark, str(tmp_path)), 8, 8, ["k", "z"], options)
    parts = lambda df: {(r.k, r.z): {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in tilebytes.decode_tile(r.content, {"u", "v", "height", "indices", "normals"}).items()} for r in df.collect()}
    assert parts(made) == parts(encode.encode_terrain(grids, 8, ["k", "z"], options)) and made.count() == 6
    images = png.height_images(queries._rasters(spark, str(tmp_path)), ["z", "x", "y"], "terrarium", 8)
    report = encode.verified(encode.reproject(boxes, images, 8, 8, ["k", "z"], options), ["k", "z"]).collect()
    assert len(report) == 6 and all(r.corrupt is None and r.vertices >= 4 and r.normal_bytes == 2 * r.vertices for r in report)
    with pytest.raises(Exception, match="samples, not 256"):
        encode.encode_rasters(boxes, queries._rasters(spark, str(tmp_path)), 16, 8, ["k", "z"], options).collect()


def test_steps_of_the_whole_job_make_few_tiles_at_once(spark, monkeypatch):
    """The memory of each Arrow step does not follow the rows of a batch, and parts of batches change no result."""
    box, vec = "struct<west:double,south:double,east:double,north:double>", {"west": 10.0, "south": 20.0, "east": 11.0, "north": 21.0}
    frame = lambda schema: spark.createDataFrame([], schema)
    runs, whole = [], type(frame("k int")).mapInArrow
    monkeypatch.setattr(type(frame("k int")), "mapInArrow", lambda self, run, *more: runs.append(run) or whole(self, run, *more))
    png.height_images(frame("k long, heights array<double>"), ["k"], "terrarium", 256)
    png.image_heights(frame("k long, content binary"), ["k"], "terrarium", 256)
    resample.geodetic_grids(frame(f"k long, z int, bounds {box}"), frame("z int, x int, y int, heights array<double>"), 8, 65, ["k"], 1)
    encode.encode_terrain(frame(f"k long, bounds {box}, heights array<double>, halo array<double>"), 64, ["k"], encode.Options(max_error=1e9, normals="gradient"))
    tilebytes.decode_tiles(frame("k long, content binary"), ["k"])
    rng = np.random.default_rng(4)
    image, fine = rng.uniform(0, 900, 65536), rng.uniform(0, 900, 65 * 65)
    parts = kernels.tile(fine, kernels.triangles(64).errors(fine[None])[0], tuple(vec.values()), 64, 0.0)
    rows = [
        (8, {"heights": image}),
        (8, {"content": png.write_png(rgb.encode("terrarium", image).tobytes(), 256, 256)}),
        (64, {"bounds": vec, "_z": 5, "c": {"x0": 16, "y0": 14, "tiles_x": 1, "tiles_y": 1}, "tiles": [{"tx": 16, "ty": 14, "grid": image[:64]}]}),
        (64, {"bounds": vec, "heights": fine, "halo": rng.uniform(0, 900, 67 * 67)}),
        (8, {"content": tilebytes.encode_tile(**{"head" if k == "header" else k: v for k, v in parts.items()})}),
    ]
    for run, (n, row) in zip(runs, rows, strict=True):
        peaks = []
        for count in (n, n, 8 * n):  # the first for what is made once
            batch = pa.RecordBatch.from_pylist([{"k": k} | row for k in range(count)])
            tracemalloc.start()
            keys = [k for out in run([batch]) for k in out["k"].to_pylist()]
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
            assert keys == list(range(count))
        assert peaks[2] < 2 * peaks[1], (list(row), peaks)
        each = [x for k in range(batch.num_rows) for out in run([batch.slice(k, 1)]) for x in out.to_pylist()] if "content" not in row else []
        assert not each or str(each) == str([x for out in run([batch]) for x in out.to_pylist()])


def test_only_images_under_a_box_are_decoded(spark):
    """An image that no box asks for has no part in the work; one that two boxes share is decoded once."""
    good = png.write_png(rgb.encode("terrarium", np.arange(64.0)).tobytes(), 8, 8)
    boxes = spark.createDataFrame([(1, 5, (10.0, 20.0, 20.0, 30.0)), (2, 5, (12.0, 20.0, 22.0, 30.0))], "k long, z int, bounds struct<west:double,south:double,east:double,north:double>")
    images = spark.createDataFrame([(z, x, y, good if z == 5 and x < 24 else b"no image") for z in (4, 5) for x in range(32) for y in range(32)], "z int, x int, y int, content binary")
    options = encode.Options(max_error=5.0, normals="gradient")
    want = encode.encode_rasters(boxes, png.image_heights(images.where("z = 5 AND x < 24"), ["z", "x", "y"], "terrarium", 8), 8, 8, ["k"], options)
    tiles = lambda df: {r.k: bytes(r.content) for r in df.collect()}
    got = tiles(encode.reproject(boxes, images, 8, 8, ["k"], options))
    assert got == tiles(want) and len(got) == 2
    asked = [(r.z, r.x, r.y) for r in resample.under(boxes, images, 9, 1).collect()]
    assert len(asked) == len(set(asked)) > 4 and {z for z, _, _ in asked} == {5}
    with pytest.raises(Exception, match="not a PNG"):
        encode.reproject(boxes, images.withColumn("content", F.lit(b"no image")), 8, 8, ["k"], options).collect()


def test_grid_of_a_flat_raster_is_flat(spark):
    rasters = spark.createDataFrame([(5, x, y, [42.0] * 16) for x in range(32) for y in range(32)], "z int, x int, y int, heights array<double>")
    boxes = spark.createDataFrame([(1, 5, (10.0, 20.0, 20.0, 30.0)), (2, 5, (-180.0, -90.0, 180.0, 90.0))], "k int, z int, bounds struct<west:double,south:double,east:double,north:double>")
    for r in resample.geodetic_grids(boxes, rasters, 4, 17, ["k"], 2).collect():
        assert set(r.heights) == set(r.halo) == {42.0} and (len(r.heights), len(r.halo)) == (289, 441)
        inner = [r.halo[j * 21 + i] for j in range(2, 19) for i in range(2, 19)]
        assert inner == r.heights


def test_padding_keeps_zooms_apart(spark):
    rows = [(z, x, y, [float(z * 1000 + x * 100 + y * 10 + i) for i in range(4)]) for z in (3, 4) for x in range(2) for y in range(2)]
    got = {(r.z, r.x, r.y): r.heights for r in resample.padded(spark.createDataFrame(rows, "z int, x long, y long, heights array<double>"), 2, ["z"]).collect()}
    assert len(got) == 8 and got[4, 0, 0] == [4000, 4001, 4100, 4002, 4003, 4102, 4010, 4011, 4110] and got[3, 1, 1] == [3110, 3111, 3111, 3112, 3113, 3113, 3112, 3113, 3113]


@pytest.mark.parametrize("cells, normals", [(4, "face"), (8, "gradient"), (16, "none")])
def test_kernels_equal_columns(spark, cells, normals):
    """Tile bytes by numpy kernels and by column forms, with heights that are missing."""
    rng, side = random.Random(cells), cells + 1
    grid = lambda n: [math.nan if rng.random() < 0.02 else rng.uniform(-50, 900) for _ in range(n)]
    rows = [(k, (10.0 + k, 20.0, 11.0 + k, 21.0), grid(side * side), grid((side + 2) ** 2)) for k in range(3)] + [(9, (0.0, 89.0, 1.0, 90.0), [5.0] * (side * side), [5.0] * (side + 2) ** 2)]
    tiles = spark.createDataFrame(rows, "k long, bounds struct<west:double,south:double,east:double,north:double>, heights array<double>, halo array<double>")
    options = encode.Options(max_error=60.0, normals=normals)
    a, b = ({r.k: tilebytes.decode_tile(r.content) for r in made.collect()} for made in (encode.encode_terrain(tiles, cells, ["k"], options), encode.encode_columns(tiles, cells, ["k"], options)))
    assert a.keys() == b.keys()
    for k in a:
        for name in ("u", "v", "height", "indices"):
            assert a[k][name].tolist() == b[k][name].tolist(), name
        assert {e: x.tolist() for e, x in a[k]["edges"].items()} == {e: x.tolist() for e, x in b[k]["edges"].items()}
        flat = lambda h: [x for v in h.values() for x in (v.values() if isinstance(v, dict) else [v])]
        assert flat(a[k]["header"]) == pytest.approx(flat(b[k]["header"]), rel=1e-9, nan_ok=True)
        if normals != "none":
            # bytes may differ by one where a float is at the edge of a step
            assert np.abs(np.frombuffer(a[k]["normals"], np.uint8).astype(int) - np.frombuffer(b[k]["normals"], np.uint8)).max() <= 1


@pytest.mark.parametrize("cells", [64, 256])
def test_large_grids(cells):
    """Against plain recursion on rough heights; the triangles cover the grid; a plane needs two."""
    rng = np.random.default_rng(cells)
    side, tri = cells + 1, kernels.triangles(cells)
    h = np.cumsum(np.cumsum(rng.normal(size=(side, side)), 0), 1).ravel()
    err = tri.errors(h[None])[0]
    assert len(tri.mesh(tri.errors(np.add.outer(np.arange(side) * 3.0, np.arange(side) * 2.0).reshape(1, -1))[0], 0.01)[1]) == 6
    limit = float(np.quantile(err, 0.9))
    posts, idx = tri.mesh(err, limit)
    t = posts[idx].reshape(-1, 3)
    x, y = t % side, t // side
    area = np.abs((x[:, 1] - x[:, 0]) * (y[:, 2] - y[:, 0]) - (x[:, 2] - x[:, 0]) * (y[:, 1] - y[:, 0]))
    assert area.sum() == 2 * cells * cells and area.min() > 0
    own = {}

    def error(a, b, c):
        """The error of a triangle's midpoint with all below it; both triangles of a midpoint count."""
        if abs(a[0] - c[0]) + abs(a[1] - c[1]) <= 1:
            return 0.0
        m = ((a[0] + b[0]) // 2, (a[1] + b[1]) // 2)
        at = lambda p: p[1] * side + p[0]
        own[at(m)] = max(error(c, a, m), error(b, c, m), own.get(at(m), 0.0), abs((h[at(a)] + h[at(b)]) / 2 - h[at(m)]))
        return own[at(m)]

    if cells == 64:
        for _ in range(2 * 6):  # a midpoint on the seam of both halves needs the other half's first
            error((0, 0), (cells, cells), (cells, 0))
            error((cells, cells), (0, 0), (0, cells))
        assert all(err[p] == pytest.approx(e) for p, e in own.items())


def test_wrong_sizes_are_errors(spark):
    tiles = _grids(spark).withColumn("halo", F.array_repeat(F.lit(1.0), 48))
    with pytest.raises(Exception, match="halo needs 49"):
        encode.encode_terrain(tiles, 4, ["k"], encode.Options(normals="gradient")).collect()
    with pytest.raises(Exception, match="halo needs 49"):
        tiles.select(normals.gradient_normal(F.lit(0.5), F.lit(0.5), F.col("bounds"), F.col("halo"), 4, 1)).collect()
    with pytest.raises(Exception, match="grid needs 81"):
        encode.encode_terrain(tiles, 8, ["k"]).collect()
    packed = spark.createDataFrame([(bytearray(11),)], "c binary")
    with pytest.raises(Exception, match="not three for each pixel"):
        packed.select(codec.checked_rgb(F.col("c"), F.lit(2), F.lit(2))).collect()
    with pytest.raises(Exception, match="unknown height format"):
        packed.select(codec.format_name(F.lit("jpeg"))).collect()
    with pytest.raises(ValueError, match="unknown height format"):
        rgb.encode("jpeg", np.zeros(1))


@pytest.mark.parametrize("name", ["terrarium", "Mapbox-RGB", "gsi"])
def test_packed_heights_equal_columns(spark, name):
    values = [0.0, -0.004, 123.456, -9999.95, 8848.86, 32767.9, 1e9, -1e9, 1e30, -1e30, math.inf, -math.inf, math.nan]
    t = spark.createDataFrame([(values,)], "h array<double>").select(codec.encode_heights(codec.format_name(F.lit(name)), F.col("h")).alias("p"), codec.pack_rgb(codec.encode_heights(codec.format_name(F.lit(name)), F.col("h"))).alias("c"))
    row = t.select("c", codec.decode_heights(codec.format_name(F.lit(name)), codec.unpack_rgb(F.col("c"))).alias("back")).first()
    assert rgb.encode(name, np.array(values)).tobytes() == bytes(row.c)
    assert rgb.decode(name, np.frombuffer(bytes(row.c), np.uint8)).tolist() == pytest.approx(row.back, nan_ok=True)


def test_masks_and_container_names(spark):
    masks = [[7] * 65536, [7] * 65535 + [8], [7, 8], [9] * 70000]
    got = spark.createDataFrame([(i, m) for i, m in enumerate(masks)], "i int, v array<int>").coalesce(1).select("i", avail.collapsed_mask(F.col("v")).alias("m")).orderBy("i").collect()
    assert [(r.m.kind, r.m.uniform) for r in got] == [("uniform", 7), ("grid", None), ("uniform", 0), ("uniform", 9)] and got[1].m.grid == masks[1]
    names = spark.createDataFrame([("PNG",), ("image/webp",), ("avif",)], "n string")
    assert [r.c for r in names.select(codec.container_name(F.col("n")).alias("c")).collect()] == ["png", "webp", "avif"]
    with pytest.raises(Exception, match="unknown container"):
        names.select(codec.container_name(F.lit("gif"))).collect()


def test_octahedral_bytes_come_back():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(2000, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert (kernels.oct_vectors(kernels.oct_bytes(v)) * v).sum(1).min() > 0.999 and len(kernels.oct_vectors(b"\1\2\3")) == 1


def test_poles(spark):
    p = spark.createDataFrame([(0.0, 0.0, 6356752.314245179 + 100), (0.0, 0.0, -6356752.314245179), (0.0, 0.0, 0.0)], "x double, y double, z double").select(geo.ecef_to_geodetic(F.struct("x", "y", "z")).alias("g")).select("g.*").collect()
    assert p[0].lat == pytest.approx(90) and p[0].h == pytest.approx(100, abs=1e-3) and p[1].lat == pytest.approx(-90) and p[1].h == pytest.approx(0, abs=1e-3)


def test_data_source(spark, tmp_path):
    """Trees written and read by the data source; sections, bytes, bad files."""
    tiles, root = encode.encode_terrain(_grids(spark), 4, ["z", "x", "y"], encode.Options(max_error=5.0, normals="face")), str(tmp_path / "tree")
    spark.dataSource.register(datasource.TerrainSource)
    tiles.write.format("terrain").mode("append").save(root)
    read = lambda **o: spark.read.format("terrain").options(**o).load(root)
    assert sorted((r.z, r.x, r.y, bytes(r.content)) for r in read(sections="content").collect()) == sorted((r.z, r.x, r.y, bytes(r.content)) for r in tiles.collect())
    some = read(sections="u, header", tilesPerPartition="1")
    assert some.columns == ["z", "x", "y", "header", "u", "corrupt"] and some.rdd.getNumPartitions() == 2
    whole = {(r.x,): (r.u, r.indices, r.edges.west, len(r.normals)) for r in read().collect()}
    want = {(r.x,): tilebytes.decode_tile(r.content) for r in tiles.collect()}
    assert whole == {k: (d["u"].tolist(), d["indices"].tolist(), d["edges"]["west"].tolist(), len(d["normals"])) for k, d in want.items()}
    (tmp_path / "tree/3/0/9.terrain").write_bytes(b"no tile")
    assert [r.y for r in read(mode="PERMISSIVE", sections="u").where("corrupt is not null").collect()] == [9]
    with pytest.raises(Exception, match="not a tile"):
        read().collect()
    with pytest.raises(Exception, match="unknown sections"):
        read(sections="w").columns


@pytest.mark.parametrize("buffer", [1, 2])
def test_halo_of_neighbours(spark, buffer):
    """Halos of 3 by 3 tiles of 4 posts with a corner tile missing; whole neighbours give the posts of the raster."""
    tiles = {(x, y): [float((y * 4 + j) * 100 + x * 4 + i) for j in range(4) for i in range(4)] for x in range(3) for y in range(3) if (x, y) != (2, 2)}
    frame = spark.createDataFrame([(x, y, h) for (x, y), h in tiles.items()], "x int, y int, heights array<double>")
    got = {(r.x, r.y): r.halo for r in resample.halo(frame, 4, buffer).collect()}
    span, clamp = range(-buffer, 5 + buffer), lambda v: max(0, min(v, 11))
    raster = lambda x, y: [clamp(y * 4 + j) * 100.0 + clamp(x * 4 + i) for j in span for i in span]
    assert got.keys() == tiles.keys() and got[0, 0] == raster(0, 0) and got[0, 1] == raster(0, 1)
    # without the diagonal neighbour, the last column of the one to the south counts
    want = {(i, j): 100.0 * (4 + j) + 4 + i for i in span for j in span} | {(i, j): 100.0 * (4 + j) + 7 for i in span for j in span if i > 3 and j > 3}
    assert got[1, 1] == [want[i, j] for j in span for i in span]
