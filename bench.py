"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], and tile kernels at the published sizes; prints one JSON line.

Queries are timed after a warm-up of the session, once each. Kernels run over many tiles in all cores, so their
figures are seconds a tile on the whole machine; ``resample_257_per_post`` computes each post's place anew, as
before the hoisting of axes, to show what that saves.
"""

import json
import math
import os
import time

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkrelief import queries
from sparkrelief.functions import rgb
from sparkrelief.operators import kernels
from sparkrelief.plans import encode

HEADLINE = ("flagship", "rtin_mesh_counts", "decoded_vertices", "halo_pad", "mercator_sample", "tile_xyz_count", "ecef_roundtrip", "terrarium_codec", "delta_stream")
#: Tiles that a kernel runs over.
TILES = 64


def _kernels() -> dict:
    """Kernels of one tile, by name: a block of 4 by 4 raster tiles of 256 pixels to 257 posts a side, 512 by 512 pixels, 257 by 257 normals and meshes."""
    rng = np.random.default_rng(1)
    block = np.cumsum(rng.normal(size=(1024, 1024)), 1)
    world, x0, y0 = 256 << 12, 2048 * 256, 1400 * 256
    west, east = x0 / world * 360 - 180 + 0.05, (x0 + 1024) / world * 360 - 180 - 0.05
    lat = lambda y: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / world))))
    box = (west, lat(y0 + 1000), east, lat(y0 + 20))
    heights, packed = rng.uniform(0, 4000, 512 * 512), rgb.encode("terrarium", rng.uniform(0, 4000, 512 * 512))
    normals = rng.normal(size=(257 * 257, 3))
    normals /= np.linalg.norm(normals, axis=1, keepdims=True)
    octets, grid = kernels.oct_bytes(normals), block[:257, :257].ravel()

    def per_post():
        t = np.arange(257) / 256
        lon = np.repeat((west + t * (east - west))[None], 257, 0).ravel()
        phi = np.radians(np.repeat((box[3] - t * (box[3] - box[1]))[:, None], 257, 1).ravel())
        left, right, tx = kernels.axis((lon + 180) / 360 * world - 0.5, x0, x0 + 1023)
        up, down, ty = kernels.axis((1 - np.arcsinh(np.tan(phi)) / math.pi) / 2 * world - 0.5, y0, y0 + 1023)
        return kernels.blend(kernels.blend(block[up, left], block[up, right], tx), kernels.blend(block[down, left], block[down, right], tx), ty)

    def mesh():
        tri = kernels.triangles(256)
        return tri.mesh(tri.errors(grid[None])[0], 4.0)

    return {
        "resample_257": lambda: kernels.resampled(block, x0, y0, world, box, 257, 0), "resample_257_per_post": per_post, "resample_257_halo_4": lambda: kernels.resampled(block, x0, y0, world, box, 257, 4),
        "encode_512": lambda: rgb.encode("terrarium", heights), "decode_512": lambda: rgb.decode("terrarium", packed), "oct_encode_257": lambda: kernels.oct_bytes(normals), "oct_decode_257": lambda: kernels.oct_vectors(octets), "mesh_257": mesh,
    }


def _run(name: str):
    def batches(some):
        import pyarrow as pa

        kernel = _kernels()[name]
        kernel()
        for batch in some:
            start = time.perf_counter()
            for _ in range(batch.num_rows):
                kernel()
            yield pa.RecordBatch.from_arrays([pa.array([time.perf_counter() - start])], ["s"])

    return batches


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # the session, the code cache and the Python workers
    queries.queries()["decoded_vertices"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        start = time.time()
        queries.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    per_tile = {}
    for name in _kernels():
        done = spark.range(0, TILES, 1, int(cpus)).mapInArrow(_run(name), "s double").agg(F.max("s")).first()[0]
        per_tile[name] = round(done / TILES, 6)
    # whole tiles of 257 posts from heights to bytes
    tiles = spark.range(0, TILES, 1, int(cpus)).selectExpr("id k", "named_struct('west', id*0.1D, 'south', 40D, 'east', id*0.1D + 0.1D, 'north', 40.1D) bounds", "transform(sequence(0, 66048), i -> sin(i % 257 / 9D + id) * 300 + cos(floor(i / 257) / 7D) * 200) heights")
    start = time.time()
    encode.encode_terrain(tiles, 256, ["k"], encode.Options(max_error=4.0)).write.format("noop").mode("overwrite").save()
    per_tile["encode_terrain_257"] = round((time.time() - start) / TILES, 6)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "seconds_per_tile": per_tile}))


if __name__ == "__main__":
    main()
