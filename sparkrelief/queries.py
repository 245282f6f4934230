"""Registered queries of the terrain engine and their SQL oracles.

Points: integer hashes of keys give lon and lat in both engines. Grids: an embedding is an 8 by 8 grid of
heights, north up, in thousandths; tiles lie side by side in rows of 20.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import codec, geo
from .operators import avail, normals, quantize, resample, rtin, streams
from .plans import encode
from .sources import png, tilebytes

_LON, _LAT = "(k * 2654435761 % 3600001) / 10000.0 - 180", "(k * 40503 % 1700001) / 10000.0 - 85"
SQL: dict[str, str] = {}
RUN: dict = {}


def _query(sql: str | None = None):
    def keep(f):
        RUN[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _read(spark: SparkSession, sf_dir: str, table: str, *columns) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def _points(spark, sf_dir, table, key, *more) -> DataFrame:
    k = F.col(key).cast("long")
    lon = (k * F.lit(2654435761) % 3600001) / F.lit(10000.0) - 180
    lat = (k * F.lit(40503) % 1700001) / F.lit(10000.0) - 85
    return _read(spark, sf_dir, table, k.alias("k"), lon.alias("lon"), lat.alias("lat"), *more)


def _sql_points(table: str, key: str, more: str = "") -> str:
    return f"pts AS (SELECT k, {_LON} AS lon, {_LAT} AS lat {', ' + more if more else ''} FROM (SELECT CAST({key} AS BIGINT) AS k, * FROM {table}))"


def _tiles(spark, sf_dir, extra=()) -> DataFrame:
    h = F.transform("embedding", lambda e: e.cast("double") * 1000)
    x, y = (F.col("vec_id") % 20).cast("int"), F.floor(F.col("vec_id") / 20).cast("int")
    return _read(spark, sf_dir, "embeddings", "vec_id", h.alias("heights"), x.alias("x"), y.alias("y"))


def _rasters(spark, sf_dir) -> DataFrame:
    """z, x, y, heights of the tiles at two zooms; at 6 they are half as high, and 100 more."""
    t = _tiles(spark, sf_dir)
    return t.select(F.lit(7).alias("z"), "x", "y", "heights").unionByName(t.select(F.lit(6).alias("z"), "x", "y", F.transform("heights", lambda h: h / 2 + 100).alias("heights")))


def _padded(spark, sf_dir) -> DataFrame:
    """9 by 9 grids: the last column and row again."""
    t = _tiles(spark, sf_dir)
    at = geo.let(F.col("heights"), lambda h: F.transform(F.sequence(F.lit(0), F.lit(80)), lambda i: F.get(h, F.least(F.floor(i / 9), F.lit(7)).cast("int") * 8 + F.least(i % 9, F.lit(7)))))
    return t.withColumn("heights", at).withColumn("bounds", geo.geodetic_bounds(F.col("x").cast("long"), F.col("y").cast("long"), F.lit(7)))


_SQL_GRID = "grid AS (SELECT vec_id, gx, gy, CAST(embedding[least(gy,7)*8 + least(gx,7) + 1] AS DOUBLE) * 1000 AS h FROM embeddings, range(9) r(gx), range(9) s(gy))"
_SQL_TREE = """tri0 AS (
 SELECT 1 AS level, ax, ay, bx, by_, cx, cy, CAST(NULL AS INT) AS pm FROM (VALUES (0,0,8,8,8,0),(8,8,0,0,0,8)) t(ax,ay,bx,by_,cx,cy)
 UNION ALL
 SELECT level+1, CASE WHEN s=0 THEN cx ELSE bx END, CASE WHEN s=0 THEN cy ELSE by_ END, CASE WHEN s=0 THEN ax ELSE cx END, CASE WHEN s=0 THEN ay ELSE cy END, (ax+bx)//2, (ay+by_)//2, (ay+by_)//2*9+(ax+bx)//2
 FROM tri0, (VALUES (0),(1)) q(s) WHERE level <= 6),
tri AS (SELECT *, CASE WHEN level <= 6 THEN (ay+by_)//2*9+(ax+bx)//2 END AS mid FROM tri0),
step AS (SELECT DISTINCT pm AS up, mid AS down FROM tri WHERE pm IS NOT NULL AND mid IS NOT NULL),
reach AS (SELECT DISTINCT mid AS up, mid AS down FROM tri WHERE mid IS NOT NULL UNION SELECT r.up, s.down FROM reach r JOIN step s ON r.down = s.up),
post AS (SELECT vec_id, gy*9+gx AS p, h FROM grid),
own AS (SELECT a.vec_id, t.mid, max(abs((a.h+b.h)/2-m.h)) AS e FROM tri t JOIN post a ON a.p=t.ay*9+t.ax JOIN post b ON b.p=t.by_*9+t.bx AND b.vec_id=a.vec_id JOIN post m ON m.p=t.mid AND m.vec_id=a.vec_id WHERE t.mid IS NOT NULL GROUP BY 1,2),
err AS (SELECT o.vec_id, r.up AS mid, max(o.e) AS e FROM own o JOIN reach r ON r.down=o.mid GROUP BY 1,2),
kept AS (SELECT v.vec_id, t.* FROM tri t CROSS JOIN (SELECT vec_id FROM embeddings) v LEFT JOIN err em ON em.vec_id=v.vec_id AND em.mid=t.mid LEFT JOIN err ep ON ep.vec_id=v.vec_id AND ep.mid=t.pm
 WHERE (t.pm IS NULL OR ep.e > 200) AND (t.mid IS NULL OR em.e <= 200))"""
_RTIN = f"WITH RECURSIVE {_SQL_GRID}, {_SQL_TREE} "


@_query(f"WITH {_sql_points('lineitem', 'l_orderkey')} SELECT x, y, count(*) AS n FROM (SELECT CAST(least(greatest(floor((lon+180)/360*1024),0),1023) AS BIGINT) x, CAST(least(greatest(floor((1-asinh(tan(radians(least(greatest(lat,-85.05112877980659),85.05112877980659))))/pi())/2*1024),0),1023) AS BIGINT) y FROM pts) GROUP BY 1,2")
def tile_xyz_count(spark, sf_dir):
    t = geo.lonlat_to_xyz(F.col("lon"), F.col("lat"), F.lit(10))
    return _points(spark, sf_dir, "lineitem", "l_orderkey").select(t.alias("t")).groupBy(F.col("t.x").alias("x"), F.col("t.y").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_sql_points('lineitem', 'l_partkey')} SELECT x, y, count(*) AS n FROM (SELECT CAST(least(greatest(floor((lon+180)/360*512),0),511) AS BIGINT) x, 511-CAST(least(greatest(floor((1-asinh(tan(radians(least(greatest(lat,-85.05112877980659),85.05112877980659))))/pi())/2*512),0),511) AS BIGINT) y FROM pts) GROUP BY 1,2")
def tile_tms_count(spark, sf_dir):
    t = geo.lonlat_to_tms(F.col("lon"), F.col("lat"), F.lit(9))
    return _points(spark, sf_dir, "lineitem", "l_partkey").select(t.alias("t")).groupBy(F.col("t.x").alias("x"), F.col("t.y").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_sql_points('lineitem', 'l_orderkey')} SELECT x, y, count(*) AS n FROM (SELECT CAST(least(greatest(floor((lon+180)/360*512),0),511) AS BIGINT) x, CAST(least(greatest(floor((lat+90)/180*256),0),255) AS BIGINT) y FROM pts) GROUP BY 1,2")
def tile_geodetic_count(spark, sf_dir):
    t = geo.lonlat_to_geodetic(F.col("lon"), F.col("lat"), F.lit(8))
    return _points(spark, sf_dir, "lineitem", "l_orderkey").select(t.alias("t")).groupBy(F.col("t.x").alias("x"), F.col("t.y").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT k, x, y, round(x/1024.0*360-180,6) AS west, round(degrees(atan(sinh(pi()*(1-2*(y+1)/1024.0)))),6) AS south, round((x+1)/1024.0*360-180,6) AS east, round(degrees(atan(sinh(pi()*(1-2*y/1024.0)))),6) AS north, round(degrees(atan(sinh(pi()*(1-2*(1023-y)/1024.0)))),6) AS tms_north, round(y*180/1024.0-90,6) AS geo_south FROM (SELECT o_orderkey AS k, o_orderkey*7919%1024 AS x, o_orderkey*104729%1024 AS y FROM orders)")
def tile_bounds(spark, sf_dir):
    k = F.col("o_orderkey")
    t = _read(spark, sf_dir, "orders", k.alias("k"), (k * 7919 % 1024).alias("x"), (k * 104729 % 1024).alias("y"))
    x, y, z = F.col("x"), F.col("y"), F.lit(10)
    b = t.select("k", "x", "y", geo.xyz_bounds(x, y, z).alias("b"), geo.tms_bounds(x, y, z).alias("t"), geo.geodetic_bounds(x, y, z).alias("g"))
    return b.select("k", "x", "y", *[F.round(f"b.{c}", 6).alias(c) for c in ("west", "south", "east", "north")], F.round("t.north", 6).alias("tms_north"), F.round("g.south", 6).alias("geo_south"))


_SQL_ECEF = "radians(lon) AS lam, radians(lat) AS phi, 6378137.0/sqrt(1-0.0066943799901413165*sin(radians(lat))*sin(radians(lat))) AS n"


@_query(f"WITH {_sql_points('customer', 'c_custkey', 'c_acctbal AS h')}, p AS (SELECT *, {_SQL_ECEF} FROM pts) SELECT k, round((n+h)*cos(phi)*cos(lam),3)+0 AS x, round((n+h)*cos(phi)*sin(lam),3)+0 AS y, round((n*(1-0.0066943799901413165)+h)*sin(phi),3)+0 AS z FROM p")
def ecef_forward(spark, sf_dir):
    p = _points(spark, sf_dir, "customer", "c_custkey", F.col("c_acctbal").alias("h")).select("k", geo.geodetic_to_ecef(F.col("lon"), F.col("lat"), F.col("h")).alias("p"))
    return p.select("k", *[(F.round(f"p.{c}", 3) + F.lit(0.0)).alias(c) for c in "xyz"])


@_query(f"WITH {_sql_points('orders', 'o_orderkey', 'floor(o_totalprice) AS h')} SELECT k, round(lon,6) AS lon, round(lat,6) AS lat, round(h,2) AS h FROM pts")
def ecef_roundtrip(spark, sf_dir):
    p = _points(spark, sf_dir, "orders", "o_orderkey", F.floor("o_totalprice").cast("double").alias("h")).select("k", geo.geodetic_to_ecef(F.col("lon"), F.col("lat"), F.col("h")).alias("p"))
    return p.select("k", geo.ecef_to_geodetic(F.col("p")).alias("g")).select("k", F.round("g.lon", 6).alias("lon"), F.round("g.lat", 6).alias("lat"), F.round("g.h", 2).alias("h"))


def _codec(name, encode_, decode_):
    def run(spark, sf_dir):
        e = F.col("l_extendedprice") / F.lit(10.0) - 2000
        t = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", e.cast("float").alias("e")).withColumn("p", encode_(F.col("e")))
        return t.select("l_orderkey", "l_linenumber", "p.r", "p.g", "p.b", F.round(decode_(F.col("p")).cast("double"), 2).alias("back"))

    run.__name__ = name
    return run


_E = "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice/10.0-2000 AS FLOAT) AS e FROM lineitem"
_query(f"SELECT l_orderkey, l_linenumber, r, g, b, round(CAST(CAST(r*256+g+CAST(b AS FLOAT)/CAST(256 AS FLOAT) AS FLOAT)-CAST(32768 AS FLOAT) AS DOUBLE),2) AS back FROM (SELECT *, v>>16 AS r, (v>>8)&255 AS g, v&255 AS b FROM (SELECT *, CAST(trunc(least(greatest((e+CAST(32768 AS FLOAT))*CAST(256 AS FLOAT),0),16777215)) AS INT) AS v FROM ({_E})))")(_codec("terrarium_codec", codec.encode_terrarium, codec.decode_terrarium))
_query(f"SELECT l_orderkey, l_linenumber, r, g, b, round(CAST(CAST(-10000 AS FLOAT)+CAST(v AS FLOAT)*CAST(0.1 AS FLOAT) AS DOUBLE),2) AS back FROM (SELECT *, v>>16 AS r, (v>>8)&255 AS g, v&255 AS b FROM (SELECT *, CAST(least(greatest(round((e+CAST(10000 AS FLOAT))*CAST(10 AS FLOAT)),0),16777215) AS INT) AS v FROM ({_E})))")(_codec("mapbox_codec", codec.encode_mapbox, codec.decode_mapbox))
_query(f"SELECT l_orderkey, l_linenumber, r, g, b, round(CAST(CAST((CASE WHEN v<8388608 THEN v ELSE v-16777216 END)*0.01 AS FLOAT) AS DOUBLE),2) AS back FROM (SELECT *, v>>16 AS r, (v>>8)&255 AS g, v&255 AS b FROM (SELECT *, CAST(((CAST(round(CAST(e AS DOUBLE)*100) AS BIGINT)%16777216)+16777216)%16777216 AS INT) AS v FROM ({_E})))")(_codec("gsi_codec", codec.encode_gsi, codec.decode_gsi))


@_query("SELECT l_orderkey, l_linenumber, v, round(v/5.0-1000,3) AS back FROM (SELECT l_orderkey, l_linenumber, CAST(round((least(greatest(l_extendedprice/4-3000,-1000),12107)+1000)*5) AS INT) AS v FROM lineitem)")
def heightmap1_codec(spark, sf_dir):
    v = codec.elevation_to_u16(F.col("l_extendedprice") / 4 - 3000)
    return _read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", v.alias("v")).withColumn("back", F.round(codec.u16_to_elevation(F.col("v")), 3))


@_query("SELECT p_partkey, m, m&1=1 AS sw, m&2=2 AS se, m&4=4 AS nw, m&8=8 AS ne FROM (SELECT p_partkey, CAST((CASE WHEN p_size%2=0 THEN 1 ELSE 0 END)+(CASE WHEN p_size%3=0 THEN 2 ELSE 0 END)+(CASE WHEN p_size%5=0 THEN 4 ELSE 0 END)+(CASE WHEN p_size%7=0 THEN 8 ELSE 0 END) AS INT) AS m FROM part)")
def child_mask(spark, sf_dir):
    s = F.col("p_size")
    t = _read(spark, sf_dir, "part", "p_partkey", codec.child_mask(*[s % n == 0 for n in (2, 3, 5, 7)]).alias("m")).withColumn("f", codec.child_flags(F.col("m")))
    return t.select("p_partkey", "m", "f.sw", "f.se", "f.nw", "f.ne")


@_query("SELECT l_orderkey, l_linenumber, d AS back, CASE WHEN d>=0 THEN 2*d ELSE -2*d-1 END AS code FROM (SELECT l_orderkey, l_linenumber, l_partkey-l_suppkey*7 AS d FROM lineitem)")
def zigzag_codec(spark, sf_dir):
    t = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", codec.zigzag(F.col("l_partkey") - F.col("l_suppkey") * 7).alias("code"))
    return t.select("l_orderkey", "l_linenumber", codec.unzigzag(F.col("code")).alias("back"), "code")


# lineitem has rows with equal keys, so the place in a stream also needs the part
_PLACE = "l_linenumber*1000000+l_partkey"


@_query(f"SELECT l_orderkey, o, CAST((CASE WHEN d>=0 THEN 2*d ELSE -2*d-1 END)%65536 AS INT) AS code, CAST(v AS INT) AS back FROM (SELECT *, v-coalesce(lag(v) OVER (PARTITION BY l_orderkey ORDER BY o),0) AS d FROM (SELECT l_orderkey, {_PLACE} AS o, l_partkey%32768 AS v FROM lineitem))")
def delta_stream(spark, sf_dir):
    t = _read(spark, sf_dir, "lineitem", "l_orderkey", F.expr(_PLACE).alias("o"), (F.col("l_partkey") % 32768).alias("v"))
    coded = streams.delta_encode(t, ["l_orderkey"], ["o"], "v")
    return streams.delta_decode(coded, ["l_orderkey"], ["o"], out="back").select("l_orderkey", "o", "code", "back")


@_query(f"SELECT l_orderkey, o, CAST(idx AS BIGINT) AS back, CAST(coalesce(max(idx) OVER (PARTITION BY l_orderkey ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),-1)+1-idx AS BIGINT) AS code FROM (SELECT l_orderkey, o, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY f)-1 AS idx FROM (SELECT l_orderkey, {_PLACE} AS o, min({_PLACE}) OVER (PARTITION BY l_orderkey, l_partkey%3) AS f FROM lineitem))")
def high_water_stream(spark, sf_dir):
    t = _read(spark, sf_dir, "lineitem", "l_orderkey", F.expr(_PLACE).alias("o"), (F.col("l_partkey") % 3).alias("g"))
    t = t.withColumn("f", F.min("o").over(Window.partitionBy("l_orderkey", "g"))).withColumn("idx", F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy("f")).cast("long") - 1)
    coded = streams.high_water_encode(t, ["l_orderkey"], ["o"], "idx")
    return streams.high_water_decode(coded, ["l_orderkey"], ["o"], out="back").select("l_orderkey", "o", F.col("back").cast("long").alias("back"), F.col("code").cast("long").alias("code"))


@_query(_RTIN + "SELECT vec_id, CAST(mid AS INT) AS post, round(e,3) AS err FROM err WHERE e > 0")
def rtin_errors(spark, sf_dir):
    t = rtin.with_errors(_padded(spark, sf_dir), 8).select("vec_id", F.posexplode("err").alias("post", "e"))
    return t.where("e > 0").select("vec_id", "post", F.round("e", 3).alias("err"))


@_query(_RTIN + "SELECT vec_id, count(*) // 3 AS triangles, count(DISTINCT p) AS vertices FROM (SELECT vec_id, ay*9+ax AS p FROM kept UNION ALL SELECT vec_id, by_*9+bx FROM kept UNION ALL SELECT vec_id, cy*9+cx FROM kept) GROUP BY 1")
def rtin_mesh_counts(spark, sf_dir):
    m = rtin.mesh(_padded(spark, sf_dir), 8, 200.0)
    return m.select("vec_id", (F.size("indices") / 3).cast("long").alias("triangles"), F.size("posts").cast("long").alias("vertices"))


@_query(_RTIN + "SELECT vec_id, CAST(ay*9+ax AS INT) AS a, CAST(by_*9+bx AS INT) AS b, CAST(cy*9+cx AS INT) AS c FROM kept")
def rtin_triangles(spark, sf_dir):
    m = rtin.mesh(_padded(spark, sf_dir), 8, 200.0)
    t = m.select("vec_id", "posts", "indices", F.explode(F.sequence(F.lit(0), (F.size("indices") / 3 - 1).cast("int"))).alias("i"))
    return t.select("vec_id", *[F.get("posts", F.get("indices", F.col("i") * 3 + j)).alias(c) for j, c in enumerate("abc")])


_VERTS = _RTIN + ", vp AS (SELECT DISTINCT vec_id, p FROM (SELECT vec_id, ay*9+ax AS p FROM kept UNION ALL SELECT vec_id, by_*9+bx FROM kept UNION ALL SELECT vec_id, cy*9+cx FROM kept)), vh AS (SELECT v.vec_id, v.p, o.h FROM vp v JOIN post o ON o.vec_id=v.vec_id AND o.p=v.p), rng AS (SELECT vec_id, min(h) lo, max(h) hi FROM vh GROUP BY 1) "


@_query(_VERTS + "SELECT v.vec_id, CAST(round(v.p%9/8.0*32767) AS INT) AS uq, CAST(round((1-v.p//9/8.0)*32767) AS INT) AS vq, CASE WHEN hi>lo THEN CAST(round((h-lo)/(hi-lo)*32767) AS INT) ELSE 0 END AS hq FROM vh v JOIN rng USING (vec_id)")
def height_range_quantize(spark, sf_dir):
    m = rtin.mesh(_padded(spark, sf_dir), 8, 200.0).withColumn("vs", rtin.vertices(F.col("posts"), F.col("heights"), 8)).withColumn("r", quantize.height_range(F.col("vs")))
    q = m.select("vec_id", quantize.quantised(F.col("vs"), F.col("r.lo"), F.col("r.hi")).alias("q")).select("vec_id", F.explode(F.arrays_zip("q.u", "q.v", "q.height")).alias("z"))
    return q.select("vec_id", F.col("z.u").alias("uq"), F.col("z.v").alias("vq"), F.col("z.height").alias("hq"))


@_query(_VERTS + """SELECT vec_id, edge, CAST(row_number() OVER (PARTITION BY vec_id, edge ORDER BY along)-1 AS INT) AS place, CAST(p AS INT) AS post FROM (SELECT vec_id, 'west' AS edge, -(p//9) AS along, p FROM vp WHERE p%9=0
UNION ALL SELECT vec_id, 'south', p%9, p FROM vp WHERE p//9=8 UNION ALL SELECT vec_id, 'east', -(p//9), p FROM vp WHERE p%9=8 UNION ALL SELECT vec_id, 'north', p%9, p FROM vp WHERE p//9=0)""")
def edge_indices(spark, sf_dir):
    """The vertices along each edge of each tile, in order, as grid posts."""
    m = encode.meshes(_flat_curve(spark, sf_dir), 8, encode.Options(max_error=200.0))
    each = m.select("vec_id", "vertices", F.explode(F.array(*[F.struct(F.lit(e).alias("edge"), F.col(f"edges.{e}").alias("at")) for e in ("west", "south", "east", "north")])).alias("e"))
    v = each.select("vec_id", "vertices", "e.edge", F.posexplode("e.at").alias("place", "i")).withColumn("v", F.get("vertices", F.col("i")))
    return v.select("vec_id", "edge", "place", (F.col("v.gy") * 9 + F.col("v.gx")).alias("post"))


def _flat_curve(spark, sf_dir) -> DataFrame:
    """Bounds so small that the curvature vanishes, for comparison with plain meshes."""
    z = F.lit(0.0)
    return _padded(spark, sf_dir).withColumn("bounds", geo.bounds(z, z, z, z))


@_query("SELECT vec_id, z, startX AS start_x, startX + (1<<(z-7)) - 1 AS end_x, startY AS start_y, startY + (1<<(z-7)) - 1 AS end_y FROM (SELECT vec_id, CAST(z AS INT) AS z, (vec_id%20)*(1<<(z-7)) AS startX, (vec_id//20)*(1<<(z-7)) AS startY FROM embeddings, range(8,11) r(z))")
def tile_descendants(spark, sf_dir):
    t = _tiles(spark, sf_dir).select("vec_id", F.posexplode(avail.descendants(F.col("x").cast("long"), F.col("y").cast("long"), F.lit(7), F.lit(10))).alias("i", "r"))
    return t.select("vec_id", (F.col("i") + 8).alias("z"), F.get("r", F.lit(0)).alias("q")).select("vec_id", "z", F.col("q.startX").alias("start_x"), F.col("q.endX").alias("end_x"), F.col("q.startY").alias("start_y"), F.col("q.endY").alias("end_y"))


@_query(f"WITH {_sql_points('events', 'user_id')}, t AS (SELECT CAST(z AS INT) AS z, CAST(least(greatest(floor((lon+180)/360*(2<<z)),0),(2<<z)-1) AS BIGINT) x, CAST(least(greatest(floor((lat+90)/180*(1<<z)),0),(1<<z)-1) AS BIGINT) y FROM pts, range(0,6) r(z)) SELECT z, min(x) AS start_x, min(y) AS start_y, max(x) AS end_x, max(y) AS end_y FROM t GROUP BY 1")
def tile_availability(spark, sf_dir):
    p = _points(spark, sf_dir, "events", "user_id").withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(5))))
    t = p.select("z", geo.lonlat_to_geodetic(F.col("lon"), F.col("lat"), F.col("z")).alias("t"))
    return avail.available(t.select("z", "t.x", "t.y"))


@_query(f"""WITH {_sql_points('events', 'user_id')}, t AS (SELECT CAST(z AS INT) AS z, CAST(least(greatest(floor((lon+180)/360*(2<<z)),0),(2<<z)-1) AS BIGINT) x, CAST(least(greatest(floor((lat+90)/180*(1<<z)),0),(1<<z)-1) AS BIGINT) y FROM pts, range(0,6) r(z)) , a AS (SELECT z, min(x) AS start_x, min(y) AS start_y, max(x) AS end_x, max(y) AS end_y FROM t GROUP BY 1)
SELECT '{{"tilejson":"2.1.0","format":"quantized-mesh-1.0","version":"1.0.0","scheme":"tms","tiles":["{{z}}/{{x}}/{{y}}.terrain"],"available":[' || string_agg(printf('[{{"startX":%d,"startY":%d,"endX":%d,"endY":%d}}]', start_x, start_y, end_x, end_y), ',' ORDER BY z) || '],"minzoom":0,"maxzoom":5,"bounds":[-180.0,-90.0,180.0,90.0],"extensions":["octvertexnormals"]}}' AS json FROM a""")
def layer_json(spark, sf_dir):
    """The manifest of the tiles with events, without blanks; one row of one entry a zoom level."""
    entry = F.struct("z", F.array(avail.rectangle(*[F.col(c) for c in ("start_x", "start_y", "end_x", "end_y")])).alias("r"))
    levels = tile_availability(spark, sf_dir).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.r).alias("levels"))
    text = avail.manifest(F.col("levels"), F.lit(0), F.lit(5), F.array(*map(F.lit, (-180.0, -90.0, 180.0, 90.0))), F.array(F.lit("octvertexnormals")))
    return levels.select(F.regexp_replace(text, r"\s", "").alias("json"))


@_query("WITH m AS (SELECT o_custkey, count(*) AS n, min(v) AS lo, max(v) AS hi FROM (SELECT o_custkey, CASE WHEN o_orderkey%7=0 THEN 255 ELSE 0 END AS v FROM orders) GROUP BY 1) SELECT o_custkey, CASE WHEN lo=hi THEN 'uniform' ELSE 'grid' END AS kind, CAST(CASE WHEN lo=hi THEN lo END AS INT) AS uniform FROM m")
def water_mask_collapse(spark, sf_dir):
    """Whether each customer's mask has one value; from sums, as a customer may have any number of orders."""
    v = F.when(F.col("o_orderkey") % 7 == 0, 255).otherwise(0)
    t = _read(spark, sf_dir, "orders", "o_custkey", v.alias("v")).groupBy("o_custkey").agg(avail.collapsed(F.min("v"), F.max("v")).alias("m"))
    return t.select("o_custkey", "m.kind", "m.uniform")


_SQL_RASTERS = """ras AS (SELECT 7 AS z, vec_id, vec_id%20 AS x, vec_id//20 AS y, list_transform(CAST(embedding AS DOUBLE[]), lambda e: e*1000) AS g FROM embeddings
UNION ALL SELECT 6, vec_id, vec_id%20, vec_id//20, list_transform(CAST(embedding AS DOUBLE[]), lambda e: e*1000/2+100) FROM embeddings)"""


@_query(f"WITH {_SQL_RASTERS} SELECT e.z, e.x, e.y, CAST(i AS INT) AS post, round(CASE WHEN i%9<8 AND i//9<8 THEN e.g[i//9*8+i%9+1] WHEN i//9<8 THEN coalesce(r.g[i//9*8+1], e.g[i//9*8+8]) WHEN i%9<8 THEN coalesce(s.g[i%9+1], e.g[57+i%9]) ELSE coalesce(d.g[1], s.g[8], r.g[57], e.g[64]) END,3) AS h FROM ras e CROSS JOIN range(81) k(i) LEFT JOIN ras r ON r.z=e.z AND r.x=e.x+1 AND r.y=e.y LEFT JOIN ras s ON s.z=e.z AND s.x=e.x AND s.y=e.y+1 LEFT JOIN ras d ON d.z=e.z AND d.x=e.x+1 AND d.y=e.y+1")
def halo_pad(spark, sf_dir):
    t = _rasters(spark, sf_dir).select("z", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "heights")
    return resample.padded(t, 8, ["z"]).select("z", "x", "y", F.posexplode("heights").alias("post", "v")).select("z", "x", "y", "post", F.round("v", 3).alias("h"))


_SQL_AXIS = "least(greatest(floor({v}),{lo}),{hi})"


_SQL_PIXELS = "px AS (SELECT vec_id%20*8+i%8 AS px, vec_id//20*8+i//8 AS py, CAST(embedding[i+1] AS DOUBLE)*1000 AS h FROM embeddings, range(64) r(i)), lim AS (SELECT min(px) AS xl, max(px) AS xh, min(py) AS yl, max(py) AS yh FROM px)"


def _sql_bilinear(keys: str, places: str, limits: str = "lim", pixels: str = "px", zoom: str = "") -> str:
    """Heights at continuous places (x, y) of ``places``, with ``limits`` xl, xh, yl, yh."""
    axis = ", ".join(_SQL_AXIS.format(v=f"floor({c})+{d}", lo=f"{c}l", hi=f"{c}h") + f" AS {c}{d}" for c in "xy" for d in (0, 1))
    same = (lambda n: f" AND {n}.z=q.z") if zoom else lambda n: ""
    corners = " ".join(f"JOIN {pixels} {n} ON {n}.px=x{i} AND {n}.py=y{j}{same(n)}" for n, i, j in (("a", 0, 0), ("b", 1, 0), ("c", 0, 1), ("d", 1, 1)))
    return f"SELECT {keys}, round((a.h+(b.h-a.h)*tx)+((c.h+(d.h-c.h)*tx)-(a.h+(b.h-a.h)*tx))*ty,3)+0 AS h FROM (SELECT {keys}, x-floor(x) AS tx, y-floor(y) AS ty, {axis} FROM {places}{', ' + limits if limits else ''}) q {corners}"


@_query(f"WITH {_sql_points('supplier', 's_suppkey')}, ax AS (SELECT k, (lon+180)/360*1024-0.5 AS x, (1-asinh(tan(radians(lat)))/pi())/2*1024-0.5 AS y FROM pts), {_SQL_PIXELS} {_sql_bilinear('k', 'ax')}")
def mercator_sample(spark, sf_dir):
    rasters = _tiles(spark, sf_dir).select(F.lit(7).alias("z"), "x", "y", "heights")
    edge = rasters.agg(*[f(c).cast("long").alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    block = edge.select(F.struct((F.col("lox") * 8).alias("x_lo"), (F.col("hix") * 8 + 7).alias("x_hi"), (F.col("loy") * 8).alias("y_lo"), (F.col("hiy") * 8 + 7).alias("y_hi")).alias("block"))
    ax, ay = resample.pixel_axes(F.col("lon"), F.col("lat"), F.lit(7), 8, F.col("block"))
    points = _points(spark, sf_dir, "supplier", "s_suppkey").crossJoin(F.broadcast(block)).select("k", F.lit(7).alias("z"), ax.alias("ax"), ay.alias("ay"))
    return resample.sample(points, rasters, 8, ["k"]).select("k", (F.round("h", 3) + F.lit(0.0)).alias("h"))


@_query(f"WITH {_sql_points('nation', 'n_nationkey')} SELECT k, x0, y0, x1-x0+1 AS tiles_x, y1-y0+1 AS tiles_y FROM (SELECT k, CAST(floor((lon+180)/360*256) AS BIGINT) x0, CAST(floor((1-asinh(tan(radians(least(lat+3,85.05112877980659))))/pi())/2*256) AS BIGINT) y0, CAST(least(floor((least(lon+5,180)+180)/360*256),255) AS BIGINT) x1, CAST(floor((1-asinh(tan(radians(lat)))/pi())/2*256) AS BIGINT) y1 FROM pts)")
def tiles_covering(spark, sf_dir):
    p = _points(spark, sf_dir, "nation", "n_nationkey")
    c = resample.covering(geo.bounds(F.col("lon"), F.col("lat"), F.col("lon") + 5, F.col("lat") + 3), F.lit(8))
    return p.select("k", c.alias("c")).select("k", "c.x0", "c.y0", "c.tiles_x", "c.tiles_y")


@_query(f"WITH {_sql_points('nation', 'n_nationkey')} SELECT k, CAST(gx AS INT) AS gx, CAST(gy AS INT) AS gy, round(lon+gx*0.25,6) AS lon, round(lat+2-gy*0.25,6) AS lat FROM pts, range(-1,10) a(gx), range(-1,10) b(gy)")
def buffered_geodetic(spark, sf_dir):
    p = _points(spark, sf_dir, "nation", "n_nationkey").select("k", geo.bounds(F.col("lon"), F.col("lat"), F.col("lon") + 2, F.col("lat") + 2).alias("bounds"))
    return resample.geodetic_posts(p, 9, 1).select("k", "gx", "gy", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


_FRACTION = "(1-asinh(tan(radians(greatest(least({lat},85.05112877980659),-85.05112877980659))))/pi())/2"


def _sql_grid_heights(buffer: int) -> str:
    """Heights at the posts of ``_boxes``, each within the block of its covering tiles."""
    n, wide = "CAST(1<<z AS DOUBLE)", buffer * 0.25
    tile = lambda v: f"least(greatest(floor({v}*{n}),0),{n}-1)"
    row = lambda lat: tile(_FRACTION.format(lat=lat))
    return f"""WITH {_SQL_RASTERS}, px AS (SELECT z, x*8+i%8 AS px, y*8+i//8 AS py, g[i+1] AS h FROM ras, range(64) r(i)),
bx AS (SELECT k, z, w, s, {tile(f"(w-{wide}+180)/360")}*8 AS xl, {tile(f"(w+2+{wide}+180)/360")}*8+7 AS xh, {row(f"s+2+{wide}")}*8 AS yl, {row(f"s-{wide}")}*8+7 AS yh
 FROM (SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(z AS INT) AS z, CAST(n_nationkey AS DOUBLE)*2-179.5 AS w, CAST(n_nationkey%10 AS DOUBLE)+73.5 AS s FROM nation, range(6,8) r(z))),
ax AS (SELECT k, z, CAST(gx AS INT) AS gx, CAST(gy AS INT) AS gy, (w+gx*0.25+180)/360*8*{n}-0.5 AS x, {_FRACTION.format(lat="s+2-gy*0.25")}*8*{n}-0.5 AS y, xl, xh, yl, yh FROM bx, range({-buffer},{9 + buffer}) a(gx), range({-buffer},{9 + buffer}) b(gy))
{_sql_bilinear("k, z, gx, gy", "ax", "", "px", "z").replace("SELECT k, z, gx, gy, round", "SELECT q.k, q.z, q.gx, q.gy, round", 1)}"""


def _boxes(spark, sf_dir) -> DataFrame:
    """Boxes of two degrees over the rasters, one for each nation and zoom."""
    k = F.col("n_nationkey").cast("long")
    west, south = k.cast("double") * 2 - 179.5, (k % 10).cast("double") + 73.5
    return _read(spark, sf_dir, "nation", k.alias("k"), geo.bounds(west, south, west + 2, south + 2).alias("bounds")).withColumn("z", F.explode(F.array(F.lit(6), F.lit(7))))


def _grid_heights(spark, sf_dir, buffer: int) -> DataFrame:
    side, name = 9 + 2 * buffer, "halo" if buffer else "heights"
    g = resample.geodetic_grids(_boxes(spark, sf_dir), _rasters(spark, sf_dir), 8, 9, ["k", "z"], buffer).select("k", "z", F.posexplode(name).alias("i", "h"))
    return g.select("k", "z", (F.col("i") % side - buffer).alias("gx"), (F.floor(F.col("i") / side) - buffer).cast("int").alias("gy"), (F.round("h", 3) + F.lit(0.0)).alias("h"))


@_query(_sql_grid_heights(0))
def geodetic_grid(spark, sf_dir):
    return _grid_heights(spark, sf_dir, 0)


@_query(_sql_grid_heights(1))
def buffered_geodetic_heights(spark, sf_dir):
    return _grid_heights(spark, sf_dir, 1)


@_query()
def raster_tiles(spark, sf_dir):
    """The whole job: images of heights at two zooms to tile bytes with normals, and what these decode to."""
    images = png.height_images(_rasters(spark, sf_dir), ["z", "x", "y"], "terrarium", 8)
    tiles = encode.reproject(_boxes(spark, sf_dir), images, 8, 8, ["k", "z"], encode.Options(max_error=50.0, normals="gradient"))
    return encode.verified(tiles, ["k", "z"]).select("k", "z", "triangles", "vertices", F.round("lo", 1).alias("lo"), F.round("hi", 1).alias("hi"), "normal_bytes", "corrupt")


_SQL_BOUNDS = "b AS (SELECT vec_id, (vec_id%20)*180/128.0-180 AS west, (vec_id//20)*180/128.0-90 AS south, (vec_id%20+1)*180/128.0-180 AS east, (vec_id//20+1)*180/128.0-90 AS north FROM embeddings)"


def _sql_ecef(lon: str, lat: str, h: str) -> str:
    """x, y and z of a point as SQL."""
    a, e2 = geo.WGS84_A, geo.WGS84_E2
    n = f"{a}/sqrt(1-{e2!r}*sin(radians({lat}))*sin(radians({lat})))"
    return f"({n}+{h})*cos(radians({lat}))*cos(radians({lon})) AS x, ({n}+{h})*cos(radians({lat}))*sin(radians({lon})) AS y, ({n}*(1-{e2!r})+{h})*sin(radians({lat})) AS z"


@_query(f"""WITH {_SQL_PIXELS}, t AS (SELECT vec_id, x, y, x*180/128.0-180 AS west, (127-y)*180/128.0-90 AS south, 180/128.0 AS deg FROM (SELECT vec_id, vec_id%20 AS x, vec_id//20 AS y FROM embeddings)),
p AS (SELECT t.*, CAST(gy*9+gx AS INT) AS post, gx, gy, x*8+gx AS qx, y*8+gy AS qy FROM t, range(9) r(gx), range(9) s(gy)),
c AS (SELECT p.*, least(qx,xh) AS mx, greatest(qx-1,xl) AS wx, least(qx+1,xh) AS ex, least(qy,yh) AS my, greatest(qy-1,yl) AS ny, least(qy+1,yh) AS sy FROM p, lim),
d AS (SELECT vec_id, post, radians(west+gx/8.0*deg) AS lam, radians(south+(1-gy/8.0)*deg) AS phi, (e.h-w.h)/2/(deg/8*radians({geo.WGS84_A})*cos(radians(south+deg/2))) AS dx, (n.h-s.h)/2/(deg/8*radians({geo.WGS84_A})) AS dy
 FROM c JOIN px e ON e.px=ex AND e.py=my JOIN px w ON w.px=wx AND w.py=my JOIN px n ON n.px=mx AND n.py=ny JOIN px s ON s.px=mx AND s.py=sy),
v AS (SELECT vec_id, post, dx*sin(lam)+dy*sin(phi)*cos(lam)+cos(phi)*cos(lam) AS x, -dx*cos(lam)+dy*sin(phi)*sin(lam)+cos(phi)*sin(lam) AS y, -dy*cos(phi)+sin(phi) AS z FROM d)
SELECT vec_id, post, round(x/l,6)+0 AS nx, round(y/l,6)+0 AS ny, round(z/l,6)+0 AS nz FROM (SELECT *, sqrt(x*x+y*y+z*z) AS l FROM v)""")
def gradient_normals_halo(spark, sf_dir):
    """A normal for each of the 81 posts of a tile, from a halo of the neighbours; rows of tiles go to the south here, so the bounds count from the north."""
    b = geo.geodetic_bounds(F.col("x").cast("long"), (127 - F.col("y")).cast("long"), F.lit(7))
    t = resample.halo(_tiles(spark, sf_dir), 8, 1).select("vec_id", "halo", b.alias("bounds"))
    n = normals.grid_normals(t, ["vec_id"], 8, 1).select("vec_id", F.posexplode("normals").alias("post", "n"))
    return n.select("vec_id", "post", *[(F.round(f"n.{c}", 6) + F.lit(0.0)).alias(f"n{c}") for c in "xyz"])


@_query("""WITH v AS (SELECT vec_id, i AS vid, CAST(i%8 AS DOUBLE) AS px, CAST(i//8 AS DOUBLE) AS py, CAST(embedding[i+1] AS DOUBLE) AS pz FROM embeddings, range(64) r(i)),
t AS (SELECT s, gx, gy FROM range(7) p(gx), range(7) q(gy), range(2) k(s)),
f AS (SELECT CASE WHEN s=0 THEN gy*8+gx ELSE gy*8+gx+1 END AS a, CASE WHEN s=0 THEN gy*8+gx+1 ELSE gy*8+gx+9 END AS b, gy*8+gx+8 AS c FROM t),
x AS (SELECT a.vec_id, f.a, f.b, f.c, (b.py-a.py)*(c.pz-a.pz)-(b.pz-a.pz)*(c.py-a.py) AS nx, (b.pz-a.pz)*(c.px-a.px)-(b.px-a.px)*(c.pz-a.pz) AS ny, (b.px-a.px)*(c.py-a.py)-(b.py-a.py)*(c.px-a.px) AS nz FROM f JOIN v a ON a.vid=f.a JOIN v b ON b.vid=f.b AND b.vec_id=a.vec_id JOIN v c ON c.vid=f.c AND c.vec_id=a.vec_id),
e AS (SELECT vec_id, unnest([a,b,c]) AS vid, CAST(CAST(nx AS FLOAT) AS DOUBLE) AS nx, CAST(CAST(ny AS FLOAT) AS DOUBLE) AS ny, CAST(CAST(nz AS FLOAT) AS DOUBLE) AS nz FROM x),
s AS (SELECT vec_id, vid, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM e GROUP BY 1,2)
SELECT vec_id, CAST(vid AS INT) AS vid, round(nx/l,4)+0 AS nx, round(ny/l,4)+0 AS ny, round(nz/l,4)+0 AS nz FROM (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS l FROM s)""")
def face_normals(spark, sf_dir):
    """Area-weighted normals of the full grid of each embedding, two triangles to a cell."""
    posts = _read(spark, sf_dir, "embeddings", "vec_id", F.posexplode("embedding").alias("vid", "h"))
    vertex = posts.select("vec_id", "vid", (F.col("vid") % 8).cast("double").alias("px"), F.floor(F.col("vid") / 8).cast("double").alias("py"), F.col("h").cast("double").alias("pz"))
    corner = F.floor(F.col("cell") / 7).cast("int") * 8 + F.col("cell") % 7
    cells = _read(spark, sf_dir, "embeddings", "vec_id", F.explode(F.sequence(F.lit(0), F.lit(48))).alias("cell")).withColumn("o", corner)
    tri = lambda a, b, c: F.struct(*[(F.col("o") + k).alias(n) for n, k in (("a", a), ("b", b), ("c", c))])
    triangle = cells.select("vec_id", "cell", F.posexplode(F.array(tri(0, 1, 8), tri(1, 9, 8))).alias("half", "t")).select("vec_id", (F.col("cell") * 2 + F.col("half")).alias("tid"), "t.a", "t.b", "t.c")
    n = normals.face_normals(vertex, triangle, ["vec_id"])
    return n.select("vec_id", "vid", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("nx", "ny", "nz")])


@_query("""WITH n AS (SELECT vec_id, i, CAST(x/l AS FLOAT) AS x, CAST(y/l AS FLOAT) AS y, CAST(z/l AS FLOAT) AS z FROM (SELECT *, sqrt(x*x+y*y+z*z) AS l FROM (SELECT vec_id, CAST(i AS INT) AS i, CAST(embedding[3*i+1] AS DOUBLE) AS x, CAST(embedding[3*i+2] AS DOUBLE) AS y, CAST(embedding[3*i+3] AS DOUBLE) AS z FROM embeddings, range(21) r(i)))),
p AS (SELECT vec_id, i, z, CAST(x/CAST(abs(x)+abs(y)+abs(z) AS FLOAT) AS FLOAT) AS px, CAST(y/CAST(abs(x)+abs(y)+abs(z) AS FLOAT) AS FLOAT) AS py FROM n),
f AS (SELECT vec_id, i, CASE WHEN z<0 THEN CAST(CAST(1 AS FLOAT)-abs(py) AS FLOAT)*(CASE WHEN px>=0 THEN CAST(1 AS FLOAT) ELSE CAST(-1 AS FLOAT) END) ELSE px END AS u, CASE WHEN z<0 THEN CAST(CAST(1 AS FLOAT)-abs(px) AS FLOAT)*(CASE WHEN py>=0 THEN CAST(1 AS FLOAT) ELSE CAST(-1 AS FLOAT) END) ELSE py END AS v FROM p)
SELECT vec_id, i, CAST(trunc((u*CAST(0.5 AS FLOAT)+CAST(0.5 AS FLOAT))*CAST(255 AS FLOAT)) AS INT) AS a, CAST(trunc((v*CAST(0.5 AS FLOAT)+CAST(0.5 AS FLOAT))*CAST(255 AS FLOAT)) AS INT) AS b FROM f""")
def oct_codec(spark, sf_dir):
    """Each three components of an embedding as a unit vector, and its two bytes."""
    v = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: geo.normalised(geo.xyz(*[F.get("embedding", i * 3 + k).cast("double") for k in range(3)])))
    t = _read(spark, sf_dir, "embeddings", "vec_id", F.posexplode(v).alias("i", "v"))
    return t.select("vec_id", "i", codec.oct_encode(F.col("v")).alias("o")).select("vec_id", "i", "o.a", "o.b")


@_query("""WITH p AS (SELECT a, b, a/255.0*2-1 AS x, b/255.0*2-1 AS y FROM (SELECT DISTINCT CAST(l_partkey%256 AS INT) AS a, CAST(l_suppkey%256 AS INT) AS b FROM lineitem)),
q AS (SELECT a, b, x, y, 1-abs(x)-abs(y) AS z FROM p), f AS (SELECT a, b, z, CASE WHEN z<0 THEN (1-abs(y))*(CASE WHEN x>=0 THEN 1 ELSE -1 END) ELSE x END AS x, CASE WHEN z<0 THEN (1-abs(x))*(CASE WHEN y>=0 THEN 1 ELSE -1 END) ELSE y END AS y FROM q)
SELECT a, b, round(CAST(CAST(x/sqrt(x*x+y*y+z*z) AS FLOAT) AS DOUBLE),5)+0 AS x, round(CAST(CAST(y/sqrt(x*x+y*y+z*z) AS FLOAT) AS DOUBLE),5)+0 AS y, round(CAST(CAST(z/sqrt(x*x+y*y+z*z) AS FLOAT) AS DOUBLE),5)+0 AS z FROM f""")
def oct_vectors(spark, sf_dir):
    """The vectors of pairs of bytes, packed and taken apart again."""
    t = _read(spark, sf_dir, "lineitem", (F.col("l_partkey") % 256).cast("int").alias("a"), (F.col("l_suppkey") % 256).cast("int").alias("b")).distinct()
    packed = t.select(F.unhex(F.concat(F.lpad(F.hex("a"), 2, "0"), F.lpad(F.hex("b"), 2, "0"))).alias("content"))
    o = packed.select(F.explode(codec.oct_pairs(F.col("content"))).alias("o"))
    n = o.select("o.a", "o.b", codec.oct_decode(F.col("o")).alias("n"))
    return n.select("a", "b", *[(F.round(F.col(f"n.{c}").cast("double"), 5) + F.lit(0.0)).alias(c) for c in "xyz"])


@_query("""WITH h AS (SELECT vec_id, i, CAST(round((least(greatest(CAST(embedding[i+1] AS DOUBLE)*1000,-1000),12107)+1000)*5) AS INT) AS v FROM embeddings, range(64) r(i))
SELECT vec_id, string_agg(printf('%02X%02X', v%256, v//256), '' ORDER BY i) AS content, sum(v) AS total FROM h GROUP BY 1""")
def heightmap1_bytes(spark, sf_dir):
    """16-bit heights as bytes, and the sum of what they decode to."""
    content = codec.u16_bytes(F.transform("heights", codec.elevation_to_u16), 64)
    t = _tiles(spark, sf_dir).select("vec_id", content.alias("raw"))
    return t.select("vec_id", F.hex("raw").alias("content"), F.aggregate(codec.u16_values(F.col("raw")), F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))


_SQL_SAMPLES = f"""{_SQL_BOUNDS}, r AS (SELECT b.*, list_min(embedding)::DOUBLE*1000 AS lo, list_max(embedding)::DOUBLE*1000 AS hi, (west+east)/2 AS ml, (south+north)/2 AS mp FROM b JOIN embeddings USING (vec_id)),
corner AS (SELECT vec_id, unnest([west,west,west,west,east,east,east,east]) AS lon, unnest([south,south,north,north,south,south,north,north]) AS lat, unnest([lo,hi,lo,hi,lo,hi,lo,hi]) AS h FROM r),
side AS (SELECT vec_id, unnest([west,east,ml,ml]) AS lon, unnest([mp,mp,south,north]) AS lat, hi, (lo+hi)/2 AS half FROM r),
mid AS (SELECT vec_id, {_sql_ecef("ml", "mp", "(lo+hi)/2")} FROM r)"""


@_query(f"""WITH {_SQL_SAMPLES}, p AS (SELECT vec_id, {_sql_ecef("lon", "lat", "h")} FROM (SELECT vec_id, lon, lat, h FROM corner UNION ALL SELECT vec_id, lon, lat, hi FROM side))
SELECT m.vec_id, round(any_value(m.x),2)+0 AS cx, round(any_value(m.y),2)+0 AS cy, round(any_value(m.z),2)+0 AS cz, round(max(sqrt((p.x-m.x)**2+(p.y-m.y)**2+(p.z-m.z)**2)),2) AS radius FROM mid m JOIN p USING (vec_id) GROUP BY 1""")
def bounding_sphere(spark, sf_dir):
    t = _padded(spark, sf_dir).select("vec_id", "bounds", F.array_min("heights").alias("lo"), F.array_max("heights").alias("hi"))
    s = t.select("vec_id", quantize.bounding_sphere(F.col("bounds"), F.col("lo"), F.col("hi")).alias("s"))
    return s.select("vec_id", *[(F.round(f"s.centre.{c}", 2) + F.lit(0.0)).alias(f"c{c}") for c in "xyz"], F.round("s.radius", 2).alias("radius"))


_SQL_HORIZON = f"""s AS (SELECT vec_id, x/{geo.WGS84_A} AS x, y/{geo.WGS84_A} AS y, z/{geo.WGS84_B} AS z FROM p), d0 AS (SELECT vec_id, x/{geo.WGS84_A} AS x, y/{geo.WGS84_A} AS y, z/{geo.WGS84_B} AS z FROM mid),
d AS (SELECT vec_id, x/l AS dx, y/l AS dy, z/l AS dz FROM (SELECT *, sqrt(x*x+y*y+z*z) AS l FROM d0)),
k AS (SELECT vec_id, dx, dy, dz, greatest(sqrt(x*x+y*y+z*z),1) AS m, x*dx+y*dy+z*dz AS dot, sqrt((y*dz-z*dy)**2+(z*dx-x*dz)**2+(x*dy-y*dx)**2) AS crs FROM s JOIN d USING (vec_id)),
w AS (SELECT vec_id, dx, dy, dz, dot/m/m - crs/m*sqrt(greatest(m*m-1,0))/m AS q FROM k),
o AS (SELECT vec_id, dx, dy, dz, coalesce(max(1/q) FILTER (q>0),1) AS scale FROM w GROUP BY 1,2,3,4)
SELECT vec_id, round(dx*scale,5)+0 AS hx, round(dy*scale,5)+0 AS hy, round(dz*scale,5)+0 AS hz FROM o"""


@_query(f"""WITH {_SQL_SAMPLES}, p AS (SELECT vec_id, {_sql_ecef("lon", "lat", "h")} FROM (SELECT vec_id, lon, lat, h FROM corner UNION ALL SELECT vec_id, lon, lat, half FROM side UNION ALL SELECT vec_id, ml, mp, hi FROM r)), {_SQL_HORIZON}""")
def horizon_point(spark, sf_dir):
    """Over samples of the bounds, as for tiles without vertices."""
    t = _padded(spark, sf_dir).select("vec_id", "bounds", F.array_min("heights").alias("lo"), F.array_max("heights").alias("hi"))
    h = t.select("vec_id", quantize.horizon_point(F.col("bounds"), F.col("lo"), F.col("hi")).alias("p"))
    return h.select("vec_id", *[(F.round(f"p.{c}", 5) + F.lit(0.0)).alias(f"h{c}") for c in "xyz"])


@_query(f"""{_VERTS.rstrip()}, {_SQL_BOUNDS}, mid AS (SELECT vec_id, {_sql_ecef("(west+east)/2", "(south+north)/2", "(lo+hi)/2")} FROM rng JOIN b USING (vec_id)),
p AS (SELECT vec_id, {_sql_ecef("lon", "lat", "h")} FROM (SELECT v.vec_id, west+(v.p%9)/8.0*(east-west) AS lon, south+(1-(v.p//9)/8.0)*(north-south) AS lat, h FROM vh v JOIN b USING (vec_id))), {_SQL_HORIZON}""")
def horizon_point_mesh(spark, sf_dir):
    """Over the vertices of the mesh."""
    m = rtin.mesh(_padded(spark, sf_dir), 8, 200.0).withColumn("vs", rtin.vertices(F.col("posts"), F.col("heights"), 8)).withColumn("r", quantize.height_range(F.col("vs"))).withColumn("e", quantize.vertex_ecef(F.col("vs"), F.col("bounds")))
    h = m.select("vec_id", quantize.horizon_point(F.col("bounds"), F.col("r.lo"), F.col("r.hi"), F.col("e")).alias("p"))
    return h.select("vec_id", *[(F.round(f"p.{c}", 5) + F.lit(0.0)).alias(f"h{c}") for c in "xyz"])


def _decoded(spark, sf_dir, sections) -> DataFrame:
    """What the bytes of flat-bounded tiles decode to."""
    return tilebytes.decode_tiles(encode.encode_terrain(_flat_curve(spark, sf_dir), 8, ["vec_id"], encode.Options(max_error=200.0)), ["vec_id"], sections=sections)


@_query(SQL["height_range_quantize"])
def decoded_vertices(spark, sf_dir):
    """Quantised vertices as they come out of tile bytes."""
    d = _decoded(spark, sf_dir, ["u", "v", "height"]).select("vec_id", F.explode(F.arrays_zip("u", "v", "height")).alias("p"))
    return d.select("vec_id", F.col("p.u").alias("uq"), F.col("p.v").alias("vq"), F.col("p.height").alias("hq"))


@_query(SQL["rtin_triangles"])
def decoded_triangles(spark, sf_dir):
    """Triangles as they come out of tile bytes; a vertex's place gives its post."""
    d = _decoded(spark, sf_dir, ["u", "v", "indices"])
    post = lambda k: F.round(F.lit(8.0) - F.get("v", k) / F.lit(32767.0) * 8).cast("int") * 9 + F.round(F.get("u", k) / F.lit(32767.0) * 8).cast("int")
    t = d.select("vec_id", "u", "v", "indices", F.explode(F.sequence(F.lit(0), (F.size("indices") / 3 - 1).cast("int"))).alias("i"))
    return t.select("vec_id", *[post(F.get("indices", F.col("i") * 3 + j).cast("int")).alias(c) for j, c in enumerate("abc")])


@_query("""SELECT vec_id, CAST(i AS INT) AS post, round(CAST(CAST((v>>16)*256+((v>>8)&255)+CAST(v&255 AS FLOAT)/CAST(256 AS FLOAT) AS FLOAT)-CAST(32768 AS FLOAT) AS DOUBLE),3) AS h
FROM (SELECT vec_id, i, CAST(trunc((CAST(CAST(embedding[i+1] AS DOUBLE)*1000 AS FLOAT)+CAST(32768 AS FLOAT))*CAST(256 AS FLOAT)) AS INT) AS v FROM embeddings, range(64) r(i))""")
def png_heights(spark, sf_dir):
    """Heights as they come out of PNG images."""
    images = png.height_images(_tiles(spark, sf_dir), ["vec_id"], "terrarium", 8)
    return png.image_heights(images, ["vec_id"], "terrarium", 8).select("vec_id", F.posexplode("heights").alias("post", "h")).select("vec_id", "post", F.round(F.col("h").cast("double"), 3).alias("h"))


@_query("""WITH p AS (SELECT vec_id, i, CAST(round((CAST(CAST(embedding[i+1] AS DOUBLE)*1000 AS FLOAT)+CAST(10000 AS FLOAT))*CAST(10 AS FLOAT)) AS INT) AS v FROM embeddings, range(64) r(i))
SELECT vec_id, string_agg(printf('%02X%02X%02X', v>>16, (v>>8)&255, v&255), '' ORDER BY i) AS content, round(CAST(CAST(-10000 AS FLOAT)+CAST(max(v) FILTER (i=42) AS FLOAT)*CAST(0.1 AS FLOAT) AS DOUBLE),2) AS at_2_5, round(sum(CAST(CAST(-10000 AS FLOAT)+CAST(v AS FLOAT)*CAST(0.1 AS FLOAT) AS DOUBLE)),1) AS total FROM p GROUP BY 1""")
def packed_rgb(spark, sf_dir):
    """Heights as packed bytes of a named format, one height taken from the bytes, and the sum of all."""
    name = codec.format_name(F.lit("Terrain-RGB"))
    t = _tiles(spark, sf_dir).select("vec_id", codec.checked_rgb(codec.pack_rgb(codec.encode_heights(name, F.col("heights"))), F.lit(8), F.lit(8)).alias("raw"))
    back = codec.decode_heights(name, codec.unpack_rgb(F.col("raw")))
    total = F.aggregate(back, F.lit(0.0), lambda s, h: s + h.cast("double"))
    return t.select("vec_id", F.hex("raw").alias("content"), F.round(codec.height_at(name, F.col("raw"), F.lit(8), F.lit(2), F.lit(5)).cast("double"), 2).alias("at_2_5"), F.round(total, 1).alias("total"))


@_query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber%5 WHEN 0 THEN 255 WHEN 1 THEN 0 WHEN 2 THEN 128 WHEN 3 THEN 255 ELSE v>>16 END AS r, CASE l_linenumber%5 WHEN 0 THEN 255 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 255 ELSE (v>>8)&255 END AS g, CASE l_linenumber%5 WHEN 0 THEN 255 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 255 ELSE v&255 END AS b
FROM (SELECT *, CAST(l_partkey*100%16777216 AS INT) AS v FROM lineitem)""")
def gsi_extremes(spark, sf_dir):
    """Infinite, missing and very large heights, and plain ones."""
    inf = F.lit(float("inf"))
    n = F.col("l_linenumber") % 5
    e = F.when(n == 0, inf).when(n == 1, -inf).when(n == 2, F.lit(float("nan"))).when(n == 3, F.lit(1e30)).otherwise(F.col("l_partkey").cast("double")).cast("float")
    return _read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", codec.encode_gsi(e).alias("p")).select("l_orderkey", "l_linenumber", "l_partkey", "p.r", "p.g", "p.b")


@_query("SELECT c_custkey AS k, CAST(CASE WHEN c_custkey%2=0 THEN 90 ELSE -90 END AS DOUBLE) AS lat, round(floor(c_acctbal),3) AS h FROM customer")
def ecef_poles(spark, sf_dir):
    """Points on the axis of the earth, there and back."""
    k = F.col("c_custkey")
    z = F.when(k % 2 == 0, 1.0).otherwise(-1.0) * (F.lit(geo.WGS84_A / math.sqrt(1 - geo.WGS84_E2) * (1 - geo.WGS84_E2)) + F.floor("c_acctbal"))
    t = _read(spark, sf_dir, "customer", k.alias("k"), geo.ecef_to_geodetic(geo.xyz(F.lit(0.0), F.lit(0.0), z)).alias("g"))
    return t.select("k", F.round("g.lat", 6).alias("lat"), (F.round("g.h", 3) + F.lit(0.0)).alias("h"))


@_query(f"WITH {_SQL_BOUNDS} SELECT vec_id, CAST(i AS INT) AS post, round({geo.MEAN_RADIUS}/2*(radians(north-south)**2*(i//9/8.0)*(1-i//9/8.0)+(radians(east-west)*cos(radians((south+north)/2)))**2*(i%9/8.0)*(1-i%9/8.0)),4) AS bulge FROM b, range(81) r(i)")
def curvature_bulge(spark, sf_dir):
    at = F.transform(F.sequence(F.lit(0), F.lit(80)), lambda i: geo.curvature_bulge(i % 9, F.floor(i / 9), 8, F.col("bounds")))
    return _padded(spark, sf_dir).select("vec_id", F.posexplode(at).alias("post", "v")).select("vec_id", "post", F.round("v", 4).alias("bulge"))


@_query("SELECT l_orderkey, l_linenumber, l_partkey, round(-400+(l_partkey%32768)/32767.0*(8848.0+400),3) AS h FROM lineitem")
def dequantised_heights(spark, sf_dir):
    h = quantize.dequantised(F.col("l_partkey") % 32768, F.lit(-400.0), F.lit(8848.0))
    return _read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", F.round(h, 3).alias("h"))


def _sql_range(kind: str, x0: str, y0: str, x1: str, y1: str) -> str:
    return f'SELECT k, \'{kind}\' AS scheme, CAST({x0} AS BIGINT) AS start_x, CAST({y0} AS BIGINT) AS start_y, CAST({x1} AS BIGINT) AS end_x, CAST({y1} AS BIGINT) AS end_y FROM q'


def _sql_ranges() -> str:
    x = lambda v, n: f"least(greatest(floor(({v}+180)/360*{n}),0),{n - 1})"
    y = lambda v: f"least(greatest(floor({_FRACTION.format(lat=v)}*256),0),255)"
    g = lambda v: f"least(greatest(floor(({v}+90)/180*256),0),255)"
    parts = [_sql_range("geodetic", x("lon", 512), g("lat"), x("lon+5", 512), g("lat+3")), _sql_range("xyz", x("lon", 256), y("lat+3"), x("lon+5", 256), y("lat")), _sql_range("tms", x("lon", 256), f"255-{y('lat')}", x("lon+5", 256), f"255-{y('lat+3')}"), "SELECT k, 'full' AS scheme, 0, 0, 511, 255 FROM q"]
    return f"WITH {_sql_points('nation', 'n_nationkey')}, q AS (SELECT k, lon, lat FROM pts) " + " UNION ALL ".join(parts)


@_query(_sql_ranges())
def ranges_of_bounds(spark, sf_dir):
    """The tiles over a box in each scheme, and those of a whole level."""
    b = geo.bounds(F.col("lon"), F.col("lat"), F.col("lon") + 5, F.col("lat") + 3)
    ranges = F.array(*[F.struct(F.lit(k).alias("scheme"), (avail.full_level(F.lit(8)) if k == "full" else avail.range_of_bounds(b, F.lit(8), k)).alias("r")) for k in ("geodetic", "xyz", "tms", "full")])
    t = _points(spark, sf_dir, "nation", "n_nationkey").select("k", F.explode(ranges).alias("e"))
    return t.select("k", "e.scheme", *[F.col(f"e.r.{c}").alias(n) for c, n in (("startX", "start_x"), ("startY", "start_y"), ("endX", "end_x"), ("endY", "end_y"))])


_CURVED = _SQL_TREE.replace("post AS (SELECT vec_id, gy*9+gx AS p, h FROM grid)", f"{_SQL_BOUNDS}, post AS (SELECT vec_id, gy*9+gx AS p, h+{geo.MEAN_RADIUS}/2*(radians(north-south)**2*(gy/8.0)*(1-gy/8.0)+(radians(east-west)*cos(radians((south+north)/2)))**2*(gx/8.0)*(1-gx/8.0)) AS h FROM grid JOIN b USING (vec_id))")


@_query(f"""WITH RECURSIVE {_SQL_GRID}, {_CURVED}, c AS (SELECT vec_id, ay*9+ax AS p FROM kept UNION ALL SELECT vec_id, by_*9+bx FROM kept UNION ALL SELECT vec_id, cy*9+cx FROM kept)
SELECT c.vec_id, count(*)//3 AS triangles, count(DISTINCT c.p) AS vertices, round(CAST(CAST(min(h) AS FLOAT) AS DOUBLE),1) AS lo, round(CAST(CAST(max(h) AS FLOAT) AS DOUBLE),1) AS hi FROM c JOIN grid g ON g.vec_id=c.vec_id AND g.gy*9+g.gx=c.p GROUP BY 1""")
def flagship(spark, sf_dir):
    """Tiles from grids to bytes and back: triangles, vertices and height range of each."""
    tiles = encode.encode_terrain(_padded(spark, sf_dir), 8, ["vec_id"], encode.Options(max_error=200.0))
    d = tilebytes.decode_tiles(tiles, ["vec_id"], sections=["header", "u", "indices"])
    return d.select("vec_id", (F.size("indices") / 3).cast("long").alias("triangles"), F.size("u").cast("long").alias("vertices"), F.round(F.col("header.min_height").cast("double"), 1).alias("lo"), F.round(F.col("header.max_height").cast("double"), 1).alias("hi"))


def queries() -> dict:
    return dict(RUN)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
