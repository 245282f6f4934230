"""Right-triangulated irregular networks without recursion.

As the error of a triangle is never under its children's, splitting top-down
comes to a filter: a triangle is in the mesh if its parent must split and it
must not. The triangle tree of a grid size is a dimension of one row with
arrays, broadcast to the tiles; a tile is one row too, so meshing has no shuffle.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import let


@lru_cache(maxsize=8)
def triangle_tree(cells: int) -> tuple[list[dict], dict[int, list[int]]]:
    """Triangles of a grid of ``cells`` by ``cells`` in mesh order, and for each midpoint the numbers of the triangles that its error covers."""
    if cells < 1 or cells & (cells - 1):
        raise ValueError("the grid size must be a power of two plus one")
    side, deepest = cells + 1, 2 * (cells.bit_length() - 1) + 1
    post = lambda p: p[1] * side + p[0]
    rows: list[dict] = []
    under: dict[int, set[int]] = {}

    def grow(a, b, c, level, parents):
        split = level < deepest
        m = ((a[0] + b[0]) // 2, (a[1] + b[1]) // 2) if split else None
        number = len(rows)
        rows.append({"level": level, "a": post(a), "b": post(b), "c": post(c), "mid": post(m) if split else None, "parent_mid": parents[-1] if parents else None, "leaf": not split})
        if split:
            for p in {*parents, post(m)}:
                under.setdefault(p, set()).add(number)
            grow(c, a, m, level + 1, (*parents, post(m)))
            grow(b, c, m, level + 1, (*parents, post(m)))

    grow((0, 0), (cells, cells), (cells, 0), 1, ())
    grow((cells, cells), (0, 0), (0, cells), 1, ())
    # a midpoint shared by two triangles has one error, and so have all above it
    closed = {p: set(s) for p, s in under.items()}
    for number in sorted((i for i, r in enumerate(rows) if not r["leaf"]), key=lambda i: -rows[i]["level"]):
        r = rows[number]
        if r["parent_mid"] is not None:
            closed[r["parent_mid"]] |= closed[r["mid"]]
    return rows, {p: sorted(s) for p, s in closed.items()}


def dimension(spark: SparkSession, cells: int) -> DataFrame:
    """One row: the triangles in mesh order, and for each grid post the triangles that its error covers."""
    rows, closed = triangle_tree(cells)
    tri = [(r["level"], r["a"], r["b"], r["c"], r["mid"], r["parent_mid"]) for r in rows]
    covers = [closed.get(p, []) for p in range((cells + 1) ** 2)]
    return spark.createDataFrame([(tri, covers)], "tri array<struct<level:int,a:int,b:int,c:int,mid:int,parent_mid:int>>, covers array<array<int>>")


def _errors(tri: Column, covers: Column, h: Column) -> Column:
    """For each grid post the error at which it is needed; NaN counts as none."""
    own = lambda h: F.transform(tri, lambda t: F.when(t.mid.isNotNull(), F.nullif(F.abs((F.get(h, t.a).cast("double") + F.get(h, t.b)) / 2 - F.get(h, t.mid)), F.lit(float("nan")))))
    most = lambda o: F.transform(covers, lambda c: F.coalesce(F.array_max(F.transform(c, lambda i: F.get(o, i))), F.lit(0.0)))
    return let(let(h, own), most)


def with_errors(tiles: DataFrame, cells: int, heights: str = "heights") -> DataFrame:
    """``tiles`` with ``err``: for each grid post the error at which it is needed."""
    both = tiles.crossJoin(F.broadcast(dimension(tiles.sparkSession, cells)))
    return both.withColumn("err", _errors(F.col("tri"), F.col("covers"), F.col(heights))).drop("tri", "covers")


def mesh(tiles: DataFrame, cells: int, max_error: float, heights: str = "heights", error_heights: str | None = None) -> DataFrame:
    """``tiles`` with ``posts`` (grid posts of the vertices in order of first use) and ``indices`` (three for a triangle).

    Values that lambdas use again and again are bound by ``let``: the optimizer would move their expressions
    into the lambda and compute them for every element.
    """
    both = tiles.crossJoin(F.broadcast(dimension(tiles.sparkSession, cells)))
    e = F.lit(float(max_error))
    corners = lambda err: F.flatten(
        F.transform(F.filter("tri", lambda t: (t.parent_mid.isNull() | (F.get(err, t.parent_mid) > e)) & (t.mid.isNull() | (F.get(err, t.mid) <= e))), lambda t: F.array(t.a, t.b, t.c))
    )
    # array_distinct keeps the first of equals, which is the order of first use
    split = lambda k: F.struct(k.alias("k"), F.array_distinct(k).alias("posts"))
    numbered = lambda s: F.struct(s.posts.alias("posts"), F.transform(s.k, lambda p: (F.array_position(s.posts, p) - 1).cast("int")).alias("indices"))
    made = let(let(let(_errors(F.col("tri"), F.col("covers"), F.col(error_heights or heights)), corners), split), numbered)
    return both.withColumn("_m", made).withColumn("posts", F.col("_m.posts")).withColumn("indices", F.col("_m.indices")).drop("_m", "tri", "covers")


def vertices(posts: Column, heights: Column, cells: int) -> Column:
    """array<struct<gx, gy, u, v, h>> of mesh vertices; v grows to the north."""
    side = cells + 1
    post = lambda h: lambda p: F.struct((p % side).alias("gx"), F.floor(p / side).cast("int").alias("gy"), ((p % side) / cells).alias("u"), (1 - F.floor(p / side) / cells).alias("v"), F.get(h, p).cast("double").alias("h"))
    return let(F.struct(posts.alias("p"), heights.alias("h")), lambda s: F.transform(s.p, post(s.h)))
