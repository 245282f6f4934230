"""Delta and high-water-mark streams as window functions; each key is one stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import unzigzag, zigzag
from ..functions.geo import let


def _before(keys: list[str], order: list[str]):
    w = Window.partitionBy(*keys).orderBy(*order)
    return w, w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)


def delta_encode(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "code") -> DataFrame:
    """Zigzag of the difference to the value before (0 before the first), in 16 bits."""
    w, _, _ = _before(keys, order)
    return df.withColumn(out, F.pmod(zigzag(F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0))), F.lit(65536)).cast("int"))


def delta_decode(df: DataFrame, keys: list[str], order: list[str], code: str = "code", out: str = "value") -> DataFrame:
    _, upto, _ = _before(keys, order)
    return df.withColumn(out, F.pmod(F.sum(unzigzag(F.col(code))).over(upto), F.lit(65536)).cast("int"))


def high_water_encode(df: DataFrame, keys: list[str], order: list[str], index: str, out: str = "code") -> DataFrame:
    """How far an index is below the highest plus one so far; an index above that raises an error."""
    _, _, ahead = _before(keys, order)
    code = F.coalesce(F.max(index).over(ahead), F.lit(-1)) + 1 - F.col(index)
    return df.withColumn(out, F.when(code >= 0, code).otherwise(F.raise_error(F.lit("index above the high-water mark")).cast("long")))


def high_water_decode(df: DataFrame, keys: list[str], order: list[str], code: str = "code", out: str = "index") -> DataFrame:
    _, _, ahead = _before(keys, order)
    return df.withColumn(out, F.coalesce(F.sum(F.when(F.col(code) == 0, 1).otherwise(0)).over(ahead), F.lit(0)) - F.col(code))


def edge_indices(u: Column, v: Column) -> Column:
    """Struct west, south, east, north of vertex numbers sorted along each edge, from arrays of quantised u and v."""
    side = lambda at, keep, along: F.transform(F.array_sort(F.transform(F.filter(at, keep), lambda p: F.struct(p[along].alias("k"), p.i.alias("i")))), lambda p: p.i)
    made = lambda at: F.struct(
        side(at, lambda p: p.u == 0, "v").alias("west"), side(at, lambda p: p.v == 0, "u").alias("south"),
        side(at, lambda p: p.u == 32767, "v").alias("east"), side(at, lambda p: p.v == 32767, "u").alias("north"),
    )
    return let(let(F.arrays_zip(u.alias("u"), v.alias("v")), lambda z: F.transform(z, lambda x, i: F.struct(x.u.alias("u"), x.v.alias("v"), i.alias("i")))), made)
