"""Connected components by rounds of joins, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): for each id of the links ``a``, ``b`` the smallest id reachable.

    Alternates large-star and small-star: each round links every id's neighbours to the smallest of them, so a
    component becomes a star around its smallest id after few rounds. Both stars aggregate by ``min`` before
    the shuffle. Rows per round never exceed the number of links. Each round is written to the shared folder.
    """
    links = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = _state(links)
    for _ in range(most_rounds):
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # large star: neighbours above u go to the smallest neighbour of u
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: neighbours not above u, and u itself, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        links = staged(small, "links")
        before, state = state, _state(links)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(links.select("v", "v").distinct())


def _state(links: DataFrame) -> tuple:
    """Number and checksums of the links; the same when a round changed nothing."""
    return tuple(links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first())
