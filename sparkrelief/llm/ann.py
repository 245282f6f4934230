"""Operator 9: approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample: each node splits its sample at the
median of a random projection (the difference of two of its vectors). Every
vector is then put into its leaf of every tree. A query descends all trees with
one shared priority queue, ordered by the sum of the squared margins to the
splits passed on the wrong side (a near bound of the distance, as the directions
are nearly orthogonal), and takes the best leaves of the whole forest. Leaves
next to each other form buckets, in which vectors and queries meet; a large
bucket is dealt into parts, each of which the query visits. Each meeting keeps
its nearest few, by exact distances in double precision, and the best of all
meetings win.

Equal vectors are one entry with the smallest few ids, so a vector that a third
of all rows share fills no leaf and is never expanded.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, read, staged

NEIGHBOURS = 10
#: Vectors that the trees are fitted on at most.
MAX_SAMPLE = 20_000
TREES = 8
#: A node with no more sample vectors than this is a leaf; at full sample a tree has about 1250 leaves or more.
LEAF_SAMPLE = 16
#: Share of all leaves of the forest that a query visits among ``VISITS_AT`` vectors or fewer; it falls with their number to the power ``-VISITS_POWER``.
VISITS, VISITS_AT, VISITS_POWER = 0.14, 2_000, 0.18
#: Neighbouring leaves of a bucket, and vectors of a part of one.
BUCKET, PART = 32, 4096


class Forest:
    """Trees as arrays: a node has a direction, a threshold and two children; a negative child is a leaf."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF_SAMPLE, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.roots, self.left, self.right, self.cut, self.leaves = [], [], [], [], []
        directions = []
        for _ in range(trees):
            count = 0
            stack = [(np.arange(len(sample)), -1, 0)]
            root = None
            while stack:
                ids, parent, side = stack.pop()
                node = None
                if len(ids) > leaf:
                    for _ in range(5):
                        a, b = sample[rng.choice(ids, 2, replace=False)]
                        d = a - b
                        norm = np.linalg.norm(d)
                        if norm > 0 and np.isfinite(norm):
                            d = d / norm
                            p = sample[ids] @ d
                            cut = float(np.median(p))
                            low = p < cut
                            if low.any() and not low.all():
                                node = len(self.cut)
                                directions.append(d)
                                self.cut.append(cut)
                                self.left.append(0)
                                self.right.append(0)
                                stack += [(ids[low], node, 0), (ids[~low], node, 1)]
                                break
                if node is None:
                    count += 1
                    node = -count
                if parent < 0:
                    root = node
                elif side:
                    self.right[parent] = node
                else:
                    self.left[parent] = node
            self.roots.append(root)
            self.leaves.append(count)
        self.directions = np.array(directions).reshape(len(directions), sample.shape[1] if sample.ndim == 2 else 0)
        self.cut, self.left, self.right = np.array(self.cut), np.array(self.left, int), np.array(self.right, int)

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree, from 0."""
        out = np.empty((len(vectors), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            at = np.full(len(vectors), root)
            while (inner := np.flatnonzero(at >= 0)).size:
                for node in np.unique(at[inner]):
                    mine = inner[at[inner] == node]
                    p = vectors[mine] @ self.directions[node]
                    at[mine] = np.where(p < self.cut[node], self.left[node], self.right[node])
            out[:, t] = -at - 1
        return out

    def search(self, vector: np.ndarray, visits: int) -> list[tuple[int, int]]:
        """The best leaves of the forest, as (tree, leaf)."""
        p = (self.directions @ vector - self.cut).tolist() if len(self.cut) else []
        queue = [(0.0, t, root) for t, root in enumerate(self.roots)]
        heapq.heapify(queue)
        left, right, found = self.left.tolist(), self.right.tolist(), []
        while queue and len(found) < visits:
            margin, tree, node = heapq.heappop(queue)
            while node >= 0:
                near, far = (left[node], right[node]) if p[node] < 0 else (right[node], left[node])
                heapq.heappush(queue, (margin + p[node] * p[node], tree, far))
                node = near
            found.append((tree, -node - 1))
        return found


def usable(column: str = "embedding"):
    """Column: no null, no null component, all finite, not all zero."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1) if len(flat) else np.empty((0, 0))


def visits_of(n: int) -> float:
    """The share of leaves that a query visits among ``n`` vectors."""
    return min(1.0, VISITS * min(1.0, (VISITS_AT / max(n, 1)) ** VISITS_POWER))


def nearest(rows: DataFrame, neighbours: int = NEIGHBOURS, every: int = 100, visits: float | None = None, forest: Forest | None = None) -> DataFrame:
    """query_id, rank, vec_id and score: the nearest ``neighbours`` of each row whose id is divisible by ``every``.

    Null ids and vectors that are null, empty, zero or not finite take no part. Vectors are compared with those of
    their own length; each length has an index of its own. Ties go to the smaller id; a row is never its own
    neighbour, nor is a row with its id; rows of equal vectors are neighbours at distance 0, each row once. Fewer than
    ``neighbours`` other rows: all that are found. An empty table gives an empty result. Extra columns are not read.
    """
    spark = rows.sparkSession
    able = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable())
    widths = sorted(r["w"] for r in able.groupBy(F.size("embedding").alias("w")).count().collect())
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, [_nearest(able.where(F.size("embedding") == w), neighbours, every, visits, forest) for w in widths])


def _nearest(able: DataFrame, neighbours: int, every: int, visits: float | None, forest: Forest | None) -> DataFrame:
    """The same for usable vectors of one length."""
    spark = able.sparkSession
    # adding 0.0 turns -0.0 into 0.0, so that equal vectors are equal
    able = able.select("vec_id", F.transform("embedding", lambda x: x + F.lit(0.0)).alias("v"))
    few = Window.partitionBy("v").orderBy("vec_id")
    ranked = able.withColumn("k", F.row_number().over(few)).where(F.col("k") <= neighbours + 1)
    entries = staged(ranked.groupBy("v").agg(F.min("vec_id").alias("id"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    n = entries.count()
    if forest is None:
        share = min(1.0, MAX_SAMPLE / n)
        sample = entries.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0)).orderBy("id").limit(2 * MAX_SAMPLE).select("v").toArrow()
        forest = Forest(_matrix(sample["v"]))
    held = spark.sparkContext.broadcast(forest)
    wanted = max(1, int(np.ceil((visits_of(n) if visits is None else visits) * sum(forest.leaves))))

    def placed(batches):
        f = held.value
        for batch in batches:
            if batch.num_rows:
                leaves = f.assign(_matrix(batch["v"]))
                k = leaves.shape[1]
                i = pa.array(np.repeat(np.arange(len(leaves)), k))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(k, dtype=np.int32), len(leaves))), pa.array(leaves.ravel() // BUCKET), pa.array(leaves.ravel()), batch["id"].take(i), batch["v"].take(i)], ["tree", "bucket", "leaf", "id", "v"])

    def probed(batches):
        f = held.value
        for batch in batches:
            for q, v, m in zip(batch["q"].to_pylist(), batch["v"], _matrix(batch["v"]), strict=True):
                mine: dict[tuple[int, int], list[int]] = {}
                for tree, leaf in f.search(m, wanted):
                    mine.setdefault((tree, leaf // BUCKET), []).append(leaf)
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in mine], pa.int32()), pa.array([b for _, b in mine], pa.int32()), pa.array(list(mine.values()), pa.list_(pa.int32())), pa.array([q] * len(mine), pa.int64()), pa.array([v.as_py()] * len(mine), pa.list_(pa.float64()))], ["tree", "bucket", "leaves", "q", "v"])

    def met(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        q, wish, ids, leaf = right["q"].to_numpy(), right["leaves"].to_pylist(), left["id"].to_numpy(), left["leaf"].to_numpy()
        a, b = _matrix(right["v"]), _matrix(left["v"])
        out_q, out_id, out_s = [], [], []
        for i in range(len(q) if len(ids) else 0):
            here = np.flatnonzero(np.isin(leaf, wish[i]))
            if not len(here):
                continue
            d = np.sqrt(np.square(b[here] - a[i]).sum(1))
            k = min(len(d), neighbours + 1)
            near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
            near = near[np.lexsort((ids[here[near]], d[near]))][:k]
            out_q.append(np.full(len(near), q[i]))
            out_id.append(ids[here[near]])
            out_s.append(d[near])
        join = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
        return pa.Table.from_arrays([join(out_q, pa.int64()), join(out_id, pa.int64()), join(out_s, pa.float64())], ["q", "id", "score"])

    asked = able.where(F.col("vec_id") % every == 0)
    queries = asked.join(entries.select("v", F.col("id").alias("q")), "v").select("q", "vec_id").distinct()
    distinct = entries.join(queries.select(F.col("q").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("q"), "v")
    index = entries.select("id", "v").repartition(partitions(spark), "id").mapInArrow(placed, "tree int, bucket int, leaf int, id long, v array<double>")
    # the number of parts of a bucket follows from the number of entries, as the trees split a sample of them at medians
    parts = max(1, math.ceil(n * BUCKET / max(forest.leaves) / PART))
    index = index.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    probes = distinct.repartition(partitions(spark), "q").mapInArrow(probed, "tree int, bucket int, leaves array<int>, q long, v array<double>").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    meet = ["tree", "bucket", "part"]
    found = index.groupBy(*meet).cogroup(probes.groupBy(*meet)).applyInArrow(met, "q long, id long, score double").distinct()
    best = Window.partitionBy("q").orderBy("score", "id")
    top = found.withColumn("k", F.row_number().over(best)).where(F.col("k") <= neighbours + 1).drop("k")
    wide = top.join(entries.select("id", "ids"), "id").select("q", "score", F.explode("ids").alias("n"))
    each = wide.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy("score", "n"))).where(F.col("k") <= neighbours + 1)
    rows_of = queries.join(each, "q").where(F.col("vec_id") != F.col("n"))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("score", "n"))
    return rows_of.select(F.col("vec_id").alias("query_id"), rank.alias("rank"), F.col("n").alias("vec_id"), "score").where(F.col("rank") <= neighbours)


def op9_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
