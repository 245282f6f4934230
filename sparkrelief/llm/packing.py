"""Operator 10: packing documents into sequences by linear grouping and best fit.

Lengths are integers up to the capacity, so the corpus is described by a
histogram of bounded size, and the whole plan is made from it on the driver,
whatever the number of documents:

1. lengths above ``LARGE`` are sorted and cut into ``GROUPS`` groups of equal
   cardinality; each is rounded up to the longest of its group;
2. configurations of these few sizes are chosen, fullest first, by a bounded
   knapsack over what is left;
3. actual lengths take the rounded places, as runs of equal lengths;
4. the small lengths go, longest first, to the fullest sequence they fit.

Ranks within each length, counted in parallel, then give every piece its place.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Memory, as_bytes, default_path, loaded
from .common import giving_back, partitions, read, slices, staged

CAPACITY = 4096
SEPARATOR = 1
#: Longer pieces are large; the others fill gaps.
LARGE = CAPACITY // 8
#: Groups of equal cardinality of the large lengths.
GROUPS = 48
#: Bits of a rank within its length.
_RANK_BITS = 48


def _configuration(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many of each size make the fullest sequence; of equally full ones, one with the longest sizes."""
    ways = [np.zeros(capacity + 1, bool)]
    ways[0][0] = True
    for s, n in zip(reversed(sizes), reversed(left), strict=True):
        w = ways[-1].copy()
        add = w
        for _ in range(min(n, capacity // s)):
            shifted = np.zeros_like(add)
            shifted[s:] = add[:-s]
            add = shifted
            w |= add
        ways.append(w)
    at = int(np.flatnonzero(ways[-1])[-1])
    take = []
    for k, (s, n) in enumerate(zip(sizes, left, strict=True)):
        below = ways[len(sizes) - k - 1]
        count = max(c for c in range(min(n, at // s) + 1) if below[at - c * s])
        take.append(count)
        at -= count * s
    return take


def plan(histogram: dict[int, int], capacity: int = CAPACITY, large: int = LARGE, groups: int = GROUPS) -> list[tuple[list[int], int]]:
    """Patterns (lengths in order, number of sequences of this kind) that hold each length of the histogram as often as it is there."""
    histogram = {s: n for s, n in histogram.items() if n}
    if any(not 0 < s <= capacity for s in histogram):
        raise ValueError("lengths must be from 1 to the capacity")
    runs = [[s, histogram[s]] for s in sorted((s for s in histogram if s > large), reverse=True)]
    total = sum(n for _, n in runs)
    grouped: list[list[list[int]]] = []
    for g in range(min(groups, total)):
        want = total * (g + 1) // min(groups, total) - total * g // min(groups, total)
        mine = []
        while want:
            n = min(want, runs[0][1])
            mine.append([runs[0][0], n])
            runs[0][1] -= n
            want -= n
            if not runs[0][1]:
                runs.pop(0)
        grouped.append(mine)
    merged: dict[int, list[list[int]]] = {}
    for mine in grouped:  # groups of one rounded size are one
        merged.setdefault(mine[0][0], []).extend(mine)
    sizes = list(merged)
    left = [sum(n for _, n in merged[s]) for s in sizes]
    made: list[tuple[list[int], int]] = []
    while any(left):
        take = _configuration(sizes, left, capacity)
        times = min(n // c for n, c in zip(left, take, strict=True) if c)
        left = [n - c * times for n, c in zip(left, take, strict=True)]
        while times:  # actual lengths in runs
            heads = []
            for s, c in zip(sizes, take, strict=True):
                need = c
                for run in merged[s]:
                    k = min(need, run[1])
                    heads += [(run, k)] if k else []
                    need -= k
                    if not need:
                        break
            t = min([times, *(run[1] // k for run, k in heads)])
            made.append(([run[0] for run, k in heads for _ in range(k)], t))
            for run, k in heads:
                run[1] -= k * t
            for s in sizes:
                merged[s] = [r for r in merged[s] if r[1]]
            times -= t
    gaps: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    for lengths, n in made:
        gaps[capacity - sum(lengths)].append((lengths, n))
    order = sorted(gaps)
    for s in sorted((s for s in histogram if s <= large), reverse=True):
        n = histogram[s]
        while n:
            k = bisect.bisect_left(order, s)
            if k == len(order):
                fit = capacity // s
                lengths, most, gap = [], max(1, n // fit), capacity
            else:
                gap = order[k]
                lengths, most = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(k)
            each = min(gap // s, n) if n < most else min(gap // s, n // most)
            t = min(most, n // each)
            if most > t and k < len(order) + 1 and lengths:
                if gap not in gaps:
                    bisect.insort(order, gap)
                gaps[gap].append((lengths, most - t))
            rest = gap - each * s
            if rest not in gaps:
                bisect.insort(order, rest)
            gaps[rest].append((lengths + [s] * each, t))
            n -= each * t
    return [x for mine in gaps.values() for x in mine]


def places(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces of this length in a sequence, offset of the first of them)."""
    used: Counter = Counter()
    out, base = [], 0
    for lengths, times in patterns:
        offset = 0
        for s, c in sorted(Counter(lengths).items(), reverse=True):
            out.append((s, used[s], used[s] + c * times, base, c, offset))
            used[s] += c * times
            offset += s * c
        base += times
    return out


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every document's tokens and separator, cut only beyond the capacity."""

    def run(batches):
        bpe = loaded(path or default_path())
        memory, end = Memory(), as_bytes([SEPARATOR])
        for batch in slices(batches, most=1 << 20):
            split = [bpe.parts(t) for t in batch["text"].to_pylist()]
            of = memory.of(split, bpe.merge_all)
            out: list[tuple] = []
            for d, parts in zip(batch["doc_id"].to_pylist(), split, strict=True):
                whole = b"".join([as_bytes([p]) if isinstance(p, int) else b"".join([of[w] for w in p]) for p in parts]) + end
                for k in range(0, len(whole), 4 * capacity):
                    x = whole[k : k + 4 * capacity]
                    out.append((d, k // (4 * capacity), k // 4, len(x) // 4, zlib.crc32(x)))
            del split
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(giving_back(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of ``docs`` with ``sequence_id`` and ``offset``.

    A null or empty text is the separator alone. Repeated rows are packed as often as they are there. An empty
    table gives an empty result. Extra columns are not read. The driver gets a histogram of at most ``capacity``
    lengths; the broadcast plan is bounded by the patterns made from it.
    """
    spark = docs.sparkSession
    table = staged(pieces(docs, path, capacity), "pieces")
    salts = 4 * partitions(spark)
    salted = table.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    tally = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = places(plan(histogram, capacity, large=max(1, capacity // 8)))
    # sorted by length and first rank, and the ranks of a length have no gap, so the last row not above a piece is its own
    steps = np.array(sorted(rows), np.int64).reshape(-1, 6)
    held = spark.sparkContext.broadcast(((steps[:, 0] << _RANK_BITS) | steps[:, 1], steps))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = tally.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_k", F.row_number().over(inside)).join(starts, ["length", "_salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_k") - 1).cast("long").alias("rank"))

    def placed(batches):
        keys, plan_rows = held.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            step = plan_rows[np.searchsorted(keys, (length << _RANK_BITS) | rank, side="right") - 1]
            nth, each = rank - step[:, 1], step[:, 4]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(step[:, 3] + nth // each), pa.array(step[:, 5] + nth % each * length)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents", "doc_id", "text"))
