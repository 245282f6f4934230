"""What the text operators share: reading, staging in the shared folder, hashing of bytes and words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A document is a training row of the learned operators if crc32(doc_id as text) mod 4 is not this.
HELD_OUT_REMAINDER = 2

U = np.uint64
_M1, _M2, _M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0xD6E8FEB86659FD93)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The columns of a table of ``sf_dir``; only these are read from Parquet."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def partitions(spark: SparkSession, least: int = 8) -> int:
    """How many parts to deal data to: the session's shuffle partitions, which the user sizes to the data."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a local one only where that is unset and all runs on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="llm-stage-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns freed memory to the system: a worker process outlives its task and shares the executor's memory with the next one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(run):
    """A function of batches that gives memory back after its last batch."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def slices(batches, column: str = "text", most: int = 1 << 22):
    """The batches in slices whose texts have about ``most`` bytes, or one row; a slice copies nothing."""
    for batch in batches:
        sizes = pc.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // most
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(sizes)], strict=False):
            yield batch.slice(a, b - a)


def is_held_out(doc_id: str = "doc_id"):
    """Column: crc32 of the id's decimal text mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == HELD_OUT_REMAINDER, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    x = x ^ (x >> U(29))
    x = x * _M2
    return x ^ (x >> U(32))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two uint64 hashes; the order counts."""
    return mix(a * _M3 + b)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = np.ones(1, U), np.ones(1, U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base mod 2**64, and of its inverse."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        base = 0x9E3779B97F4A7C15
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, U(b))
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _POWERS = tuple(made)
    return _POWERS


def word_hashes(data: bytes, blanks: np.ndarray = _SPACE) -> np.ndarray:
    """Hashes of the words of ``data`` in order: runs of bytes outside ``blanks`` ([\\x20\\x09-\\x0D]), A-Z lower-cased."""
    b = _LOWER[np.frombuffer(data, np.uint8)]
    inside = ~blanks[b]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    first, end = edge[::2], edge[1::2]
    if not len(first):
        return np.empty(0, U)
    with np.errstate(over="ignore"):
        up, down = powers(len(b) + 1)
        total = np.zeros(len(b) + 1, U)
        np.cumsum(mix((b.astype(U) + U(1)) * _M1) * up[: len(b)], out=total[1:])
        return mix((total[end] - total[first]) * down[first] + (end - first).astype(U) * _M3)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; with fewer words, of the whole sequence; none without words."""
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        k = min(n, len(words))
        h = words[: len(words) - k + 1]
        for i in range(1, k):
            h = pair(h, words[i : len(words) - k + 1 + i])
        return np.unique(mix(h + U(k) * _M1))
