"""Tile trees ``{z}/{x}/{y}.terrain``: reading by binaryFile, which reaches what Spark does; writing by the data source ``terrain``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """z, x, y, content of every tile file under ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.terrain").load(root)
    part = lambda i: F.regexp_extract("path", r"(\d+)/(\d+)/(\d+)\.terrain$", i).cast("int")
    return files.select(part(1).alias("z"), part(2).alias("x"), part(3).alias("y"), "content")


def write_table(tiles: DataFrame, path: str) -> None:
    """z, x, y, content as Parquet partitioned by z: one file for many tiles, as object stores like it."""
    tiles.write.mode("overwrite").partitionBy("z").parquet(path)


def write_tree(tiles: DataFrame, root: str) -> None:
    """One file for each tile, by the data source ``terrain``, on any file system that pyarrow reaches."""
    from .datasource import TerrainSource

    tiles.sparkSession.dataSource.register(TerrainSource)
    tiles.select(*[F.col(c).cast("int").alias(c) for c in "zxy"], "content").write.format("terrain").mode("append").save(root)
