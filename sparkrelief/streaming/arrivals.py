"""Tiles that arrive as a stream: each micro-batch is encoded and appended (an extension; the batch plans are reused)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.encode import Options, encode_terrain


def encode_stream(tiles: DataFrame, cells: int, keys: list[str], path: str, checkpoint: str, options: Options | None = None):
    """Starts a query that encodes arriving tiles into Parquet; exactly once, as the file sink keeps a log."""
    return encode_terrain(tiles, cells, keys, options).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
