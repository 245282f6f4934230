"""A small PNG codec for 8-bit RGB and RGBA, and dispatch to image containers."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import rgb
from . import tilebytes

# Fixed value: the signature of a PNG file.
SIGNATURE = b"\x89PNG\r\n\x1a\n"


class ContainerError(ValueError):
    """An image that can't be read or written."""


class Unsupported(ContainerError):
    """A container without a codec here."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(pixels: bytes, width: int, height: int, channels: int = 3) -> bytes:
    """PNG of RGB or RGBA bytes."""
    if len(pixels) != width * height * channels:
        raise ContainerError("the number of bytes doesn't fit the size")
    rows = np.frombuffer(pixels, np.uint8).reshape(height, width * channels)
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 6, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> tuple[bytes, int, int]:
    """RGB bytes, width and height; alpha is dropped."""
    if data[:8] != SIGNATURE:
        raise ContainerError("not a PNG")
    at, packed, head = 8, [], None
    while at + 8 <= len(data):
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or head[2] != 8 or head[3] not in (2, 6) or head[6]:
        raise ContainerError("only 8-bit RGB and RGBA without interlacing are read")
    width, height, channels = head[0], head[1], 3 if head[3] == 2 else 4
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * channels)
    except (zlib.error, ValueError) as e:
        raise ContainerError(f"not a PNG: {e}") from e
    out = np.zeros((height, width * channels), np.uint8)
    zero = np.zeros((width, channels), np.int64)
    for y in range(height):
        kind, line = int(raw[y, 0]), raw[y, 1:].reshape(width, channels).astype(np.int64)
        up = out[y - 1].reshape(width, channels).astype(np.int64) if y else zero
        if kind == 0:
            row = line
        elif kind == 1:
            row = np.cumsum(line, axis=0)
        elif kind == 2:
            row = line + up
        elif kind in (3, 4):
            row, a, c = np.empty_like(line), zero[0], zero[0]
            for i in range(width):  # a pixel needs the one before it; its channels go at once
                b = up[i]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    to_a, to_b, to_c = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
                    guess = np.where((to_a <= to_b) & (to_a <= to_c), a, np.where(to_b <= to_c, b, c))
                a = row[i] = (line[i] + guess) & 255
                c = b
        else:
            raise ContainerError("unknown filter")
        out[y] = (row & 255).ravel()
    return out.reshape(height, width, channels)[:, :, :3].tobytes(), width, height


def write_container(name: str, pixels: bytes, width: int, height: int, channels: int = 3) -> bytes:
    """An image in a container by its name; only png has a codec here."""
    kind = name.lower().removeprefix("image/")
    if kind == "png":
        return write_png(pixels, width, height, channels)
    if kind in ("webp", "avif"):
        raise Unsupported(kind)
    raise ContainerError(f"unknown container: {name}")


def image_heights(images: DataFrame, keys: list[str], fmt: str, tile_size: int) -> DataFrame:
    """keys and ``heights`` (single precision, north up) of PNG ``content``; another size than ``tile_size`` squared is an error."""

    def run(batches):
        for batch in batches:
            for _, some in tilebytes.slices(batch, tile_size * tile_size):
                made = []
                for content in some["content"].to_pylist():
                    pixels, width, height = read_png(content)
                    if (width, height) != (tile_size, tile_size):
                        raise ContainerError(f"an image of {width} by {height} pixels, not {tile_size} by {tile_size}")
                    made.append(rgb.decode(fmt, np.frombuffer(pixels, np.uint8)))
                at = pa.array(np.arange(len(made) + 1) * tile_size * tile_size, pa.int32())
                yield pa.RecordBatch.from_arrays([*[some[k] for k in keys], pa.ListArray.from_arrays(at, pa.array(np.concatenate(made), pa.float32()))], [*keys, "heights"])

    schema = T.StructType([*[images.schema[k] for k in keys], T.StructField("heights", T.ArrayType(T.FloatType()))])
    return images.select(*keys, "content").mapInArrow(run, schema)


def height_images(tiles: DataFrame, keys: list[str], fmt: str, tile_size: int) -> DataFrame:
    """keys and PNG ``content`` of ``heights``."""

    def run(batches):
        for batch in batches:
            grids = tilebytes.lists(batch["heights"])
            for k, some in tilebytes.slices(batch, tile_size * tile_size):
                made = []
                for heights in grids[k : k + some.num_rows]:
                    if len(heights) != tile_size * tile_size:
                        raise ContainerError(f"{len(heights)} heights, not {tile_size * tile_size}")
                    made.append(write_png(rgb.encode(fmt, np.asarray(heights, float)).tobytes(), tile_size, tile_size))
                yield pa.RecordBatch.from_arrays([*[some[c] for c in keys], pa.array(made, pa.binary())], [*keys, "content"])

    return tiles.select(*keys, "heights").mapInArrow(run, T.StructType([*[tiles.schema[k] for k in keys], T.StructField("content", T.BinaryType())]))
