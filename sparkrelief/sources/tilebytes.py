"""Terrain tile bytes: packing and parsing in Arrow batches. Everything else stays in columns."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of the format.
HEADER = struct.Struct("<3d2f3dd3d")
EXT_NORMALS, EXT_MASK, EXT_METADATA = 1, 2, 4
MASK_SIZES = (1, 65536)
#: Numbers (or bytes) that an Arrow step makes at once, besides one row's; a batch may have 10,000 rows of any size.
AT_ONCE = 1 << 18
HEADER_FIELDS = ("center", "min_height", "max_height", "sphere_center", "sphere_radius", "horizon_point")
EDGES = ("west", "south", "east", "north")


class TileError(ValueError):
    """Bytes that are no tile."""


def _delta(values) -> np.ndarray:
    d = np.diff(np.asarray(values, np.int64), prepend=0)
    return (((d << 1) ^ (d >> 63)) & 0xFFFF).astype("<u2")


def _undelta(codes: np.ndarray) -> np.ndarray:
    c = codes.astype(np.int64)
    return np.cumsum((c >> 1) ^ -(c & 1)) & 0xFFFF


def _high_water(indices: np.ndarray) -> np.ndarray:
    top = np.maximum.accumulate(np.concatenate(([-1], indices[:-1]))) + 1 if len(indices) else indices
    codes = top - indices
    if (codes < 0).any():
        raise TileError("index above the high-water mark")
    return codes


def _from_high_water(codes: np.ndarray) -> np.ndarray:
    new = codes == 0
    return np.cumsum(new) - new - codes


def encode_tile(head: dict, u, v, height, indices, edges: dict, normals: bytes | None = None, mask: bytes | None = None, metadata: str | None = None, level: int = 0) -> bytes:
    """A tile's bytes. ``mask`` has one byte or 65536; ``level`` over 0 compresses."""
    n = len(u)
    wide = n > 65535
    kind, unit = ("<u4", 4) if wide else ("<u2", 2)
    if normals is not None and len(normals) != 2 * n:
        raise TileError("normals have two bytes for each vertex")
    vec = lambda p: (p["x"], p["y"], p["z"])
    parts = [HEADER.pack(*vec(head["center"]), head["min_height"], head["max_height"], *vec(head["sphere_center"]), head["sphere_radius"], *vec(head["horizon_point"])), struct.pack("<I", n)]
    parts += [_delta(x).tobytes() for x in (u, v, height)]
    parts.append(b"\0" * (-(92 + 6 * n) % unit))
    idx = np.asarray(indices, np.int64)
    parts += [struct.pack("<I", len(idx) // 3), _high_water(idx).astype(kind).tobytes()]
    for e in EDGES:
        parts += [struct.pack("<I", len(edges[e])), np.asarray(edges[e], np.int64).astype(kind).tobytes()]
    for number, payload in ((EXT_NORMALS, normals), (EXT_MASK, mask), (EXT_METADATA, metadata)):
        if payload is None:
            continue
        if number == EXT_MASK and len(payload) not in MASK_SIZES:
            raise TileError("a water mask has 1 or 65536 bytes")
        if number == EXT_METADATA:
            text = payload.encode()
            payload = struct.pack("<I", len(text)) + text
        parts += [struct.pack("<BI", number, len(payload)), payload]
    whole = b"".join(parts)
    if level:
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        whole = z.compress(whole) + z.flush()
    return whole


def is_gzip(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b"


def _extensions(data: bytes, at: int, n: int) -> dict:
    """Known extensions; a cut one ends the search, unknown ones are skipped, the last of equals wins."""
    out: dict = {"normals": None, "mask": None, "metadata": None}
    while len(data) - at >= 5:
        number, size = struct.unpack_from("<BI", data, at)
        at += 5
        if at + size > len(data):
            break
        payload = data[at : at + size]
        at += size
        if number == EXT_NORMALS:
            out["normals"] = payload[: 2 * n]
        elif number == EXT_MASK:
            out["mask"] = payload if size in MASK_SIZES else b"\0"
        elif number == EXT_METADATA:
            if size < 4 or struct.unpack_from("<I", payload)[0] > size - 4:
                raise TileError("metadata is cut short")
            out["metadata"] = payload[4 : 4 + struct.unpack_from("<I", payload)[0]].decode()
    return out


def decode_tile(data: bytes, sections: set[str] | None = None) -> dict:
    """The asked sections of a tile (all by default), compressed or not; the streams of others are stepped over. Numbers are arrays."""
    wanted = lambda *names: sections is None or not sections.isdisjoint(names)
    try:
        if is_gzip(data):
            data = zlib.decompress(data, 31)
        h = HEADER.unpack_from(data)
        (n,) = struct.unpack_from("<I", data, HEADER.size)
        at, out = HEADER.size + 4, {}
        kind, unit = ("<u4", 4) if n > 65535 else ("<u2", 2)
        if len(data) < at + 6 * n:
            raise TileError("vertices are cut short")
        for name in ("u", "v", "height"):
            if wanted(name):
                out[name] = _undelta(np.frombuffer(data, "<u2", n, at))
            at += 2 * n
        at += -at % unit
        (t,) = struct.unpack_from("<I", data, at)
        if len(data) < at + 4 + 3 * t * unit:
            raise TileError("indices are cut short")
        if wanted("indices"):
            out["indices"] = _from_high_water(np.frombuffer(data, kind, 3 * t, at + 4).astype(np.int64))
        at += 4 + 3 * t * unit
        edges = {}
        for e in EDGES:
            (k,) = struct.unpack_from("<I", data, at)
            if len(data) < at + 4 + k * unit:
                raise TileError("edges are cut short")
            if wanted("edges"):
                edges[e] = np.frombuffer(data, kind, k, at + 4).astype(np.int64)
            at += 4 + k * unit
    except (struct.error, ValueError, zlib.error) as e:
        raise TileError(f"not a tile: {e}") from e
    if wanted("edges"):
        out["edges"] = edges
    if wanted("header"):
        vec = lambda i: dict(zip("xyz", h[i : i + 3], strict=True))
        out["header"] = {"center": vec(0), "min_height": h[3], "max_height": h[4], "sphere_center": vec(5), "sphere_radius": h[8], "horizon_point": vec(9)}
    if wanted("normals", "mask", "metadata"):
        out |= {k: v for k, v in _extensions(data, at, n).items() if wanted(k)}
    return out


_VEC = T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"])
HEADER_SCHEMA = T.StructType([T.StructField("center", _VEC), T.StructField("min_height", T.FloatType()), T.StructField("max_height", T.FloatType()), T.StructField("sphere_center", _VEC), T.StructField("sphere_radius", T.DoubleType()), T.StructField("horizon_point", _VEC)])
_INTS, _LONGS = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
MESH_SCHEMA = T.StructType([
    T.StructField("header", HEADER_SCHEMA), *(T.StructField(c, _INTS) for c in ("u", "v", "height")), T.StructField("indices", _LONGS), T.StructField("edges", T.StructType([T.StructField(e, _LONGS) for e in EDGES])),
    T.StructField("normals", T.BinaryType()), T.StructField("mask", T.BinaryType()), T.StructField("metadata", T.StringType()), T.StructField("corrupt", T.StringType()),
])


def lists(column) -> list[np.ndarray]:
    """The values of a list column, not copied."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[at[i] : at[i + 1]] for i in range(len(column))]


def slices(batch: pa.RecordBatch, sizes):
    """First row and rows of parts of ``batch``, each of ``AT_ONCE`` and a row at most by ``sizes``, a number for each row or one for all."""
    part = np.cumsum(np.broadcast_to(np.asarray(sizes, np.int64), batch.num_rows)) // AT_ONCE
    starts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), batch.num_rows]
    for k, end in zip(starts, starts[1:], strict=False):
        yield k, batch.slice(k, end - k)


def _arrow(field: T.StructField, rows: list[dict]) -> pa.Array:
    """A column of what tiles were decoded to."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind, values = to_arrow_type(field.dataType), [r.get(field.name) for r in rows]
    if field.name == "edges":
        return pa.StructArray.from_arrays([_arrow(T.StructField(e, _LONGS), [v or {} for v in values]) for e in EDGES], EDGES, mask=pa.array([v is None for v in values]))
    if isinstance(field.dataType, T.ArrayType):
        there = [v is not None for v in values]
        sizes = np.array([len(v) if v is not None else 0 for v in values], np.int64)
        flat = np.concatenate([v for v in values if v is not None] or [np.empty(0, np.int64)])
        at = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32(), mask=np.array([*(not x for x in there), False]))
        return pa.ListArray.from_arrays(at, pa.array(flat, kind.value_type))
    return pa.array(values, kind)


def encode_tiles(tiles: DataFrame, keys: list[str], level: int = 0) -> DataFrame:
    """keys and ``content`` from columns header, q (u, v, height), indices, edges and, if there, normals, mask, metadata."""
    more = [c for c in ("normals", "mask", "metadata") if c in tiles.columns]

    def run(batches):
        for batch in batches:
            heads = batch["header"].to_pylist()
            u, v, h = (lists(batch["q"].field(c)) for c in ("u", "v", "height"))
            indices, sides = lists(batch["indices"]), {e: lists(batch["edges"].field(e)) for e in EDGES}
            rest = {c: batch[c].to_pylist() for c in more}
            made = [encode_tile(heads[i], u[i], v[i], h[i], indices[i], {e: sides[e][i] for e in EDGES}, level=level, **{c: rest[c][i] for c in more}) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in keys], pa.array(made, pa.binary())], [*keys, "content"])

    schema = T.StructType([*[tiles.schema[k] for k in keys], T.StructField("content", T.BinaryType())])
    return tiles.select(*keys, "header", "q", "indices", "edges", *more).mapInArrow(run, schema)


def mesh_schema(sections: list[str] | None = None) -> T.StructType:
    """The fields of decoded tiles: the asked sections, and ``corrupt``."""
    return T.StructType([f for f in MESH_SCHEMA if sections is None or f.name in sections or f.name == "corrupt"])


def decoded(contents: list[bytes], sections: list[str] | None = None, strict: bool = True) -> list[pa.Array]:
    """Arrow columns of ``mesh_schema(sections)`` for some tiles."""
    rows, asked = [], None if sections is None else set(sections)
    for data in contents:
        try:
            rows.append(decode_tile(data, asked))
        except TileError as e:
            if strict:
                raise
            rows.append({"corrupt": str(e)})
    return [_arrow(f, rows) for f in mesh_schema(sections)]


def decode_tiles(tiles: DataFrame, keys: list[str], strict: bool = True, sections: list[str] | None = None) -> DataFrame:
    """keys and the asked ``sections`` of each ``content``; only these are decoded. If not ``strict``, bad bytes give nulls and a message in ``corrupt``."""
    wanted = mesh_schema(sections)

    def run(batches):
        for batch in batches:
            for _, some in slices(batch, pc.fill_null(pc.binary_length(batch["content"]), 0).to_numpy(zero_copy_only=False)):
                yield pa.RecordBatch.from_arrays([*[some[k] for k in keys], *decoded(some["content"].to_pylist(), sections, strict)], [*keys, *wanted.names])

    return tiles.select(*keys, "content").mapInArrow(run, T.StructType([*[tiles.schema[k] for k in keys], *wanted]))
