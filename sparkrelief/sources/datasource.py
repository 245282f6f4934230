"""The data source ``terrain``: tile trees ``{z}/{x}/{y}.terrain`` as tables, by pyarrow's file systems (local, HDFS, S3, GCS).

``spark.dataSource.register(TerrainSource)``; then ``spark.read.format("terrain").option("sections", "header,u")``
decodes only these sections, and ``df.write.format("terrain").mode("append").save(root)`` writes rows of
(z, x, y, content), each file first under another name, so that readers see whole tiles only. Files that only
Spark's own readers reach are read by ``files.read_tree``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import tilebytes

_FILE = re.compile(r"(\d+)/(\d+)/(\d+)\.terrain$")
_KEYS = T.StructType([T.StructField(c, T.IntegerType()) for c in "zxy"])


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Files(InputPartition):
    """Some tiles: (z, x, y, path)."""

    tiles: list[tuple[int, int, int, str]]


class TerrainReader(DataSourceReader):
    def __init__(self, options: dict[str, str], sections: list[str] | None):
        self.root, self.sections = options["path"], sections
        self.strict = options.get("mode", "FAILFAST").upper() != "PERMISSIVE"
        self.at_once = int(options.get("tilesPerPartition", "512"))

    def partitions(self) -> list[Files]:
        system, root = _opened(self.root)
        found = [(m, i.path) for i in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=False)) if i.type == fs.FileType.File and (m := _FILE.search(i.path))]
        tiles = sorted((int(m[1]), int(m[2]), int(m[3]), path) for m, path in found)
        return [Files(tiles[i : i + self.at_once]) for i in range(0, len(tiles), self.at_once)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.root)
        for i in range(0, len(partition.tiles), 64):
            some = partition.tiles[i : i + 64]
            contents = []
            for *_, path in some:
                with system.open_input_stream(path) as f:
                    contents.append(f.read())
            keys = [pa.array([t[k] for t in some], pa.int32()) for k in range(3)]
            if self.sections == ["content"]:
                yield pa.RecordBatch.from_arrays([*keys, pa.array(contents, pa.binary())], [*"zxy", "content"])
            else:
                yield pa.RecordBatch.from_arrays([*keys, *tilebytes.decoded(contents, self.sections, self.strict)], [*"zxy", *tilebytes.mesh_schema(self.sections).names])


@dataclass
class Written(WriterCommitMessage):
    """How many tiles a task wrote."""

    tiles: int


class TerrainWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.root, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _opened(self.root)
        made, folders = 0, set()
        for batch in iterator:
            for z, x, y, content in zip(*[batch[c].to_pylist() for c in ("z", "x", "y", "content")], strict=True):
                folder = f"{root}/{z}/{x}"
                if folder not in folders:
                    system.create_dir(folder, recursive=True)
                    folders.add(folder)
                # a task that is tried again, or runs twice, puts the same bytes in the same place
                part = f"{folder}/.{y}-{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as f:
                    f.write(content)
                system.move(part, f"{folder}/{y}.terrain")
                made += 1
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        """Tiles are in place already."""

    def abort(self, messages: list[Written | None]) -> None:
        """Tiles that were written stay, as they are whole; a new run replaces them."""


class TerrainSource(DataSource):
    """Options: ``path``; ``sections`` (of a tile, comma-separated, or ``content`` for bytes); ``mode`` FAILFAST or PERMISSIVE; ``tilesPerPartition``."""

    @classmethod
    def name(cls) -> str:
        return "terrain"

    def _sections(self) -> list[str] | None:
        asked = [s.strip() for s in self.options.get("sections", "").split(",") if s.strip()]
        known = {f.name for f in tilebytes.MESH_SCHEMA} | {"content"}
        if unknown := set(asked) - known:
            raise ValueError(f"unknown sections: {', '.join(sorted(unknown))}")
        if "content" in asked and len(asked) > 1:
            raise ValueError("content can't be read along with its sections")
        return asked or None

    def schema(self) -> T.StructType:
        sections = self._sections()
        rest = [T.StructField("content", T.BinaryType())] if sections == ["content"] else list(tilebytes.mesh_schema(sections))
        return T.StructType([*_KEYS, *rest])

    def reader(self, schema: T.StructType) -> TerrainReader:
        return TerrainReader(self.options, self._sections())

    def writer(self, schema: T.StructType, overwrite: bool) -> TerrainWriter:
        if missing := {"z", "x", "y", "content"} - set(schema.names):
            raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
        return TerrainWriter(self.options, overwrite)
