"""A data source that lists files and hashes them in chunks.

The driver lists paths and sizes only. A partition is some files of about ``PARTITION`` bytes together (a larger file is one of
its own: a digest is taken in order); a task streams them, one chunk in memory. Paths are those of ``pyarrow.fs``
(local, hdfs, s3, gs); a path that only another connector knows takes ``files.inventory``, which holds a file in one value.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from urllib.parse import quote, unquote
from uuid import uuid4

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PARTITION = 128 << 20
OPEN_COST = 1 << 20
SCHEMA = "filename string, path string, length bigint, sha256 string"


class Files(InputPartition):
    """(path, size) of the files of one task."""

    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


def _file_system(path: str):
    """(file system, path in it, what comes before)."""
    from pyarrow import fs
    if "://" in path and not path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(quote(path, safe="/:@%=?&,"))
        inner = unquote(inner)
        return system, inner, path[:len(path) - len(inner)] if path.endswith(inner) else ""
    inner = path.removeprefix("file:")
    return fs.LocalFileSystem(), os.path.abspath(f"/{inner.lstrip('/')}" if path.startswith("file:") else inner), "file:"


def file_writer(base: str):
    """A step for ``mapInArrow`` over (name, content): each row becomes the file ``base/name``, and a batch its number of files.
    A file appears whole under its name; a repeated task puts the same bytes there again."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root, _ = _file_system(base)
        made = set()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder, _, last = f"{root}/{name}".rpartition("/")
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                unfinished = f"{folder}/_{uuid4().hex}"
                with system.open_output_stream(unfinished) as stream:
                    stream.write(content)
                system.move(unfinished, f"{folder}/{last}")
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})
    return write


class DigestReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = options["paths"].split("\n")
        self.extensions = {e.lower() for e in options["extensions"].split("\n")}
        self.chunk = int(options["chunk"])

    def partitions(self) -> list[Files]:
        from pyarrow import fs
        found = []
        for path in self.paths:
            system, root, prefix = _file_system(path)
            for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
                if info.type == fs.FileType.File and info.extension.lower() in self.extensions and not info.base_name.startswith(("_", ".")):
                    found.append((prefix + info.path, info.size))
        parts, size = [[]], 0
        for path, n in sorted(found, key=lambda f: -f[1]):
            if parts[-1] and size + n > PARTITION:
                parts.append([])
                size = 0
            parts[-1].append((path, n))
            size += n + OPEN_COST
        return [Files(p) for p in parts]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows = []
        for path, _ in partition.files:
            system, inner, _ = _file_system(path)
            digest, length = hashlib.sha256(), 0
            with system.open_input_stream(inner) as stream:
                while block := stream.read(self.chunk):
                    digest.update(block)
                    length += len(block)
            rows.append((path.rpartition("/")[2], path, length, digest.hexdigest()))
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string()))],
                                         ["filename", "path", "length", "sha256"])


class FileDigests(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DigestReader:
        return DigestReader(dict(self.options))
