"""Spark data sources: `deflate` reads compressed files of a mounted folder, in parts where their framing allows; `file_sink` writes bytes as files.

    spark.dataSource.register(DeflateSource)
    spark.read.format("deflate").option("table", "chunks").load("/data/*.gz")
"""

from __future__ import annotations

import glob
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .members import Malformed, gzip_header, members

TABLES = {"chunks": "file_id string, start_byte long, piece long, bytes binary", "members": "file_id string, header_offset long, end_offset long, uncompressed_size long, newlines long, crc32 long"}
MOST_BLOCK = 1 << 16  # bytes of a BGZF block
REFUSED = {"no-verify": "output is always verified", "sparse-windows": "windows are whole", "io-read-method": "Spark reads the files"}


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int


def block_size(data: bytes, at: int) -> int | None:
    """Size of the BGZF block whose header is at a place, or None where there is no such header."""
    if data[at : at + 4] != b"\x1f\x8b\x08\x04":
        return None
    try:
        return gzip_header(data, at)[1].get("bgzf_block_size")
    except Malformed:
        return None


def first_block(f: BinaryIO, at: int, size: int) -> int:
    """The first BGZF block at or after a byte: a header whose size leads to another header, or to the end of the file."""
    while at < size:
        f.seek(at)
        data = f.read(3 * MOST_BLOCK)
        place = data.find(b"\x1f\x8b\x08\x04")
        while 0 <= place < 2 * MOST_BLOCK:
            own = block_size(data, place)
            if own and (at + place + own == size or block_size(data, place + own)):
                return at + place
            place = data.find(b"\x1f\x8b\x08\x04", place + 1)
        at += 2 * MOST_BLOCK
    return size


class DeflateReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.table, self.form = options.get("table", "chunks"), options.get("container", "auto")
        self.span, self.path = int(options.get("span", 16 << 20)), re.sub(r"^file:(//)?", "", options["path"])

    def partitions(self) -> list[Part]:
        """A BGZF file is cut every `span` bytes, any other file is one part; the driver reads one header of each file, tasks find the block edges."""
        found = sorted(glob.glob(os.path.join(self.path, "*") if os.path.isdir(self.path) else self.path))
        if not found:
            raise FileNotFoundError(self.path)
        parts = []
        for path in found:
            size = os.path.getsize(path)
            with open(path, "rb") as f:
                blocks = self.form in ("auto", "gzip") and block_size(f.read(MOST_BLOCK), 0)
            edges = [*range(0, size, self.span), size] if blocks else [0, size]
            parts += [Part(path, a, b) for a, b in zip(edges, edges[1:], strict=False)] or [Part(path, 0, 0)]
        return parts

    def read(self, part: Part) -> Iterator[tuple]:
        size = os.path.getsize(part.path)
        with open(part.path, "rb") as f:
            start = first_block(f, part.start, size) if part.start else 0
            end = first_block(f, part.end, size) if part.end < size else size
            if start >= end and part.start:
                return
            f.seek(start)
            content = f.read(end - start)
        n = 0
        for m, data in members(content, self.form):
            if data is None and self.table == "members":
                yield part.path, start + m.header_offset, start + m.end_offset, m.uncompressed_size, m.newlines, m.fields.get("crc32")
            elif data and self.table == "chunks":
                yield part.path, start, n, data
                n += 1


class DeflateSource(DataSource):
    """Options: table (chunks, members), container (auto, gzip, zlib, raw-deflate), span (bytes of a part of a BGZF file)."""

    @classmethod
    def name(cls) -> str:
        return "deflate"

    def schema(self) -> str:
        for name, why in REFUSED.items():
            if name in self.options:
                raise ValueError(f"{name}: {why}")
        table = self.options.get("table", "chunks")
        if table not in TABLES:
            raise ValueError(f"table is one of {', '.join(TABLES)}")
        return TABLES[table]

    def reader(self, schema: object) -> DeflateReader:
        return DeflateReader(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


def same_file(a: str, b: str) -> bool:
    """Whether two paths lead to one file, by links too."""
    return os.path.exists(a) and os.path.exists(b) and os.path.samefile(a, b)


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str, force: bool, inputs: str = ""):
        self.folder, self.force, self.inputs = re.sub(r"^file:(//)?", "", folder), force, re.sub(r"^file:(//)?", "", inputs)

    def write(self, rows: Iterator) -> Written:
        done = []
        inputs = glob.glob(os.path.join(self.inputs, "*") if os.path.isdir(self.inputs) else self.inputs)
        for row in rows:
            target = os.path.join(self.folder, os.path.basename(row["file_id"]))
            if any(same_file(target, x) for x in inputs):
                raise ValueError(f"{target} is an input")
            part = f"{target}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(row["content"] or b"")
                f.flush()
                os.fsync(f.fileno())
            done.append((part, target))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files = [x for m in messages if m for x in m.files]
        for part, target in files:
            if self.force:
                os.replace(part, target)
            else:
                os.link(part, target)  # fails where the target exists
                os.unlink(part)

    def abort(self, messages: list[Written | None]) -> None:
        for part, _ in (x for m in messages if m for x in m.files):
            if os.path.exists(part):
                os.unlink(part)


class FileSink(DataSource):
    """Rows (file_id, content) as files of a mounted folder, whole or not at all; an existing file is replaced in overwrite mode only.

    Option inputs: a path or pattern of files that are never replaced.
    """

    @classmethod
    def name(cls) -> str:
        return "file_sink"

    def schema(self) -> str:
        return "file_id string, content binary"

    def writer(self, schema: object, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite, self.options.get("inputs", ""))


__all__ = ["DeflateSource", "FileSink"]
