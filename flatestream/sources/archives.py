"""Tables from compressed files: archives (file_id, content) come from Spark's binaryFile reader or from a column."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from .batches import arrow_schema, packed
from .members import Malformed, Member, members

CHUNK = 4 << 20
MEMBER_FIELDS = [c.split(" ")[0] for c in schema.MEMBERS.split(", ")]


def archives(spark: SparkSession, path: str) -> DataFrame:
    """file_id, content of the files of a path, from any file system that Spark reads. A file may have 2 GiB at most."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_id"), "content")


def _row(file_id: str, i: int, m: Member | None, e: Malformed | None) -> dict:
    row = {"file_id": file_id, "member": i, "ok": e is None}
    if m:
        row |= {k: getattr(m, k) for k in ("format", "header_offset", "deflate_offset", "footer_offset", "end_offset", "uncompressed_offset", "uncompressed_size", "newlines")} | m.fields
    if e:
        row |= {"error_kind": e.kind, "error_offset": e.offset, "expected": e.expected, "actual": e.actual}
    return row


def member_table(files: DataFrame, format: str = "auto", strict: bool = False) -> DataFrame:
    """One row for each verified member, and one with ok = false and the error for what can't be read after them.

    strict raises at the first fault instead. A null content is an empty file.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for file_id, content in zip(batch.column(0), batch.column(1), strict=True):
                file_id, i = file_id.as_py(), 0
                try:
                    for m, data in members(content.as_py() or b"", format):
                        if data is None:
                            yield _row(file_id, i, m, None)
                            i += 1
                except Malformed as e:
                    if strict:
                        raise ValueError(f"{file_id}: {e}") from e
                    yield _row(file_id, i, None, e)

    arrow = arrow_schema(schema.MEMBERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed((tuple(map(r.get, MEMBER_FIELDS)) for r in rows(batches)), arrow)

    return files.select("file_id", "content").mapInArrow(run, schema.MEMBERS)


def chunk_table(files: DataFrame, format: str = "auto", chunk: int = CHUNK) -> DataFrame:
    """Decoded bytes in order: file_id, member, chunk, uncompressed_offset, bytes. Raises at a fault, so nothing unverified is kept."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for file_id, content in zip(batch.column(0), batch.column(1), strict=True):
                file_id, i, n, at = file_id.as_py(), 0, 0, 0
                try:
                    for _, data in members(content.as_py() or b"", format, chunk):
                        if data is None:
                            i += 1
                            continue
                        yield file_id, i, n, at, data
                        n, at = n + 1, at + len(data)
                except Malformed as e:
                    raise ValueError(f"{file_id}: {e}") from e

    arrow = arrow_schema(schema.CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(rows(batches), arrow)

    return files.select("file_id", "content").mapInArrow(run, schema.CHUNKS)


def digest_table(files: DataFrame, format: str = "auto", chunk: int = CHUNK) -> DataFrame:
    """file_id, sha256: of each file's whole decoded output, streamed through one state. Raises at a fault."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for file_id, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                state = hashlib.sha256()
                try:
                    for _, data in members(content.as_py() or b"", format, chunk):
                        state.update(data or b"")
                except Malformed as e:
                    raise ValueError(f"{file_id}: {e}") from e
                found.append(state.hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(found, pa.string())], ["file_id", "sha256"])

    return files.select("file_id", "content").mapInArrow(run, "file_id string, sha256 string")


def line_table(files: DataFrame, format: str = "auto") -> DataFrame:
    """file_id, line, byte_offset, terminated, text (binary, without \\n): a line ends at \\n only; an unterminated last one is a row but no line break."""

    form = "file_id string, line long, byte_offset long, terminated boolean, text binary"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for file_id, content in zip(batch.column(0), batch.column(1), strict=True):
                file_id, line, at = file_id.as_py(), 0, 0
                tail: list[bytes] = []
                try:
                    for _, data in members(content.as_py() or b"", format):
                        if not data:
                            continue
                        *full, rest = data.split(b"\n")
                        if full:
                            full[0] = b"".join([*tail, full[0]])
                            tail = []
                            for t in full:
                                yield file_id, line, at, True, t
                                line, at = line + 1, at + len(t) + 1
                        tail.append(rest)
                except Malformed as e:
                    raise ValueError(f"{file_id}: {e}") from e
                last = b"".join(tail)
                if last:
                    yield file_id, line, at, False, last

    arrow = arrow_schema(form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(rows(batches), arrow)

    return files.select("file_id", "content").mapInArrow(run, form)


def decode_report(members_: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Members, compressed and decoded bytes, lines and validity."""
    return members_.groupBy(*keys).agg(
        F.count_if("ok").alias("member_count"), F.coalesce(F.sum(F.col("end_offset") - F.col("header_offset")), F.lit(0)).alias("compressed_bytes"), F.coalesce(F.sum("uncompressed_size"), F.lit(0)).alias("decompressed_bytes"),
        F.coalesce(F.sum("newlines"), F.lit(0)).alias("line_count"), F.bool_and("ok").alias("ok"),
    )


def checkpoints_of(members_: DataFrame) -> DataFrame:
    """A checkpoint at the start of each member, with the lines before it."""
    from ..operators.scans import running

    rows = running(members_.where("ok"), ["file_id"], F.floor(F.col("member") / 4096), [F.col("member")], {"line_offset": ("sum", F.col("newlines"))})
    kind = F.when(F.col("format") == "gzip", "gzip_member_header").when(F.col("format") == "zlib", "zlib_header").otherwise("raw_deflate_start")
    return rows.select("file_id", F.col("member").alias("ordinal"), (F.col("header_offset") * 8).alias("compressed_offset_bits"), "uncompressed_offset", kind.alias("kind"), "header_offset", "line_offset")


def index_meta_of(members_: DataFrame) -> DataFrame:
    rows = members_.where("ok").groupBy("file_id").agg(F.first("format").alias("format"), F.max("end_offset").alias("compressed_size"), F.sum("uncompressed_size").alias("uncompressed_size"), F.sum("newlines").alias("total_lines"), F.bool_and(F.col("bgzf_block_size").isNotNull()).alias("bgzf"))
    kind = F.when(F.col("bgzf"), "bgzf").otherwise(F.col("format"))
    return rows.select("file_id", kind.alias("kind"), "compressed_size", "uncompressed_size", F.lit(None).cast("long").alias("spacing"), "total_lines")


def decode_spans(files: DataFrame, spans: DataFrame) -> DataFrame:
    """Decode each span of whole members on its own: file_id, ordinal, expected_size, actual_size, crc32 of its bytes.

    One file's bytes go to as many tasks as it has spans; spans (file_id, compressed_offset_bits, next_bits, expected_size, ordinal) start at member headers.
    """
    import zlib

    form = "file_id string, ordinal long, expected_size long, actual_size long, crc32 long"

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for file_id, ordinal, expected, part in zip(*batch.columns, strict=True):
                size = crc = 0
                for _, data in members(part.as_py(), "gzip"):
                    if data:
                        size, crc = size + len(data), zlib.crc32(data, crc)
                yield file_id.as_py(), ordinal.as_py(), expected.as_py(), size, crc

    arrow = arrow_schema(form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(rows_of(batches), arrow)

    start = F.shiftright("compressed_offset_bits", 3).cast("int")
    end = F.coalesce(F.shiftright("next_bits", 3), F.octet_length("content").cast("long")).cast("int")
    rows = spans.join(files, "file_id").select("file_id", "ordinal", "expected_size", F.substring("content", start + 1, end - start).alias("part"))
    return rows.mapInArrow(run, form)
