"""Streams of stored blocks only: their data lies in the file as it is, so a walk over the block headers cuts one stream into parts for many tasks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.checksums import combined_crc32
from .members import Malformed, detect, gzip_header, zlib_header

PART = 4 << 20
BLOCKS = "file_id string, member long, block long, header_offset long, block_offset long, size long, member_offset long, uncompressed_offset long, is_final boolean, crc32 long"


def _blocks(content: bytes, format: str) -> list[dict] | None:
    """The blocks of a file in order, or None where one of them isn't stored. Raises Malformed where lengths don't agree or bytes are missing."""
    format = detect(content) if format == "auto" else format
    foot = {"gzip": 8, "zlib": 4}.get(format, 0)
    found: list[dict] = []
    at = member = total = 0
    while at < len(content) or not found:
        head = at
        at = gzip_header(content, at)[0] if format == "gzip" else zlib_header(content, at)[0] if format == "zlib" else at
        own, last = 0, False
        while not last:
            header = content[at : at + 5]
            if header and header[0] >> 1 & 3:
                return None
            size = int.from_bytes(header[1:3], "little")
            if len(header) < 5 or at + 5 + size > len(content):
                raise Malformed("truncated", len(content))
            if size ^ int.from_bytes(header[3:5], "little") != 0xFFFF:
                raise Malformed("invalid_data", at)
            last = bool(header[0] & 1)
            found.append({"member": member, "block": len(found), "header_offset": head, "block_offset": at, "size": size, "member_offset": own, "uncompressed_offset": total + own, "is_final": last, "crc32": None})
            own, at = own + size, at + 5 + size
        footer = content[at : at + foot]
        if len(footer) < foot:
            raise Malformed("truncated", len(content))
        if format == "gzip":
            if int.from_bytes(footer[4:], "little") != own & 0xFFFFFFFF:
                raise Malformed("size_mismatch", at + 4, int.from_bytes(footer[4:], "little"), own & 0xFFFFFFFF)
            found[-1]["crc32"] = int.from_bytes(footer[:4], "little")
        at, total, member = at + foot, total + own, member + 1
        if format != "gzip" and at < len(content):
            raise Malformed("trailing_garbage", at)
    return found


def stored_blocks(files: DataFrame, format: str = "auto") -> DataFrame:
    """The stored blocks of each file, by their headers alone; a file with any other block has no row. A member's last block has the CRC-32 of its footer (gzip)."""

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(BLOCKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows = _blocks(content.as_py() or b"", format)
                except Malformed as e:
                    raise ValueError(f"{file_id}: {e}") from e
                if rows:
                    yield pa.RecordBatch.from_pylist([{"file_id": file_id} | r for r in rows], arrow)

    return files.select("file_id", "content").mapInArrow(run, BLOCKS)


def stored_chunks(files: DataFrame, blocks: DataFrame, part: int = PART) -> DataFrame:
    """file_id, member, part, uncompressed_offset, bytes: each part is the blocks of a member that start within the same `part` bytes of its output.

    A part is cut out of its file and decoded on its own; stored_mismatches compares the members with their footers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [zlib.decompressobj(-15).decompress(x.as_py()) for x in batch.column("piece")]
            kept = [batch.column(c) for c in ("file_id", "member", "part", "uncompressed_offset")]
            yield pa.record_batch([*kept, pa.array(data, pa.binary())], ["file_id", "member", "part", "uncompressed_offset", "bytes"])

    spans = blocks.groupBy("file_id", "member", F.floor(F.col("member_offset") / part).alias("part")).agg(
        F.min("uncompressed_offset").alias("uncompressed_offset"), F.min("block_offset").alias("start"), F.max(F.col("block_offset") + 5 + F.col("size")).alias("end")
    )
    piece = F.substring("content", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    rows = spans.join(files, "file_id").select("file_id", "member", "part", "uncompressed_offset", piece.alias("piece"))
    return rows.mapInArrow(run, "file_id string, member long, part long, uncompressed_offset long, bytes binary")


def stored_mismatches(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """file_id, member, expected, actual of the gzip members whose parts don't have the CRC-32 of the footer."""
    found = combined_crc32(chunks, ["file_id", "member"], "part", "bytes").select("file_id", "member", F.col("crc32").alias("actual"))
    want = blocks.where("crc32 is not null").select("file_id", "member", F.col("crc32").alias("expected"))
    return want.join(found, ["file_id", "member"]).where("expected <> actual")
