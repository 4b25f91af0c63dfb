"""Random-access index files as tables, and tables as index files: gzi, gzidx, gztool and the native form."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import arrow_schema, packed

WINDOW = 32768
MOST_POINTS, MOST_PAYLOAD = 4 << 20, 64 << 10
# Fixed values of the formats.
NATIVE, GZIDX, GZTOOL0, GZTOOL1 = b"RGZIDX01", b"GZIDX", b"gzipindx", b"gzipindX"
KIND_FLAGS = {"gzip": 0, "bgzf": 1 << 4, "zlib": 1 << 5, "raw-deflate": 1 << 6}
POINT_FLAGS = {"gzip_member_header": 0, "deflate_block": 2, "gzip_member_deflate": 4, "zlib_header": 8, "raw_deflate_start": 16}
SCHEMA = (
    "file_id string, index_format string, kind string, compressed_size long, uncompressed_size long, spacing long, total_lines long, "
    "ordinal long, compressed_offset_bits long, uncompressed_offset long, point_kind string, header_offset long, line_offset long, payload binary, is_compressed boolean, next_offset long, next_line long"
)
FIELDS = [c.split(" ")[0] for c in SCHEMA.split(", ")]


class Fields:
    """Reads fixed-width fields; short input raises."""

    def __init__(self, data: bytes, order: str):
        self.data, self.at, self.order = data, 0, order

    def __call__(self, form: str) -> int:
        size = struct.calcsize(f"{self.order}{form}")
        return struct.unpack(f"{self.order}{form}", self.bytes(size))[0]

    def bytes(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("index ends early")
        self.at += n
        return out

    def count(self, form: str) -> int:
        n = self(form)
        if n > MOST_POINTS:
            raise ValueError(f"index claims {n} points")
        return n


def bits_of(byte: int, n: int) -> int:
    if n > 7 or n and not byte:
        raise ValueError("invalid bit offset")
    return byte * 8 - n


def byte_of(bits: int) -> tuple[int, int]:
    return (bits // 8 + 1, 8 - bits % 8) if bits % 8 else (bits // 8, 0)


def unpacked(payload: bytes, is_compressed: bool) -> bytes:
    if is_compressed:
        z = zlib.decompressobj()
        payload = z.decompress(payload, WINDOW + 1) + z.flush()
        if not z.eof or z.unused_data:
            raise ValueError("window payload isn't one whole zlib stream")
    if len(payload) != WINDOW:
        raise ValueError("a window has 32768 bytes")
    return payload


def read_index(data: bytes, archive_size: int | None = None) -> list[dict]:
    """Points of an index of any of the formats, each with the index's own fields; bytes after the index raise."""
    if data[:8] == NATIVE:
        meta, points, f = _native(data)
    elif data[:5] == GZIDX:
        meta, points, f = _gzidx(data)
    elif data[:8] == bytes(8) and data[8:16] in (GZTOOL0, GZTOOL1):
        meta, points, f = _gztool(data)
    elif len(data) >= 8 and 8 + 16 * int.from_bytes(data[:8], "little") == len(data):
        meta, points, f = _gzi(data)
    else:
        raise ValueError("not an index of a known format")
    if f.at != len(data):
        raise ValueError("bytes after the index")
    meta["compressed_size"] = meta.get("compressed_size") if meta.get("compressed_size") is not None else archive_size
    return [meta | {"ordinal": i} | p for i, p in enumerate(points)]


def _gzi(data: bytes) -> tuple[dict, list[dict], Fields]:
    f = Fields(data, "<")
    pairs = [(0, 0)] + [(f("Q"), f("Q")) for _ in range(f.count("Q"))]
    return {"index_format": "gzi", "kind": "bgzf"}, [{"compressed_offset_bits": a * 8, "uncompressed_offset": b, "point_kind": "gzip_member_header"} for a, b in pairs], f


def _gzidx(data: bytes) -> tuple[dict, list[dict], Fields]:
    f = Fields(data, "<")
    f.bytes(5)
    version, _ = f("B"), f("B")
    if version > 1:
        raise ValueError("unknown version")
    meta = {"index_format": "gzidx", "kind": "gzip", "compressed_size": f("Q"), "uncompressed_size": f("Q"), "spacing": f("I")}
    if f("I") != WINDOW:
        raise ValueError("a window has 32768 bytes")
    points, has = [], []
    for i in range(f.count("I")):
        byte, off, n = f("Q"), f("Q"), f("B")
        has.append(bool(f("B")) if version else i > 0)
        points.append({"compressed_offset_bits": bits_of(byte, n), "uncompressed_offset": off, "point_kind": "deflate_block" if has[-1] else "gzip_member_deflate"})
    for p, h in zip(points, has, strict=True):
        if h:
            p |= {"payload": f.bytes(WINDOW), "is_compressed": False}
    return meta, points, f


def _gztool(data: bytes) -> tuple[dict, list[dict], Fields]:
    f = Fields(data, ">")
    lines = f.bytes(16)[8:] == GZTOOL1
    if lines:
        f("I")
    have, size = f.count("Q"), f("Q")
    if have != size:
        raise ValueError("the index isn't whole")
    points = []
    for _ in range(have):
        off, byte, n, length = f("Q"), f("Q"), f("I"), f("I")
        if length > MOST_PAYLOAD:
            raise ValueError("window payload too long")
        p = {"compressed_offset_bits": bits_of(byte, n), "uncompressed_offset": off, "point_kind": "deflate_block" if length else "gzip_member_deflate"}
        if length:
            p |= {"payload": f.bytes(length), "is_compressed": True}
        if lines:
            p["line_offset"] = f("Q") - 1
        points.append(p)
    meta = {"index_format": "gztool", "kind": "gzip", "uncompressed_size": f("Q")}
    if lines:
        meta["total_lines"] = f("Q")
    return meta, points, f


def _native(data: bytes) -> tuple[dict, list[dict], Fields]:
    f = Fields(data, "<")
    f.bytes(8)
    if f("H") != 1:
        raise ValueError("unknown version")
    flags = f("H")
    kind = {v: k for k, v in KIND_FLAGS.items()}.get(flags & 0x70)
    if kind is None or flags & ~0x7F:
        raise ValueError("unknown flags")
    values = [f("Q") if flags >> i & 1 else f("Q") * 0 or None for i in range(4)]
    meta = {"index_format": "native", "kind": kind} | dict(zip(["compressed_size", "uncompressed_size", "spacing", "total_lines"], values, strict=True))
    points = []
    for _ in range(f.count("Q")):
        bits, off, line, header, own, window, length = f("Q"), f("Q"), f("Q"), f("Q"), f("B"), f("B"), f("I")
        name = {v: k for k, v in POINT_FLAGS.items()}.get(own & ~1)
        if name is None or window > 2 or length > MOST_PAYLOAD:
            raise ValueError("unknown point flags")
        p = {"compressed_offset_bits": bits, "uncompressed_offset": off, "point_kind": name}
        if own & 1:
            p["line_offset"] = line
        if name == "gzip_member_deflate":
            p["header_offset"] = header
        payload = f.bytes(length)
        if window:
            p |= {"payload": payload, "is_compressed": window == 2}
        points.append(p)
    return meta, points, f


def write_index(meta: dict, points: list[dict], form: str) -> bytes:
    """The index in a format; raises ValueError where the format can't hold it."""
    need = lambda name: meta[name] if meta.get(name) is not None else _lacks(form, name)
    out = bytearray()
    put = lambda order, f, *v: out.extend(struct.pack(order + f, *v))
    if form == "native":
        names = ["compressed_size", "uncompressed_size", "spacing", "total_lines"]
        flags = sum(1 << i for i, n in enumerate(names) if meta.get(n) is not None) | KIND_FLAGS[meta["kind"]]
        out += NATIVE
        put("<", "HH5Q", 1, flags, *[meta.get(n) or 0 for n in names], len(points))
        for p in points:
            payload = p.get("payload") or b""
            own = POINT_FLAGS[p["point_kind"]] | (p.get("line_offset") is not None)
            put("<", "4QBBI", p["compressed_offset_bits"], p["uncompressed_offset"], p.get("line_offset") or 0, (p.get("header_offset") or 0) if own & 4 else 0, own, (2 if p.get("is_compressed") else 1) if payload else 0, len(payload))
            out += payload
        return bytes(out)
    if meta["kind"] not in ("gzip", "bgzf"):
        _lacks(form, "a gzip or BGZF source")
    if form == "gzi":
        if meta["kind"] != "bgzf" or any(p.get("payload") for p in points):
            _lacks(form, "BGZF blocks without windows")
        rest = [p for p in points if p["uncompressed_offset"] or p["compressed_offset_bits"]]
        put("<", "Q", len(rest))
        for p in rest:
            put("<", "QQ", p["compressed_offset_bits"] // 8, p["uncompressed_offset"])
        return bytes(out)
    if any(p["point_kind"] == "gzip_member_header" for p in points):
        _lacks(form, "points after the member headers")
    if form == "gzidx":
        out += GZIDX
        put("<", "BBQQIII", 1, 0, need("compressed_size"), need("uncompressed_size"), need("spacing"), WINDOW, len(points))
        for p in points:
            byte, n = byte_of(p["compressed_offset_bits"])
            put("<", "QQBB", byte, p["uncompressed_offset"], n, bool(p.get("payload")))
        for p in points:
            if p.get("payload"):
                out += unpacked(p["payload"], p.get("is_compressed"))
        return bytes(out)
    if form not in ("gztool", "gztool-lines"):
        raise ValueError(f"unknown index format {form}")
    lines = form == "gztool-lines"
    if lines and any(p.get("line_offset") is None for p in points):
        _lacks(form, "the lines of every point")
    out += bytes(8) + (GZTOOL1 + bytes(4) if lines else GZTOOL0)
    put(">", "QQ", len(points), len(points))
    for p in points:
        byte, n = byte_of(p["compressed_offset_bits"])
        payload = zlib.compress(unpacked(p["payload"], p.get("is_compressed")), 9) if p.get("payload") else b""
        put(">", "QQII", p["uncompressed_offset"], byte, n, len(payload))
        out += payload
        if lines:
            put(">", "Q", p["line_offset"] + 1)
    put(">", "Q", need("uncompressed_size"))
    if lines:
        put(">", "Q", need("total_lines"))
    return bytes(out)


def _lacks(form: str, what: str) -> None:
    raise ValueError(f"{form} needs {what}")


def index_table(files: DataFrame) -> DataFrame:
    """One row for each point of each index file (file_id, content), with the fields of its index and the offset and line of the next point. Raises at a fault."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for file_id, content in zip(batch.column(0), batch.column(1), strict=True):
                points = read_index(content.as_py() or b"")
                for i, p in enumerate(points):
                    after = points[i + 1] if i + 1 < len(points) else {}
                    p |= {"file_id": file_id.as_py(), "next_offset": after.get("uncompressed_offset"), "next_line": after.get("line_offset")}
                    yield tuple(map(p.get, FIELDS))

    arrow = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(rows(batches), arrow)

    return files.select("file_id", "content").mapInArrow(run, SCHEMA)


def index_files(points: DataFrame, form: str) -> DataFrame:
    """file_id, content: an index file of each file's points, in the columns of index_table. A file's points meet in one row."""
    meta = ["kind", "compressed_size", "uncompressed_size", "spacing", "total_lines"]
    own = ["compressed_offset_bits", "uncompressed_offset", "point_kind", "header_offset", "line_offset", "payload", "is_compressed"]
    rows = points.groupBy("file_id").agg(*[F.first(m).alias(m) for m in meta], F.array_sort(F.collect_list(F.struct("compressed_offset_bits", *[c for c in own if c != "compressed_offset_bits"]))).alias("points"))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            names = batch.schema.names
            for values in zip(*batch.columns, strict=True):
                row = {name: v.as_py() for name, v in zip(names, values, strict=True)}
                yield row["file_id"], write_index(row, row["points"], form)

    arrow = arrow_schema("file_id string, content binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(rows_of(batches), arrow)

    return rows.mapInArrow(run, "file_id string, content binary")
