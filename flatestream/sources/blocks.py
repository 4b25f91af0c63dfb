"""DEFLATE blocks as a table: types, sizes, code lengths and references of every block of every member."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from .batches import arrow_schema, packed
from .members import Malformed, members

# Fixed values of RFC 1951.
LENGTH_BASE = [3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 15, 17, 19, 23, 27, 31, 35, 43, 51, 59, 67, 83, 99, 115, 131, 163, 195, 227, 258]
LENGTH_EXTRA = [0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4, 5, 5, 5, 5, 0]
DISTANCE_BASE = [1, 2, 3, 4, 5, 7, 9, 13, 17, 25, 33, 49, 65, 97, 129, 193, 257, 385, 513, 769, 1025, 1537, 2049, 3073, 4097, 6145, 8193, 12289, 16385, 24577]
DISTANCE_EXTRA = [0, 0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 8, 9, 9, 10, 10, 11, 11, 12, 12, 13, 13]
CODE_ORDER = [16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15]
WINDOW = 32768
FIELDS = re.findall(r"(\w+) (?:string|long|boolean|array<int>|array<struct)", schema.BLOCKS.replace("`", ""))
KINDS = ["Uncompressed", "Fixed Huffman", "Dynamic Huffman"]


LENGTHS, DISTANCES = (np.array([base, extra]) for base, extra in ((LENGTH_BASE + [0] * 2, LENGTH_EXTRA + [0] * 2), (DISTANCE_BASE + [0] * 2, DISTANCE_EXTRA + [0] * 2)))
STEP, MOST_STEP = 2048, 1 << 18  # bits that are looked at together: the first time in a block, and at most


def _reversed(n: int) -> np.ndarray:
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([out << 1, out << 1 | 1])
    return out


REVERSED = [_reversed(n) for n in range(16)]


def table_of(lengths: list[int]) -> tuple[np.ndarray, int]:
    """Symbol << 4 | length for every value of the next bits, -1 for none; and the number of bits.

    Codes in order tile the values of the bits read from the first on, so they are laid out so and then put in the order of reversed bits.
    """
    own = np.array(lengths, np.int64)
    used = np.flatnonzero(own)
    used = used[np.argsort(own[used], kind="stable")]
    size = own[used]
    most = int(size[-1]) if len(size) else 1
    tiles = np.repeat(used << 4 | size, 1 << (most - size))
    if len(tiles) > 1 << most:
        raise Malformed("invalid_data", 0)
    out = np.full(1 << most, -1)
    out[: len(tiles)] = tiles
    return out[REVERSED[most]], most


def code_lengths(data: bytes, at: int) -> tuple[list[int], list[int], list[int], int]:
    """Code lengths of the precode, of literals and of distances from the header at a bit; and the bit after it."""
    start, byte = at, at >> 3
    bits = int.from_bytes(data[byte : byte + 640], "little") >> (at & 7)  # a header has 4,500 bits at most
    end = 8 * len(data)
    literals, distances, count = (bits & 31) + 257, (bits >> 5 & 31) + 1, (bits >> 10 & 15) + 4
    pre = [0] * 19
    for i, place in enumerate(CODE_ORDER[:count]):
        pre[place] = bits >> (14 + 3 * i) & 7
    bits >>= 14 + 3 * count
    at += 14 + 3 * count
    table, most = table_of(pre)
    table, mask, found = table.tolist(), (1 << most) - 1, []
    while len(found) < literals + distances:
        entry = table[bits & mask]
        if entry < 0:
            raise Malformed("invalid_data" if at < end else "truncated", min(at, end) >> 3)
        s, n = entry >> 4, entry & 15
        if s < 16:
            found.append(s)
        else:
            if s == 16 and not found:
                raise Malformed("invalid_data", at >> 3)
            more, least = ((2, 3), (3, 3), (7, 11))[s - 16]
            found += (found[-1:] if s == 16 else [0]) * (least + (bits >> n & (1 << more) - 1))
            n += more
        bits >>= n
        at += n
    if at > end:
        raise Malformed("truncated", len(data))
    if len(found) > literals + distances or not found[256]:
        raise Malformed("invalid_data", start >> 3)
    return pre, found[:literals], found[literals:], at


def _symbols(data: bytes, at: int, first: tuple[np.ndarray, int], second: tuple[np.ndarray, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Output length and distance (0 for a literal) of each symbol of a block's data from bit `at`, and the bit after its end.

    What a symbol would be is looked up for every bit of a step at once; then only the places are followed one by one.
    """
    sizes, aways, step, done = [], [], STEP, False
    while not done:
        low = at >> 3
        piece = np.frombuffer(data[low : low + step // 8 + 8] + bytes(16), np.uint8).astype(np.uint64)
        n = len(piece) - 8
        words = piece[:n].copy()
        for i in range(1, 8):
            words |= piece[i : i + n] << np.uint64(8 * i)
        count = min(step // 8, len(data) - low) * 8
        if count <= at - 8 * low:
            raise Malformed("truncated", len(data))
        place = np.arange(count)
        bits = (words[: count >> 3, None] >> np.arange(8, dtype=np.uint64)).ravel().view(np.int64)  # 57 bits at least, of which a symbol has 48 at most
        entry = first[0][bits & ((1 << first[1]) - 1)]
        symbol, width = entry >> 4, entry & 15
        size, away = np.ones(count, np.int64), np.zeros(count, np.int64)
        bad = entry < 0
        copies = np.flatnonzero((symbol > 256) & ~bad)
        code = symbol[copies] - 257
        rest, w = bits[copies] >> width[copies], width[copies]
        extra = LENGTHS[1][code]
        size[copies] = LENGTHS[0][code] + (rest & ((1 << extra) - 1))
        rest, w = rest >> extra, w + extra
        other = second[0][rest & ((1 << second[1]) - 1)]
        d, dw = np.maximum(other >> 4, 0), other & 15
        wrong = (code > 28) | (other < 0) | (d > 29)
        d = np.minimum(d, 29)
        extra = DISTANCES[1][d]
        away[copies] = DISTANCES[0][d] + (rest >> dw & ((1 << extra) - 1))
        width[copies] = w + dw + extra
        bad[copies] |= wrong
        stop = bad | (symbol == 256)
        follow = np.where(stop, -1, place + width).tolist()
        path, p = [], at - 8 * low
        add = path.append
        while p < count:
            add(p)
            p = follow[p]
            if p < 0:
                break
        if p < 0:
            last = path.pop()
            if bad[last]:
                raise Malformed("invalid_data", low + (last >> 3))
            p, done = last + int(width[last]), True
        path = np.array(path, np.int64)
        sizes.append(size[path])
        aways.append(away[path])
        at, step = 8 * low + p, min(4 * step, MOST_STEP)
    if at > 8 * len(data):
        raise Malformed("truncated", len(data))
    return np.concatenate(sizes), np.concatenate(aways), at


FIXED = table_of([8] * 144 + [9] * 112 + [7] * 24 + [8] * 8), table_of([5] * 30)


def stream_blocks(content: bytes, at: int, details: int | None = None) -> Iterator[dict]:
    """The blocks of the stream that starts at a byte, and of the last one `end`, the byte after it. Of the references the first `details` are listed."""
    total, out, i, final, bit = 8 * len(content), 0, 0, False, 8 * at
    left = details
    while not final:
        start = bit
        head = int.from_bytes(content[bit >> 3 : (bit >> 3) + 2], "little") >> (bit & 7)
        final, kind = bool(head & 1), head >> 1 & 3
        bit += 3
        if bit > total:
            raise Malformed("truncated", len(content))
        b = {"index_in_stream": i, "is_final": final, "compressed_offset_bits": start, "uncompressed_offset": out, "literal_symbols": 0, "backreference_symbols": 0, "copied_bytes": 0, "farthest_backreference": 0, "references": []}
        b["window_backreference_count"] = b["merged_window_backreference_count"] = b["used_window_symbols"] = b["omitted_backreference_count"] = 0
        if kind == 3:
            raise Malformed("invalid_data", start >> 3)
        b["block_type"] = KINDS[kind]
        if kind == 0:
            byte = (bit + 7) >> 3
            size, inverse = (int.from_bytes(content[byte + j : byte + j + 2], "little") for j in (0, 2))
            if byte + 4 > len(content):
                raise Malformed("truncated", len(content))
            if size ^ inverse != 0xFFFF:
                raise Malformed("invalid_data", byte + 4)
            b["compressed_data_offset_bits"] = 8 * (byte + 4)
            bit = 8 * (byte + 4 + size)
            if bit > total:
                raise Malformed("truncated", len(content))
            out += size
        else:
            first, second = FIXED
            if kind == 2:
                b["precode"], b["literal"], b["distance"], bit = code_lengths(content, bit)
                first, second = table_of(b["literal"]), table_of(b["distance"])
            b["compressed_data_offset_bits"] = bit
            size, away, bit = _symbols(content, bit, first, second)
            ends = np.cumsum(size)
            before = ends - size  # bytes of the block before each symbol
            copy = away > 0
            if np.any(away > before + out):
                raise Malformed("invalid_data", start >> 3)
            b["backreference_symbols"] = int(copy.sum())
            b["literal_symbols"] = len(size) - b["backreference_symbols"]
            b["copied_bytes"] = int(size[copy].sum())
            reach = away - before
            window = copy & (reach > 0)
            reach, length = reach[window], np.minimum(size[window], reach[window])
            if len(reach):
                b["farthest_backreference"], b["window_backreference_count"] = int(reach.max()), len(reach)
                listed = len(reach) if left is None else min(left, len(reach))
                b["references"] = [{"distance": x, "length": y} for x, y in zip(reach[:listed].tolist(), length[:listed].tolist(), strict=True)]
                b["omitted_backreference_count"] = len(reach) - listed
                left = None if left is None else left - listed
                order = np.argsort(-reach, kind="stable")
                low, high = -reach[order], (length - reach)[order]
                reached = np.concatenate([[-WINDOW - 1], np.maximum.accumulate(high)[:-1]])
                b["merged_window_backreference_count"] = int((low > reached).sum())
                b["used_window_symbols"] = int(np.maximum(0, high - np.maximum(low, reached)).sum())
            out += int(ends[-1]) if len(ends) else 0
        b["compressed_size_bits"] = bit - start
        b["uncompressed_size"] = out - b["uncompressed_offset"]
        b["end"] = (bit + 7) >> 3
        i += 1
        yield b


class _Stream(ctypes.Structure):
    """z_stream of zlib.h."""

    _fields_ = [
        ("next_in", ctypes.c_void_p), ("avail_in", ctypes.c_uint), ("total_in", ctypes.c_ulong), ("next_out", ctypes.c_void_p), ("avail_out", ctypes.c_uint), ("total_out", ctypes.c_ulong), ("msg", ctypes.c_char_p),
        ("state", ctypes.c_void_p), ("zalloc", ctypes.c_void_p), ("zfree", ctypes.c_void_p), ("opaque", ctypes.c_void_p), ("data_type", ctypes.c_int), ("adler", ctypes.c_ulong), ("reserved", ctypes.c_ulong),
    ]


def _library() -> ctypes.CDLL | None:
    try:
        z = ctypes.CDLL("libz.so.1")  # the one that Python's own zlib uses; it doesn't pass on where blocks start
    except OSError:
        return None
    z.zlibVersion.restype = ctypes.c_char_p
    z.inflateInit2_.argtypes = [ctypes.c_void_p, ctypes.c_int, ctypes.c_char_p, ctypes.c_int]
    z.inflate.argtypes, z.inflateEnd.argtypes = [ctypes.c_void_p, ctypes.c_int], [ctypes.c_void_p]
    return z


LIBRARY = _library()
Z_BLOCK, Z_OK, Z_STREAM_END, Z_BUF_ERROR = 5, 0, 1, -5


def block_starts(content: bytes, at: int) -> Iterator[tuple[int, int]]:
    """The bit where each block of the stream at a byte starts, and the bytes of the stream before it.

    zlib stops after each block and tells the place; where it can't be loaded, stream_blocks finds the same places, far slower.
    """
    if LIBRARY is None:
        yield from ((b["compressed_offset_bits"], b["uncompressed_offset"]) for b in stream_blocks(content, at, 0))
        return
    source, out, s = np.frombuffer(content, np.uint8), ctypes.create_string_buffer(1 << 16), _Stream()
    place, room = ctypes.addressof(s), ctypes.addressof(out)
    s.next_in, s.avail_in = source.ctypes.data + at, len(content) - at
    if LIBRARY.inflateInit2_(place, -15, LIBRARY.zlibVersion(), ctypes.sizeof(s)) != Z_OK:
        raise MemoryError("zlib doesn't start")
    try:
        yield 8 * at, 0
        code = Z_OK
        while code != Z_STREAM_END:
            s.next_out, s.avail_out = room, len(out)
            code = LIBRARY.inflate(place, Z_BLOCK)
            if code not in (Z_OK, Z_STREAM_END):
                raise Malformed("truncated" if code == Z_BUF_ERROR else "invalid_data", at + s.total_in)
            if s.data_type & 192 == 128 and code == Z_OK:  # after a block that isn't the last
                yield 8 * (at + s.total_in) - (s.data_type & 7), s.total_out
    finally:
        LIBRARY.inflateEnd(place)


def block_table(files: DataFrame, format: str = "auto", details: int | None = None, most_streams: int | None = None, most_blocks: int | None = None) -> DataFrame:
    """One row for each block of gzip, zlib or raw DEFLATE files; references are those into the bytes before the block, by their distance from its start.

    Every stream is decoded and held against its footer first; raises at a fault. uncompressed_offset counts from the start of the stream.
    Of a file's references the first `details` are listed, the number of others is omitted_backreference_count; the counts beside
    cover all of them. A file of more streams or blocks than allowed fails the job.
    """
    def own_blocks(file_id: str, content: bytes) -> Iterator[dict]:
        stream = blocks = 0
        left = details
        for m, data in members(content, format):
            if data is not None:
                continue
            if most_streams is not None and stream >= most_streams:
                raise ValueError(f"{file_id}: more than {most_streams} streams")
            for b in stream_blocks(content, m.deflate_offset, left):
                end, blocks = b.pop("end"), blocks + 1
                if most_blocks is not None and blocks > most_blocks:
                    raise ValueError(f"{file_id}: more than {most_blocks} blocks")
                if left is not None:
                    left -= len(b["references"])
                yield b | {"file_id": file_id, "stream_index": stream}
            if end != m.footer_offset:
                raise Malformed("invalid_data", end)
            stream += 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for file_id, content in zip(batch.column(0), batch.column(1), strict=True):
                file_id = file_id.as_py()
                try:
                    for row in own_blocks(file_id, content.as_py() or b""):
                        yield tuple(map(row.get, FIELDS))
                except Malformed as e:
                    raise ValueError(f"{file_id}: {e}") from e

    arrow = arrow_schema(schema.BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(rows(batches), arrow, 250)  # a row has up to 350 code lengths, and its references

    return files.select("file_id", "content").mapInArrow(run, schema.BLOCKS)


def block_violations(blocks: DataFrame, members: DataFrame) -> DataFrame:
    """file_id, stream_index, rule for every broken invariant between blocks and members; empty for sound tables."""
    sums = blocks.groupBy("file_id", "stream_index").agg(
        F.sum("uncompressed_size").alias("size"), F.count_if("is_final").alias("finals"), F.max_by("is_final", "index_in_stream").alias("last"),
        F.count_if((F.col("block_type") != "Uncompressed") & (F.col("literal_symbols") + F.col("copied_bytes") != F.col("uncompressed_size"))).alias("odd"),
    )
    m = members.where("ok").select("file_id", F.col("member").alias("stream_index"), "uncompressed_size")
    rows = sums.join(m, ["file_id", "stream_index"], "full")
    rules = [
        ("one final block, the last", (F.col("finals") != 1) | ~F.col("last")),
        ("literals and copies make up a block", F.col("odd") > 0),
        ("blocks make up the stream", F.col("size") != F.col("uncompressed_size")),
        ("stream without blocks or blocks without a stream", F.col("size").isNull() | F.col("uncompressed_size").isNull()),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(x, F.lit(False)), n) for n, x in rules]), lambda r: r.isNotNull())
    return rows.select("file_id", "stream_index", F.explode(found).alias("rule"))
