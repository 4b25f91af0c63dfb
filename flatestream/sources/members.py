"""Members of gzip, BGZF, zlib and raw DEFLATE bytes: one helper that every table below is made from."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

FHCRC, FEXTRA, FNAME, FCOMMENT = 2, 4, 8, 16


class Malformed(Exception):
    def __init__(self, kind: str, offset: int, expected: int | None = None, actual: int | None = None):
        super().__init__(f"{kind} at byte {offset}")
        self.kind, self.offset, self.expected, self.actual = kind, offset, expected, actual


@dataclass
class Member:
    format: str
    header_offset: int
    deflate_offset: int = 0
    footer_offset: int = 0
    end_offset: int = 0
    uncompressed_offset: int = 0
    uncompressed_size: int = 0
    newlines: int = 0
    fields: dict = field(default_factory=dict)


def detect(content: bytes) -> str:
    """gzip or zlib by the first two bytes; raises where it is neither, as raw DEFLATE is never guessed."""
    if content[:2] == b"\x1f\x8b":
        return "gzip"
    if len(content) >= 2 and content[0] & 15 == 8 and content[0] >> 4 <= 7 and (content[0] << 8 | content[1]) % 31 == 0 and not content[1] & 32:
        return "zlib"
    raise Malformed("unrecognized_format", 0)


def gzip_header(content: bytes, at: int) -> tuple[int, dict]:
    """End of the header at `at`, and its fields."""
    if content[at : at + 2] != b"\x1f\x8b":
        raise Malformed("trailing_garbage" if at else "bad_magic", at)
    if len(content) < at + 10:
        raise Malformed("truncated", len(content))
    if content[at + 2] != 8:
        raise Malformed("unsupported_compression_method", at + 2)
    flags = content[at + 3]
    if flags & 0xE0:
        raise Malformed("reserved_flags", at + 3)
    found = {"flags": flags, "mtime": int.from_bytes(content[at + 4 : at + 8], "little"), "xfl": content[at + 8], "os": content[at + 9]}
    end = at + 10
    if flags & FEXTRA:
        size = int.from_bytes(content[end : end + 2], "little")
        if len(content) < end + 2 + size:
            raise Malformed("truncated", len(content))
        extra = found["extra"] = content[end + 2 : end + 2 + size]
        end += 2 + size
        i = 0
        while i + 4 <= size:
            length = int.from_bytes(extra[i + 2 : i + 4], "little")
            if extra[i : i + 2] == b"BC" and length == 2 and i + 6 <= size:
                found["bgzf_block_size"] = int.from_bytes(extra[i + 4 : i + 6], "little") + 1
            i += 4 + length
    for flag, name in ((FNAME, "file_name"), (FCOMMENT, "comment")):
        if flags & flag:
            stop = content.find(b"\0", end)
            if stop < 0:
                raise Malformed("unterminated_header_field", end)
            found[name], end = content[end:stop], stop + 1
    if flags & FHCRC:
        if len(content) < end + 2:
            raise Malformed("truncated", len(content))
        want, have = int.from_bytes(content[end : end + 2], "little"), zlib.crc32(content[at:end]) & 0xFFFF
        if want != have:
            raise Malformed("header_checksum_mismatch", end, want, have)
        end += 2
    return end, found


def zlib_header(content: bytes, at: int) -> tuple[int, dict]:
    if len(content) < at + 2:
        raise Malformed("truncated", len(content))
    cmf, flg = content[at], content[at + 1]
    if cmf & 15 != 8:
        raise Malformed("unsupported_compression_method", at)
    if cmf >> 4 > 7:
        raise Malformed("unsupported_window_size", at)
    if (cmf << 8 | flg) % 31:
        raise Malformed("bad_header_check", at)
    if flg & 32:
        raise Malformed("preset_dictionary", at + 1)
    return at + 2, {"flags": flg, "xfl": flg >> 6}


def members(content: bytes, format: str = "auto", piece: int = 4 << 20) -> Iterator[tuple[Member, bytes | None]]:
    """Decoded pieces of each member in order, each with its member, and (member, None) at the verified end of each.

    Raises Malformed at the first fault; pieces before it have been given. gzip members follow one another; a zlib or raw
    stream must end with the bytes.
    """
    if format == "auto":
        format = detect(content)
    at = total = 0
    view = memoryview(content)
    while at < len(content) or at == 0:
        own = Member(format, at, uncompressed_offset=total)
        if format == "gzip":
            own.deflate_offset, own.fields = gzip_header(content, at)
        elif format == "zlib":
            own.deflate_offset, own.fields = zlib_header(content, at)
        else:
            own.deflate_offset = at
        inflate = zlib.decompressobj(-15)
        crc, adler, place = 0, 1, own.deflate_offset
        data = b""
        while not inflate.eof:
            try:
                data = inflate.decompress(inflate.unconsumed_tail or view[place : place + piece], piece)
            except zlib.error:
                raise Malformed("invalid_data", place) from None
            if inflate.eof or not inflate.unconsumed_tail:
                place += piece
            if data:
                crc, adler = zlib.crc32(data, crc), zlib.adler32(data, adler)
                own.uncompressed_size += len(data)
                own.newlines += data.count(b"\n")
                yield own, data
            elif place >= len(content) + piece and not inflate.eof:
                raise Malformed("truncated", len(content))
        end = min(place, len(content)) - len(inflate.unused_data)
        own.footer_offset = end
        size = {"gzip": 8, "zlib": 4}.get(format, 0)
        foot = content[end : end + size]
        if len(foot) < size:
            raise Malformed("truncated", len(content))
        if format == "gzip":
            own.fields |= {"crc32": int.from_bytes(foot[:4], "little"), "isize": int.from_bytes(foot[4:], "little")}
            if own.fields["crc32"] != crc:
                raise Malformed("checksum_mismatch", end, own.fields["crc32"], crc)
            if own.fields["isize"] != own.uncompressed_size & 0xFFFFFFFF:
                raise Malformed("size_mismatch", end + 4, own.fields["isize"], own.uncompressed_size & 0xFFFFFFFF)
        elif format == "zlib":
            own.fields["adler32"] = int.from_bytes(foot, "big")
            if own.fields["adler32"] != adler:
                raise Malformed("checksum_mismatch", end, own.fields["adler32"], adler)
        at = own.end_offset = end + size
        total += own.uncompressed_size
        yield own, None
        if format != "gzip":
            if at < len(content):
                raise Malformed("trailing_garbage", at)
            return
