"""Members, blocks and checksums against zlib and gzip from the standard library."""

import gzip
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flatestream.operators.checksums import adler32_combine, crc32_combine
from flatestream.plans.views import gzip_member
from flatestream.sources.blocks import stream_blocks
from flatestream.sources.members import Malformed, detect, gzip_header, members

SAMPLE = ("record 1 value 17\n" * 300 + "".join(random.Random(1).choices("acgt\n", k=5000))).encode()


def decode(content, format="auto", piece=1000):
    out, ends = [], []
    for m, data in members(content, format, piece):
        (ends.append(m) if data is None else out.append(data))
    return b"".join(out), ends


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=3000), min_size=1, max_size=5), st.integers(0, 9), st.integers(1, 4000))
def test_members_follow_one_another(parts, level, piece):
    data, ends = decode(b"".join(gzip_member(p, level) for p in parts), piece=piece)
    assert data == b"".join(parts)
    assert [m.uncompressed_size for m in ends] == list(map(len, parts))
    assert [m.newlines for m in ends] == [p.count(b"\n") for p in parts]


@pytest.mark.parametrize("level", [0, 1, 6])
def test_formats(level):
    assert decode(zlib.compress(SAMPLE, level))[0] == SAMPLE
    raw = zlib.compressobj(level, zlib.DEFLATED, -15)
    raw = raw.compress(SAMPLE) + raw.flush()
    assert decode(raw, "raw-deflate")[0] == SAMPLE
    with pytest.raises(Malformed, match="trailing_garbage"):
        decode(raw + b"x", "raw-deflate")


def test_header_fields():
    head = b"\x1f\x8b\x08\x1e\x01\0\0\0\x02\x03" + b"\x06\0BC\x02\0\x1b\0" + b"name\0" + b"note\0"
    head += (zlib.crc32(head) & 0xFFFF).to_bytes(2, "little")
    end, f = gzip_header(head + b"rest", 0)
    assert end == len(head) and (f["file_name"], f["comment"], f["bgzf_block_size"], f["mtime"], f["os"], f["xfl"]) == (b"name", b"note", 28, 1, 3, 2)
    with pytest.raises(Malformed, match="header_checksum_mismatch"):
        gzip_header(head[:-1] + bytes([head[-1] ^ 1]), 0)


@pytest.mark.parametrize(
    "broken, kind",
    [
        (b"", "bad_magic"), (b"PK", "bad_magic"), (b"\x1f\x8b\x07" + bytes(20), "unsupported_compression_method"), (b"\x1f\x8b\x08\xe0" + bytes(20), "reserved_flags"),
        (b"\x1f\x8b\x08\x08" + bytes(6) + b"endless", "unterminated_header_field"), (gzip_member(SAMPLE) + b"junk", "trailing_garbage"), (gzip_member(SAMPLE)[:-9], "truncated"),
    ],
)
def test_faults(broken, kind):
    with pytest.raises(Malformed) as e:
        decode(broken, "gzip")
    assert e.value.kind == kind


def test_every_truncation_and_footer_damage_is_found():
    whole = gzip_member(b"abc\n" * 20)
    for n in range(len(whole)):
        with pytest.raises(Malformed):
            decode(whole[:n], "gzip")
    for i, kind in ((-8, "checksum_mismatch"), (-1, "size_mismatch")):
        bad = bytearray(whole)
        bad[i] ^= 1
        with pytest.raises(Malformed, match=kind):
            decode(bytes(bad), "gzip")


def test_detect():
    assert detect(gzip.compress(b"x")) == "gzip" and detect(zlib.compress(b"x")) == "zlib"
    for other in (b"", b"\x1f", b"ab", b"\x78\x9d"):
        with pytest.raises(Malformed):
            detect(other)


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=4000), st.sampled_from([0, 1, 6, 9]), st.sampled_from([zlib.Z_DEFAULT_STRATEGY, zlib.Z_FIXED]))
def test_blocks_make_up_the_stream(data, level, strategy):
    z = zlib.compressobj(level, zlib.DEFLATED, -15, 8, strategy)
    half = len(data) // 2
    raw = z.compress(data[:half]) + z.flush(zlib.Z_FULL_FLUSH) + z.compress(data[half:]) + z.flush()
    blocks = list(stream_blocks(raw, 0))
    assert sum(b["uncompressed_size"] for b in blocks) == len(data) and blocks[-1]["end"] == len(raw)
    assert [b["is_final"] for b in blocks] == [False] * (len(blocks) - 1) + [True]
    for b in blocks:
        if b["block_type"] != "Uncompressed":
            assert b["literal_symbols"] + b["copied_bytes"] == b["uncompressed_size"]


@given(st.binary(max_size=500), st.binary(max_size=500))
def test_combined_checksums(a, b):
    assert crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert adler32_combine(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)
