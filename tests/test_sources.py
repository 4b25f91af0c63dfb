"""Index files, data sources, resuming inside streams, and the user's actions."""

import random
import zlib

import pyarrow as pa
import pytest

from flatestream.plans import actions
from flatestream.plans.views import gzip_member
from flatestream.sources import archives, resume, stored, tsv
from flatestream.sources.blocks import stream_blocks
from flatestream.sources.members import Malformed
from flatestream.sources.datasource import DeflateSource, FileSink, first_block
from flatestream.sources.index_files import byte_of, bits_of, index_files, index_table, read_index, write_index
from flatestream.sources.resume import EMPTY, decode_at

RNG = random.Random(9)
TEXT = "".join(RNG.choices("abcdefgh \n", k=150_000)).encode()
WINDOW = RNG.randbytes(32768)
META = {"kind": "gzip", "compressed_size": 9000, "uncompressed_size": 70000, "spacing": 1000, "total_lines": 12}
POINTS = [
    {"compressed_offset_bits": 80, "uncompressed_offset": 0, "point_kind": "gzip_member_deflate", "header_offset": 0, "line_offset": 0},
    {"compressed_offset_bits": 4003, "uncompressed_offset": 33000, "point_kind": "deflate_block", "line_offset": 5, "payload": WINDOW, "is_compressed": False},
    {"compressed_offset_bits": 9008, "uncompressed_offset": 66000, "point_kind": "deflate_block", "line_offset": 9, "payload": zlib.compress(WINDOW), "is_compressed": True},
]


def bgzf(data, size=1000):
    out = b""
    for i in range(0, len(data), size):
        m = gzip_member(data[i : i + size])
        out += m[:3] + b"\x04" + m[4:10] + b"\x06\0BC\x02\0" + (len(m) + 8 - 1).to_bytes(2, "little") + m[10:]
    return out


def bgzf_starts(whole):
    at, out = 0, []
    while at < len(whole):
        out.append(at)
        at += int.from_bytes(whole[at + 16 : at + 18], "little") + 1
    return out


@pytest.mark.parametrize("form, lines, has", [("native", True, True), ("gzidx", False, True), ("gztool", False, True), ("gztool-lines", True, True)])
def test_index_round_trip(form, lines, has):
    data = write_index(META, POINTS, form)
    got = read_index(data)
    assert [(p["compressed_offset_bits"], p["uncompressed_offset"]) for p in got] == [(p["compressed_offset_bits"], p["uncompressed_offset"]) for p in POINTS]
    assert [p.get("line_offset") for p in got] == [p["line_offset"] if lines else None for p in POINTS]
    raw = [zlib.decompress(p["payload"]) if p.get("is_compressed") else p.get("payload") for p in got]
    assert raw == [None, WINDOW, WINDOW] and got[0]["uncompressed_size"] == 70000
    for n in list(range(0, 200)) + list(range(200, len(data), 997)):
        if data[:n] != bytes(8):  # an empty gzi index
            with pytest.raises(ValueError):
                read_index(data[:n])
    with pytest.raises(ValueError):
        read_index(data + b"x")


def test_gzi():
    meta = {"kind": "bgzf", "uncompressed_size": 5}
    points = [{"compressed_offset_bits": b * 8, "uncompressed_offset": o, "point_kind": "gzip_member_header"} for b, o in ((0, 0), (40, 1000), (90, 2000))]
    data = write_index(meta, points, "gzi")
    assert len(data) == 40 and [p["uncompressed_offset"] for p in read_index(data, 100)] == [0, 1000, 2000]
    for form in ("gzidx", "gztool", "gztool-lines", "other"):
        with pytest.raises(ValueError):
            write_index(meta, points, form)
    with pytest.raises(ValueError):
        write_index(META, POINTS, "gzi")
    with pytest.raises(ValueError):
        read_index((1 << 60).to_bytes(8, "little"))


def test_bit_offsets():
    for bits in range(1, 200):
        assert bits_of(*byte_of(bits)) == bits
    for bad in ((0, 1), (5, 8)):
        with pytest.raises(ValueError):
            bits_of(*bad)


def test_empty_blocks_reach_every_bit():
    assert sorted(EMPTY) == list(range(8)) and all(width % 8 == r for r, (_, width) in EMPTY.items())


@pytest.mark.parametrize("level, strategy", [(1, 0), (6, 0), (9, 0), (6, zlib.Z_FIXED), (0, 0)])
def test_decode_from_every_block(level, strategy):
    z = zlib.compressobj(level, zlib.DEFLATED, -15, 4, strategy)
    raw = b"".join(z.compress(TEXT[i : i + 7000]) for i in range(0, len(TEXT), 7000)) + z.flush()
    blocks = list(stream_blocks(raw, 0))
    seen = set()
    for b in blocks:
        off, size = b["uncompressed_offset"], b["uncompressed_size"]
        seen.add(b["compressed_offset_bits"] % 8)
        assert decode_at(raw, b["compressed_offset_bits"], TEXT[max(0, off - 32768) : off], size) == TEXT[off : off + size]
    assert strategy or level == 0 or len(seen) > 3


def test_decode_points(spark):
    raw = gzip_member(TEXT)
    files = spark.createDataFrame([("f", raw)], "file_id string, content binary")
    points, at = [], 0
    blocks = list(stream_blocks(raw, 10))
    for i, b in enumerate(blocks):
        points.append(("f", i, b["compressed_offset_bits"], b["uncompressed_offset"], b["uncompressed_size"], b["compressed_offset_bits"] + b["compressed_size_bits"]))
    rows = spark.createDataFrame(points, "file_id string, ordinal long, compressed_offset_bits long, uncompressed_offset long, expected_size long, next_bits long")
    got = resume.decode_points(files, resume.windows_at(files, rows)).orderBy("ordinal").collect()
    assert len(got) == len(points) > 1 and b"".join(r.bytes for r in got) == TEXT


def test_sources_and_sink(spark, tmp_path):
    spark.dataSource.register(DeflateSource)
    spark.dataSource.register(FileSink)
    (tmp_path / "in").mkdir()
    whole = bgzf(TEXT)
    (tmp_path / "in/a.gz").write_bytes(whole)
    (tmp_path / "in/b.z").write_bytes(zlib.compress(b"one\ntwo"))
    with open(f"{tmp_path}/in/a.gz", "rb") as f:
        assert {first_block(f, x, len(whole)) for x in range(0, len(whole), 777)} < set(bgzf_starts(whole)) | {len(whole)}
    rows = spark.read.format("deflate").option("span", 20_000).load(f"{tmp_path}/in")
    got = rows.orderBy("file_id", "start_byte", "piece").collect()
    assert b"".join(r.bytes for r in got if r.file_id.endswith("a.gz")) == TEXT and rows.rdd.getNumPartitions() > 3
    members = spark.read.format("deflate").option("table", "members").option("span", 20_000).load(f"{tmp_path}/in/a.gz")
    assert members.count() == 150 and members.selectExpr("sum(uncompressed_size) n").first().n == len(TEXT)
    for option in ("no-verify", "sparse-windows"):
        with pytest.raises(Exception):
            spark.read.format("deflate").option(option, "x").load(f"{tmp_path}/in").collect()
    out = tmp_path / "out"
    out.mkdir()
    files = spark.createDataFrame([("x.bin", b"1"), ("y.bin", b"")], "file_id string, content binary")
    files.write.format("file_sink").mode("append").save(f"{out}")
    assert {p.name: p.read_bytes() for p in out.iterdir()} == {"x.bin": b"1", "y.bin": b""}
    with pytest.raises(Exception):
        files.write.format("file_sink").mode("append").save(f"{out}")
    files.withColumn("content", files.content.cast("binary")).write.format("file_sink").mode("overwrite").save(f"{out}")


def test_actions(spark):
    files = spark.createDataFrame([("a", gzip_member(b"l0\nl1\nl2") + gzip_member(b"")), ("b", bgzf(b"x\n" * 900))], "file_id string, content binary")
    assert {r.file_id: r.line_count for r in actions.count_lines(files).collect()} == {"a": 2, "b": 900}
    assert {r.file_id: r.decompressed_bytes for r in actions.count(files).collect()} == {"a": 8, "b": 1800}
    cut = actions.cut(files.where("file_id = 'a'"), "2@1,1L@1L,inf@2L,3@99,5L@0")
    pieces = {}
    for r in cut.orderBy("range_ord", "chunk").collect():
        pieces[r.range_ord] = pieces.get(r.range_ord, b"") + bytes(r.bytes)
    assert pieces == {0: b"0\n", 1: b"l1\n", 2: b"l2", 4: b"l0\nl1\nl2"}
    assert sum(len(r.bytes) for r in actions.decode(files, expected_size=None, output_limit=1800).collect()) == 1808
    for bad in ({"output_limit": 100}, {"expected_size": 9}):
        with pytest.raises(Exception):
            actions.decode(files, **bad).collect()
    broken = files.selectExpr("file_id", "substring(content, 1, 20) content")
    assert not any(r.ok for r in actions.test(broken).collect()) and all(r.ok for r in actions.test(files).collect())
    with pytest.raises(Exception):
        actions.count(broken).collect()
    points, windows, meta = actions.import_index(actions.export_index(files.where("file_id = 'b'"), "gzi"))
    assert points.count() == 2 and windows.count() == 0 and meta.first().kind == "bgzf"
    assert [r.line for r in actions.analyze(files.where("file_id = 'a'")).orderBy("ord").collect()][0].startswith("Stream 0")
    both = index_table(index_files(spark.createDataFrame([("f", "gzip", 9, 9, 9, None, 0, 80, 0, "deflate_block", None, None, WINDOW, False)], archives_schema()), "native"))
    assert bytes(both.first().payload) == WINDOW


def archives_schema():
    return "file_id string, kind string, compressed_size long, uncompressed_size long, spacing long, total_lines long, ordinal long, compressed_offset_bits long, uncompressed_offset long, point_kind string, header_offset long, line_offset long, payload binary, is_compressed boolean"


def test_line_table_of_odd_files(spark):
    files = spark.createDataFrame([("a", gzip_member(b"")), ("b", gzip_member(b"\n") + gzip_member(b"\r\nx")), ("c", zlib.compress(b"q"))], "file_id string, content binary")
    got = sorted((r.file_id, r.line, r.byte_offset, r.terminated, bytes(r.text)) for r in archives.line_table(files).collect())
    assert got == [("b", 0, 0, True, b""), ("b", 1, 1, True, b"\r"), ("b", 2, 3, False, b"x"), ("c", 0, 0, False, b"q")]


def test_ranges_by_index_equal_those_by_decoding(spark):
    rng = random.Random(3)
    texts = {"a": TEXT[:90_000], "b": b"\n" * 50 + TEXT[:40_000], "c": b"", "d": b"one line"}
    files = spark.createDataFrame([(k, gzip_member(t, 6, 2) if k != "b" else gzip_member(t[:9000]) + gzip_member(t[9000:], 6, 1)) for k, t in texts.items()], "file_id string, content binary")
    index = actions.import_index(actions.export_index(files, "native", spacing=6000))
    assert index[0].where("kind = 'deflate_block'").count() > 5 and actions.indexes.index_violations(*index).count() == 0
    spec = ["10@0", "inf@0", "3L@0", "0@5", "4L@20", "inf@40L", "7@999999", "2L@999999L", "1L@60"] + [f"{rng.randrange(30_000)}@{rng.randrange(90_000)}" for _ in range(4)] + [f"{rng.randrange(900)}L@{rng.randrange(9000)}L" for _ in range(4)] + [f"{rng.randrange(500)}L@{rng.randrange(80_000)}" for _ in range(4)]

    def joined(rows):
        out = {}
        for r in rows.orderBy("range_ord", "chunk").collect():
            out[r.file_id, r.range_ord] = out.get((r.file_id, r.range_ord), b"") + bytes(r.bytes)
        return out

    got = joined(actions.cut(files, ",".join(spec), index=index))
    assert got == joined(actions.cut(files, ",".join(spec)))
    for i, (size, at) in enumerate(x.split("@") for x in spec):
        for k, t in texts.items():
            breaks = [j + 1 for j in range(len(t)) if t[j : j + 1] == b"\n"]
            line = lambda n: 0 if n == 0 else breaks[n - 1] if n <= len(breaks) else len(t)
            start = line(int(at[:-1])) if at.endswith("L") else min(int(at), len(t))
            if size == "inf":
                end = len(t)
            elif size.endswith("L"):
                end = start if size == "0L" else max(start, line(sum(b <= start for b in breaks) + int(size[:-1])))
            else:
                end = min(len(t), start + int(size))
            assert got.get((k, i), b"") == t[start:end], (k, spec[i])


def test_gztool_index_of_one_member(spark):
    files = spark.createDataFrame([("f", gzip_member(TEXT, 6, 2))], "file_id string, content binary")
    for form in ("gzidx", "gztool", "gztool-lines"):
        points, windows, meta = actions.import_index(actions.export_index(files, form, spacing=20_000))
        rows = {r.compressed_offset_bits: r for r in points.collect()}
        assert len(rows) > 3
        for w in windows.collect():
            off = rows[w.compressed_offset_bits].uncompressed_offset
            own = zlib.decompress(w.payload) if w.is_compressed else bytes(w.payload)
            assert own[-min(off, 32768) :] == TEXT[max(0, off - 32768) : off]
            if form == "gztool-lines":
                assert rows[w.compressed_offset_bits].line_offset == TEXT[:off].count(b"\n")


def test_blocks_of_all_formats_and_limits(spark):
    from flatestream.sources.blocks import block_table

    raw = zlib.compressobj(6, zlib.DEFLATED, -15)
    raw = raw.compress(TEXT) + raw.flush()
    for format, content in (("auto", gzip_member(TEXT) + gzip_member(b"x" * 500)), ("auto", zlib.compress(TEXT)), ("raw-deflate", raw)):
        files = spark.createDataFrame([("f", content)], "file_id string, content binary")
        rows = block_table(files, format).orderBy("stream_index", "index_in_stream").collect()
        assert sum(r.uncompressed_size for r in rows) == len(TEXT) + (500 if format == "auto" and content[:2] == b"\x1f\x8b" else 0)
        for r in rows:
            covered = {x for ref in r.references for x in range(-ref.distance, ref.length - ref.distance)}
            assert (r.used_window_symbols, r.window_backreference_count, r.omitted_backreference_count) == (len(covered), len(r.references), 0)
            assert r.merged_window_backreference_count == sum(x - 1 not in covered for x in covered)
            assert r.compressed_offset_bits < r.compressed_data_offset_bits <= r.compressed_offset_bits + r.compressed_size_bits
        few = block_table(files, format, details=5).collect()
        assert sum(len(r.references) for r in few) == 5 and sum(r.omitted_backreference_count for r in few) == sum(len(r.references) for r in rows) - 5
        assert [actions.has_complete_details(block_table(files, format, n)).first().complete for n in (None, 5)] == [True, False]
        lines = [r.line for r in actions.analyze(files, format).orderBy("ord").collect()]
        assert lines[0].startswith("Stream 0") and any("literal:" in x for x in lines)
    broken = bytearray(zlib.compress(TEXT))
    broken[-1] ^= 1
    for limit, content in (({}, bytes(broken)), ({"most_blocks": 1}, gzip_member(TEXT)), ({"most_streams": 1}, gzip_member(b"a") * 2)):
        with pytest.raises(Exception):
            block_table(spark.createDataFrame([("f", content)], "file_id string, content binary"), **limit).collect()


def test_first_bytes_and_summary(spark):
    files = spark.createDataFrame([("a", gzip_member(b"abc\n") + gzip_member(b"def")), ("b", gzip_member(b""))], "file_id string, content binary")
    assert b"".join(bytes(r.bytes) for r in actions.first_bytes(files, 5).orderBy("chunk").collect()) == b"abc\nd"
    row = actions.summary(files, seconds=0.5).first()
    assert (row.files, row.member_count, row.decompressed_bytes, row.line_count) == (2, 3, 7, 1) and row.mib_per_second == 14 / (1 << 20)


def test_stored_streams_are_cut(spark):
    many = zlib.compressobj(0, zlib.DEFLATED, -15)
    many = b"".join(many.compress(TEXT[i : i + 5000]) + many.flush(zlib.Z_FULL_FLUSH) for i in range(0, len(TEXT), 5000)) + many.flush()
    raw = {"a": gzip_member(TEXT, 0) + gzip_member(b"", 0) + gzip_member(TEXT[:9], 0), "b": gzip_member(TEXT, 0) + gzip_member(TEXT), "c": gzip_member(b"", 0)}
    files = spark.createDataFrame(list(raw.items()), "file_id string, content binary")
    blocks = stored.stored_blocks(files)
    assert {r.file_id for r in blocks.select("file_id").distinct().collect()} == {"a", "c"}
    chunks = stored.stored_chunks(files, blocks, 40_000)
    got = chunks.where("file_id = 'a'").orderBy("uncompressed_offset", "member").collect()
    assert b"".join(bytes(r.bytes) for r in got) == TEXT + TEXT[:9] and {r.member for r in got} == {0, 1, 2}
    assert stored.stored_mismatches(chunks, blocks).count() == 0
    for content, format in ((many, "raw-deflate"), (zlib.compress(TEXT, 0), "zlib")):
        one = spark.createDataFrame([("f", content)], "file_id string, content binary")
        parts = stored.stored_chunks(one, stored.stored_blocks(one, format), 20_000).orderBy("part").collect()
        assert b"".join(bytes(r.bytes) for r in parts) == TEXT and len(parts) > 2
    wrong = bytearray(raw["a"])
    wrong[20] ^= 1
    bad = spark.createDataFrame([("f", bytes(wrong))], "file_id string, content binary")
    rows = stored.stored_blocks(bad)
    assert stored.stored_mismatches(stored.stored_chunks(bad, rows), rows).first().member == 0
    length = bytearray(raw["a"])
    length[11] ^= 1
    for content in (bytes(length), raw["c"][:-3], zlib.compress(b"x", 0) + b"y", b""):
        with pytest.raises(Exception):
            stored.stored_blocks(spark.createDataFrame([("f", content)], "file_id string, content binary")).collect()


def test_read_at(spark):
    files = spark.createDataFrame([("a", gzip_member(TEXT, 6, 2)), ("b", gzip_member(b"abc") + gzip_member(b"def"))], "file_id string, content binary")
    index = actions.import_index(actions.export_index(files, spacing=9000))
    seeks = [("a", 0, "end", -70_000, 30_000), ("a", 1, "start", 149_990, 99), ("a", 2, "start", 200_000, 5), ("b", 0, "end", -4, 2), ("b", 1, "end", 0, 3)]
    form = "file_id string, range_ord int, whence string, delta long, size int"
    got = {}
    for r in actions.read_at(files, spark.createDataFrame(seeks, form), index).orderBy("chunk").collect():
        got[r.file_id, r.range_ord] = got.get((r.file_id, r.range_ord), b"") + bytes(r.bytes)
    assert got == {("a", 0): TEXT[-70_000:-40_000], ("a", 1): TEXT[149_990:], ("b", 0): b"cd"}
    for bad in (("b", 0, "end", -7, 2), ("b", 0, "start", -1, 2), ("b", 0, "middle", 0, 2)):
        with pytest.raises(Exception):
            actions.read_at(files, spark.createDataFrame([bad], form), index).collect()
    unsized = (index[0], index[1], index[2].withColumn("uncompressed_size", actions.F.lit(None).cast("long")))
    with pytest.raises(Exception):
        actions.read_at(files, spark.createDataFrame(seeks[3:4], form), unsized).collect()


def test_inputs_are_kept_and_random_bytes(spark, tmp_path):
    spark.dataSource.register(FileSink)
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    (tmp_path / "in/a").write_bytes(b"old")
    (tmp_path / "out/b").symlink_to(tmp_path / "in/a")
    for name, folder in (("a", "in"), ("b", "out")):
        with pytest.raises(Exception):
            spark.createDataFrame([(name, b"new")], "file_id string, content binary").write.format("file_sink").option("inputs", f"{tmp_path}/in").mode("overwrite").save(f"{tmp_path}/{folder}")
    assert (tmp_path / "in/a").read_bytes() == b"old"
    read = lambda *a: b"".join(bytes(r.bytes) for r in tsv.pseudo_random(spark, *a).orderBy("piece").collect())
    whole = read(2500, 5, 1000)
    assert len(whole) == 2500 and whole == read(2500, 5, 1000) != read(2500, 6, 1000) and len(zlib.compress(whole)) > 2490 and read(0, 1) == b""


def test_packed_batches_are_bounded():
    from flatestream.sources.batches import packed

    schema = pa.schema([("k", pa.string()), ("b", pa.binary())])
    rows = [(str(i), bytes(1000)) for i in range(2500)] + [("large", bytes(3 << 20))] + [("x", None)]
    got = list(packed(iter(rows), schema))
    assert [r for b in got for r in zip(*(c.to_pylist() for c in b.columns), strict=True)] == rows
    assert [b.num_rows for b in got] == [1000, 1000, 501, 1]
    taken = []
    first = next(packed((taken.append(r) or r for r in rows), schema))
    assert first.num_rows == len(taken) == 1000


@pytest.mark.parametrize("memory, strategy", [(9, zlib.Z_HUFFMAN_ONLY), (1, 0), (8, zlib.Z_FIXED)])
def test_blocks_over_many_steps(memory, strategy):
    z = zlib.compressobj(6, zlib.DEFLATED, -15, memory, strategy)
    raw = z.compress(TEXT) + z.flush()
    blocks = list(stream_blocks(raw + b"after", 0))
    assert sum(b["uncompressed_size"] for b in blocks) == len(TEXT) and blocks[-1]["end"] == len(raw)
    assert all(b["literal_symbols"] + b["copied_bytes"] == b["uncompressed_size"] for b in blocks)
    for n in (0, 1, len(raw) // 2, len(raw) - 1):
        with pytest.raises(Malformed):
            list(stream_blocks(raw[:n], 0))


def test_windows_of_short_texts_are_compressed(spark):
    """A window has 32 KiB in an index file, of which a short text fills a part: the zeros aren't moved."""
    files = spark.createDataFrame([("f", gzip_member(TEXT[:12_000], 6, 1))], "file_id string, content binary")
    index = actions.export_index(files, spacing=2048)
    points, windows, _ = actions.import_index(index)
    assert windows.count() > 3 and len(index.first().content) < 32768
    own = {r.compressed_offset_bits: bytes(r.payload) for r in resume.whole_windows(windows).collect()}
    for p in points.where("kind = 'deflate_block'").collect():
        assert own[p.compressed_offset_bits] == (bytes(32768) + TEXT[: p.uncompressed_offset])[-32768:] and p.line_offset == TEXT[: p.uncompressed_offset].count(b"\n")


def test_report_decodes_blocks_once(spark):
    files = spark.createDataFrame([("f", gzip_member(TEXT))], "file_id string, content binary")
    rows = actions.analyze(files)
    assert "MapInArrow" not in rows._jdf.queryExecution().toString() and rows.count() > 3


def test_block_starts(monkeypatch):
    """zlib's places of blocks are those of the walk over all symbols: stored, fixed and dynamic blocks, empty ones too, and a stream without bytes."""
    from flatestream.sources import blocks

    z = zlib.compressobj(6, zlib.DEFLATED, -15, 1)
    raw = z.compress(TEXT[:40_000]) + z.flush(zlib.Z_FULL_FLUSH) + z.flush(zlib.Z_SYNC_FLUSH) + z.compress(b"ab" * 9) + z.flush(zlib.Z_PARTIAL_FLUSH) + z.compress(RNG.randbytes(9000)) + z.flush()
    for data in (raw, zlib.compress(b"")[2:-4], zlib.compress(TEXT, 0)[2:-4]):
        walked = [(b["compressed_offset_bits"], b["uncompressed_offset"]) for b in blocks.stream_blocks(b"head" + data + b"after", 4, 0)]
        assert blocks.LIBRARY and list(blocks.block_starts(b"head" + data + b"after", 4)) == walked
        with monkeypatch.context() as m:
            m.setattr(blocks, "LIBRARY", None)
            assert list(blocks.block_starts(b"head" + data + b"after", 4)) == walked
    for data in (raw[:-1], b"", b"\x07"):
        with pytest.raises(Malformed):
            list(blocks.block_starts(data, 0))


def test_cut_by_index_reads_few_windows(spark):
    """A range needs the window of its first span alone, and no join: each file meets its index once."""
    files = spark.createDataFrame([("f", gzip_member(TEXT, 6, 1))], "file_id string, content binary")
    index = actions.import_index(actions.export_index(files, spacing=2048))
    asked = [tuple(r) for r in actions.ranges.parse_ranges(spark, "inf@6000,3L@90000").collect()]
    assert index[1].count() > 40 and actions._first_windows(index[1], asked).count() == 2
    cut = actions.cut(files, "inf@6000,3L@90000", index=index)
    assert "Join" not in cut._jdf.queryExecution().executedPlan().toString()
    got = {0: b"", 1: b""}
    for r in cut.orderBy("range_ord", "chunk").collect():
        got[r.range_ord] += bytes(r.bytes)
    three = TEXT[90_000:].split(b"\n")[:3]
    assert got == {0: TEXT[6000:], 1: b"".join(x + b"\n" for x in three)}
    bare = (index[0].withColumn("line_offset", actions.F.lit(None).cast("long")), index[1], index[2])
    with pytest.raises(Exception):
        actions.cut(files, "3L@90000", index=bare).collect()


def test_cut_by_index_of_long_lines(spark):
    """All spans of a long line have the same line breaks before them: the window of the one with the break that is looked for is enough."""
    text = b"".join(RNG.randbytes(k).replace(b"\n", b"-") + b"\n" for k in (3000, 60_000, 2047, 2047, 50_000))
    files = spark.createDataFrame([("f", gzip_member(text, 6, 1))], "file_id string, content binary")
    index = actions.import_index(actions.export_index(files, spacing=1))
    asked = [tuple(r) for r in actions.ranges.parse_ranges(spark, "2L@1L,inf@4L").collect()]
    assert index[1].count() > 200 and actions._first_windows(index[1], asked).count() <= 3
    got = {0: b"", 1: b""}
    for r in actions.cut(files, "2L@1L,inf@4L", index=index).orderBy("range_ord", "chunk").collect():
        got[r.range_ord] += bytes(r.bytes)
    cut = text.split(b"\n")
    assert got == {0: cut[1] + b"\n" + cut[2] + b"\n", 1: cut[4] + b"\n"}
