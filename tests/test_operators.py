"""Operators against brute force on small random tables."""

import random
import struct
from statistics import median

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flatestream.functions import columns as c
from flatestream.operators import grouping, indexes, intervals, ranges, statistics
from flatestream.operators.scans import asof_backward, running
from flatestream.streaming import streams


def test_running(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, 1, 2, 5])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at long, v long")
    out = running(df, ["k"], F.floor(F.col("at") / 17), [F.col("at")], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v")), "n": ("count", F.lit(1))}).collect()
    for r in out:
        before = [v for k, at, v in rows if k == r.k and at < r.at]
        known = [v for v in before if v is not None]
        assert (r.s, r.m, r.l, r.n) == (sum(known), max(known, default=None), known[-1] if known else None, len(before))


@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, strict):
    rng = random.Random(2)
    points = [(rng.choice("xy"), rng.randrange(60), i) for i in range(40)]
    probes = [(rng.choice("xyz"), rng.randrange(70), i) for i in range(80)]
    got = asof_backward(spark.createDataFrame(probes, "k string, t long, id long"), spark.createDataFrame(points, "k string, t long, p long"), ["k"], "t", F.floor(F.col("t") / 8), ["p"], strict=strict, tie="p").collect()
    assert len(got) == 80
    for r in got:
        best = max(((t, p) for k, t, p in points if k == r.k and (t < r.t if strict else t <= r.t)), default=(None, None))
        assert r.p == best[1]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(-1, 12)), max_size=30))
def test_interval_union(spark, pairs):
    covered = sorted({x for s, n in pairs for x in range(s, s + n)})
    want = [x for x in covered if x - 1 not in set(covered)]
    df = spark.createDataFrame([(s, n) for s, n in pairs], "s long, n long")
    got = intervals.interval_union(df, [], "s", "n", F.floor(F.col("start") / 8)).collect()
    assert sorted(r.start for r in got) == want and sum(r.end - r.start for r in got) == len(covered)


def test_interval_example(spark):
    df = spark.createDataFrame([(10, 20), (10, 2), (30, 5)], "s long, n long")
    assert [tuple(r) for r in intervals.interval_union(df, [], "s", "n", F.floor(F.col("start") / 8)).collect()] == [(10, 35)]


def test_histograms(spark):
    h = lambda v, b, **k: {r.bin: r["count"] for r in statistics.histogram(spark.createDataFrame([(x,) for x in v], "v double"), [], "v", b, **k).collect()}
    assert h([3.0, 4.0, 5.0], 8, integers=True) == {0: 1, 1: 1, 2: 1}
    assert h([7.0] * 4, 8) == {0: 4} and h([0.0, 100.0], 8) == {0: 1, 7: 1} and h([], 8) == {}


def test_line_lookup_example(spark):
    points = spark.createDataFrame([("f", i, b, o, "deflate_block", None, n) for i, (b, o, n) in enumerate([(0, 0, 0), (80, 1000, 0), (160, 2000, 1)])], "file_id string, ordinal long, compressed_offset_bits long, uncompressed_offset long, kind string, header_offset long, line_offset long")
    targets = spark.createDataFrame([("f", n) for n in range(3)], "file_id string, line long")
    assert {r.line: r.checkpoint_offset for r in indexes.checkpoint_at_line(targets, points).collect()} == {0: 0, 1: 1000, 2: 2000}


def test_violations(spark):
    ck = "file_id string, ordinal long, compressed_offset_bits long, uncompressed_offset long, kind string, header_offset long, line_offset long"
    points = spark.createDataFrame([("f", 0, 4, 0, "gzip_member_header", None, 0), ("f", 1, 4, 9, "zlib_header", None, None), ("f", 2, 900, 5, "deflate_block", None, 7)], ck)
    windows = spark.createDataFrame([("f", 900, b"w", False)], "file_id string, compressed_offset_bits long, payload binary, is_compressed boolean")
    meta = spark.createDataFrame([("f", "gzip", 100, 50, None, 3)], "file_id string, kind string, compressed_size long, uncompressed_size long, spacing long, total_lines long")
    got = {(r.ordinal, r.rule) for r in indexes.index_violations(points, windows, meta).collect()}
    assert {(0, "a stream start must be byte-aligned"), (1, "compressed offsets must increase"), (1, "kind not allowed in this index"), (2, "offsets must not decrease"), (2, "offset beyond the compressed size"), (2, "more lines than bytes"), (2, "line offset beyond the total"), (0, "line offsets must be all or none")} <= got


def test_parse_ranges(spark):
    got = [tuple(r)[1:] for r in ranges.parse_ranges(spark, "10@0,1KiB@15KiB,5L@20L,inf@40L").orderBy("range_ord").collect()]
    assert got == [("bytes", 10, "bytes", 0), ("bytes", 1024, "bytes", 15360), ("lines", 5, "lines", 20), ("rest", None, "lines", 40)]
    for bad in ("", "1", "1@", "@1", "1@2@3", "1@inf", "x@1", "1KB@0", "-1@0", "1@0,", "1 @0", "99EiB@0"):
        with pytest.raises(Exception):
            ranges.parse_ranges(spark, bad).collect()


def test_column_functions(spark):
    row = spark.range(1).select(
        c.bytes_text(F.lit(0)).alias("zero"), c.bytes_text(F.lit((3 << 60) + (1 << 40) + 5)).alias("big"), c.bits_text(F.lit(17)).alias("bits"), c.escaped_bytes(F.lit(b"a\x00~\xff")).alias("esc"),
        c.percentage(F.lit(1), F.lit(0)).alias("none"), c.compression_ratio(F.lit(10), F.lit(16)).alias("ratio"), c.throughput(F.lit(1 << 21), F.lit(2.0)).alias("speed"), c.alphabet_text(F.array(*[F.lit(x) for x in (0, 2, 2, 1, 0)])).alias("shape"), c.alphabet_text(F.array(F.lit(0))).alias("unused"), c.counts_by_length(F.array(F.lit(1), F.lit(3), F.lit(3)), 3).alias("by"),
        c.looks_like_gzi(F.lit((2).to_bytes(8, "little") + bytes(8)), F.lit(40)).alias("gzi"), c.bar(F.lit(5), F.lit(10)).alias("bar"),
    ).first()
    assert (row.zero, row.big, row.bits, row.esc, row.none, row.gzi, row.bar) == ("0 B", "3 EiB 1 TiB 5 B", "2 B 1 b", "a\\x00~\\xff", 0.0, True, "=" * 10)
    assert (row.ratio, row.speed, row.shape, row.unused, row.by) == (5.0, 1.0, "3 of 5 used, lengths 1 to 2 (1:1, 2:2)", "unused", [1, 0, 2])
    with pytest.raises(Exception):
        spark.range(1).select(c.decode_bit_offset(F.lit(0).cast("long"), F.lit(3))).collect()
    values = [0.0, 1.0, 1e-5, 123456.0, 1234567.0, 0.1 + 0.2, -2.5, 1e300]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", c.general_text(F.col("v")).alias("t")).collect()
    assert all(r.t == f"{r.v:.6g}".replace("e+0", "e+0") for r in got)


def test_archive_stream_and_late_data(spark, tmp_path):
    from flatestream.plans.views import gzip_member
    from flatestream.sources.archives import decode_report, member_table

    for i in range(3):
        (tmp_path / f"{i}.gz").write_bytes(gzip_member(b"a\nb\n" * (i + 1)) + gzip_member(b""))
    rows = member_table(streams.arriving_archives(spark, f"file://{tmp_path}/*.gz"), "gzip")
    got = streams.finished(rows, f"file://{tmp_path}/out")
    assert sorted((r.member_count, r.line_count, r.ok) for r in decode_report(got).collect()) == [(2, 2, True), (2, 4, True), (2, 6, True)]


def test_benchmark_tables(spark, tmp_path):
    from flatestream import schema
    from flatestream.sources import tsv

    header = [c.strip().strip("`").split("`")[0].split(" ")[0] for c in schema.BENCH_RAW.replace("`order`", "order").split(", ")]
    row = lambda tool, rep, wall, ok: ["t", "c|x", "m", tool, "z", "4", str(rep), "0", *([str(wall)] * 4 if ok else [""] * 4), "100", *([str(wall)] if ok else [""]), "0" if ok else "1", "success" if ok else "failed", "o", "e"]
    rows = [row("main", 1, 2.0, True), row("main", 2, 4.0, True), row("candidate", 1, 1.0, True), row("candidate", 2, 2.0, True), row("candidate", 3, 0, False)]
    path = tmp_path / "raw.tsv"
    path.write_text("\n".join("\t".join(r) for r in [header, *rows]) + "\n")
    raw = tsv.read_raw(spark, f"file://{path}")
    assert statistics.bench_violations(raw).count() == 0
    summary = statistics.bench_summary(raw)
    got = {r.tool: (r.attempts, r.successes, r.failures, r.median_wall_seconds) for r in summary.collect()}
    assert got == {"main": (2, 2, 0, 3.0), "candidate": (3, 2, 1, 1.5)}
    delta = statistics.paired_delta(raw.where("status = 'success'"), ["corpus"], ["threads", "repetition"], "tool", "wall_seconds", "main", "candidate").first()
    assert (delta.pairs, delta.median_delta) == (2, -50.0)
    assert {r.rule for r in statistics.bench_violations(raw.unionByName(raw.limit(1)).withColumn("exit_status", F.lit(0))).collect()} >= {"attempt occurs more than once", "status disagrees with exit_status"}
    tsv.write_summary(summary, f"file://{tmp_path}/out", spark.createDataFrame([("os", "x")], "key string, value string"))
    text = next((tmp_path / "out/summary").glob("part*")).read_text().splitlines()
    assert len(text) == 3 and "1.500000" in text[1]
    assert tsv.markdown(summary.select("corpus", "tool"), ["tool"]).orderBy("ord").collect()[2].line == "| c\\|x | candidate |"
    path.write_text("\n".join("\t".join(r) for r in [header[::-1], *rows]) + "\n")
    with pytest.raises(Exception):
        tsv.read_raw(spark, f"file://{path}").collect()


def test_sequence_records_and_limits(spark):
    from flatestream.plans.views import gzip_member
    from flatestream.sources import archives, tsv

    lines = [r.line for r in tsv.fastq_like(spark, 20).orderBy("line_no").collect()]
    assert len(lines) == 80 and lines[0] == "@read-0" and set(lines[1]) <= set("ACGT")
    files = spark.createDataFrame([("f", gzip_member("\n".join(lines).encode() + b"\n"))], "file_id string, content binary")
    table = archives.line_table(files)
    assert tuple(tsv.fastq_records(table).first()) == ("f", 20, 1000)
    with pytest.raises(Exception):
        tsv.fastq_records(table.where("line < 79")).collect()
    assert grouping.at_most(table, ["file_id"], 80, "lines").count() == 80
    with pytest.raises(Exception):
        grouping.at_most(table, ["file_id"], 79, "lines").collect()


def test_first_arrivals(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")], "key long, t string").selectExpr("key", "cast(t as timestamp) ts")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    assert sorted(r.key for r in streams.finished(streams.first_arrivals(stream, "key"), f"file://{tmp_path}/out").collect()) == [1, 2]


def test_bootstrap_by_brute_force(spark):
    def draw(seed, i, j):
        h = 42
        for form, v in (("<i", seed), ("<q", i), ("<i", j)):
            h = xxhash.xxh64_intdigest(struct.pack(form, v), seed=h)
        return h - (1 << 64) if h >> 63 else h

    values = sorted([3.0, 1.5, 8.25, 2.0, 2.0, 7.5, 0.5])
    n, rounds = len(values), 200
    medians = sorted(median(values[draw(4, i, j) % n] for j in range(n)) for i in range(rounds))
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    assert statistics.bootstrap_median_upper(df, "v", seed=4, iterations=rounds).first().upper == medians[min(rounds - 1, int(rounds * 0.95))]


def test_stream_of_windows_leaves_rows_in_files(spark, tmp_path):
    rows = spark.range(500).selectExpr("timestamp_seconds(id * 97) ts", "concat('t', id % 3) event_type", "cast(id as double) value")
    rows.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = streams.telemetry_windows_stream(spark, f"file://{tmp_path}/events.parquet", "1 hour", f"file://{tmp_path}/out")
    want = streams.telemetry_windows(rows, "1 hour")
    key = lambda df: sorted((r.window.start, r.event_type, r.samples, r.most) for r in df.collect())
    assert key(got) == key(want)


def test_supported_and_checked_columns(spark):
    from flatestream.functions import columns
    from flatestream.operators.statistics import supported

    plan = spark.createDataFrame([(t, m, f) for t in "abc" for m in ("stdout", "verify") for f in ("gzip", "zlib")], "tool string, mode string, format string")
    rules = spark.createDataFrame([("a", None, None), ("b", "verify", "gzip"), ("b", None, "gzip")], "tool string, mode string, format string")
    assert sorted((r.tool, r.mode, r.format) for r in supported(plan, rules).collect()) == [("a", m, f) for m in ("stdout", "verify") for f in ("gzip", "zlib")] + [("b", "stdout", "gzip"), ("b", "verify", "gzip")]
    at = lambda b, d: spark.createDataFrame([(b, d)], "b long, d long").select(columns.add_offset(F.col("b"), F.col("d"))).first()[0]
    assert (at(5, -5), at(5, 7), at(None, 1)) == (0, 12, None)
    for b, d in ((5, -6), ((1 << 63) - 1, 1)):
        with pytest.raises(Exception):
            at(b, d)
    head = lambda k: spark.createDataFrame([(k, 80, 3)], "k string, b long, h long").select(columns.member_header_offset(F.col("k"), F.col("b"), F.col("h"))).first()[0]
    assert (head("gzip_member_header"), head("gzip_member_deflate")) == (10, 3)
    with pytest.raises(Exception):
        head("deflate_block")
    assert [r[0] for r in spark.createDataFrame([("bgzf",), ("zlib",)], "k string").select(columns.format_for_index(F.col("k"))).collect()] == ["gzip", "zlib"]


def test_interval_union_of_equal_rows(spark):
    """Rows that open an interval occur often, so a copy must not be taken for the opening row of the one before."""
    starts = [10 * (i % 400) for i in range(40_000)]
    df = spark.createDataFrame([(s, 5) for s in starts], "s long, n long").repartition(7)
    got = intervals.interval_union(df, [], "s", "n", F.floor(F.col("start") / 64)).collect()
    assert sorted(tuple(r) for r in got) == [(s, s + 5) for s in range(0, 4000, 10)]
    seen = intervals.reference_coverage(df.select(F.lit(7).alias("k"), (F.col("s") + 5).alias("distance"), F.col("n").alias("length")), ["k"], F.floor(F.col("start") / 512)).collect()
    assert [tuple(r) for r in seen] == [(7, 400, 2000)]


def test_bytes_text_up_to_a_unit(spark):
    n = F.lit((5 << 30) + (3 << 20) + 7)
    assert tuple(spark.range(1).select(c.bytes_text(n), c.bytes_text(n, "MiB")).first()) == ("5 GiB 3 MiB 7 B", "5123 MiB 7 B")


def test_bootstrap_holds_no_sample(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 1000).cast("double").alias("v"))
    plan = []
    for bins in (3, 1024):
        out = statistics.bootstrap_median_upper(df, "v", iterations=20, bins=bins)
        assert "collect_list" not in out._jdf.queryExecution().toString()
        plan.append(out.first().upper)
    assert plan[0] == plan[1] and 480 < plan[0] < 540
    assert statistics.bootstrap_median_upper(df.limit(0), "v", iterations=5).count() == 0
