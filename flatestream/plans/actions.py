"""What a user of a decompressor asks for, as functions from archives (file_id, content) to DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import indexes, ranges
from ..operators.scans import running
from ..operators.statistics import histogram
from ..sources import archives, resume
from ..sources.blocks import block_table
from ..sources.index_files import index_files, index_table
from .views import stored


def decode(files: DataFrame, format: str = "auto", expected_size: int | None = None, output_limit: int | None = None) -> DataFrame:
    """Chunks in order. Raises where a file's output goes over the limit, or isn't of the expected size."""
    chunks = archives.chunk_table(files, format)
    if expected_size is None and output_limit is None:
        return chunks
    most = min(x for x in (expected_size, output_limit) if x is not None)
    end = F.col("uncompressed_offset") + F.octet_length("bytes")
    chunks = chunks.withColumn("bytes", F.when(end > most, F.raise_error(F.lit("more output than allowed")).cast("binary")).otherwise(F.col("bytes")))
    if expected_size is None:
        return chunks
    sizes = chunks.groupBy("file_id").agg(F.sum(F.octet_length("bytes")).alias("_n"))
    sizes = files.select("file_id").join(sizes, "file_id", "left").where(F.coalesce("_n", F.lit(0)) != expected_size)
    wrong = sizes.select(F.raise_error(F.lit("less output than expected")).cast("string").alias("file_id"))
    return chunks.unionByName(wrong, allowMissingColumns=True)


def test(files: DataFrame, format: str = "auto") -> DataFrame:
    """file_id, ok, error_kind, error_offset of every file."""
    rows = archives.member_table(files, format)
    return rows.groupBy("file_id").agg(F.bool_and("ok").alias("ok"), F.max("error_kind").alias("error_kind"), F.max("error_offset").alias("error_offset"))


def count(files: DataFrame, format: str = "auto") -> DataFrame:
    return archives.decode_report(archives.member_table(files, format, strict=True)).select("file_id", "decompressed_bytes")


def count_lines(files: DataFrame, format: str = "auto") -> DataFrame:
    return archives.decode_report(archives.member_table(files, format, strict=True)).select("file_id", "line_count")


Index = tuple[DataFrame, DataFrame, DataFrame]


def cut(files: DataFrame, spec: str, format: str = "auto", index: Index | None = None) -> DataFrame:
    """file_id, range_ord, chunk, bytes of the ranges of a specification such as `10@0,5L@20L,inf@40L`.

    With an index (as import_index gives it) only the spans that a range touches, or that hold its first or last line break, are decoded;
    chunk is then the number of the span.
    """
    request = ranges.parse_ranges(files.sparkSession, spec)
    if index:
        return _cut_by_index(files, request, *index)
    members = archives.member_table(files, format, strict=True)
    sizes = archives.index_meta_of(members).select("file_id", "uncompressed_size")
    bounds = ranges.byte_bounds(request, archives.line_table(files, format), sizes)
    return ranges.extract_ranges(archives.chunk_table(files, format), bounds)


def _cut_by_index(files: DataFrame, request: DataFrame, points: DataFrame, windows: DataFrame, meta: DataFrame) -> DataFrame:
    """A file's bytes, points and windows go to one task once, in order, and it decodes the spans that the ranges need."""
    asked = [tuple(r) for r in request.collect()]  # a request is a small table
    both = files.select("file_id", F.lit(0).alias("side"), F.lit(-1).cast("long").alias("bits"), F.col("content").alias("data"))
    both = both.unionByName(meta.select("file_id", F.lit(0).alias("side"), F.lit(-2).cast("long").alias("bits"), "uncompressed_size", "total_lines"), allowMissingColumns=True)
    both = both.unionByName(_first_windows(windows, asked).select("file_id", F.lit(1).alias("side"), F.col("compressed_offset_bits").alias("bits"), F.col("payload").alias("data"), "is_compressed"), allowMissingColumns=True)
    both = both.unionByName(points.select("file_id", F.lit(2).alias("side"), F.col("compressed_offset_bits").alias("bits"), "uncompressed_offset", "kind", "line_offset"), allowMissingColumns=True)
    rows = both.where("file_id is not null").repartition("file_id").sortWithinPartitions("file_id", "side", "bits")
    return resume.pieces_by_index(rows, asked)


def _first_windows(windows: DataFrame, asked: list[tuple]) -> DataFrame:
    """Windows of spans that hold the first byte, or the break before a first or last line, of a range that is asked for; what follows in a range needs none.

    All of them where `windows` don't have the places of their spans, as those of import_index do.
    """
    if "next_line" not in windows.columns:
        return windows
    own = F.lit(False)
    for _, size_kind, size, offset_kind, offset in asked:
        if offset_kind == "bytes":
            own = own | ((F.col("from_offset") <= offset) & F.coalesce(F.col("next_offset") > offset, F.lit(True)))
            continue
        for line in (offset, offset + size) if size_kind == "lines" else (offset,):
            own = own | (F.coalesce(F.col("from_line") < line, F.lit(True)) & F.coalesce(F.col("next_line") >= line, F.lit(True)))
    return windows.where(own)


def _span_bytes(files: DataFrame, spans: DataFrame, bounds: DataFrame) -> DataFrame:
    """The bytes of bounds (file_id, range_ord, start, end) from the spans that they touch, each decoded once."""
    touched = spans.select("file_id", "ordinal", F.col("uncompressed_offset").alias("_from"), "end_offset").join(bounds, "file_id").where("start < end_offset and end > _from")
    own = spans.join(touched.select("file_id", "ordinal").distinct(), ["file_id", "ordinal"], "left_semi")
    chunks = resume.decode_points(files, own).select("file_id", "ordinal", "bytes").join(spans.select("file_id", "ordinal", "uncompressed_offset"), ["file_id", "ordinal"])
    return ranges.extract_ranges(chunks.withColumnRenamed("ordinal", "chunk"), bounds)


def read_at(files: DataFrame, seeks: DataFrame, index: Index) -> DataFrame:
    """file_id, range_ord, chunk, bytes of seeks (file_id, range_ord, whence, delta, size): `size` bytes from a place that is counted from `start` or `end`.

    A place before byte 0 raises, and one counted from the end where the index doesn't have the decoded size; one at or past the end gives nothing.
    """
    points, windows, meta = index
    points, meta = stored(points, "points"), stored(meta, "meta")
    spans = stored(indexes.spans(points, meta).join(windows, ["file_id", "compressed_offset_bits"], "left"), "spans")
    unknown = F.raise_error(F.concat(F.lit("the index has no decoded size: "), "file_id")).cast("long")
    base = F.when(F.col("whence") == "start", F.lit(0).cast("long")).when(F.col("whence") == "end", F.coalesce("uncompressed_size", unknown)).otherwise(F.raise_error(F.lit("whence is start or end")).cast("long"))
    asked = seeks.join(meta.select("file_id", "uncompressed_size"), "file_id").withColumn("start", c.add_offset(base, F.col("delta").cast("long")))
    end = F.least(F.col("start") + F.col("size"), "uncompressed_size")
    return _span_bytes(files, spans, stored(asked.select("file_id", "range_ord", "start", end.alias("end")), "bounds"))


def index_points(files: DataFrame, spacing: int | None = None, format: str = "auto") -> DataFrame:
    """Checkpoints with payload and is_compressed: the member starts and, with `spacing`, block starts inside streams that many decoded bytes apart.

    A point inside a stream has the up to 32 KiB of its stream before it as a window; every point has the line breaks before it.
    """
    if spacing is not None:
        return resume.point_table(files, format, spacing)
    starts = archives.checkpoints_of(archives.member_table(files, format, strict=True))
    return starts.withColumns({"payload": F.lit(None).cast("binary"), "is_compressed": F.lit(False)})


def export_index(files: DataFrame, form: str = "native", spacing: int | None = None, format: str = "auto", points: DataFrame | None = None) -> DataFrame:
    """file_id, content: an index of each file's member starts, and with `spacing` of points inside its streams. `points` are those of index_points, where they are known."""
    if points is None:
        return stored(resume.written_indexes(files, form, format, spacing), "index")
    members = stored(archives.member_table(files, format, strict=True), "members")
    if form in ("gzidx", "gztool", "gztool-lines"):
        starts = members.select("file_id", F.col("header_offset"), (F.col("deflate_offset") * 8).alias("bits"))
        points = points.join(starts, ["file_id", "header_offset"], "left").withColumn("compressed_offset_bits", F.coalesce("bits", "compressed_offset_bits"))
        points = points.withColumn("kind", F.when(F.col("bits").isNotNull(), "gzip_member_deflate").otherwise(F.col("kind"))).drop("bits")
    meta = archives.index_meta_of(members).withColumn("spacing", F.lit(spacing).cast("long"))
    return stored(index_files(points.withColumnRenamed("kind", "point_kind").join(meta, "file_id"), form), "index")


def import_index(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Checkpoints, windows and the fields of index files. Raises where an index breaks a rule."""
    table = index_table(files)
    rows = stored(table.drop("payload"), "points")  # windows, most of an index, are read again where they are needed, and never stored twice
    points = rows.select("file_id", "ordinal", "compressed_offset_bits", "uncompressed_offset", F.col("point_kind").alias("kind"), "header_offset", "line_offset")
    windows = table.where("payload is not null").select("file_id", "compressed_offset_bits", "payload", "is_compressed", F.col("uncompressed_offset").alias("from_offset"), "next_offset", F.col("line_offset").alias("from_line"), "next_line")
    meta = rows.select("file_id", "kind", "compressed_size", "uncompressed_size", "spacing", "total_lines").distinct()
    return indexes.all_or_none_lines(points), windows, meta


def analyze(files: DataFrame, format: str = "auto", details: int = 1_000_000) -> DataFrame:
    """file_id, ord, line: a report of the streams and blocks of each file, in order; `details` is the budget of listed references."""
    blocks = stored(block_table(files, format, details).drop("references"), "blocks")  # each kind of line reads them
    members = stored(archives.member_table(files, format, strict=True), "members")
    name = lambda c: F.coalesce(F.decode(c, "UTF-8"), F.lit("-"))
    check = F.when(F.col("format") == "gzip", F.format_string("CRC32 %08x", "crc32")).when(F.col("format") == "zlib", F.format_string("Adler32 %08x", "adler32")).otherwise("no checksum")
    ratio = F.format_string("%.2f", F.coalesce(c.compression_ratio(F.col("uncompressed_size"), (F.col("end_offset") - F.col("header_offset")) * 8), F.lit(0.0)))
    level = F.when(F.col("format") == "zlib", c.lookup(F.col("xfl"), c.ZLIB_LEVELS)).when(F.col("format") == "gzip", c.lookup(F.col("xfl"), c.EXTRA_FLAGS)).otherwise("-")
    head = F.format_string("Stream %d: %s %s, %s -> %s, ratio %s, %s, OS %s", "member", "format", name("file_name"), c.bytes_text(F.col("end_offset") - F.col("header_offset")), c.bytes_text(F.col("uncompressed_size")), ratio, check, F.coalesce(c.lookup(F.col("os"), c.OPERATING_SYSTEMS), F.lit("-")))
    more = F.format_string("  comment %s, extra %s, level: %s", name("comment"), F.coalesce(c.escaped_bytes(F.col("extra")), F.lit("-")), level)
    streams = members.select("file_id", F.col("member").cast("double").alias("place"), head.alias("line"))
    fields = members.select("file_id", (F.col("member") + 0.5 / (1 << 30)).alias("place"), more.alias("line"))
    place = F.col("stream_index") + (F.col("index_in_stream") + 1) / (1 << 30)
    shape = F.format_string(
        "  Block %d: %s%s, header %d b, %s -> %s, %d literals, %d references, %d into the window (%d merged, %d bytes used, %d not listed)", "index_in_stream", "block_type", F.when(F.col("is_final"), " (final)").otherwise(""),
        F.col("compressed_data_offset_bits") - F.col("compressed_offset_bits"), c.bits_text(F.col("compressed_size_bits")), c.bytes_text(F.col("uncompressed_size")), "literal_symbols", "backreference_symbols",
        "window_backreference_count", "merged_window_backreference_count", "used_window_symbols", "omitted_backreference_count",
    )
    each = blocks.select("file_id", place.alias("place"), shape.alias("line"))
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n"), F.col(n).alias("a")) for i, n in enumerate(("precode", "distance", "literal"))]))
    alphabets = blocks.where("block_type = 'Dynamic Huffman'").select("file_id", place.alias("place"), kinds.alias("k"))
    alphabets = alphabets.select("file_id", (F.col("place") + (F.col("k.i") + 1) / (1 << 34)).alias("place"), F.concat(F.lit("    "), "k.n", F.lit(": "), c.alphabet_text(F.col("k.a"))).alias("line"))
    types = blocks.groupBy("file_id", "block_type").count().select("file_id", F.lit(1e12).alias("place"), F.format_string("%s blocks: %d", "block_type", "count").alias("line"))
    same = blocks.where("block_type = 'Dynamic Huffman'").groupBy("file_id").agg((F.count("literal") - F.count_distinct("literal")).alias("n"), F.count("literal").alias("of"))
    same = same.select("file_id", F.lit(1.5e12).alias("place"), F.format_string("Repeated literal alphabets: %d of %d", "n", "of").alias("line"))
    sizes = histogram(blocks, ["file_id"], "uncompressed_size", 8, integers=True)
    bars = sizes.join(sizes.groupBy("file_id").agg(F.max("count").alias("most")), "file_id")
    bars = bars.select("file_id", (F.lit(2e12) + F.col("bin")).alias("place"), F.format_string("Block sizes, bin %d of [%.0f, %.0f]: %d %s", "bin", "low", "high", "count", c.bar(F.col("count"), F.col("most"))).alias("line"))
    rows = streams
    for x in (fields, each, alphabets, types, same, bars):
        rows = rows.unionByName(x)
    numbered = running(rows, ["file_id"], F.floor(F.col("place") / 1024), [F.col("place"), F.col("line")], {"ord": ("count", F.lit(1))})
    return numbered.select("file_id", "ord", "line")


def has_complete_details(blocks: DataFrame) -> DataFrame:
    """file_id, complete: whether every reference of every block is listed."""
    return blocks.groupBy("file_id").agg((F.sum("omitted_backreference_count") == 0).alias("complete"))


def first_bytes(files: DataFrame, n: int, format: str = "auto") -> DataFrame:
    """Chunks up to the first n decoded bytes of each file; what comes after them is decoded and verified, but not given."""
    chunks = archives.chunk_table(files, format).where(F.col("uncompressed_offset") < n)
    return chunks.withColumn("bytes", F.substring("bytes", F.lit(1), F.least(F.octet_length("bytes"), n - F.col("uncompressed_offset")).cast("int")))


def summary(files: DataFrame, seconds: float | None = None, format: str = "auto") -> DataFrame:
    """One row for all files: files, members, bytes in and out, line breaks, and MiB of output in a second where the time is given."""
    report = archives.decode_report(archives.member_table(files, format, strict=True))
    total = report.agg(F.count(F.lit(1)).alias("files"), *[F.sum(x).alias(x) for x in ("member_count", "compressed_bytes", "decompressed_bytes", "line_count")])
    return total.withColumn("mib_per_second", c.throughput(F.col("decompressed_bytes"), F.lit(seconds).cast("double")))
