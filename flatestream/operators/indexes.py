"""Checkpoint tables: spans, lookups, validation, thinning, line offsets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import asof_backward

# The kinds of checkpoints that each kind of index may hold.
ALLOWED_KINDS = {
    "gzip": ["gzip_member_header", "gzip_member_deflate", "deflate_block"],
    "bgzf": ["gzip_member_header", "gzip_member_deflate", "deflate_block"],
    "zlib": ["zlib_header", "deflate_block"],
    "raw-deflate": ["raw_deflate_start", "deflate_block"],
}
STARTS = ["gzip_member_header", "gzip_member_deflate", "zlib_header", "raw_deflate_start"]


def spans(checkpoints: DataFrame, meta: DataFrame) -> DataFrame:
    """Each checkpoint with the offset where the next one starts, the last with the total size; and the length between."""
    w = Window.partitionBy("file_id").orderBy("compressed_offset_bits")
    rows = checkpoints.withColumn("_next", F.lead("uncompressed_offset").over(w)).withColumn("next_bits", F.lead("compressed_offset_bits").over(w))
    rows = rows.join(meta.select("file_id", "uncompressed_size"), "file_id", "left")
    end = F.coalesce("_next", "uncompressed_size")
    return rows.withColumn("end_offset", end).withColumn("expected_size", end - F.col("uncompressed_offset")).drop("_next", "uncompressed_size")


def checkpoint_at_byte(targets: DataFrame, checkpoints: DataFrame, bucket_bytes: int = 64 << 20) -> DataFrame:
    """targets (file_id, offset, ...) with the last checkpoint at or before offset (of equal offsets the last one)."""
    points = checkpoints.select("file_id", F.col("uncompressed_offset").alias("offset"), "compressed_offset_bits", F.col("uncompressed_offset").alias("checkpoint_offset"))
    return asof_backward(targets, points, ["file_id"], "offset", F.floor(F.col("offset") / bucket_bytes), ["compressed_offset_bits", "checkpoint_offset"], tie="compressed_offset_bits")


def checkpoint_at_line(targets: DataFrame, checkpoints: DataFrame, bucket_lines: int = 1 << 20) -> DataFrame:
    """targets (file_id, line, ...) with the last checkpoint whose line_offset is below line; for line 0 the last one at byte 0.

    Null where any checkpoint of the file lacks line_offset.
    """
    whole = checkpoints.groupBy("file_id").agg(F.bool_and(F.col("line_offset").isNotNull()).alias("_whole"))
    points = checkpoints.select("file_id", F.col("line_offset").alias("line"), "compressed_offset_bits", F.col("uncompressed_offset").alias("checkpoint_offset")).where("line is not null")
    payload = ["compressed_offset_bits", "checkpoint_offset"]
    later = asof_backward(targets.where("line > 0"), points, ["file_id"], "line", F.floor(F.col("line") / bucket_lines), payload, strict=True, tie="compressed_offset_bits")
    zero = points.where("checkpoint_offset = 0").groupBy("file_id").agg(F.max_by(F.struct(*payload), "compressed_offset_bits").alias("_p"))
    first = targets.where("line = 0").join(zero, "file_id", "left").select(*targets.columns, "_p.*")
    both = later.unionByName(first).join(whole, "file_id", "left")
    return both.select(*targets.columns, *[F.when(F.col("_whole"), F.col(c)).alias(c) for c in payload])


def index_violations(checkpoints: DataFrame, windows: DataFrame, meta: DataFrame) -> DataFrame:
    """file_id, ordinal, rule: every broken rule of the index tables; empty for a valid index."""
    w = Window.partitionBy("file_id").orderBy("ordinal")
    rows = checkpoints.withColumnRenamed("kind", "ck").join(meta.withColumnRenamed("kind", "kind_"), "file_id", "left").join(windows.select("file_id", "compressed_offset_bits", F.lit(True).alias("has_window")), ["file_id", "compressed_offset_bits"], "left")
    has = F.coalesce("has_window", F.lit(False))
    allowed = F.lit(False)
    for kind, own in ALLOWED_KINDS.items():
        allowed = allowed | ((F.col("kind_") == kind) & F.col("ck").isin(own))
    rows = rows.withColumnRenamed("line_offset", "line")
    prior = lambda c: F.lag(c).over(w)
    rows = rows.select(
        "file_id", "ordinal", F.col("compressed_offset_bits").alias("bits"), F.col("uncompressed_offset").alias("off"), "line", has.alias("has"), "ck", "kind_",
        "compressed_size", "uncompressed_size", "total_lines", prior("compressed_offset_bits").alias("p_bits"), prior("uncompressed_offset").alias("p_off"), prior("line").alias("p_line"),
        F.count("line").over(Window.partitionBy("file_id")).alias("n_line"), F.count(F.lit(1)).over(Window.partitionBy("file_id")).alias("n_all"),
    )
    start = F.col("ck").isin(STARTS)
    rules: list[tuple[str, Column]] = [
        ("compressed offsets must increase", F.col("bits") <= F.col("p_bits")),
        ("offsets must not decrease", F.col("off") < F.col("p_off")),
        ("offset beyond the compressed size", F.col("bits") > F.col("compressed_size") * 8),
        ("offset beyond the uncompressed size", F.col("off") > F.col("uncompressed_size")),
        ("kind not allowed in this index", ~allowed),
        ("a stream start must be byte-aligned", start & (F.col("bits") % 8 != 0)),
        ("a stream start has no window", start & F.col("has")),
        ("the stream starts at 0", F.col("ck").isin("zlib_header", "raw_deflate_start") & ((F.col("bits") != 0) | (F.col("off") != 0))),
        ("an interior point needs a window", F.col("kind_").isin("zlib", "raw-deflate") & ~start & ~F.col("has")),
        ("line offsets must not decrease", F.col("line") < F.col("p_line")),
        ("more lines than bytes", F.col("line") > F.col("off")),
        ("line offset beyond the total", F.col("line") > F.col("total_lines")),
        ("line offsets must be all or none", (F.col("n_line") > 0) & (F.col("n_line") < F.col("n_all"))),
        ("more lines than bytes in total", F.col("total_lines") > F.col("uncompressed_size")),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in rules]), lambda r: r.isNotNull())
    return rows.select("file_id", "ordinal", F.explode(found).alias("rule"))


def thin(checkpoints: DataFrame, spacing: int) -> DataFrame:
    """Checkpoints kept one after another: starts, points without a window, and points `spacing` or more after the last kept one.

    What is kept depends on what was kept before, so a file's offsets are folded in order; a task holds one batch of a file's narrow rows at a time.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, last = None, 0
        for f in frames:
            keep = []
            for file_id, off, always in zip(f["file_id"], f["uncompressed_offset"], f["always"], strict=True):
                if file_id != file:
                    file, last = file_id, None
                take = always or last is None or off - last >= spacing
                if take:
                    last = off
                keep.append(take)
            yield f[keep]

    rows = checkpoints.withColumn("always", F.col("kind").isin(STARTS) | ~F.coalesce(F.col("has_window"), F.lit(False)))
    order = ["file_id", "compressed_offset_bits"]
    return rows.repartition("file_id").sortWithinPartitions(*order).mapInPandas(fold, rows.schema).drop("always")


def all_or_none_lines(checkpoints: DataFrame) -> DataFrame:
    """line_offset of every checkpoint of a file, or of none if one lacks it."""
    whole = F.bool_and(F.col("line_offset").isNotNull()).over(Window.partitionBy("file_id"))
    return checkpoints.withColumn("line_offset", F.when(whole, F.col("line_offset")))


def line_offsets_at(points: DataFrame, lines: DataFrame, bucket_bytes: int = 16 << 20) -> DataFrame:
    """points (file_id, uncompressed_offset, ...) with line_offset, the line breaks before each; lines as line_table gives them.

    Breaks and points are put in one order and counted along it, so no point meets all breaks before it.
    """
    from .scans import running

    kept = [x for x in points.columns if x != "line_offset"]
    breaks = lines.where("terminated").select("file_id", (F.col("byte_offset") + F.octet_length("text")).alias("_at"), F.lit(1).alias("_break"))
    rows = points.select("file_id", F.col("uncompressed_offset").alias("_at"), F.struct(*kept).alias("_point")).unionByName(breaks, allowMissingColumns=True)
    found = running(rows, ["file_id"], F.floor(F.col("_at") / bucket_bytes), [F.col("_at"), F.coalesce("_break", F.lit(0))], {"line_offset": ("count", F.col("_break"))})
    return found.where("_point is not null").select("_point.*", "line_offset")


def line_mismatches(checkpoints: DataFrame, lines: DataFrame) -> DataFrame:
    """file_id, ordinal, imported, counted: checkpoints whose line_offset isn't what the decoded lines give; empty for a true index."""
    known = checkpoints.where("line_offset is not null")
    counted = line_offsets_at(known.withColumn("imported", F.col("line_offset")), lines)
    return counted.where("imported <> line_offset").select("file_id", "ordinal", "imported", F.col("line_offset").alias("counted"))
