"""Byte and line ranges `SIZE@OFFSET`, cut out of chunk and line tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT = r"^([0-9]+)(|B|KiB|MiB|GiB|TiB|PiB|EiB|L)$"
SHIFT = {"": 0, "B": 0, "KiB": 10, "MiB": 20, "GiB": 30, "TiB": 40, "PiB": 50, "EiB": 60, "L": 0}


def parse_ranges(spark: SparkSession, spec: str) -> DataFrame:
    """range_ord, size_kind, size, offset_kind, offset. Kinds are bytes, lines, and rest (`inf`, as a size only). Raises on any other form."""
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(spec), ",", -1)).alias("range_ord", "element"))
    parts = F.split("element", "@", -1)
    rows = rows.withColumn("p", F.when(F.size(parts) == 2, parts).otherwise(F.raise_error(F.concat(F.lit("not SIZE@OFFSET: "), "element")).cast("array<string>")))

    def quantity(text: F.Column, rest: bool) -> tuple[F.Column, F.Column]:
        unit, digits = F.regexp_extract(text, UNIT, 2), F.regexp_extract(text, UNIT, 1)
        bad = F.raise_error(F.concat(F.lit("not a quantity: "), text))
        factor = F.lit(1).cast("decimal(20,0)")
        for u, s in SHIFT.items():
            factor = F.when(unit == u, F.lit(1 << s).cast("decimal(20,0)")).otherwise(factor)
        number = (digits.cast("decimal(18,0)") * factor).cast("long")
        kind = F.when(text.rlike(UNIT), F.when(unit == "L", "lines").otherwise("bytes"))
        value = F.when(text.rlike(UNIT), number)
        if rest:
            return F.when(text == "inf", "rest").otherwise(F.coalesce(kind, bad.cast("string"))), F.when(text == "inf", F.lit(None)).otherwise(F.coalesce(value, bad.cast("long")))
        return F.coalesce(kind, bad.cast("string")), F.coalesce(value, bad.cast("long"))

    (sk, s), (ok, o) = quantity(F.element_at("p", 1), True), quantity(F.element_at("p", 2), False)
    return rows.select("range_ord", sk.alias("size_kind"), s.alias("size"), ok.alias("offset_kind"), o.alias("offset"))


def byte_bounds(ranges: DataFrame, lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """file_id, range_ord, start, end: each range in bytes for each file. lines (file_id, line, byte_offset), sizes (file_id, uncompressed_size).

    Line n starts after n line breaks; beyond the last one it is the end of the file. Ranges past the end are short or empty. `ranges` is a request, so a small table.
    """
    r = sizes.crossJoin(F.broadcast(ranges))

    def at_line(rows: DataFrame, line: str, name: str) -> DataFrame:
        starts = lines.select("file_id", F.col("line").alias(line), F.col("byte_offset").alias("_at"))
        return rows.join(starts, ["file_id", line], "left").withColumn(name, F.coalesce("_at", "uncompressed_size")).drop("_at")

    r = r.withColumn("_l", F.when(F.col("offset_kind") == "lines", F.col("offset")))
    r = at_line(r, "_l", "_s").withColumn("start", F.when(F.col("offset_kind") == "lines", F.col("_s")).otherwise(F.least("offset", "uncompressed_size")))
    before = lines.where("terminated").select("file_id", F.col("line").alias("_k"), (F.col("byte_offset") + F.octet_length("text") + 1).alias("_end"))
    here = lines.groupBy("file_id").agg(F.count_if("terminated").alias("_breaks"))
    r = r.join(here, "file_id", "left")
    inside = F.when(F.col("offset_kind") == "lines", F.col("offset"))
    held = r.where("size_kind = 'lines' and offset_kind = 'bytes'").select("file_id", "range_ord", "start").join(before, "file_id").where("_end <= start").groupBy("file_id", "range_ord").agg(F.count(F.lit(1)).alias("_past"))
    r = r.join(held, ["file_id", "range_ord"], "left").withColumn("_want", F.when((F.col("size_kind") == "lines") & (F.col("size") > 0), F.coalesce(inside, F.col("_past"), F.lit(0)) + F.col("size")))
    r = at_line(r, "_want", "_e")
    end = F.when(F.col("size_kind") == "rest", F.col("uncompressed_size")).when(F.col("size_kind") == "lines", F.when(F.col("size") == 0, F.col("start")).otherwise(F.greatest("_e", "start"))).otherwise(F.least(F.col("start") + F.col("size"), F.col("uncompressed_size")))
    return r.select("file_id", "range_ord", "start", end.alias("end"))


def extract_ranges(chunks: DataFrame, bounds: DataFrame) -> DataFrame:
    """file_id, range_ord, chunk, bytes: the pieces of each range in chunk order. Ranges stay apart where they overlap; an empty one has no piece."""
    c = chunks.select("file_id", "chunk", F.col("uncompressed_offset").alias("_at"), "bytes", (F.col("uncompressed_offset") + F.octet_length("bytes")).alias("_end"))
    rows = bounds.where("end > start").join(c, "file_id").where((F.col("start") < F.col("_end")) & (F.col("end") > F.col("_at")))
    first = F.greatest(F.col("start") - F.col("_at"), F.lit(0)).cast("int")
    size = (F.least("end", "_end") - F.greatest("start", "_at")).cast("int")
    return rows.select("file_id", "range_ord", "chunk", F.substring("bytes", first + 1, size).alias("bytes"))
