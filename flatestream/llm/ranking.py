"""Ranks over large groups without one task for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


ROWS = 1 << 16  # of a bucket, about


def bucket_bits(rows: DataFrame) -> int:
    """Bits of a bucket number, so that a bucket of evenly spread rows has about ROWS of them at any size; 12 at least."""
    return max(12, (rows.count() // ROWS).bit_length())


def bucket_ranks(rows: DataFrame, keys: list[str], bucket: Column, order: list[Column], rank: str, total: str) -> DataFrame:
    """Add `rank`, the place from 0 of each row within its keys, and `total`, the rows of its keys.

    `bucket` must rise with `order`. Buckets are counted first (with partial sums on the map side); a row's rank is its
    place within its bucket plus the rows of the earlier buckets. So a group is spread over as many tasks as it has
    buckets, and only the table of bucket counts is put in order as a whole.
    """
    rows = rows.withColumn("_bucket", bucket)
    by = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    rows = rows.withColumn("_key", F.concat_ws("\x00", *by) if by else F.lit(""))
    counts = rows.groupBy("_key", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("_key")
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_key", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(group).alias(total))
    place = F.row_number().over(Window.partitionBy("_key", "_bucket").orderBy(*order))
    out = rows.withColumn("_place", place).join(starts, ["_key", "_bucket"])
    return out.withColumn(rank, F.col("_start") + F.col("_place") - 1).drop("_key", "_bucket", "_place", "_start")
