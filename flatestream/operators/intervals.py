"""Union of intervals and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import running

WINDOW = 32768  # the history a DEFLATE back-reference can reach


def interval_union(df: DataFrame, keys: list[str], start: str, length: str, bucket: Column) -> DataFrame:
    """keys, start, end: the maximal intervals covered by [start, start + length). Touching intervals merge, contained ones vanish.

    Rows with a null bound or a length below 1 are left out. `bucket` follows start.
    """
    rows = df.select(*keys, F.col(start).alias("start"), (F.col(start) + F.col(length)).alias("end")).where("end > start")
    rows = rows.groupBy(*keys, "start").agg(F.max("end").alias("end"))  # one row a start: equal rows could come in another order the second time
    order = [F.col("start")]
    rows = running(rows, keys, bucket, order, {"reach": ("max", F.col("end"))})
    rows = rows.withColumn("opens", F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1).otherwise(0))
    rows = running(rows, keys, bucket, order, {"before": ("sum", F.col("opens"))}).withColumn("island", F.col("before") + F.col("opens"))
    return rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def reference_coverage(refs: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """keys, groups, used: how back-references (distance, length) cover the WINDOW bytes before a block, clipped at its start."""
    start = F.lit(WINDOW) - F.col("distance")
    placed = refs.select(*keys, start.alias("start"), F.least(F.col("length"), F.lit(WINDOW) - start).alias("n"))
    return interval_union(placed, keys, "start", "n", bucket).groupBy(*keys).agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("end") - F.col("start")).alias("used"))
