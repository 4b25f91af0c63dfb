"""Ordered grouping: first rows within a budget, fixed batches, adjacency chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import running


def first_n(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in order: a detail budget over the whole group. `bucket` follows `order`."""
    return running(df, keys, bucket, order, {"_place": ("count", F.lit(1))}).where(F.col("_place") < n).drop("_place")


def budget(df: DataFrame, keys: list[str], part: list[str], bucket: Column, order: list[Column], n: int) -> DataFrame:
    """keys, part, kept, omitted: how many of each part's rows are among the first n of its keys."""
    rows = running(df, keys, bucket, order, {"_place": ("count", F.lit(1))})
    return rows.groupBy(*keys, *part).agg(F.count_if(F.col("_place") < n).alias("kept"), F.count_if(F.col("_place") >= n).alias("omitted"))


def fixed_batches(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], size: int) -> DataFrame:
    """Add batch: rows in order, `size` to a batch."""
    rows = running(df, keys, bucket, order, {"_place": ("count", F.lit(1))})
    return rows.withColumn("batch", F.floor(F.col("_place") / size)).drop("_place")


def accepted_chain(df: DataFrame, keys: list[str], start: str, end: str, bucket: Column) -> DataFrame:
    """The rows of each group that follow one another without a gap from its first start, as far as they do. `bucket` follows start."""
    order = [F.col(start), F.col(end)]
    rows = running(df, keys, bucket, order, {"_end": ("last", F.col(end))})
    broken = F.when(F.col("_end").isNull() | (F.col("_end") == F.col(start)), 0).otherwise(1)
    rows = running(rows.withColumn("_broken", broken), keys, bucket, order, {"_breaks": ("sum", F.col("_broken"))})
    return rows.where("_breaks + _broken = 0").select(*df.columns)


def at_most(df: DataFrame, keys: list[str], n: int, what: str) -> DataFrame:
    """df itself; running it raises where a group has more than n rows. Limits fail, they don't cut."""
    over = df.groupBy(*keys).count().where(F.col("count") > n) if keys else df.groupBy().count().where(F.col("count") > n)
    fail = over.select(F.raise_error(F.lit(f"more than {n} {what}")).cast(df.schema[0].dataType).alias(df.columns[0]))
    return df.unionByName(fail, allowMissingColumns=True)
