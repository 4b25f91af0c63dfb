"""Histograms, the three medians, grouped benchmark summaries and paired comparisons."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import running


def histogram(df: DataFrame, keys: list[str], value: str, bins: int, integers: bool = False) -> DataFrame:
    """keys, bin, low, high, count of equal bins over [min, max]; the maximum is in the last bin. Empty bins have no row.

    Integers have no more bins than max - min + 1; if all values are equal there is one filled bin. Nulls are left out.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    ends = rows.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    n = F.least(F.lit(bins), (F.col("high") - F.col("low") + 1).cast("long")) if integers else F.lit(bins)
    ends = ends.withColumn("n", n.cast("long"))
    rows = rows.join(ends, keys) if keys else rows.crossJoin(ends)  # without keys, ends is one row
    place = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("n")), F.col("n") - 1))
    return rows.withColumn("bin", place.cast("long")).groupBy(*keys, "bin", "low", "high").agg(F.count(F.lit(1)).alias("count"))


def median(value: str) -> Column:
    """Mean of the two middle values."""
    return F.median(value)


def order_statistics(df: DataFrame, keys: list[str], value: str, places: Mapping[str, Callable[[Column], Column]], buckets: int = 1024) -> DataFrame:
    """keys and, for each name, the value at a place from 0 of the group's sorted values; a place is a function of their number.

    Nulls are left out. Values are ranked by buckets of their range, so a large group is spread over tasks and never collected.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    ends = rows.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count(F.lit(1)).alias("_n"))
    rows = rows.join(ends, keys) if keys else rows.crossJoin(ends)
    bucket = F.when(F.col("_high") == F.col("_low"), 0).otherwise(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * buckets))
    ranked = running(rows, keys, bucket, [F.col("_v")], {"_place": ("count", F.lit(1))})
    return ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("_place") == place(F.col("_n")), F.col("_v"))).alias(name) for name, place in places.items()])


def upper_median(n: Column) -> Column:
    """sorted[n div 2]."""
    return F.floor(n / 2)


def nearest_rank(fraction: float) -> Callable[[Column], Column]:
    """sorted[min(n - 1, int(n * fraction))]."""
    return lambda n: F.least(n - 1, F.floor(n * fraction))


METRICS = ["wall_seconds", "user_seconds", "system_seconds", "max_rss_kib", "decoded_mib_per_second"]
GROUP = ["corpus", "mode", "tool", "backend", "threads"]


def bench_summary(raw: DataFrame) -> DataFrame:
    """Attempts, successes, failures and medians over the successful rows of each group."""
    good = F.col("status") == "success"
    medians = [F.median(F.when(good, F.col(m))).alias(f"median_{m}") for m in METRICS]
    return raw.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(good).alias("successes"), F.count_if(~F.coalesce(good, F.lit(False))).alias("failures"), *medians)


def bench_violations(raw: DataFrame) -> DataFrame:
    """rule, corpus, mode, tool, threads, repetition of the rows that break a rule of the raw table; empty for a valid one."""
    good, ends = F.coalesce(F.col("status") == "success", F.lit(False)), F.coalesce(F.col("exit_status") == 0, F.lit(False))
    metrics = [F.col(m) for m in METRICS]
    bad = F.lit(False)
    for m in metrics:
        bad = bad | m.isNull() | F.isnan(m) | (m < 0)
    some = F.lit(False)
    for m in metrics:
        some = some | m.isNotNull()
    key = ["corpus", "mode", "tool", "threads", "repetition"]
    rules = F.array(F.when(good != ends, "status disagrees with exit_status"), F.when(good & bad, "metric missing, not finite or negative"), F.when(~good & some, "metric of a failure"))
    one = raw.select(F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"), *key)
    twice = raw.groupBy(*key).count().where("count > 1").select(F.lit("attempt occurs more than once").alias("rule"), *key)
    sizes = raw.where(good).groupBy("corpus", "mode").agg(F.count_distinct("decoded_bytes").alias("n")).where("n > 1")
    differ = sizes.select(F.lit("sizes differ").alias("rule"), "corpus", "mode", F.lit(None).cast("string").alias("tool"), F.lit(None).cast("int").alias("threads"), F.lit(None).cast("int").alias("repetition"))
    return one.unionByName(twice).unionByName(differ)


def percent_delta(candidate: Column, base: Column) -> Column:
    """Null where base isn't positive."""
    return F.when(base > 0, (candidate / base - 1) * 100)


def paired_delta(df: DataFrame, keys: list[str], pair: list[str], side: str, value: str, base: str, candidate: str) -> DataFrame:
    """Per keys the number of pairs and the median of their deltas; a pair has one row of either side for keys and `pair`."""
    a = df.where(F.col(side) == base).select(*keys, *pair, F.col(value).alias("_base"))
    b = df.where(F.col(side) == candidate).select(*keys, *pair, F.col(value).alias("_cand"))
    both = a.join(b, [*keys, *pair])
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.median(percent_delta(F.col("_cand"), F.col("_base"))).alias("median_delta"))


def bootstrap_median_upper(df: DataFrame, value: str, seed: int = 1, iterations: int = 10_000, fraction: float = 0.95, bins: int = 1024) -> DataFrame:
    """upper: the nearest-rank `fraction` quantile of the medians of resamples, each of as many draws as there are values.

    Draws come from a hash of (seed, iteration, draw), so that the result doesn't depend on partitions. A draw is a place among the sorted values,
    so the median of a resample lies at the median of its places: these are counted in `bins` bins, and one by one within the bins of the two
    middle ones. So draws are rows that Spark counts where it makes them, and no task holds a sample.
    """
    spark = df.sparkSession
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "upper double")
    width = -(-n // bins)
    draws = spark.range(iterations * n).select(F.expr(f"id div {n}").alias("i"), (F.col("id") % n).cast("int").alias("j"))
    draws = draws.select("i", F.pmod(F.xxhash64(F.lit(seed), "i", "j"), F.lit(n).cast("long")).alias("place")).withColumn("bin", F.expr(f"place div {width}"))

    def middle(counts: DataFrame, by: str, low: Column, high: Column, before: Column) -> DataFrame:
        """counts (i, `by`, n) with `_past`, the draws of the resample before a row; only the rows that hold its draw `low` or `high`."""
        w = Window.partitionBy("i", "bin").orderBy(by) if by == "place" else Window.partitionBy("i").orderBy(by)
        past = before + F.sum("n").over(w) - F.col("n")
        held = counts.withColumn("_past", past)
        inside = lambda at: (F.col("_past") <= at) & (at < F.col("_past") + F.col("n"))
        return held.withColumn("_low", inside(low)).withColumn("_high", inside(high)).where("_low or _high")

    low, high = F.lit((n - 1) // 2), F.lit(n // 2)
    found = middle(draws.groupBy("i", "bin").agg(F.count(F.lit(1)).alias("n")), "bin", low, high, F.lit(0)).select("i", "bin", F.col("_past").alias("_before"))
    own = draws.join(F.broadcast(found), ["i", "bin"])  # two rows an iteration at most
    own = middle(own.groupBy("i", "bin", "_before", "place").agg(F.count(F.lit(1)).alias("n")), "place", low, high, F.col("_before"))
    places = own.groupBy("i").agg(F.max(F.when(F.col("_low"), F.col("place"))).alias("a"), F.max(F.when(F.col("_high"), F.col("place"))).alias("b"))
    ends = rows.agg(F.min("_v").alias("_least"), F.max("_v").alias("_most")).first()
    span = ends["_most"] - ends["_least"]
    bucket = F.floor((F.col("_v") - ends["_least"]) / span * 1024) if span else F.lit(0)
    ranked = running(rows, [], bucket, [F.col("_v")], {"place": ("count", F.lit(1))})
    wanted = places.select("i", F.explode(F.array("a", "b")).alias("place"))
    medians = ranked.join(F.broadcast(wanted), "place").groupBy("i").agg((F.sum("_v") / 2).alias("m"))
    return order_statistics(medians, [], "m", {"upper": nearest_rank(fraction)})


def parity(df: DataFrame, keys: list[str], tool: str, digest: str) -> DataFrame:
    """keys, tools, agree: whether all tools gave one digest."""
    return df.groupBy(*keys).agg(F.count_distinct(tool).alias("tools"), (F.count_distinct(digest) == 1).alias("agree"))


def run_plan(tools: DataFrame, corpora: DataFrame, modes: DataFrame, threads: DataFrame, repetitions: int) -> DataFrame:
    """Every combination once, tools rotated by repetition. Inputs are small configuration tables."""
    n = tools.count()
    plan = tools.crossJoin(corpora).crossJoin(modes).crossJoin(threads).crossJoin(tools.sparkSession.range(1, repetitions + 1).select(F.col("id").cast("int").alias("repetition")))
    return plan.withColumn("order", ((F.col("repetition") - 1 + F.col("tool_rank")) % n).cast("int"))


def supported(plan: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of a plan that a rule (tool, mode, format; null for any) allows. Rules are a small configuration table."""
    p, r = plan.alias("p"), F.broadcast(rules).alias("r")
    meets = F.col("p.tool") == F.col("r.tool")
    for name in ("mode", "format"):
        meets &= F.col(f"r.{name}").isNull() | (F.col(f"p.{name}") == F.col(f"r.{name}"))
    return p.join(r, meets, "left_semi")
