"""Running values over long ordered groups, in two levels.

A plain window puts a whole group into one task. Here each group is cut into buckets that follow its order. Buckets are
aggregated first (with partial aggregation on the map side), the table of buckets carries the running value over its
few rows, and a window within each bucket adds what precedes a row there. So a group that holds a third of all rows is
spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], values: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Add, for each name, the running `sum`, `max`, `count` or `last` (non-null) of what precedes a row in its keys.

    `bucket` must not fall along `order`, and `order` must tell rows apart where the result depends on it. Where nothing precedes, a
    sum or count is 0, max and last are null. Null keys form a group of their own.
    """
    cols = {n: f"_v{i}" for i, n in enumerate(values)}
    rows = df.withColumn("_bucket", bucket)
    rows = rows.withColumn("_order", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    for n, (_, value) in values.items():
        rows = rows.withColumn(cols[n], value)

    def over(kind: str, c: str, w: Window) -> Column:
        if kind == "count":
            return F.coalesce(F.count(c).over(w), F.lit(0))
        if kind == "sum":
            return F.coalesce(F.sum(c).over(w), F.lit(0))
        return F.max(c).over(w) if kind == "max" else F.last(c, ignorenulls=True).over(w)

    def whole(kind: str, c: str) -> Column:
        if kind == "last":
            return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_order")))
        return {"sum": F.sum, "max": F.max, "count": F.count}[kind](c)

    parts = rows.groupBy(*keys, "_bucket").agg(*[whole(kind, cols[n]).alias(cols[n]) for n, (kind, _) in values.items()])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_bucket").alias("_b"),
        *[over("sum" if kind == "count" else kind, cols[n], before).alias(f"_c{cols[n]}") for n, (kind, _) in values.items()],
    )
    on = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = Window.partitionBy(*keys, "_bucket").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    for n, (kind, _) in values.items():
        rows = rows.withColumn(f"_l{cols[n]}", over(kind, cols[n], within))
    out = rows.join(carried, on)
    for n, (kind, _) in values.items():
        own, more = F.col(f"_l{cols[n]}"), F.col(f"_c{cols[n]}")
        out = out.withColumn(n, own + more if kind in ("sum", "count") else F.greatest(own, more) if kind == "max" else F.coalesce(own, more))
    return out.select(*df.columns, *values)


def asof_backward(probes: DataFrame, points: DataFrame, keys: list[str], at: str, bucket: Column, payload: list[str], strict: bool = False, tie: str | None = None) -> DataFrame:
    """Add to each probe the `payload` of the last point of its keys whose `at` is at most (strict: below) the probe's.

    Of points with one `at` the one with the greatest `tie` counts. `bucket` is computed from `at` on both sides and must not fall with it. Probes
    without an earlier point get nulls. Points and probes are put in one order, so there is no range join.
    """
    kept = [c for c in probes.columns if c not in payload]
    p = probes.select(*keys, F.col(at), F.lit(0 if strict else 1).alias("_side"), F.struct(*kept).alias("_probe"), F.lit(None).cast(points.select(F.struct(*payload)).schema[0].dataType).alias("_point"), F.lit(None).cast("long").alias("_tie"))
    q = points.select(*keys, F.col(at), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(probes.select(F.struct(*kept)).schema[0].dataType).alias("_probe"), F.struct(*payload).alias("_point"), (F.col(tie) if tie else F.lit(None)).cast("long").alias("_tie"))
    both = running(p.unionByName(q), keys, bucket, [F.col(at), F.col("_side"), F.col("_tie")], {"_found": ("last", F.col("_point"))})
    return both.where("_probe is not null").select(*[F.col(f"_probe.`{c}`") for c in kept], *[F.col(f"_found.`{c}`") for c in payload])
