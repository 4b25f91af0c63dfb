"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks. With integer weights that add up to D, block j of a source of weight w may not
start before slot floor(j * D / w) and must start before slot ceil((j + 1) * D / w). The earliest deadline goes first.
After D slots every source has had exactly its weight in blocks, so the schedule of one period serves for all periods; in
any prefix a source is less than one block away from its share.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import bucket_bits, bucket_ranks

OTHER = "(other)"
WEIGHTS = {"src0": 6} | {f"src{i}": 1 for i in range(1, 20)}


def _period(weights: Column, total: Column) -> Column:
    """The source number of each slot of one period, by earliest deadline among the released blocks."""
    number = F.sequence(F.lit(0), F.size(weights) - 1)

    def slot(state: Column, t: Column) -> Column:
        def job(i: Column) -> Column:
            w, done = F.get(weights, i), F.get(state["done"], i)
            release = F.floor(done * total / w)
            deadline = F.ceil((done + 1) * total / w)
            return F.when((done < w) & (release <= t), deadline * F.size(weights) + i)

        first = F.array_min(F.transform(number, job)) % F.size(weights)
        done = F.transform(state["done"], lambda d, i: d + F.when(i == first, F.lit(1)).otherwise(F.lit(0)).cast("long"))
        return F.struct(done.alias("done"), F.concat(state["picked"], F.array(first.cast("long"))).alias("picked"))

    start = F.struct(F.transform(weights, lambda w: F.lit(0).cast("long")).alias("done"), F.array().cast("array<bigint>").alias("picked"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), total - 1), start, slot, lambda s: s["picked"])


def pfair_mix(docs: DataFrame, weights: Mapping[str, int] = WEIGHTS, other: int = 1, block_rows: int = 16, seed: str = "mix", most_epochs: int | None = None) -> DataFrame:
    """All rows of docs, repeated as the weights demand, with mix_source, epoch, block, position and place.

    `weights` names the sources, `other` is the weight of all further sources and null together, as one source "(other)";
    a weight must be 1 or more, and sources without rows take no part. Blocks hold `block_rows` rows in an order by
    md5(seed|doc_id), the last one of a source what is left. Every row occurs: the schedule ends when the source
    that is furthest from its target has been used up once, and the others start anew until then (epoch 1, 2, ...).
    position is the block's place in the whole schedule from 0, without gaps; block its place in its source over all epochs; place
    the row's place in its block. So the rows that come out are those of the furthest source times D over its weight, without a bound of their
    own: a small source of a high weight comes back very often. Where `most_epochs` is given, a source that would start anew more often
    fails the job instead. `weights` may be empty; a null name is an error. An empty table gives no rows. Columns of docs with these names are replaced.
    """
    if min([other, *weights.values()]) < 1:
        raise ValueError("weights must be 1 or more")
    if None in weights:
        raise ValueError("a null source belongs to the others")
    docs = docs.drop("mix_source", "epoch", "block", "position", "place")
    names = list(weights)
    source = F.when(F.col("source").isin(names), F.col("source")).otherwise(F.lit(OTHER)) if names else F.lit(OTHER)
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = docs.withColumn("mix_source", source).withColumn("_md5", digest)
    sizes = rows.groupBy("mix_source").agg(F.count(F.lit(1)).alias("_rows"))
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for n, w in weights.items() for x in (n, w)]), F.col("mix_source")) if names else F.lit(None), F.lit(other)).cast("long")
    sizes = sizes.withColumn("_w", weight).withColumn("_blocks", F.expr(f"(_rows + {block_rows - 1}) div {block_rows}"))
    one = sizes.agg(
        F.array_sort(F.collect_list(F.struct("mix_source", "_w", "_blocks"))).alias("_all"), F.sum("_w").alias("_d"), F.max(F.expr("(_blocks + _w - 1) div _w")).alias("_periods")
    ).where("_d is not null")
    period = one.select("_all", "_d", "_periods", F.posexplode(_period(F.col("_all._w"), F.col("_d"))).alias("_slot", "_i"))
    period = period.select("_d", "_periods", F.expr("get(_all, cast(_i as int))").alias("_s"), F.col("_slot").cast("long").alias("_slot"))
    schedule = period.groupBy(F.col("_s.mix_source").alias("mix_source")).agg(
        F.array_sort(F.collect_list("_slot")).alias("_slots"), F.first("_s._w").alias("_w"), F.first("_s._blocks").alias("_blocks"), F.first("_d").alias("_d"), F.first("_periods").alias("_periods")
    )
    ties = [F.md5(F.col("text").cast("binary"))] if "text" in docs.columns else []
    digits = -(-bucket_bits(docs) // 4)
    ranked = bucket_ranks(rows, ["mix_source"], F.conv(F.substring("_md5", 1, digits), 16, 10).cast("long"), [F.col("_md5"), F.col("doc_id"), *ties], "_r", "_total")
    placed = ranked.join(F.broadcast(schedule), "mix_source").withColumn("_own", F.expr(f"_r div {block_rows}"))
    epochs = F.expr("(_periods * _w - 1 - _own) div _blocks")
    if most_epochs is not None:
        epochs = F.when(epochs >= most_epochs, F.raise_error(F.concat(F.lit(f"more than {most_epochs} epochs of source "), "mix_source")).cast("long")).otherwise(epochs)
    out = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), epochs))).withColumn("block", F.col("epoch") * F.col("_blocks") + F.col("_own"))
    position = F.expr("(block div _w) * _d + get(_slots, cast(block % _w as int))")
    return out.withColumn("position", position).withColumn("place", F.expr(f"_r % {block_rows}")).select(*docs.columns, "mix_source", "epoch", "block", "position", "place")


SQL = f"""
WITH RECURSIVE named AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {w}::BIGINT)" for n, w in WEIGHTS.items())}) AS t(name, w)),
rows_ AS (
  SELECT d.doc_id, coalesce(n.name, '{OTHER}') AS mix_source, coalesce(n.w, 1) AS w, md5('mix|' || coalesce(d.doc_id::VARCHAR, '')) AS h, md5(d.text) AS tie
  FROM documents d LEFT JOIN named n ON d.source = n.name),
sizes AS (SELECT mix_source, any_value(w) AS w, count(*) AS n, (count(*) + 15) // 16 AS blocks FROM rows_ GROUP BY mix_source),
numbered AS (SELECT *, row_number() OVER (ORDER BY mix_source) - 1 AS i, sum(w) OVER ()::BIGINT AS d, max((blocks + w - 1) // w) OVER () AS periods, count(*) OVER () AS k FROM sizes),
lists AS (SELECT list(w ORDER BY i) AS ws, any_value(d) AS d, any_value(k) AS k FROM numbered),
slots AS (
  SELECT -1::BIGINT AS t, [0::BIGINT FOR w IN ws] AS done, -1::BIGINT AS picked, ws, d, k FROM lists
  UNION ALL
  SELECT t + 1, [done[j + 1] + CASE WHEN j = p THEN 1 ELSE 0 END FOR j IN range(k)], p, ws, d, k FROM (
    SELECT *, list_min([ceil((done[j + 1] + 1) * d / ws[j + 1])::BIGINT * k + j FOR j IN range(k) IF done[j + 1] < ws[j + 1] AND floor(done[j + 1] * d / ws[j + 1]) <= t + 1]) % k AS p
    FROM slots WHERE t + 1 < d)),
schedule AS (SELECT picked AS i, list(t ORDER BY t) AS starts FROM slots WHERE t >= 0 GROUP BY picked),
ranked AS (SELECT *, row_number() OVER (PARTITION BY mix_source ORDER BY h, doc_id, tie) - 1 AS r FROM rows_),
placed AS (SELECT r.doc_id, r.mix_source, r.r, n.w, n.d, n.blocks, s.starts, unnest(range(0, (n.periods * n.w - 1 - r.r // 16) // n.blocks + 1)) AS epoch
  FROM ranked r JOIN numbered n USING (mix_source) JOIN schedule s ON s.i = n.i)
SELECT doc_id, mix_source, epoch, epoch * blocks + r // 16 AS block,
  ((epoch * blocks + r // 16) // w) * d + starts[(epoch * blocks + r // 16) % w + 1] AS position, r % 16 AS place
FROM placed
"""
