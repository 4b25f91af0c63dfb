"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import bucket_bits, bucket_ranks


def stratified_shards(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """All columns and rows of docs, then shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    Rows are put in a seeded random order within their source; a row's fractional rank is (place + 0.5) / rows of its
    source. All rows, sorted by fractional rank, are cut into runs whose lengths differ by one at most, so each shard
    has every source in proportion. Ties go by source, then by the seeded order, then by doc_id. A null source is a source
    of its own; null doc_ids and repeated rows are rows like others; with fewer rows than shards some shards are empty.
    Columns of docs named shard or slot are replaced.
    """
    docs = docs.drop("shard", "slot")
    kept = docs.columns
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = docs.withColumn("_h", key)
    ties = [F.col(c) for c in ("text_crc32", "size") if c in kept]
    bits = bucket_bits(docs)
    part = F.shiftrightunsigned("_h", 64 - bits).cast("int")
    rows = rows.withColumn("_order", F.col("_h").bitwiseXOR(F.lit(-(1 << 63)))).withColumn("_s", F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source")))
    rows = bucket_ranks(rows, ["_s"], part, [F.col("_order"), F.col("doc_id"), *ties], "_r", "_n")
    rows = rows.withColumn("_f", (F.col("_r") + 0.5) / F.col("_n"))
    rows = bucket_ranks(rows, [], F.floor(F.col("_f") * (1 << bits)).cast("int"), [F.col("_f"), F.col("_s"), F.col("_order"), F.col("doc_id"), *ties], "_p", "_all")
    shard = F.expr(f"(_p * {shards}L) div _all")
    rows = rows.withColumn("shard", shard.cast("int"))
    slot = F.expr(f"_p - (shard * _all + {shards - 1}L) div {shards}L")
    return rows.withColumn("slot", slot.cast("long")).select(*kept, "shard", "slot")
