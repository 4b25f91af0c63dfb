"""The queries opN_<name>, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_extraction, language_id, line_dedup, masked_lm, media, mixing, quality_lm, sharding
from .common import materialize, table
from .near_dedup import Forest, near_duplicates


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Forest(k=4))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.masked_scores(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.pfair_mix(docs).select("doc_id", "mix_source", "epoch", "block", "position", "place")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8_line_dedup leaves, without its repeated runs of 50 words."""
    docs = materialize(line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")), "without-lines")
    return line_dedup.dedup_passages(docs)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.stratified_shards(rows).withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_media": op2_media,
    "op3_quality": op3_quality,
    "op4_masked_lm": op4_masked_lm,
    "op5_html_extraction": op5_html_extraction,
    "op6_mixing": op6_mixing,
    "op7_decontamination": op7_decontamination,
    "op8_line_dedup": op8_line_dedup,
    "op8_passage_dedup": op8_passage_dedup,
    "op9_language_id": op9_language_id,
    "op10_sharding": op10_sharding,
}
ORACLES: dict[str, str] = {
    "op6_mixing": mixing.SQL,
    "op7_decontamination": decontamination.sql(),
    "op8_line_dedup": line_dedup.SQL,
}
