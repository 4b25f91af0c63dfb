"""A training corpus from `documents`, in five stages of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flatestream.llm import decontamination, language_id, mixing, sharding
from flatestream.llm.common import forget, materialize, table
from flatestream.llm.near_dedup import Forest, near_duplicates


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language could be told.

    Those without any letter go, null and empty texts among them, and all of them where no row has a language to learn from. Null
    doc_ids and repeated rows stay; of an empty table nothing is left. Columns named lang_pred or score pass through as they are.
    """
    profiles = language_id.fit(docs.where(~language_id.held_out()))
    own = [F.col(c).alias(f"_{c}") for c in docs.columns]
    found = language_id.predict(docs.select(*own, "text"), profiles).where("lang_pred <> 'und'")
    return found.select(*[F.col(f"_{c}").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near-duplicates, on five-word shingles.

    Rows of a doc_id stay or go together; null doc_ids and texts without words stay, as they are linked with nothing.
    """
    dropped = materialize(near_duplicates(docs, Forest(k=5)).where(~F.col("kept")).select("doc_id").distinct(), "dropped")
    return docs.join(dropped.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text contains no benchmark item; null and empty texts contain none. Without items all rows stay."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row at least once, and again as its source's target weight demands; a null source is one of the others.

    A stage returns the columns of documents alone, so what is left of the schedule is how often each row occurs.
    """
    keys = [c for c in ("doc_id", "source", "text") if c in docs.columns]
    other = [c for c in docs.columns if c not in keys]
    mixed = mixing.pfair_mix(docs.select(*keys, F.struct(*other).alias("_rest")) if other else docs)
    return mixed.select(*[F.col(f"_rest.`{c}`").alias(c) if c in other else F.col(c) for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with shard and slot. Rows of fewer than the shards leave some of these empty."""
    return sharding.stratified_shards(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL can't express the rank-order profiles of the first stage; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each on a table of what its predecessor kept; that table is deleted once its successor is written."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        kept = materialize(stage(spark, docs, sf_dir), name)
        if i:
            forget(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
