"""The tables of a benchmark run: raw attempts, corpus manifest, summary; and generated corpora."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.columns import markdown_cell, metric_text
from ..operators.statistics import GROUP, METRICS

FORMATS = ["gzip", "zlib", "raw-deflate"]


def _read(spark: SparkSession, path: str, layout: str) -> DataFrame:
    return spark.read.csv(path, schema=layout, sep="\t", header=True, enforceSchema=False, mode="FAILFAST", quote="")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw attempts; a header or a cell that doesn't fit raises. statistics.bench_violations has the rules between cells."""
    return _read(spark, path, schema.BENCH_RAW)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    rows = _read(spark, path, schema.MANIFEST)
    form = F.when(F.col("format").isin(FORMATS), F.col("format")).otherwise(F.raise_error(F.concat(F.lit("unknown format "), "format")).cast("string"))
    return rows.withColumn("format", form)


def write_summary(summary: DataFrame, path: str, provenance: DataFrame | None = None) -> None:
    """One TSV in the order of its keys, metrics with six decimals or empty; provenance (key, value) goes beside it."""
    cells = [F.col(k) for k in GROUP] + [F.col(k) for k in ("attempts", "successes", "failures")] + [metric_text(F.col(f"median_{m}")).alias(f"median_{m}") for m in METRICS]
    summary.orderBy(*GROUP).select(*cells).coalesce(1).write.csv(f"{path}/summary", sep="\t", header=True, emptyValue="", quote="")
    if provenance is not None:
        provenance.orderBy("key").coalesce(1).write.csv(f"{path}/provenance", sep="\t", header=True, emptyValue="", quote="")


def markdown(table: DataFrame, order: list[str]) -> DataFrame:
    """ord, line of a Markdown table of a small result."""
    head = table.sparkSession.createDataFrame([(-2, "| " + " | ".join(table.columns) + " |"), (-1, "|" + " --- |" * len(table.columns))], "ord long, line string")
    cells = [F.coalesce(markdown_cell(F.col(c).cast("string")), F.lit("")) for c in table.columns]
    from pyspark.sql import Window

    body = table.select((F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("ord"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    return head.unionByName(body)


def fastq_like(spark: SparkSession, records: int, bases: int = 50, seed: int = 1) -> DataFrame:
    """line_no, line of a sequence file: four lines for each record, bases from a hash."""
    rows = spark.range(records)
    base = F.transform(F.sequence(F.lit(1), F.lit(bases)), lambda i: F.substring(F.lit("ACGT"), (F.pmod(F.xxhash64(F.lit(seed), "id", i), F.lit(4)) + 1).cast("int"), F.lit(1)))
    lines = F.array(F.concat(F.lit("@read-"), F.col("id").cast("string")), F.array_join(base, ""), F.lit("+"), F.lit("I" * bases))
    return rows.select("id", F.posexplode(lines).alias("at", "line")).select((F.col("id") * 4 + F.col("at")).alias("line_no"), "line")


def pseudo_random(spark: SparkSession, size: int, seed: int = 1, piece: int = 1 << 20) -> DataFrame:
    """piece, bytes: `size` bytes that don't compress; a piece depends on the seed and its number alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                data = np.random.Generator(np.random.Philox(key=[seed, i])).bytes(min(piece, size - i * piece))
                yield pa.record_batch([pa.array([i], pa.int64()), pa.array([data], pa.binary())], ["piece", "bytes"])

    return spark.range(-(-size // piece)).mapInArrow(run, "piece long, bytes binary")


def fastq_records(lines: DataFrame) -> DataFrame:
    """file_id, records, bases from a line table; raises where a record doesn't have its four lines in form."""
    rows = lines.withColumn("record", F.floor(F.col("line") / 4)).withColumn("at", F.col("line") % 4).withColumn("text", F.decode("text", "UTF-8"))
    one = rows.groupBy("file_id", "record").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col("at") == i, F.col("text"))).alias(f"l{i}") for i in range(4)])
    good = (F.col("n") == 4) & F.startswith("l0", F.lit("@")) & F.startswith("l2", F.lit("+")) & (F.length("l1") == F.length("l3"))
    size = F.when(F.coalesce(good, F.lit(False)), F.length("l1")).otherwise(F.raise_error(F.lit("not a sequence record")).cast("int"))
    return one.groupBy("file_id").agg(F.count(F.lit(1)).alias("records"), F.sum(size).alias("bases"))
