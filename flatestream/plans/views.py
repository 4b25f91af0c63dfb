"""Compressed views of the given tables: the library reads archives, so the queries first make some."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.batches import arrow_schema, packed

MEMBER_BYTES = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a new temporary one on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or "file://" + tempfile.mkdtemp(prefix="shared-")).rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: what is read more than once is computed once, and a lost executor costs a read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gzip_member(data: bytes, level: int = 6, memory: int = 8) -> bytes:
    """One member; the less memory (1 to 9), the shorter its blocks."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15, memory)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def document_archives(docs: DataFrame, member_bytes: int = MEMBER_BYTES, level: int = 6, memory: int = 8) -> DataFrame:
    """file_id (doc_id), source, content: the text's bytes as gzip members of `member_bytes` each, one for an empty text."""

    form = "file_id string, source string, content binary"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for file_id, source, text in zip(*batch.columns, strict=True):
                raw = (text.as_py() or "").encode()
                yield file_id.as_py(), source.as_py(), b"".join(gzip_member(raw[i : i + member_bytes], level, memory) for i in range(0, max(1, len(raw)), member_bytes))

    arrow = arrow_schema(form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(rows(batches), arrow)

    return docs.select(F.col("doc_id").cast("string").alias("file_id"), "source", "text").mapInArrow(run, form)


def damaged(files: DataFrame) -> DataFrame:
    """Every fifth of the files whole, others with a wrong CRC, a wrong size, cut short, or with bytes appended, by the number in file_id."""
    n = F.octet_length("content")
    kind = F.pmod(F.col("file_id").cast("long"), F.lit(5))
    piece = lambda a, b: F.substring("content", a, b)
    flip = lambda at: F.unhex(F.when(F.hex(piece(at, F.lit(1))) == "00", F.lit("01")).otherwise(F.lit("00")))
    whole = F.when(kind == 1, F.concat(piece(F.lit(1), n - 8), flip(n - 7), piece(n - 6, F.lit(7)))).when(kind == 2, F.concat(piece(F.lit(1), n - 4), flip(n - 3), piece(n - 2, F.lit(3))))
    whole = whole.when(kind == 3, piece(F.lit(1), n - 3)).when(kind == 4, F.concat("content", F.lit(b"junk"))).otherwise(F.col("content"))
    return files.withColumn("content", whole)


def bench_rows(events: DataFrame) -> DataFrame:
    """Attempts in the raw benchmark schema: an event is a run, its type the corpus, its user the repetition."""
    failed = F.pmod(F.col("event_id"), F.lit(11)) == 0
    ok = lambda c: F.when(~failed, c)
    tool = F.when(F.pmod(F.col("event_id"), F.lit(2)) == 0, "main").otherwise("candidate")
    return events.select(
        F.col("event_type").alias("corpus"), F.lit("decode").alias("mode"), tool.alias("tool"), F.lit("zlib").alias("backend"), F.pmod(F.col("user_id"), F.lit(4)).cast("int").alias("threads"), F.col("event_id").cast("int").alias("repetition"),
        ok(F.col("value")).alias("wall_seconds"), ok(F.col("value") * 2).alias("user_seconds"), ok(F.col("value") / 4).alias("system_seconds"), ok(F.col("user_id").cast("double")).alias("max_rss_kib"), ok(F.col("value") + 1).alias("decoded_mib_per_second"),
        ok(F.lit(1000)).cast("long").alias("decoded_bytes"), F.when(failed, 1).otherwise(0).alias("exit_status"), F.when(failed, "failed").otherwise("success").alias("status"),
    )
