"""Media columns: content-defined chunks in a deduplicated store, and media rebuilt from ordered chunk lists.

A payload (a text's UTF-8 bytes, padded with 0 to a positive multiple of 64) becomes a mono WAV file of 8-bit samples.
Cuts follow a rolling gear hash, so equal passages give equal chunks wherever they stand. Spark joins keep one copy of
every chunk digest. To read, the ordered chunk list of each distinct medium meets the store, the chunks come together in
order and the rebuilt file is held against its own digest.
"""

from __future__ import annotations

import bz2
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, shared_dir, shuffles_dropped

UNIT = 64
RATE = 8000
LEAST, MEAN_BITS, MOST = 1024, 12, 16384
GEAR = np.random.default_rng(64).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)
#: A digest with more references than this is joined by (digest, salt), its chunk once for each salt, with a salt for each so many references.
HOT_REFERENCES = 256


def digest_of(data: bytes) -> bytes:
    """128 bits of SHA-256: the name of a chunk or a medium inside the store."""
    return hashlib.sha256(data).digest()[:16]


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(UNIT if not raw else -len(raw) % UNIT)


def wav(payload: bytes) -> bytes:
    """A RIFF file of unsigned 8-bit samples, one channel."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples(medium: bytes) -> bytes:
    """The payload of wav(); raises ValueError where the file isn't whole."""
    if len(medium) < 44 or medium[:4] != b"RIFF" or medium[36:40] != b"data" or struct.unpack_from("<I", medium, 40)[0] != len(medium) - 44:
        raise ValueError("not a whole WAV file of 8-bit samples")
    return medium[44:]


def cuts(medium: bytes) -> list[int]:
    """Ends of the chunks. The hash of a place sums GEAR of the last 32 bytes, each shifted by its distance."""
    h = GEAR[np.frombuffer(medium, np.uint8)]
    step = 1
    while step < 32 and step < len(h):
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h, step = more, 2 * step
    ends, at = [], 0
    for end in [*(np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1).tolist(), len(medium)]:
        while end - at > MOST:
            at += MOST
            ends.append(at)
        if end - at >= LEAST or end == len(medium) and end > at:
            ends.append(end)
            at = end
    return ends


def chunks(medium: bytes) -> list[bytes]:
    ends = cuts(medium)
    return [medium[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def feature(payload: bytes) -> str:
    """Mean, root mean square and share of crossings of the middle of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int((np.signbit(x[1:].astype(float)) != np.signbit(x[:-1].astype(float))).sum())
    return f"mean={int(x.sum()) / len(x):.4f};rms={(int((x * x).sum()) / len(x)) ** 0.5:.4f};crossings={crossings / len(x):.4f}"


def manifests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the medium's digest `sha` and the ordered chunk digests of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, shas, digests = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                medium = wav(payload_of(text))
                sizes.append(len((text or "").encode("utf-8", "surrogatepass")))
                shas.append(digest_of(medium))
                digests.append([digest_of(c) for c in chunks(medium)])
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(shas, pa.binary()), pa.array(digests, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "sha", "digests"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, sha binary, digests array<binary>")


def chunk_rows(docs: DataFrame) -> DataFrame:
    """digest and compressed bytes of every chunk, once for each block of rows in a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, bytes] = {}
        held = 0
        out = lambda: pa.record_batch([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["digest", "z"])
        for batch in batches:
            for text in batch.column(0):
                for chunk in chunks(wav(payload_of(text.as_py()))):
                    digest = digest_of(chunk)
                    if digest not in found:
                        found[digest] = bz2.compress(chunk)
                        held += len(found[digest])
                if held > 4 << 20:
                    yield out()
                    found.clear()
                    held = 0
        if found:
            yield out()

    return docs.select("text").mapInArrow(run, "digest binary, z binary")


def write_store(docs: DataFrame) -> tuple[DataFrame, str]:
    """The store: one row for each distinct digest, as a table in buckets of the digest, and the table's name."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"chunks_{uuid.uuid4().hex}"
    rows = chunk_rows(docs).repartition(n, "digest").dropDuplicates(["digest"])
    with shuffles_dropped(spark):
        rows.write.format("parquet").option("path", f"{shared_dir(spark)}/{name}").option("compression", "none").bucketBy(n, "digest").sortBy("digest").saveAsTable(name)
    return spark.table(name), name


def read_media(lists: DataFrame, store: DataFrame) -> DataFrame:
    """Rebuild the media of lists (sha, digests) and describe what was read.

    sha, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. Raises where a rebuilt medium doesn't have its digest.
    """
    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["sha", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

        def one(sha: bytes, parts: list[bytes]) -> tuple:
            medium = b"".join(parts)
            if digest_of(medium) != sha:
                raise ValueError(f"the chunks of {sha.hex()} don't give its medium")
            payload = samples(medium)
            return sha, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(medium), hashlib.sha256(medium).hexdigest(), feature(payload)

        types = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        current, parts, rows = None, [], []
        for batch in batches:
            for sha, data in zip(batch.column("sha"), batch.column("z"), strict=True):
                sha = sha.as_py()
                if sha != current:
                    if current is not None:
                        rows.append(one(current, parts))
                    current, parts = sha, []
                parts.append(bz2.decompress(data.as_py()))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows = []
        if current is not None:
            yield pa.record_batch([pa.array([c], t) for c, t in zip(one(current, parts), types, strict=True)], names)

    refs = lists.select("sha", F.posexplode("digests").alias("at", "digest"))
    salts = F.expr(f"(n + {HOT_REFERENCES - 1}) div {HOT_REFERENCES}").alias("salts")
    hot = materialize(refs.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_REFERENCES).select("digest", salts), "hot-digests")
    cold = refs.join(hot, "digest", "left_anti").join(store, "digest").select("sha", "at", "z")
    salted = refs.join(hot, "digest").withColumn("salt", F.pmod(F.xxhash64("sha", "at"), "salts"))
    copies = store.join(hot, "digest").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    found = cold.unionAll(salted.join(copies, ["digest", "salt"]).select("sha", "at", "z"))
    found = found.repartition("sha").sortWithinPartitions("sha", "at")
    return found.select("sha", "z").mapInArrow(rebuild, "sha binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every row.

    A null text is empty: a payload of 64 zero bytes. Rows with equal texts share one medium and have equal values; repeated rows and
    null doc_ids stay. An empty table gives no rows. Other columns are ignored.
    """
    listed = materialize(manifests(docs), "manifests")
    store, name = write_store(docs)
    try:
        lists = listed.groupBy("sha").agg(F.first("digests").alias("digests"))
        described = materialize(read_media(lists, store), "media")
        forget(store)
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    return listed.select("doc_id", "n_bytes", "sha").join(described, "sha").drop("sha")
