"""Quality by perplexity under an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

Counts of the highest order and continuation counts of the lower orders are Spark tables, sharded by n-gram; joins with
the totals of their contexts give each n-gram its discounted share and each context the weight of the next lower order.
The model covers all trusted text and stays in these tables: no process holds it. Documents are cut into packs of bounded
size; the distinct n-grams of all packs get their probabilities by joins, order by order, and each pack meets those of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialize
from .wordhash import blocks, mix

ORDER = 5
POINT = 21  # bits of a code point
START = 1
HELD_GRAMS = 1 << 20  # distinct grams that a task counts before it hands them to Spark
PACK_BYTES = 16 << 20  # text of a pack
BUCKET_BITS, GROUP_GRAMS = 12, 1 << 18  # buckets of a pack's grams, by key; grams of all packs in a group of buckets
BROADCAST_IDS = 4_000_000  # more ids than that are joined by a shuffle
QUANTILE = 0.99


def symbols(text: str) -> np.ndarray:
    """The code points as they are; 0 and 1, which mark places, count as 2."""
    return np.maximum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), 2)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ORDER-gram that ends at each character of each text, START before the first, as two numbers: its first two and its last
    three code points; and the characters of each text."""
    parts, sizes = [], []
    for t in texts:
        own = symbols(t)
        parts += [np.full(ORDER - 1, START, np.int64), own]
        sizes.append(len(own))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole, sizes = np.concatenate(parts), np.array(sizes, np.int64)
    first = np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1)
    at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    a, b, c, d, e = (whole[at + j] for j in range(ORDER))
    return a << POINT | b, (c << POINT | d) << POINT | e, sizes


def key(head: np.ndarray, tail: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the last k code points of each gram."""
    tail = tail & ((1 << POINT * min(k, 3)) - 1)
    head = head & ((1 << POINT * max(0, k - 3)) - 1)
    return mix(mix(head.astype(np.uint64) + np.uint64(k)) ^ tail.astype(np.uint64)).view(np.int64)


def shifted(head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram without its last code point: the context."""
    return head >> POINT, (head & ((1 << POINT) - 1)) << 2 * POINT | tail >> POINT


class Grams(NamedTuple):
    """Distinct grams of the highest order: key, gram, how often it occurs."""

    key: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    n: np.ndarray


def distinct(head: np.ndarray, tail: np.ndarray) -> tuple[Grams, np.ndarray]:
    """The distinct ones among grams, and the index of each gram among them."""
    found = pa.array(key(head, tail, ORDER)).dictionary_encode()
    codes = found.indices.to_numpy()
    at = np.empty(len(found.dictionary), np.int64)
    at[codes] = np.arange(len(codes))
    return Grams(found.dictionary.to_numpy(), head[at], tail[at], np.bincount(codes, minlength=len(at))), codes


def merged(parts: list[Grams]) -> Grams:
    if len(parts) == 1:
        return parts[0]
    found = pa.array(np.concatenate([p.key for p in parts] or [np.zeros(0, np.int64)])).dictionary_encode()
    codes = found.indices.to_numpy()
    at = np.empty(len(found.dictionary), np.int64)
    at[codes] = np.arange(len(codes))
    head, tail, n = (np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in (1, 2, 3))
    return Grams(found.dictionary.to_numpy(), head[at], tail[at], np.bincount(codes, n, len(at)).astype(np.int64))


def gram_counts(docs: DataFrame) -> DataFrame:
    """head, tail, n over all texts, counted in each task as far as it may hold them and then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[Grams] = []
        for batch in batches:
            for a, b, _, _ in blocks(batch.column(0)):
                parts.append(distinct(*grams([t or "" for t in batch.column(0).slice(a, b - a).to_pylist()])[:2])[0])
                if sum(len(p.key) for p in parts) > HELD_GRAMS:
                    parts = [merged(parts)]
                    if len(parts[0].key) > HELD_GRAMS // 2:
                        yield pa.record_batch([pa.array(x) for x in parts.pop()[1:]], ["head", "tail", "n"])
        if parts:
            yield pa.record_batch([pa.array(x) for x in merged(parts)[1:]], ["head", "tail", "n"])

    return docs.select("text").mapInArrow(run, "head long, tail long, n long").groupBy("head", "tail").agg(F.sum("n").alias("n"))


class KneserNey:
    """A model of little text in one process. Sorted arrays of each order: n-grams with their discounted share, contexts with the weight of the lower order."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], symbols_seen: int):
        self.orders, self.floor = orders, 1 / (symbols_seen + 1)

    def probability(self, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        p = np.full(len(head), self.floor)
        before = shifted(head, tail)
        for k, (own, share, contexts, weight) in enumerate(self.orders, 1):
            context = key(*before, k - 1)
            p = np.where(_found(contexts, context), _look(contexts, weight, context), 1.0) * p + _look(own, share, key(head, tail, k))
        return p

    def log_probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Natural log-probability and characters of each text."""
        head, tail, sizes = grams(texts)
        if not len(head):
            return np.zeros(len(texts)), sizes
        _, one, place = np.unique(key(head, tail, ORDER), return_index=True, return_inverse=True)
        sums = np.concatenate([[0.0], np.cumsum(np.log(self.probability(head[one], tail[one]))[place])])
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes], sizes


def _found(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, codes), len(keys) - 1)] == codes if len(keys) else np.zeros(len(codes), bool)


def _look(keys: np.ndarray, values: np.ndarray, codes: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(codes))
    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    return np.where(keys[at] == codes, values[at], 0.0)


def _last(k: int) -> list[F.Column]:
    """head and tail of the last k code points of a gram."""
    return [F.col(c).bitwiseAND(F.lit((1 << POINT * n) - 1)).alias(c) for c, n in (("head", max(0, k - 3)), ("tail", min(k, 3)))]


def _context() -> list[F.Column]:
    """The gram without its last code point, as x and y."""
    return [F.shiftright("head", POINT).alias("x"), F.shiftleft(F.col("head").bitwiseAND(F.lit((1 << POINT) - 1)), 2 * POINT).bitwiseOR(F.shiftright("tail", POINT)).alias("y")]


class Model(NamedTuple):
    """Of each order the table of n-grams (head, tail, share) and that of contexts (x, y, weight); the probability below the first order; tables to forget."""

    orders: list[tuple[DataFrame, DataFrame]]
    floor: float
    written: list[DataFrame]


def model_tables(trusted: DataFrame) -> Model:
    """The model of all texts of `trusted`."""
    tables = [materialize(gram_counts(trusted), "grams")]
    for k in range(ORDER - 1, 0, -1):
        tables.insert(0, materialize(tables[0].groupBy(*_last(k)).agg(F.count(F.lit(1)).alias("n")), "grams"))
    orders, written = [], list(tables)
    for counts in tables:
        rare = {r.n: r.m for r in counts.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()}
        n1, n2, n3, n4 = (max(1, rare.get(i, 0)) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d1, d2, d3 = (min(max(x, 0.05), i - 0.05) for i, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        rows = counts.select("head", "tail", "n", *_context(), discount.alias("d"))
        contexts = materialize(rows.groupBy("x", "y").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("weight")), "contexts")
        shares = rows.join(contexts.select("x", "y", "total"), ["x", "y"]).select("head", "tail", ((F.col("n") - F.col("d")) / F.col("total")).alias("share"))
        orders.append((shares, contexts.select("x", "y", "weight")))
        written.append(contexts)
    return Model(orders, 1 / (tables[0].count() + 1), written)


def fit(trusted: DataFrame) -> KneserNey:
    """The model of the texts of `trusted` in this process, for texts that are few; `score` takes the tables of `model_tables`."""
    model = model_tables(trusted)
    orders = [(*_sorted(shares.toArrow(), k), *_sorted(contexts.toArrow(), k - 1)) for k, (shares, contexts) in enumerate(model.orders, 1)]
    forget(*model.written)
    return KneserNey(orders, len(orders[0][0]))


def _sorted(rows: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    keys = key(rows.column(0).to_numpy(), rows.column(1).to_numpy(), k)
    order = np.argsort(keys)
    return keys[order], rows.column(2).to_numpy()[order]


def packs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Whole rows in packs of `limit` bytes of text at most (or one row), numbered by the task's partition: the same rows give the same packs."""
    number, held, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        for a, b, data, _ in blocks(batch.column(2), limit):
            if held and size + len(data) > limit:
                yield number, held
                number, held, size = number + 1, [], 0
            held.append(batch.slice(a, b - a))
            size += len(data)
    if held:
        yield number, held


def _texts(pack: list[pa.RecordBatch]) -> Iterator[list[str]]:
    for batch in pack:
        for a, b, _, _ in blocks(batch.column(2)):
            yield [t or "" for t in batch.column(2).slice(a, b - a).to_pylist()]


def _binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Rows of 8-byte values that begin at `starts`."""
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((np.append(starts, len(values)) * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _values(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """All values of rows of 8-byte values."""
    return np.concatenate([np.zeros(0, dtype), *(np.frombuffer(x.as_buffer(), dtype) for x in column)])


def pack_grams(rows: DataFrame, limit: int) -> DataFrame:
    """pack, bucket, n, heads, tails: the distinct grams of each pack, in the order of their unsigned keys; the first bits of a key are its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, pack in packs(batches, limit):
            own = merged([distinct(*grams(texts)[:2])[0] for texts in _texts(pack)])
            order = np.argsort(own.key.view(np.uint64))
            bucket = (own.key.view(np.uint64)[order] >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            n = np.diff(np.append(starts, len(bucket)))
            yield pa.record_batch([pa.array(np.full(len(starts), number, np.int64)), pa.array(bucket[starts]), pa.array(n.astype(np.int64)), _binary(own.head[order], starts), _binary(own.tail[order], starts)], ["pack", "bucket", "n", "heads", "tails"])

    return rows.mapInArrow(run, "pack long, bucket int, n long, heads binary, tails binary")


def distinct_grams(packed: DataFrame) -> DataFrame:
    """group, head, tail: each gram of all packs once."""

    def run(rows: pa.Table) -> pa.Table:
        own, _ = distinct(_values(rows["heads"], np.int64), _values(rows["tails"], np.int64))
        return pa.table({"group": pa.array(np.full(len(own.key), rows["group"][0].as_py(), np.int32)), "head": own.head, "tail": own.tail})

    return packed.select("group", "heads", "tails").groupBy("group").applyInArrow(run, "group int, head long, tail long")


def probabilities(seen: DataFrame, model: Model) -> DataFrame:
    """head, tail, p of the distinct grams of `seen`, by joins with the model from the lowest order up."""
    tables = [seen.select("head", "tail")]
    for k in range(ORDER - 1, 0, -1):
        tables.insert(0, materialize(tables[0].select(*_last(k)).distinct(), "seen"))
    written: list[DataFrame] = tables[:-1]
    lower = None
    for k, (own, (shares, contexts)) in enumerate(zip(tables, model.orders, strict=True), 1):
        rows = own.select("head", "tail", *_context()).join(shares, ["head", "tail"], "left").join(contexts, ["x", "y"], "left")
        if lower is None:
            rows = rows.withColumn("below", F.lit(model.floor))
        else:
            rows = rows.withColumns({f"last_{c}": e for c, e in zip(("head", "tail"), _last(k - 1), strict=True)})
            rows = rows.join(lower.select(F.col("head").alias("last_head"), F.col("tail").alias("last_tail"), F.col("p").alias("below")), ["last_head", "last_tail"])
        lower = materialize(rows.select("head", "tail", (F.coalesce("share", F.lit(0.0)) + F.coalesce("weight", F.lit(1.0)) * F.col("below")).alias("p")), "probabilities")
        written.append(lower)
    forget(*written[:-1])
    return lower


def pack_logs(packed: DataFrame, known: DataFrame) -> DataFrame:
    """pack, bucket, keys (their sum), logs: the log-probabilities of a pack's grams in the order of `pack_grams`. known: group, head, tail, p."""

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        keys = key(_values(rows["heads"], np.int64), _values(rows["tails"], np.int64), ORDER)
        own = key(known["head"].to_numpy(), known["tail"].to_numpy(), ORDER)
        order = np.argsort(own)
        logs = np.log(known["p"].to_numpy())[order][np.searchsorted(own[order], keys)]
        n = rows["n"].to_numpy()
        starts = np.cumsum(n) - n
        return pa.table({"pack": rows["pack"], "bucket": rows["bucket"], "keys": np.add.reduceat(keys, starts), "logs": _binary(logs, starts)})

    return packed.groupBy("group").cogroup(known.groupBy("group")).applyInArrow(run, "pack long, bucket int, keys long, logs binary")


def score(docs: DataFrame, model: Model, limit: int = PACK_BYTES, group_grams: int = GROUP_GRAMS) -> DataFrame:
    """doc_id, lang, n_symbols, logprob of every row's whole text.

    `docs` is read twice and must give the same rows in the same partitions, as files do; where it doesn't, the job fails.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    packed = materialize(pack_grams(rows, limit), "packs")
    groups = min(1 << BUCKET_BITS, 1 + (packed.agg(F.sum("n").alias("n")).first()["n"] or 0) // group_grams)
    packed_by = packed.withColumn("group", F.col("bucket") % groups)
    seen = materialize(distinct_grams(packed_by), "seen")
    p = probabilities(seen, model)
    logs = materialize(pack_logs(packed_by, seen.join(p, ["head", "tail"]).select("group", "head", "tail", "p")), "logs")
    forget(packed, seen, p)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in packs(batches, limit):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                for batch in held:
                    out.write_batch(batch)
            yield pa.record_batch([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["pack", "rows"])

    def run(own: pa.Table, logs: pa.Table) -> pa.Table:
        if len(own) != 1:
            raise ValueError("the documents weren't the same when they were read again")
        held = list(pa.ipc.open_stream(own["rows"][0].as_buffer()))
        parts = [(*distinct(*(found := grams(texts))[:2]), found[2]) for texts in _texts(held)]
        keys = np.sort(merged([found for found, _, _ in parts]).key.view(np.uint64))
        values = _values(logs.sort_by("bucket")["logs"], np.float64)
        if len(keys) != len(values) or keys.view(np.int64).sum() != logs["keys"].to_numpy().sum():
            raise ValueError("the documents weren't the same when they were read again")
        sums, sizes = [], []
        for found, codes, n in parts:
            each = values[np.searchsorted(keys, found.key.view(np.uint64))][codes]
            full = n > 0
            of = np.zeros(len(n))
            if full.any():
                of[full] = np.add.reduceat(each, (np.cumsum(n) - n)[full])
            sums.append(of)
            sizes.append(n)
        ids = pa.Table.from_batches(held)
        return pa.table({"doc_id": ids["doc_id"], "lang": ids["lang"], "n_symbols": np.concatenate(sizes), "logprob": np.concatenate(sums)})

    moved = rows.mapInArrow(pack, "pack long, rows binary")
    scored = moved.groupBy("pack").cogroup(logs.groupBy("pack")).applyInArrow(run, "doc_id long, lang string, n_symbols long, logprob double")
    scored = materialize(scored, "scores")
    forget(logs)
    return scored


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The distinct doc_id that are labelled quality 1 and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()


def fitted_ids(trusted: DataFrame, docs: DataFrame, bound: int | None = None, most_bytes: int | None = None) -> DataFrame:
    """Four fifths of all trusted ids, by a hash of doc_id; the last fifth is kept for the thresholds.

    With `bound` only so many ids are drawn, by another hash, and with `most_bytes` as far as their texts have so many in all.
    """
    drawn, place = trusted, (F.xxhash64(F.lit("trusted"), "doc_id"), F.col("doc_id"))
    if bound is not None:
        drawn = drawn.orderBy(*place).limit(bound)
    if most_bytes is not None:
        sizes = docs.select("doc_id", F.octet_length("text").alias("size")).join(drawn, "doc_id").groupBy("doc_id").agg(F.sum("size").alias("size"))
        before = F.sum("size").over(Window.orderBy(*place))
        drawn = sizes.withColumn("before", before).where(F.coalesce("before", F.lit(0)) <= most_bytes)
    return drawn.where(F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(5)) > 0).select("doc_id")


def quality(docs: DataFrame, labels: DataFrame, bound: int | None = None, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_symbols, logprob, perplexity, threshold, kept for every row of docs.

    The model is fitted on four fifths of all trusted documents (of `bound` at most, where that is given); the thresholds come from all
    trusted documents that it wasn't fitted on. perplexity is per character. A language's threshold is the `quantile` of these; a language
    without any (null too) takes the quantile of all of them; where there are none the threshold is null. kept is true where perplexity is
    at most the threshold, and where there is none; null and empty texts have perplexity null and aren't kept. Repeated rows stay; an
    empty table gives no rows.
    """
    trusted = materialize(trusted_ids(labels), "trusted")
    fitted = materialize(fitted_ids(trusted, docs, bound), "fitted")
    few = F.broadcast(fitted) if fitted.count() <= BROADCAST_IDS else fitted.hint("merge")
    model = model_tables(docs.select("doc_id", "text").join(few, "doc_id", "left_semi"))
    perplexity = F.when(F.col("n_symbols") > 0, F.exp(-F.col("logprob") / F.col("n_symbols")))
    scored = score(docs, model).withColumn("perplexity", perplexity)
    forget(*model.written)
    rest = trusted.join(fitted.hint("merge"), "doc_id", "left_anti").hint("merge")  # grows with the labels: never broadcast
    known = materialize(scored.join(rest, "doc_id", "left_semi").where("perplexity is not null").select("lang", "perplexity"), "trusted-scores")
    limit = F.percentile_approx("perplexity", quantile, 10_000).alias("limit")
    every = known.agg(limit).first()["limit"]
    limits = known.where("lang is not null").groupBy("lang").agg(limit)
    out = scored.join(limits, "lang", "left").withColumn("threshold", F.coalesce("limit", F.lit(every).cast("double")))
    kept = (F.col("n_symbols") > 0) & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return out.select("doc_id", "lang", "n_symbols", "logprob", "perplexity", "threshold", kept.alias("kept"))
