"""Masked pseudo-likelihood of documents under a small bidirectional window network, trained in numpy inside Spark tasks.

Tokens are words, and every word of the corpus has a probability of its own, in two factors. The network gives the word's
class from the words on both sides: the FREQUENT words have a class each, all others share HASHED classes. Within a shared
class a word has its share of the class's occurrences, from counts over all documents. A document's score is
the sum of the logarithms over its whole text. Vocabulary and counts grow with the corpus and stay in Spark: the HOT_WORDS
most frequent words go to the tasks, the others meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize
from .wordhash import blocks, words

FREQUENT, HASHED = 224, 32
CLASSES = FREQUENT + HASHED
HOT_WORDS = 1 << 17  # the bound of the counts that go to the tasks: 16 bytes each
SIDE, WIDTH, HIDDEN = 2, 12, 24
ROUNDS = 2  # each document is trained on in one of so many rounds of averaging
STEP, BATCH = 0.01, 1024
SHAPES = [(CLASSES + 1, WIDTH), (2 * SIDE * WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,)]


@dataclass
class Lexicon:
    """frequent: hashes of the words with own classes; hot, hot_n: sorted hashes and counts of the most frequent others;
    totals: occurrences in each shared class; rare: the table of the remaining words (word, n) that occur more than once."""

    frequent: np.ndarray
    hot: np.ndarray
    hot_n: np.ndarray
    totals: np.ndarray
    rare: DataFrame


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word (its hash), n over all texts, counted per block of rows and then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, b, data, offsets in blocks(batch.column(1), 8 << 20):
                hashes, first = words(data, offsets)
                parts: dict[str | None, list[np.ndarray]] = {}
                for i, lang in enumerate(langs[a:b]):
                    parts.setdefault(lang, []).append(hashes[first[i] : first[i + 1]])
                for lang, own in parts.items():
                    word, n = np.unique(np.concatenate(own).view(np.int64), return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(word), pa.string()), pa.array(word), pa.array(n)], ["lang", "word", "n"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    return docs.select(lang, "text").mapInArrow(run, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, hot_words: int = HOT_WORDS) -> Lexicon:
    """Own classes go to the words with the greatest count over the root of their language's words, so that each language has some.

    Ties go to the lower hash. The driver gets FREQUENT hashes, `hot_words` counts at most, and HASHED totals.
    """
    by_lang = materialize(word_counts(docs), "word-counts")
    sizes = by_lang.groupBy("lang").agg(F.sum("n").alias("size"))
    share = (F.max(F.col("n") / F.sqrt("size"))).alias("share")
    ranked = by_lang.join(sizes, by_lang.lang.eqNullSafe(sizes.lang)).groupBy("word").agg(share)
    frequent = np.array([r.word for r in ranked.orderBy(F.desc("share"), "word").limit(FREQUENT).collect()], np.int64)
    own = docs.sparkSession.createDataFrame([(int(w),) for w in frequent], "word long")
    counts = materialize(by_lang.groupBy("word").agg(F.sum("n").alias("n")).join(F.broadcast(own), "word", "left_anti"), "tail-counts")
    forget(by_lang)
    totals = np.zeros(HASHED, np.int64)
    for r in counts.groupBy(F.pmod(F.shiftrightunsigned("word", 40), F.lit(HASHED)).alias("c")).agg(F.sum("n").alias("n")).collect():
        totals[r.c] = r.n
    # The cut between hot and rare words lies at a step of the counts' logarithm, so no task sorts words.
    step = F.floor(F.log2("n") * 16)
    held, cut = 0, None
    for r in counts.where("n > 1").groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("s")).collect():
        held += r.k
        if held > hot_words:
            break
        cut = r.s
    counts = counts.where("n > 1")
    hot = counts.where(F.lit(False) if cut is None else step >= cut).toArrow().sort_by("word")
    rare = counts if cut is None else counts.where(step < cut)
    return Lexicon(frequent, hot["word"].to_numpy(), hot["n"].to_numpy(), totals, rare)


def _classes(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    order = np.argsort(frequent)
    own = hashes.view(np.int64)
    out = FREQUENT + (hashes >> np.uint64(40)).astype(np.int64) % HASHED
    if len(frequent):
        at = order[np.minimum(np.searchsorted(frequent, own, sorter=order), len(frequent) - 1)]
        out = np.where(frequent[at] == own, at, out)
    return out


def windows(classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Classes of the SIDE words on either side of each word; CLASSES beyond a document's ends."""
    n = np.arange(len(classes))
    low, high = np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first))
    out = np.empty((len(classes), 2 * SIDE), np.int64)
    for j, d in enumerate([d for d in range(-SIDE, SIDE + 1) if d]):
        at = n + d
        out[:, j] = np.where((at >= low) & (at < high), classes[np.clip(at, 0, max(0, len(classes) - 1))], CLASSES)
    return out


class Window:
    def __init__(self, flat: np.ndarray):
        self.parts, at = [], 0
        for shape in SHAPES:
            size = int(np.prod(shape))
            self.parts.append(flat[at : at + size].reshape(shape).astype(np.float32))
            at += size

    @staticmethod
    def start(seed: int = 3) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([(rng.normal(0, 0.3 if len(s) == 2 else 0, s) / (1 if i == 0 else np.sqrt(s[0]) * 0.6)).ravel() for i, s in enumerate(SHAPES)])

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts]).astype(np.float64)

    def _forward(self, around: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, hidden values with a 1 for the bias, and logits; these are moved to a maximum of 0 where exp could overflow."""
        e, w1, b1, w2, b2 = self.parts
        x = e[around].reshape(len(around), -1)
        h = np.ones((len(x), HIDDEN + 1), np.float32)
        np.tanh(x @ w1 + b1, out=h[:, :HIDDEN])
        z = np.matmul(h, np.vstack([w2, b2]), out=out[: len(x)])
        if (np.abs(w2).sum(0) + np.abs(b2)).max() > 60:
            z -= z.max(1, keepdims=True)
        return x, h, z

    def log_probability(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        out, room = np.empty(len(target)), np.empty((BATCH, CLASSES), np.float32)
        for i in range(0, len(target), BATCH):
            _, _, z = self._forward(around[i : i + BATCH], room)
            own = z[np.arange(len(z)), target[i : i + BATCH]]
            out[i : i + BATCH] = own - np.log(np.exp(z, out=z).sum(1))
        return out

    def train(self, around: np.ndarray, target: np.ndarray, moments: list) -> None:
        """One pass of Adam over the words, in the given order."""
        room = np.empty((BATCH, CLASSES), np.float32)
        for i in range(0, len(target), BATCH):
            near, want = around[i : i + BATCH], target[i : i + BATCH]
            x, h, p = self._forward(near, room)
            np.exp(p, out=p)
            p *= 1 / (p.sum(1, keepdims=True) * len(want))
            p[np.arange(len(want)), want] -= np.float32(1 / len(want))
            e, w1, b1, w2, b2 = self.parts
            back = (p @ w2.T) * (1 - h[:, :HIDDEN] ** 2)
            into = (back @ w1.T).reshape(-1, WIDTH).T
            rows = near.ravel()
            ge = np.stack([np.bincount(rows, v, CLASSES + 1) for v in into], 1).astype(np.float32)
            above = h.T @ p
            if not moments:
                moments += [[np.zeros_like(q), np.zeros_like(q)] for q in self.parts] + [0]
            moments[-1] += 1
            t = moments[-1]
            for q, g, (m, v) in zip(self.parts, [ge, x.T @ back, back.sum(0), above[:HIDDEN], above[HIDDEN]], moments[:-1], strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                q -= STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)


def train(docs: DataFrame, frequent: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights averaged over the tasks, by words trained on; each round starts from the last average.

    Every document is trained on, in the round that a hash of its text names, so the training text is the whole corpus. Spark sums the
    weights of all tasks; the driver gets one number for each weight. How rows fall into tasks plays into the weights.
    """
    flat = Window.start()
    for part in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], flat: np.ndarray = flat) -> Iterator[pa.RecordBatch]:
            net, moments, seen = Window(flat), [], 0
            for batch in batches:
                for _, _, data, offsets in blocks(batch.column(0)):
                    hashes, first = words(data, offsets)
                    classes = _classes(hashes, frequent)
                    order = np.random.default_rng(len(classes)).permutation(len(classes))
                    net.train(windows(classes, first)[order], classes[order], moments)
                    seen += len(classes)
            if seen:
                yield pa.record_batch([pa.array(np.arange(len(flat))), pa.array(net.flat() * seen), pa.array(np.full(len(flat), float(seen)))], ["i", "w", "n"])

        own = docs.where(F.pmod(F.xxhash64(F.lit("train"), "text"), F.lit(rounds)) == part).select("text")
        sums = own.mapInArrow(run, "i long, w double, n double").groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w"))
        found = sums.toArrow().sort_by("i")
        if found.num_rows:
            flat = found["w"].to_numpy()
    return flat


def score(docs: DataFrame, known: Lexicon, flat: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, pll (the sum over the whole text), mean_pll (null without words) of every row.

    A word that the lexicon has never seen counts as one occurrence more of its class.
    """
    frequent, hot, logs_hot = known.frequent, known.hot, np.log(known.hot_n)
    logs_total = np.log(known.totals + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Window(flat)
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                hashes, first = words(data, offsets)
                classes = _classes(hashes, frequent)
                logs = net.log_probability(windows(classes, first), classes)
                tail = np.flatnonzero(classes >= FREQUENT)
                own = hashes[tail].view(np.int64)
                logs[tail] -= logs_total[classes[tail] - FREQUENT]
                rest = np.ones(len(tail), bool)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
                    rest = hot[at] != own
                    logs[tail] += np.where(rest, 0.0, logs_hot[at])
                row = np.repeat(np.arange(b - a), np.diff(first))[tail[rest]]
                own = own[rest]
                order = np.lexsort((own, row))
                own, row = own[order], row[order]
                new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (row[1:] != row[:-1])])) if len(own) else np.zeros(0, np.int64)
                ends = pa.array(np.searchsorted(row[new], np.arange(b - a + 1)).astype(np.int32))
                sums = np.concatenate([[0.0], np.cumsum(logs)])
                yield pa.record_batch(
                    [
                        batch.column(0).slice(a, b - a), pa.array(np.diff(first)), pa.array(sums[first[1:]] - sums[first[:-1]]),
                        pa.ListArray.from_arrays(ends, pa.array(own[new])), pa.ListArray.from_arrays(ends, pa.array(np.diff(np.append(new, len(own))))),
                    ],
                    ["doc_id", "n_tokens", "pll", "words", "times"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, pll double, words array<long>, times array<long>")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "masked-rows")
    asked = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    more = asked.join(known.rare.hint("merge"), "word").groupBy("row").agg(F.sum(F.col("times") * F.ln("n")).alias("more"))
    rows = rows.select("row", "doc_id", "n_tokens", "pll").join(more.hint("merge"), "row", "left").withColumn("pll", F.col("pll") + F.coalesce("more", F.lit(0.0)))
    return rows.select("doc_id", "n_tokens", "pll", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")).alias("mean_pll"))


def masked_scores(docs: DataFrame) -> DataFrame:
    """score() under a lexicon and a network of docs themselves.

    Null and empty texts have 0 tokens and pll 0. Repeated rows and null doc_ids stay. An empty table gives no rows. Other
    columns are ignored, but for lang, which shares out the own classes. Equal texts have equal scores, but for rounding.
    """
    known = lexicon(docs)
    return score(docs, known, train(docs, known.frequent))
