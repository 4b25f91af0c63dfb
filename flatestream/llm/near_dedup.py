"""Near-duplicate documents by an LSH forest over MinHash signatures.

A signature has `trees` x `depth` MinHash values. A tree is an order of these values; documents that agree in its first d
values share a region of depth d. Candidates pass an estimate from the whole signature and are then confirmed on the full
shingle sets.

The opening walk joins most of each group: in `first` trees all signatures are put in one sorted order, dealt to tasks by
range. Neighbours in that order with a longest common prefix of `shallow` values or more are candidates: all of them where at
most `small` rows share the prefix; in a denser region the nearest `near` rows on either side, and the region's `hubs`, the
rows that agree best with its most frequent values.

The descent then goes down all trees at once, level by level, and adapts the depth to each region. What is left to do in a
region are its rows outside its largest component. Where these are `block` at most, they meet all rows of the region, dealt to
tasks by blocks of rows, and the region is done; a denser region is split by the tree's next value. So a row meets at most
`block` others in a region, however many rows that has, and every pair that shares the prefix of a done region is tried. A
long prefix is shared by fewer pairs of a tree, so rows that are still in a dense region at depth `widen` go on in `more` further
trees, other orders of the same values. In a region that is dense at depth `deepest` still, blocks of such rows meet all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize
from .components import connected
from .wordhash import blocks, minhash, mix, seeds, shingles, words


@dataclass(frozen=True)
class Forest:
    """Parameters. Links hold 100 * intersection >= percent * union on sets of `k`-word shingles."""

    k: int = 5
    percent: int = 80
    trees: int = 16
    depth: int = 8
    shallow: int = 2
    small: int = 32
    near: int = 4
    hubs: int = 24
    doubt: float = 0.15
    sure: float = 0.08
    region_rows: int = 8192
    first: int = 4
    block: int = 512
    widen: int = 4
    more: int = 48
    deepest: int = 16


def signatures(docs: DataFrame, p: Forest) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, s1, s2 (a 128-bit key of the whole set), sig (trees * depth 32-bit values, big-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perms = seeds(p.trees * p.depth)
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in blocks(batch.column(2)):
                sets, first = distinct(*shingles(*words(data, offsets), p.k))
                sig = minhash(sets, first, perms).astype(">u4")
                sums = np.concatenate([np.zeros((2, 1), np.uint64), np.cumsum([mix(sets ^ np.uint64(c)) for c in (0x51ED27, 0xA3C59AC3)], axis=1, dtype=np.uint64)], axis=1)
                keys = (sums[:, first[1:]] - sums[:, first[:-1]]).view(np.int64)
                yield pa.record_batch(
                    [ids.slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(first)), pa.array(keys[0]), pa.array(keys[1]), pa.array([s.tobytes() for s in sig], pa.binary())],
                    ["doc_id", "text_key", "n_shingles", "s1", "s2", "sig"],
                )

    return docs.select(*_keyed(), "text").mapInArrow(run, "doc_id long, text_key long, n_shingles long, s1 long, s2 long, sig binary")


def _keyed() -> list[F.Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key")]


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row."""
    if not len(values):
        return values, first
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(first) - 1))])


def tree_rows(sigs: DataFrame, p: Forest) -> DataFrame:
    """One row for each of the `first` trees: its `depth` values as a key that sorts as bytes, and 4 bits of every value of all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 4 * p.depth
        for batch in batches:
            ids, sig = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for at in range(0, len(ids), 2000):
                own = np.frombuffer(b"".join(sig.slice(at, 2000).to_pylist()), np.uint8).reshape(-1, 4 * p.trees * p.depth)
                low = own[:, 3::4] & 15
                few = (low[:, ::2] << 4) | low[:, 1::2]
                few = [x.tobytes() for x in few]
                for t in range(p.first):
                    keys = [x.tobytes() for x in own[:, t * width : (t + 1) * width]]
                    yield pa.record_batch([pa.array(np.full(len(keys), t, np.int32)), pa.array(keys, pa.binary()), pa.array(ids[at : at + 2000]), pa.array(few, pa.binary())], ["tree", "key", "doc_id", "few"])

    return sigs.select("doc_id", "sig").mapInArrow(run, "tree int, key binary, doc_id long, few binary")


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of rows a and b of 4-bit values; 1 of 16 agrees by chance."""
    x = a ^ b
    same = ((x & 15) == 0).sum(1, dtype=np.int32) + ((x & 240) == 0).sum(1, dtype=np.int32)
    return (same / (2 * a.shape[1]) - 1 / 16) * (16 / 15)


def _region_pairs(few: np.ndarray, region: np.ndarray, p: Forest) -> list[tuple[int, int]]:
    """Candidate pairs of rows in one sorted order; `region` numbers the runs of rows with a common shallow prefix."""
    least, sure = p.percent / 100 - p.doubt, p.percent / 100 + p.sure
    n = len(region)
    size = np.bincount(region)[region]
    found = []
    for step in range(1, min(p.small, n)):
        i = np.flatnonzero((region[step:] == region[:-step]) & ((size[:-step] <= p.small) | (step <= p.near)))
        if len(i):
            found.append((i, i + step))
        elif step >= p.near:
            break
    starts = np.flatnonzero(np.diff(region, prepend=-1))
    for s in starts[size[starts] > p.small]:
        rows = np.arange(s, s + size[s])
        own = few[rows]
        nibbles = np.stack([own >> 4, own & 15], 2).reshape(len(rows), -1)
        mode = np.array([np.bincount(c, minlength=16).argmax() for c in nibbles.T], np.uint8)
        hubs = np.argsort(-(nibbles == mode).sum(1), kind="stable")[: p.hubs] + s
        for h in hubs:
            found.append((np.full(len(rows) - 1, h), rows[rows != h]))
    if not found:
        return []
    a, b = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    est = np.concatenate([_agree(few[a[i : i + 65536]], few[b[i : i + 65536]]) for i in range(0, len(a), 65536)])
    keep = np.flatnonzero(est >= least)
    keep = keep[np.argsort(-est[keep], kind="stable")]
    parent = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for x, y, e in zip(a[keep].tolist(), b[keep].tolist(), est[keep].tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            out.append((x, y))
            if e >= sure:
                parent[rx] = ry
    return out


def neighbours(rows: DataFrame, p: Forest) -> DataFrame:
    """Pairs a < b of doc_ids from the sorted orders of all trees; several trees may give one pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            head, ids, few = (np.concatenate(x) for x in zip(*parts, strict=True))
            region = np.cumsum(np.concatenate([[0], (head[1:] != head[:-1]).any(1)]))
            shared = np.flatnonzero(np.bincount(region)[region] > 1)
            if not len(shared):
                return None
            region = np.unique(region[shared], return_inverse=True)[1]
            ids = ids[shared]
            found = np.array(_region_pairs(few[shared], region, p), np.int64).reshape(-1, 2)
            ends = np.sort(ids[found], axis=1)
            return pa.record_batch([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["a", "b"])

        waiting, held = [], 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, -1)[:, : 4 * p.shallow]
            head = np.concatenate([batch.column(0).to_numpy().astype(np.uint8)[:, None], keys], 1)
            few = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, -1)
            new = np.flatnonzero((head[1:] != head[:-1]).any(1)) + 1
            cut = int(new[-1]) if len(new) else 0
            ids = batch.column(2).to_numpy()
            if waiting and (head[0] != waiting[-1][0][-1]).any() and not cut:
                yield from filter(None, [pairs(waiting)])
                waiting, held = [], 0
            if cut:
                waiting.append((head[:cut], ids[:cut], few[:cut]))
                yield from filter(None, [pairs(waiting)])
                waiting, held = [], 0
            waiting.append((head[cut:], ids[cut:], few[cut:]))
            held += n - cut
            if held >= p.region_rows:
                yield from filter(None, [pairs(waiting)])
                waiting, held = [], 0
        if waiting:
            yield from filter(None, [pairs(waiting)])

    order = ["tree", "key", "doc_id"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long")


def _sets(column: pa.Array, k: int) -> list[np.ndarray]:
    out = []
    for a, b, data, offsets in blocks(column):
        sets, first = distinct(*shingles(*words(data, offsets), k))
        out += [sets[first[i] : first[i + 1]] for i in range(b - a)]
    return out


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and the whole text, compressed."""
    import zstandard

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.record_batch([*batch.columns[:2], pa.array([z.compress((t.as_py() or "").encode()) for t in batch.column(2)], pa.binary())], ["doc_id", "text_key", "z"])

    return docs.select(*_keyed(), "text").mapInArrow(pack, "doc_id long, text_key long, z binary")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, z (its compressed text) of the documents in ids (doc_id, text_key), once each."""
    wanted = ids.distinct().hint("merge")  # grows with the data: never broadcast
    return packed(docs).join(wanted, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "z")


def confirmed(pairs: DataFrame, docs: DataFrame, chosen: DataFrame, p: Forest) -> DataFrame:
    """The pairs whose full shingle sets are similar enough. Texts travel compressed and meet pair by pair."""
    import zstandard

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        last: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            za, zb = batch.column("za"), batch.column("zb")
            good = np.zeros(len(a), bool)
            for i in range(len(a)):
                if len(last) > 64:
                    last.clear()
                for d, t in ((a[i], za), (b[i], zb)):
                    if d not in last:
                        last[d] = _sets(pa.array([z.decompress(t[i].as_py()).decode()], pa.large_string()), p.k)[0]
                x, y = last[a[i]], last[b[i]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = 100 * both >= p.percent * (len(x) + len(y) - both)
            yield pa.record_batch([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().hint("merge")
    needed = materialize(texts_of(docs, chosen.join(ids, "doc_id", "left_semi")), "near-texts")
    both = pairs.join(needed.select(F.col("doc_id").alias("a"), F.col("z").alias("za")), "a").join(needed.select(F.col("doc_id").alias("b"), F.col("z").alias("zb")), "b")
    found = materialize(both.select("a", "b", "za", "zb").mapInArrow(check, "a long, b long"), "near-links")
    forget(needed)
    return found


GROUP = ["tree", "head", "part"]
GROUP_TYPES = "tree int, head long, part long"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with equal GROUP columns; a run may cross batches."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in GROUP], 1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            if waiting and tuple(keys[a]) != last:
                yield pa.Table.from_batches(waiting)
                waiting = []
            last = tuple(keys[a])
            waiting.append(batch.slice(a, b - a))
    if waiting:
        yield pa.Table.from_batches(waiting)


def profiles(reps: DataFrame, p: Forest) -> DataFrame:
    """doc_id, component, values (the whole signature), few (4 bits of every value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u4").reshape(batch.num_rows, -1)
            low = (sig & 15).astype(np.uint8)
            few = (low[:, ::2] << 4) | low[:, 1::2]
            ends = pa.array(np.arange(len(sig) + 1, dtype=np.int32) * sig.shape[1])
            values = pa.ListArray.from_arrays(ends, pa.array(sig.astype(np.uint32).view(np.int32).ravel()))
            yield pa.record_batch([batch.column(0), batch.column(1), values, pa.array([x.tobytes() for x in few], pa.binary())], ["doc_id", "component", "values", "few"])

    return reps.select("doc_id", "component", "sig").mapInArrow(run, "doc_id long, component long, values array<int>, few binary")


def _value(tree: F.Column, level: int, p: Forest) -> F.Column:
    """Which value comes at `level` in a tree: the first `trees` cut the signature in rows, further ones go through it in odd steps."""
    n = p.trees * p.depth
    return F.when(tree < p.trees, (tree * p.depth + level) % n).otherwise((tree * (2 * tree + 1) + level * (2 * (tree - p.trees) + 3)) % n)


def _head(tree: F.Column, levels: int, p: Forest) -> F.Column:
    return F.xxhash64(F.lit(levels), *[F.get("values", _value(tree, d, p).cast("int")) for d in range(levels)])


def _regions(rows: DataFrame, p: Forest) -> DataFrame:
    """rows (doc_id, component, tree, head) in regions of several components, with outside (not of the largest one), out and parts (blocks of such rows and of all)."""
    sizes = rows.groupBy("tree", "head", "component").agg(F.count(F.lit(1)).alias("n"))
    found = sizes.groupBy("tree", "head").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1")
    blocks = lambda n: F.ceil(n / p.block)
    found = materialize(found.select("tree", "head", F.col("main.component").alias("main"), blocks(F.col("n") - F.col("main.n")).alias("out"), blocks(F.col("n")).alias("parts")), "near-regions")
    placed = rows.join(found, ["tree", "head"]).select("doc_id", "component", "tree", "head", (F.col("component") != F.col("main")).alias("outside"), "out", "parts")
    placed = materialize(placed, "near-placed")
    forget(found)
    return placed


def _dealt(placed: DataFrame) -> DataFrame:
    """Each block of rows outside the largest component meets each block of the region's rows in a group; of the former there is mostly one."""
    columns = ["doc_id", "component", "outside", "tree", "head"]
    own = F.xxhash64("doc_id")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asks = placed.where("outside").select(*columns, F.lit(True).alias("asks"), (F.pmod(own, "out") * F.col("parts")).alias("i"), every("parts").alias("j"))
    rows = placed.select(*columns, F.lit(False).alias("asks"), F.pmod(own, "parts").alias("j"), "parts", every("out").alias("k"))
    return asks.select(*columns, "asks", (F.col("i") + F.col("j")).alias("part")).unionByName(rows.select(*columns, "asks", (F.col("k") * F.col("parts") + F.col("j")).alias("part")))


def descent(known: DataFrame, p: Forest) -> tuple[DataFrame, list[DataFrame]]:
    """The groups (GROUP) in which rows meet: doc_id, component, outside, asks (a row outside the largest component, that meets the
    group's other rows), few, heads (the shallow prefix in every tree) and split (the trees whose shallow region was too dense). Then the tables behind it."""
    all_trees = F.sequence(F.lit(0), F.lit(p.trees - 1))
    heads = F.transform(all_trees, lambda t: _head(t, p.shallow, p))
    rows = known.select("doc_id", "component", F.posexplode(heads).alias("tree", "head"))
    held, groups, split = [], None, None
    for level in range(p.shallow, p.deepest + 1):
        placed = _regions(rows, p)
        held.append(placed)
        last = level == p.deepest
        done = _dealt(placed if last else placed.where("out <= 1"))
        groups = done if groups is None else groups.unionByName(done)
        dense = placed.where("out > 1")
        if level == p.shallow:
            split = dense.groupBy("doc_id").agg(F.collect_set("tree").alias("split"))
        if last or dense.isEmpty():
            break
        deeper = dense.select("doc_id", "tree")
        if level == p.widen:
            deeper = dense.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(p.trees + p.more - 1))).alias("tree"))
        deeper = deeper.join(known.select("doc_id", "component", "values").hint("merge"), "doc_id")
        rows = materialize(deeper.select("doc_id", "component", "tree", _head(F.col("tree"), level + 1, p).alias("head")), "near-rows")
        held.append(rows)
    own = known.join(split.hint("merge"), "doc_id", "left").select("doc_id", "few", heads.alias("heads"), F.coalesce("split", F.array().cast("array<int>")).alias("split"))
    return groups.join(own.hint("merge"), "doc_id").repartition(*GROUP).sortWithinPartitions(*GROUP), held


def rest(known: DataFrame, docs: DataFrame, chosen: DataFrame, p: Forest) -> DataFrame:
    """Links (a, b) between different components of `known` (profiles()), from all regions of all trees."""
    import zstandard

    least = p.percent / 100 - p.doubt

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            asks = group.column("asks").to_numpy()
            if asks.all() or not asks.any():
                continue
            tree = min(group.column("tree")[0].as_py(), p.trees)
            ids, part, outside = (group.column(c).to_numpy() for c in ("doc_id", "component", "outside"))
            heads = np.array(group.column("heads").to_pylist(), np.int64)[:, :tree]
            split = np.zeros((len(ids), p.trees), bool)
            for i, trees in enumerate(group.column("split").to_pylist()):
                split[i, trees] = True
            few = np.frombuffer(b"".join(group.column("few").to_pylist()), np.uint8).reshape(len(ids), -1)
            rows, meets, wanted = np.flatnonzero(~asks), {}, set()
            for s in np.flatnonzero(asks):
                r = rows[(part[rows] != part[s]) & ~(outside[rows] & (ids[rows] < ids[s]))]
                r = r[~((heads[r] == heads[s]) & ~split[s, :tree]).any(1)]  # tried in an earlier tree's shallow region
                r = r[_agree(few[r], few[s][None]) >= least]
                if len(r):
                    meets[int(ids[s])] = (int(part[s]), ids[r].tolist())
                    wanted.update(zip(ids[r].tolist(), part[r].tolist(), strict=True))
            if not meets:
                continue
            out = [(d, c, m) for d, (c, m) in meets.items()] + [(d, c, []) for d, c in wanted if d not in meets]
            key = [pa.array(np.full(len(out), group.column(c)[0].as_py()), t) for c, t in zip(GROUP, (pa.int32(), pa.int64(), pa.int64()), strict=True)]
            yield pa.record_batch([*key, *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True))], [*GROUP, "doc_id", "component", "meets"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for group in _groups(batches):
            ids = group.column("doc_id").to_pylist()
            part = dict(zip(ids, group.column("component").to_pylist(), strict=True))
            texts = dict(zip(ids, group.column("z").to_pylist(), strict=True))
            sets: dict[int, np.ndarray] = {}
            above: dict[int, int] = {}

            def top(c: int) -> int:
                while above.setdefault(c, c) != c:
                    above[c] = c = above[above[c]]
                return c

            def full(d: int) -> np.ndarray:
                if d not in sets:
                    sets[d] = _sets(pa.array([z.decompress(texts[d]).decode()], pa.large_string()), p.k)[0]
                return sets[d]

            found = []
            for a, meets in zip(ids, group.column("meets").to_pylist(), strict=True):
                for b in meets:
                    if top(part[a]) == top(part[b]):
                        continue  # joined by links of this group that are confirmed already
                    x, y = full(a), full(b)
                    if p.percent * max(len(x), len(y)) > 100 * min(len(x), len(y)):
                        continue
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= p.percent * (len(x) + len(y) - both):
                        found.append((min(a, b), max(a, b)))
                        above[top(part[a])] = top(part[b])
            if found:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    dealt, held = descent(known, p)
    meets = materialize(dealt.mapInArrow(pick, f"{GROUP_TYPES}, doc_id long, component long, meets array<long>"), "near-meets")
    forget(*held)
    texts = texts_of(docs, chosen.join(meets.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"))
    links = meets.join(texts.hint("merge"), "doc_id").repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(check, "a long, b long")
    found = materialize(links.distinct(), "near-rest")
    forget(meets)
    return found


def near_duplicates(docs: DataFrame, p: Forest = Forest()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id).

    One row for each row of docs. Null and empty texts have no shingles and are linked with nothing. A text of fewer than
    k words is one shingle. Documents with equal sets are one class from the start, however many there are; only that of the least
    doc_id takes part in the search. If a doc_id occurs with several texts, its rows count as one document, which is linked with all
    texts of the same sets; near links are sought for the one text whose xxhash64 is least. A row with a null doc_id is linked with
    nothing and kept, its component null. Other columns of `docs` are ignored; an empty table gives no rows.
    """
    sigs = materialize(signatures(docs, p), "near-sigs")
    found = sigs.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"))
    sets = materialize(found.select("s1", "s2", F.col("rep.doc_id").alias("rep"), F.col("rep.text_key").alias("text_key")), "near-sets")
    chosen = materialize(sets.groupBy(F.col("rep").alias("doc_id")).agg(F.min("text_key").alias("text_key")), "near-chosen")
    reps = sigs.join(chosen.hint("merge"), ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id"])
    pairs = materialize(neighbours(tree_rows(reps, p), p).distinct(), "near-pairs")
    links = confirmed(pairs, docs, chosen, p)
    known = reps.join(connected(links).withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    known = materialize(profiles(known, p), "near-known")
    more = rest(known, docs, chosen, p)
    labels = connected(links.unionByName(more))
    classes = materialize(sets.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id")), "near-classes")
    forget(pairs, links, known, more, sets, chosen)
    out = sigs.select("doc_id", "n_shingles", "s1", "s2").join(classes, ["s1", "s2"], "left")
    none = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(none, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
