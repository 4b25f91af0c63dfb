"""The stages in a row, each against a brute-force version on its own input; and odd rows through all of them."""

import hashlib
import re
from collections import Counter

import corpus_pipeline as c
import pytest

from flatestream.llm import mixing

from test_documents import brute_components, brute_grams, brute_order, brute_shards


def brute_language(rows):
    """Rows with a letter, where any row may be learned from."""
    return [r for r in rows if brute_order(brute_grams(r["text"]))]


def brute_near(rows):
    found = brute_components([(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None], 5)
    return [r for r in rows if r["doc_id"] is None or found[r["doc_id"]][1] == r["doc_id"]]


def brute_leaks(rows, items):
    def grams(w, n):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    split = lambda t: [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
    wanted = [(min(5, len(w)), grams(w, min(5, len(w)))) for w in map(split, items) if w]
    kept = []
    for r in rows:
        own = {n: grams(split(r["text"]), n) for n, _ in wanted}
        if not any(100 * len(g & own[n]) >= 80 * len(g) for n, g in wanted):
            kept.append(r)
    return kept


def brute_mix(rows):
    """Earliest deadline first, slot by slot, until the source that is furthest from its target has been used up once."""
    sources = {}
    for r in rows:
        sources.setdefault(r["source"] if r["source"] in mixing.WEIGHTS else mixing.OTHER, []).append(r)
    weight = {s: mixing.WEIGHTS.get(s, 1) for s in sources}
    total = sum(weight.values())
    blocks = {}
    for s, own in sources.items():
        own.sort(key=lambda r: (hashlib.md5(f"mix|{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest(), r["doc_id"] or 0))
        blocks[s] = [own[i : i + 16] for i in range(0, len(own), 16)]
    periods = max(-(-len(b) // weight[s]) for s, b in blocks.items())
    done, out = Counter(), []
    for t in range(periods * total):
        ready = [s for s in sorted(sources) if done[s] * total // weight[s] <= t]
        s = min(ready, key=lambda s: (-(-(done[s] + 1) * total // weight[s]), s))
        out += blocks[s][done[s] % len(blocks[s])]
        done[s] += 1
    return out


def key(r):
    return str([r[k] for k in ("doc_id", "text", "lang", "source", "n_chars")])


def check_stages(spark, sf_dir, docs):
    rows = [r.asDict() for r in docs.collect()]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for (name, stage), brute in zip(c.STAGES[:-1], (brute_language, brute_near, lambda r: brute_leaks(r, items), brute_mix), strict=True):
        out = stage(spark, docs, sf_dir)
        got = [r.asDict() for r in out.collect()]
        assert out.columns == docs.columns
        assert Counter(map(key, got)) == Counter(map(key, brute(rows))), name
        rows, docs = got, spark.createDataFrame([tuple(r.values()) for r in got], docs.schema)
    found = c.shard(spark, docs, sf_dir).collect()
    assert Counter((r.doc_id, r.source, r.shard, r.slot) for r in found) == Counter(brute_shards([(r["doc_id"], r["source"]) for r in rows], 16))
    return rows


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert [n for n, _ in c.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    last = check_stages(spark, sf_dir, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert Counter(r.doc_id for r in c.run(spark, sf_dir).collect()) == Counter(r["doc_id"] for r in last)


def test_odd_rows(spark):
    sf_dir = "/root/testdata/sf0.001"
    item = next(r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if len((r.text or "").split()) > 20)
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, None, "en", "src0"), (2, "", "en", "src0"), (3, "12 % 3", "en", None), (None, "some text of a null id here", "en", "src1"), (5, long, "en", "src2"), (6, long + " more", "fr", "src2"), (7, "twice the same row", None, None), (7, "twice the same row", None, None), (8, f"before {item} after", "en", "src0"), (None, item, "en", "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema)
    left = check_stages(spark, sf_dir, docs)
    assert {r["doc_id"] for r in left} == {None, 5, 7}
    clash = docs.selectExpr("*", "1 AS shard", "2 AS slot", "'x' AS lang_pred", "3 AS score", "4 AS epoch", "5 AS component_id", "6 AS position")
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, clash, sf_dir)
        assert out.columns == clash.columns and {(r.shard, r.lang_pred, r.score, r.epoch, r.position) for r in out.collect()} == {(1, "x", 3, 4, 6)}
    assert c.shard(spark, clash, sf_dir).count() == len(rows)


@pytest.mark.parametrize("stage", range(5))
def test_empty_table(spark, stage):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert c.STAGES[stage][1](spark, docs, "/root/testdata/sf0.001").count() == 0
