"""Each operator on documents against a brute-force version, with nulls, empty texts, ties, repeated rows and extra columns."""

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from flatestream.llm import decontamination, language_id, line_dedup, masked_lm, media, mixing, near_dedup, quality_lm, queries, sharding
from flatestream.llm.near_dedup import Forest, near_duplicates
from flatestream.llm.wordhash import blocks, shingles, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, n int, h string"


def frame(spark, rows):
    """rows: (doc_id, text, lang, source); the further columns clash with names inside the operators."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 99, 0.5, 7, "h") for i, t, lang, s in rows], SCHEMA)


def prose(rng, n, alphabet="abcdefgh"):
    return [("".join(rng.choices(alphabet, k=rng.randint(2, 7)))) for _ in range(n)]


def brute_shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    rows, n = [], 0
    for _ in range(40):
        base = prose(rng, rng.choice([3, 8, 40, 120]))
        for _ in range(rng.choice([1, 1, 2, 5])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                own[rng.randrange(len(own))] = "edit" + str(rng.randrange(999))
            rows.append((n, " ".join(own), rng.choice(["en", "fr", None]), rng.choice(["src0", "src1", "x", None])))
            n += 1
    rows += [(n, None, None, None), (n + 1, "", "en", "src0"), (n + 2, " \t\n", "en", "src0"), (n + 3, "one", "en", "src1"), (n + 4, "ONE", "en", "src1"), (n + 5, "é é x", None, "x")]
    rows += [(n + 6, " ".join(prose(rng, 20000)), "en", "src0")]
    return rows


def test_words_and_shingles():
    texts = [None, "", "  a\tB c\n", "x", "ÉA b\x0bc d e", "q" * 5000]
    seen = {}
    for k in (1, 2, 4):
        for _, _, data, offsets in blocks(pa.array(texts, pa.string()), limit=7):
            values, first = shingles(*words(data, offsets), k)
            assert first[-1] == len(values)
        data_all = list(blocks(pa.array(texts, pa.string())))[0]
        values, first = shingles(*words(data_all[2], data_all[3]), k)
        for i, t in enumerate(texts):
            want = brute_shingles(t, k)
            got = values[first[i] : first[i + 1]].tolist()
            assert len(set(got)) == len(want)
            for g in got:
                assert seen.setdefault((k, g), t) is not None


def brute_components(rows, k):
    sets = {i: brute_shingles(t, k) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations([i for i in sets if sets[i]], 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, corpus, k):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, corpus), Forest(k=k)).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute_components(corpus, k).items()}


def test_near_duplicates_large_group_and_odd_rows(spark):
    rng = random.Random(2)
    base = prose(rng, 150)
    rows = []
    for i in range(300):
        own = list(base)
        for _ in range(rng.randrange(8)):
            own[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(own), "en", "s"))
    rows += [(i, "the same text again and again", "en", "s") for i in range(300, 500)]
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows), Forest(k=4)).collect()}
    want = {i: c for i, (_, c) in brute_components(rows, 4).items()}
    assert got == want
    odd = near_duplicates(frame(spark, [(None, "a b c d e", None, None), (5, "a b c d e", None, None), (5, "a b c d e", None, None)]))
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in odd.collect()) == [(0, 0, True), (5, 5, True), (5, 5, True)]
    assert near_duplicates(frame(spark, [])).count() == 0


def template_pages(rng, n, groups):
    """Pages on one template (about half of each page), unlinked; some of them once more with a few edits."""
    shell = [f"t{i}" for i in range(60)]
    rows, links = [], []
    for i in range(n):
        rows.append((i, " ".join(shell + [f"w{rng.randrange(10**9)}" for _ in range(45)]), "en", "s"))
    for j in range(groups):
        own = rows[rng.randrange(n)]
        w = own[1].split()
        w[60 + rng.randrange(45)] = "edited"
        rows.append((n + j, " ".join(w), "en", "s"))
        links.append((own[0], n + j))
    return rows, links


def test_dense_region_of_unlinked_rows(spark):
    """5,000 pages that share half of their shingles: every region is dense, and the descent splits it; no link may be lost."""
    rows, links = template_pages(random.Random(12), 5000, 60)
    forest = Forest(k=4, block=4, small=4, near=1, hubs=1, region_rows=500)
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows), forest).collect()}
    want = {i: i for i in range(len(rows))}
    for a, b in sorted(links):
        want[b] = a
    assert got == {i: want[want[i]] for i in want}
    known = near_dedup.profiles(near_dedup.signatures(frame(spark, rows), forest).withColumn("component", F.col("doc_id")), forest)
    groups = near_dedup.descent(known, forest)[0].groupBy(*near_dedup.GROUP).agg(F.count_if("asks").alias("asks"), F.count_if(~F.col("asks")).alias("rows")).agg(F.max("asks"), F.max("rows"), F.sum("rows")).first()
    assert groups[0] <= 4 * 5 and groups[1] <= 4 * 5 and groups[2] < 100 * len(rows)  # no group holds a region, and no all-by-all


def test_recall_against_all_rows(spark):
    """Every link of the given documents, found by brute force over shared shingles, is within a component."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: brute_shingles(r.text, 4) for r in docs.collect()}
    where = {}
    for d, own in texts.items():
        for g in own:
            where.setdefault(g, []).append(d)
    component = {r.doc_id: r.component_id for r in near_duplicates(docs, Forest(k=4)).collect()}
    links = []
    for d in texts:
        shared = Counter(o for g in texts[d] for o in where[g] if o != d)
        links += [(d, o) for o, n in shared.items() if 100 * n >= 80 * (len(texts[d]) + len(texts[o]) - n)]
    assert len(links) > 100 and all(component[a] == component[b] for a, b in links)


def test_one_doc_id_with_two_texts(spark):
    rng = random.Random(13)
    a, b = prose(rng, 90), prose(rng, 90)
    rows = [(5, " ".join(a), None, None), (5, " ".join(b), None, None), (7, " ".join(a), None, None), (8, " ".join(b), None, None), (9, " ".join(prose(rng, 90)), None, None)]
    for _ in range(2):
        got = sorted((r.doc_id, r.component_id) for r in near_duplicates(frame(spark, rows)).collect())
        assert got == [(5, 5), (5, 5), (7, 5), (8, 5), (9, 9)]
        rows.reverse()


def test_media(spark, corpus):
    rows = [*corpus, (None, "x" * 64, None, None), (3, corpus[3][1], None, None), (3, corpus[3][1], None, None)]
    docs = frame(spark, rows)
    got = media.media(docs).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r, t in ((r, t) for r in got for i, t, *_ in rows if i == r.doc_id):
        raw = (t or "").encode()
        p = raw + bytes(64 if not raw else -len(raw) % 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        w = media.wav(p)
        assert (r.media_bytes, r.media_sha256) == (len(w), hashlib.sha256(w).hexdigest())
        assert by_text.setdefault(t or "", r.feature) == r.feature
    assert media.media(frame(spark, [])).count() == 0


def test_chunks_are_content_defined():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 200_000, np.uint8).tobytes()
    own = media.chunks(data)
    assert b"".join(own) == data and max(map(len, own)) <= media.MOST
    moved = media.chunks(b"inserted" + data)
    assert len(set(own) & set(moved)) >= len(own) - 3
    assert media.samples(media.wav(data)) == data
    with pytest.raises(ValueError):
        media.samples(media.wav(data)[:-1])


def test_media_store_keeps_each_chunk_once(spark):
    text = " ".join(prose(random.Random(4), 9000))
    rows = [(i, text + f" {i}", None, None) for i in range(40)]
    store, name = media.write_store(frame(spark, rows))
    assert store.count() == store.select("digest").distinct().count() < 200
    spark.sql(f"DROP TABLE {name}")


def brute_kneser_ney(texts, order=5):
    """Probability of a character after a context, from Counters, as the textbook has it."""
    counts = [Counter()]
    for t in texts:
        s = "\x01" * (order - 1) + (t or "")
        counts[0].update(s[i : i + order] for i in range(len(s) - order + 1))
    for _ in range(order - 1):
        counts.insert(0, Counter(g[1:] for g in counts[0]))
    models = []
    for own in counts:
        n = [max(1, sum(v == i for v in own.values())) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [0] + [min(max(x, 0.05), i - 0.05) for i, x in ((1, 1 - 2 * y * n[1] / n[0]), (2, 2 - 3 * y * n[2] / n[1]), (3, 3 - 4 * y * n[3] / n[2]))]
        after = {}
        for g, v in own.items():
            after.setdefault(g[:-1], []).append(v)
        models.append((own, d, after))

    def p(context, c):
        out = 1 / (len(counts[0]) + 1)
        for k, (own, d, after) in enumerate(models, 1):
            ctx = context[len(context) - k + 1 :]
            if ctx in after:
                v = own.get(ctx + c, 0)
                out = sum(d[min(x, 3)] for x in after[ctx]) / sum(after[ctx]) * out + (v - d[min(v, 3)]) / sum(after[ctx])
        return out

    return p


def test_kneser_ney_by_brute_force(spark):
    rng = random.Random(16)
    texts = ["abracadabra", "abab", "b", "", None, "日本語の文章と日本語", "😀😀 ა😀", *(" ".join(prose(rng, 30, "abcdé漢")) for _ in range(6))]
    model = quality_lm.fit(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]))
    p = brute_kneser_ney(texts)
    for t in [*texts, "zzz", "本日語", "cadab \U0010ffff"]:
        s = "\x01" * 4 + (t or "")
        want = sum(np.log(p(s[i - 4 : i], s[i])) for i in range(4, len(s)))
        logs, sizes = model.log_probabilities([t or ""])
        assert sizes[0] == len(t or "") and logs[0] == pytest.approx(want, rel=1e-9, abs=1e-12)
    seen = sorted({c for t in texts for c in t or ""})
    for context in ("abra", "日本語の", "\x01\x01\x01a", "????"):
        assert sum(p(context, c) for c in [*seen, "\x7f"]) == pytest.approx(1)
        logs = model.log_probabilities([context + c for c in [*seen, "\x7f"]])[0] - model.log_probabilities([context])[0]
        assert np.exp(logs).sum() == pytest.approx(1)


def test_quality_model_covers_all_trusted(spark):
    """The former bounds, 20,000 ids and 64 MiB of text, leave nothing out."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), 2000).alias("text"))
    labels = spark.range(30_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    fitted = quality_lm.fitted_ids(quality_lm.trusted_ids(labels), docs)
    assert fitted.count() == labels.where("pmod(xxhash64('calibrate', doc_id), 5) > 0").count() > 23_000
    rng = random.Random(5)
    rows = [(i, " ".join(prose(rng, 12)), "en", "s") for i in range(60)]
    own = frame(spark, rows)
    labels = labels.where("doc_id < 50")
    trusted = {r.doc_id for r in quality_lm.fitted_ids(quality_lm.trusted_ids(labels), own).collect()}
    p = brute_kneser_ney([t for i, t, _, _ in rows if i in trusted])
    for r in quality_lm.quality(own, labels).collect():
        s = "\x01" * 4 + rows[r.doc_id][1]
        assert r.logprob == pytest.approx(sum(np.log(p(s[i - 4 : i], s[i])) for i in range(4, len(s))), rel=1e-9)


@pytest.mark.parametrize(("limit", "group_grams"), [(1 << 24, 1 << 18), (100, 50), (1, 7)])
def test_quality_scores_by_brute_force(spark, limit, group_grams):
    """Many small packs and groups: null and empty texts, repeated rows, unseen characters, one text larger than a pack."""
    rng = random.Random(17)
    texts = ["abracadabra", "abab", "b", "", None, "日本語の文章と日本語", "😀😀 ა😀", *(" ".join(prose(rng, 30, "abcdé漢")) for _ in range(6))]
    model = quality_lm.model_tables(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]))
    p = brute_kneser_ney(texts)
    seen = [*texts, "zzz", "", None, "本日語", "cadab \U0010ffff", "\x00\x01ab", *texts[7:9], " ".join(prose(rng, 300, "abcxyz"))]
    docs = frame(spark, [(i if i % 7 else None, t, str(i), None) for i, t in enumerate(seen)])
    got = {int(r.lang): r for r in quality_lm.score(docs, model, limit, group_grams).collect()}
    assert len(got) == len(seen)
    for i, t in enumerate(seen):
        s = "\x01" * 4 + (t or "").replace("\x00", "\x02").replace("\x01", "\x02")
        want = sum(np.log(p(s[j - 4 : j], s[j])) for j in range(4, len(s)))
        assert (got[i].doc_id, got[i].n_symbols) == (i if i % 7 else None, len(t or "")) and got[i].logprob == pytest.approx(want, rel=1e-9, abs=1e-12)
    assert got[7].logprob == got[len(seen) - 3].logprob
    assert quality_lm.score(frame(spark, []), model).count() == 0


def test_quality_thresholds_cover_all_trusted(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(prose(rng, 30)), "en" if i % 25 else "xx", "s") for i in range(200)] + [(300, "abc", "xx", "s"), (None, "abc", "xx", "s"), (7, None, "en", "s"), (9, "q " * 200_000, "en", "s")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    fitted = {r.doc_id for r in quality_lm.fitted_ids(quality_lm.trusted_ids(labels), docs, 10).collect()}
    got = quality_lm.quality(docs, labels, bound=10, quantile=1.0).collect()
    assert 0 < len(fitted) <= 10 and len(got) == len(rows)
    for lang in ("en", "xx"):
        most = max(r.perplexity for r in got if r.lang == lang and r.perplexity and r.doc_id is not None and r.doc_id < 200 and r.doc_id not in fitted)
        assert all(r.threshold == pytest.approx(most) for r in got if r.lang == lang)
    few = quality_lm.fitted_ids(quality_lm.trusted_ids(labels), docs, 200, most_bytes=3000).count()
    assert 0 < few < 60
    assert quality_lm.quality(frame(spark, []), labels).count() == 0


def test_quality(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(prose(rng, 60)), "en", "s") for i in range(60)] + [(60 + i, " ".join(f"%$#{rng.randrange(999)}!" for _ in range(60)), "en", "s") for i in range(5)] + [(70, None, "en", None), (71, "", None, None), (72, rows_text(rng), None, None)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(60, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_lm.quality(frame(spark, rows), labels, quantile=1.0).collect()}
    assert sum(got[i].kept for i in range(60)) > 50 and not any(got[i].kept for i in range(60, 65))
    assert not got[70].kept and got[71].perplexity is None and got[72].threshold is not None
    assert all(r.kept == (r.n_symbols > 0) for r in quality_lm.quality(frame(spark, rows), labels.where("false")).collect())


def rows_text(rng):
    return " ".join(prose(rng, 30))


def test_masked_lm(spark, corpus):
    """Against a forward pass word by word in plain Python, with counts from collections.Counter."""
    docs = frame(spark, [*corpus, (None, "a b", None, None), (2, corpus[2][1], None, None)])
    known = masked_lm.lexicon(docs, hot_words=50)
    flat = masked_lm.train(docs, known.frequent)
    found = masked_lm.score(docs, known, flat).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(corpus) + 2 and len({round(r.pll, 6) for r in found if r.doc_id == 2}) == 1
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    code = lambda w: int(words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0].view(np.int64)[0])
    hashed = {w: code(w) for _, t, *_ in [*corpus, (0, "a b")] for w in split(t)}
    own = {h: i for i, h in enumerate(known.frequent.tolist())}
    class_of = {w: own.get(h, masked_lm.FREQUENT + ((h % 2**64) >> 40) % masked_lm.HASHED) for w, h in hashed.items()}
    counts = Counter(w for t in [*(r[1] for r in corpus), "a b", corpus[2][1]] for w in split(t))
    totals = Counter()
    for w, n in counts.items():
        totals[class_of[w]] += n
    shapes, at = [], 0
    for s in masked_lm.SHAPES:
        shapes.append(flat[at : at + int(np.prod(s))].reshape(s))
        at += int(np.prod(s))
    e, w1, b1, w2, b2 = shapes
    for i, t, *_ in corpus[:40]:
        w, want = split(t), 0.0
        for j, x in enumerate(w):
            around = [class_of[w[j + d]] if 0 <= j + d < len(w) else masked_lm.CLASSES for d in (-2, -1, 1, 2)]
            z = np.tanh(np.concatenate([e[a] for a in around]) @ w1 + b1) @ w2 + b2
            p = np.exp(z - z.max())
            want += np.log(p[class_of[x]] / p.sum())
            if class_of[x] >= masked_lm.FREQUENT:
                want += np.log(counts[x] / (totals[class_of[x]] + 1))
        assert got[i].n_tokens == len(w) and abs(got[i].pll - want) < 1e-3 * max(1, len(w))
    start = masked_lm.score(docs, known, masked_lm.Window.start()).agg(F.sum("pll")).first()[0]
    assert sum(r.pll for r in found) > start
    empty = [r for r in found if not r.n_tokens]
    assert empty and all(r.pll == 0 and r.mean_pll is None for r in empty)
    assert masked_lm.masked_scores(frame(spark, [])).count() == 0


def test_masked_lm_learns_from_every_document(spark):
    """Words that occur in two documents have a greater probability than those of one, however rare: the counts cover all texts."""
    rng = random.Random(14)
    new = lambda: " ".join(f"z{rng.randrange(10**12)}" for _ in range(40))
    rows = [(i, new(), "en", "s") for i in range(300)]
    rows += [(300 + i, rows[i][1], "en", "s") for i in range(20)]
    got = {r.doc_id: r.mean_pll for r in masked_lm.masked_scores(frame(spark, rows)).collect()}
    twice = [got[i] for i in [*range(20), *range(300, 320)]]
    assert min(twice) > max(got[i] for i in range(20, 300)) - 0.2 and np.mean(twice) > np.mean([got[i] for i in range(20, 300)]) + 0.5


def test_network_parts_of_the_vocabulary(spark):
    """A small language has words with own classes too; the hot and the joined counts give the same scores."""
    rng = random.Random(15)
    rows = [(i, " ".join(prose(rng, 200, "abcde")), "en", "s") for i in range(60)] + [(99, " ".join(prose(rng, 50, "xyz") * 3), "xx", "s")]
    docs = frame(spark, rows)
    known = masked_lm.lexicon(docs)
    code = lambda w: int(words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0].view(np.int64)[0])
    assert {code(w) for w in rows[-1][1].split()} & set(known.frequent.tolist())
    one = {r.doc_id: r.pll for r in masked_lm.score(docs, known, masked_lm.Window.start()).collect()}
    for hot in (1, 7):
        two = {r.doc_id: r.pll for r in masked_lm.score(docs, masked_lm.lexicon(docs, hot_words=hot), masked_lm.Window.start()).collect()}
        assert one == pytest.approx(two)


def test_language_profiles(spark):
    rng = random.Random(5)
    alphabets = {"aa": "abcdefg", "bb": "hijklmn", "cc": "éèçàabc"}
    rows = [(i, " ".join(prose(rng, 40, alphabets[lang])) + " 123 !", lang, "s") for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    rows += [(200, None, "aa", None), (201, "12 %% 3", "aa", None), (202, "ABC ABC", None, None), (203, "", "zz", None)]
    got = {r.doc_id: r for r in language_id.identify(frame(spark, rows)).collect()}
    for i, _, lang, _ in rows[:90]:
        assert got[i].lang_pred == lang and 0 <= got[i].score <= 1 and got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert [got[i].lang_pred for i in (200, 201, 203)] == ["und"] * 3 and got[200].score == 0
    assert all(r.lang_pred == "und" for r in language_id.identify(frame(spark, [(1, "abc", None, None)])).collect())


def brute_grams(text):
    own = Counter()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        w = f" {w} "
        own.update(w[j : j + n] for n in (1, 2, 3) for j in range(len(w) - n + 1) if w[j : j + n] != " ")
    return own


def brute_order(counts):
    """Most frequent first; ties by the packed code points, where the blank is 1."""
    def code(g):
        out = 0
        for c in g:
            out = out << 21 | (1 if c == " " else ord(c))
        return out

    return sorted(counts, key=lambda g: (-counts[g], code(g)))[: language_id.TOP]


def test_out_of_place_distance_by_brute_force(spark):
    rng = random.Random(17)
    alphabets = {"aa": "abcdefgh", "bb": "abcdxyz", "cc": "éèçàabc"}
    rows = [(i, " ".join(prose(rng, rng.choice([1, 5, 60]), alphabets[lang])), lang, "s") for i, lang in enumerate(["aa", "bb", "cc"] * 25)]
    rows += [(3, rows[3][1], "aa", "s"), (200, "ab " * 50_000, "aa", None), (201, "q", None, None), (None, "xyz xyz", "bb", None)]
    profiles = {}
    for lang in alphabets:
        total = Counter()
        for i, t, own, _ in rows:
            if own == lang and zlib.crc32((str(i) if i is not None else "").encode()) % 3 != 1:
                total.update(brute_grams(t))
        profiles[lang] = {g: n for n, g in enumerate(brute_order(total))}
    got = language_id.identify(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t, *_ in rows:
        own = brute_order(brute_grams(t))
        away = {lang: sum(abs(p[g] - n) if g in p else language_id.TOP for n, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        assert by_id[i].lang_pred == best and by_id[i].score == pytest.approx(1 - away[best] / (language_id.TOP * len(own)))
    assert language_id.identify(frame(spark, [])).count() == 0


def test_language_counts_by_brute_force(monkeypatch):
    text = "Ab, c Éa" * 40
    want = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f" {w} "
        for n in (1, 2, 3):
            want.update(g for j in range(len(padded) - n + 1) if (g := padded[j : j + n]).strip() and len(g) == n and " " not in g[1:-1])
    for piece in (1 << 20, 7, 3):
        monkeypatch.setattr(language_id, "PIECE", piece)
        grams, counts = language_id.ngram_counts(text)
        assert sorted(counts.tolist()) == sorted(want.values()) and len(grams) == len(want)


def test_sketch_bitmap(spark):
    rng = random.Random(8)
    known = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(500)] + [-(1 << 63), (1 << 63) - 1, 0, -1]
    asked = [*known, *(x ^ 1 for x in known), *(x ^ (1 << 40) for x in known), None]
    sketch = spark.createDataFrame([(x, 1) for x in known], "hash long, place int")
    got = decontamination._maybe(spark.createDataFrame([(x, "r") for x in asked], "hash long, _key string"), sketch)
    places = {x % decontamination.BITMAP for x in known}
    assert got.columns == ["hash", "_key"]
    assert Counter(r[0] for r in got.collect()) == Counter(x for x in asked if x is not None and x % decontamination.BITMAP in places)


@pytest.mark.parametrize("broadcast_bytes", [decontamination.BROADCAST_BYTES, -1])
def test_contained_items(spark, corpus, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", broadcast_bytes)
    rng = random.Random(6)
    items = [(1, " ".join(prose(rng, 30))), (2, " ".join(prose(rng, 12))), (3, "three Word item"), (4, None), (5, ""), (6, "absent"), (1, "again other words here now")]
    rows = list(corpus[:60])
    parts = items[0][1].split()
    rows += [(900, " ".join(prose(rng, 500) + parts + prose(rng, 500)), None, None), (901, " ".join(parts[:27] + ["x"] + parts[28:]), None, None), (902, " ".join(parts[:15]), None, None), (903, "Three word ITEM", None, None), (904, " ".join(prose(rng, 30000) + items[1][1].split()), None, None), (None, items[1][1], None, None)]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_item int")
    got = sorted((r.doc_id or -1, r.item_id, r.n_item, r.n_shared) for r in decontamination.contained_items(frame(spark, rows), bench).collect())

    def grams(text, n):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = {}
    for d, t, *_ in rows:
        for i, q in items if d is not None else ():
            n = min(5, len((q or "").split()))
            own = grams(q, n) if n else set()
            both = len(own & grams(t, n)) if n else 0
            if own and both * 100 >= 80 * len(own):
                want[(d or -1, i)] = max(want.get((d or -1, i), (0, 0, 0)), (both / len(own), both, len(own)))
    assert got == sorted((d, i, n, s) for (d, i), (_, s, n) in want.items())
    assert {900, 901, 903, 904} <= {r[0] for r in got}
    left = {r.doc_id for r in decontamination.decontaminate(frame(spark, rows), bench).collect()}
    assert left == {d for d, *_ in rows if d is not None} - {d for d, *_ in got if d != -1}  # the null doc_id holds an item
    assert decontamination.decontaminate(frame(spark, [(None, "a b", None, None), (904, "a b", None, None), rows[-2]]), bench).count() == 2
    assert decontamination.contained_items(frame(spark, rows), bench.where("false")).count() == 0
    assert decontamination.contained_items(frame(spark, []), bench).count() == 0


def test_line_dedup(spark):
    rng = random.Random(7)
    pool = ["\n".join(prose(rng, 5)) for _ in range(6)]
    rows = [(i, "\n".join(x for _ in range(rng.randrange(6)) for x in rng.choice(pool).split("\n")[rng.randrange(2) :]), None, None) for i in range(40)]
    rows += [(50, None, None, None), (51, "a\nb", None, None), (52, "a\nb", None, None), (53, "x\ny\nz\nx\ny\nz", None, None), (54, "\n\n\n\n\n", None, None), (55, "p\nq\nr", None, None), (55, "p\nq\nr", None, None)]
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(frame(spark, rows)).collect() if r.text is not None)
    seen, want, done = {}, [], set()
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        if t is None:
            continue
        lines, cut = t.split("\n"), set()
        for i in range(len(lines) - 2):
            if seen.setdefault(tuple(lines[i : i + 3]), (d, t, i)) != (d, t, i):
                cut |= {i, i + 1, i + 2}
        want.append((d, "\n".join(x for i, x in enumerate(lines) if i not in cut), len(lines), len(cut)))
    assert got == sorted(want)


def test_passage_dedup(spark):
    rng = random.Random(8)
    fresh = iter(range(10**6))
    new = lambda n: [f"w{next(fresh)}" if rng.random() < 0.5 else rng.choice("abcde") for _ in range(n)]
    long, edge, short, base = new(81), new(50), new(34), new(120)
    rows = [(0, " ".join(new(30) + long + new(30)), None, None), (1, " ".join(edge), None, None), (2, " ".join(short), None, None), (3, " ".join(base), None, None)]
    rows += [(10, "  one two " + " ".join(long) + "\tend\n", None, None), (11, "\n".join(edge), None, None), (12, " ".join(short), None, None), (13, None, None, None), (14, "", None, None), (15, " \n", None, None)]
    rows += [(16, "\n ".join(" ".join(base[i : i + 7]) for i in range(0, 120, 7)), None, None), (17, " ".join(base[20:75] + new(9) + base[60:115]), None, None), (18, " ".join(["z"] * 90), None, None), (1, " ".join(edge), None, None)]
    for i in range(20, 50):
        at = rng.randrange(60)
        rows.append((i, " ".join(new(rng.randrange(20)) + base[at : at + rng.randrange(60)] + new(rng.randrange(60)) + long[:55]), None, None))
    found = line_dedup.dedup_passages(frame(spark, rows)).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(rows) and sum(r.doc_id == 1 and r.n_words_removed == 0 and r.text == " ".join(edge) for r in found) == 2
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    earlier, passages = set(), set()
    for d, t, *_ in sorted({(r[0], r[1]) for r in rows}, key=lambda r: r[0]):
        left, w = got[d].text, (t or "").split()
        assert (left is None) == (t is None) and got[d].n_words == len(w) and len((left or "").split()) == len(w) - got[d].n_words_removed
        assert not runs((left or "").split(), 50) & earlier
        if d != 18:  # no passage within itself: what goes lies in repeated runs of 35 words
            covered = {j for i in range(len(w) - 34) if tuple(w[i : i + 35]) in passages for j in range(i, i + 35)}
            assert got[d].n_words_removed <= len(covered)
            kept = iter(w)
            assert all(x in kept for x in (left or "").split())
        earlier |= runs(w, 50)
        passages |= runs(w, 35)
    assert got[12].text == rows[6][1] and got[14].text == "" and got[15].text == " \n" and got[10].text.startswith("  one two ") and got[10].text.endswith("\tend\n")
    assert got[10].n_words_removed > 81 - 30 and got[11].n_words_removed >= 35 and got[16].n_words_removed >= 90 and got[17].n_words_removed > 50
    assert all(r.n_removed == 0 for r in line_dedup.dedup_lines(frame(spark, [r for r in rows if r[0] in (0, 1, 10)])).collect())  # three-line windows find none of these


def test_pfair_mix(spark):
    rows = [(i, f"t{i}", "en", s) for i, s in enumerate(["src0"] * 170 + ["src1"] * 30 + ["src2"] * 5 + ["else"] * 9 + [None] * 4)] + [(1, "t1", "en", "src0")]
    weights = {"src0": 5, "src1": 2, "src2": 3, "src9": 4}
    got = mixing.pfair_mix(frame(spark, rows), weights, other=1, block_rows=4).collect()
    assert Counter(r.doc_id for r in got if r.epoch == 0) == Counter(r[0] for r in rows)
    order = {}
    for r in got:
        assert order.setdefault(r.position, (r.mix_source, r.block)) == (r.mix_source, r.block)
    assert sorted(order) == list(range(len(order)))
    present = {"src0": 5, "src1": 2, "src2": 3, mixing.OTHER: 1}
    total, done = sum(present.values()), Counter()
    for t in range(len(order)):
        done[order[t][0]] += 1
        assert all(abs(done[s] - w * (t + 1) / total) < 1 for s, w in present.items())
    assert mixing.pfair_mix(frame(spark, [])).count() == 0
    assert mixing.pfair_mix(frame(spark, rows), {}, block_rows=4).count() == len(rows)
    clash = frame(spark, rows).withColumn("epoch", F.lit("x")).withColumn("block", F.lit(1)).withColumn("position", F.lit(1)).withColumn("place", F.lit(1)).withColumn("mix_source", F.lit("q"))
    assert sorted(mixing.pfair_mix(clash, weights, other=1, block_rows=4).select("doc_id", "position", "place").collect(), key=str) == sorted(((r.doc_id, r.position, r.place) for r in got), key=str)
    with pytest.raises(Exception, match="epochs of source"):
        mixing.pfair_mix(frame(spark, rows), weights, other=1, block_rows=4, most_epochs=2).collect()
    with pytest.raises(ValueError):
        mixing.pfair_mix(frame(spark, rows), {None: 2})
    with pytest.raises(ValueError):
        mixing.pfair_mix(frame(spark, rows), {"a": 0})


def spark_hash(*values):
    """Spark's xxhash64 of an int and then a long; a null leaves the hash as it is."""
    h = 42
    for form, v in zip(("<i", "<q"), values, strict=True):
        h = h if v is None else xxhash.xxh64_intdigest(struct.pack(form, v), seed=h)
    return h


def brute_shards(rows, shards):
    """doc_id, source, shard, slot: ranks by sorting, cut by counting."""
    by_source = {}
    for d, s in rows:
        by_source.setdefault("-" if s is None else "+" + s, []).append((spark_hash(17, d), d is not None, d or 0, s))
    ranked = []
    for name, own in by_source.items():
        ranked += [((i + 0.5) / len(own), name, *x) for i, x in enumerate(sorted(own, key=lambda x: x[:3]))]
    ranked.sort(key=lambda x: x[:5])
    out, slots = [], Counter()
    for i, (_, _, _, known, d, s) in enumerate(ranked):
        shard = i * shards // len(ranked)
        out.append((d if known else None, s, shard, slots[shard]))
        slots[shard] += 1
    return out


def test_op10_query(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.op10_sharding(spark, d).collect()
    want = {(i, s, n) for i, _, s, n in brute_shards([(i, r.source) for i, r in texts.items()], 16)}
    assert {(r.doc_id, r.shard, r.slot) for r in got} == want and len(got) == len(texts)
    for r in got:
        raw = (texts[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_shards(spark, corpus):
    rows = [*corpus, *corpus[:5], (None, None, None, None)]
    got = sharding.stratified_shards(frame(spark, rows), 16).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and set(by) == set(range(16))
    sources = Counter(r.source for r in got)
    for s, n in sources.items():
        for k in range(16):
            assert abs(sum(r.source == s and r.shard == k for r in got) - n / 16) <= 2 + len(sources)
    assert sharding.stratified_shards(frame(spark, corpus[:3]), 16).count() == 3
    want = brute_shards([(i, s) for i, _, _, s in rows], 16)
    assert Counter((r.doc_id, r.source, r.shard, r.slot) for r in got) == Counter(want)
    assert sharding.stratified_shards(frame(spark, [])).count() == 0
