"""HTML extraction: held-out accuracy of the field, Viterbi against all label sequences, and page edge cases."""

import itertools
import random
import re
import time

import pytest

from flatestream.llm import html_extraction as h


@pytest.fixture(scope="module")
def field():
    return h.train()


def test_held_out_accuracy(field):
    pages = h.labelled_pages(150, seed=99)
    pairs = [(a, b) for blocks, labels in pages for a, b in zip(labels, field.viterbi(blocks), strict=True)]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.97


def test_viterbi_is_the_best_sequence(field):
    for blocks, _ in h.labelled_pages(25, seed=11):
        blocks = blocks[:9]
        s, best = field.scores(blocks), field.viterbi(blocks)

        def total(y):
            return field.start[y[0]] + sum(s[i][v] for i, v in enumerate(y)) + sum(field.move[a][b] for a, b in zip(y, y[1:]))

        assert total(best) == pytest.approx(max(total(y) for y in itertools.product((0, 1), repeat=len(blocks))))


def test_leaf_blocks():
    found = h.leaf_blocks("<p>a &amp; b\n  c<br>d<p>e<!-- x <p> --><script>'</p>'</script>f</div><li>g<li>h &#233; &unknown; <a href='>'>i</a>")
    assert [b.text for b in found] == ["a & b c d", "ef", "g", "h é &unknown; i"]
    assert h.leaf_blocks(None) == h.leaf_blocks("") == h.leaf_blocks("<p> </p>") == []
    assert [b.text for b in h.leaf_blocks("1 < 2 <b")] == ["1 < 2 <b"]


def test_extract(spark, field):
    page = '<html><body><nav><a href="/">Home</a></nav><article><h1>Title of it</h1><p>A long &lt;first&gt; sentence, with words.</p><p>And a second one here.</article><footer>&copy; us</footer>'
    rows = [(1, "u", page, 5, "t"), (2, None, None, 5, "t"), (3, "u", "", 5, "t"), (3, "u", "", 5, "t"), (None, "u", "<nav><a>x</a></nav>", 5, "t")]
    got = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string"), field).collect()
    texts = {r.page_id: (r.text, r.n_chars) for r in got}
    want = "Title of it\nA long <first> sentence, with words.\nAnd a second one here."
    assert len(got) == 5 and texts[1] == (want, len(want)) and texts[2] == texts[3] == ("", 0)


def test_unknown_class_names(field):
    long = "A sentence with several words, and more of them after the comma. " * 6
    page = f"<div class=hdr><h2>Site</h2></div><div class=c1><h1>The title of the story</h1><p>{long}</p><p>{long}</p></div><div class=c2><p>Posted by admin</p><p>Great post!</p></div><div class=btm>Copyright 2024 Example Inc.</div>"
    blocks = h.leaf_blocks(page, field.words)
    assert [b.text for b, y in zip(blocks, field.viterbi(blocks)) if y] == ["The title of the story", long.strip(), long.strip()]


def test_raw_text_and_embedded_elements():
    found = lambda page: [b.text for b in h.leaf_blocks(page)]
    assert found('<p>a<script src="a.js"/>var leak=1;</script>b</p>') == ["ab"]
    assert found("<p>x <math><mi>y</mi></math> z</p><p><object>shown</object><video>too</video></p><svg>and<p>after") == ["x y z", "shown too".replace(" ", ""), "and", "after"]
    assert found("<textarea><p>no</textarea>yes<style>never closed <p>no") == ["yes"]
    assert found("a&#99999999999999999999;b &#x41;&#0065; &#" + "1" * 6000 + ";") == ["a\ufffdb AA \ufffd"]


@pytest.mark.parametrize("unit, tail", [('<b x="', ""), ('<b x="', ">"), ("<div class=x>a", ""), ('<b x=">"', ""), ("<", ""), ("&#9", ""), ("<li></li><div>", ""), ("</p></x><div>", ""), ("<!-", ""), ("<div class='", ">")])
def test_malformed_pages_take_linear_time(field, unit, tail):
    page = unit * (10_000_000 // len(unit) // (1 if unit[1:2] in ("b", "", "!") or unit[0] == "&" else 10)) + tail
    begun = time.perf_counter()
    blocks = h.leaf_blocks(page, field.words)
    field.viterbi(blocks)
    assert time.perf_counter() - begun < 15
    assert all(len(b.tags) <= len(h.BLOCK) + 1 for b in blocks[:1000])


def brute_text(page, field):
    """The best label sequence by trying all of them, on blocks found by another reading of plain pages: one element after another."""
    blocks = h.leaf_blocks(page)
    assert [b.text for b in blocks] == [" ".join(x.split()) for x in re.findall(r">([^<>]+)<", page) if x.strip()]
    s = field.scores(blocks)
    total = lambda y: field.start[y[0]] + sum(s[i][v] for i, v in enumerate(y)) + sum(field.move[a][b] for a, b in zip(y, y[1:]))
    best = max(itertools.product((0, 1), repeat=len(blocks)), key=total) if blocks else ()
    return "\n".join(b.text for b, y in zip(blocks, best) if y)


def test_query_by_brute_force(spark, field):
    rng = random.Random(21)
    rows = []
    for i in range(40):
        parts = ["".join(f"<{t}>{' '.join(rng.choice('one two three, four. five'.split()) for _ in range(rng.randrange(1, 40)))}</{t}>" for t in rng.choices(["p", "h1", "h2", "footer", "nav", "blockquote", "aside"], k=rng.randrange(1, 5))) for _ in range(2)]
        rows.append((i, f"u{i}", f"<html><body>{parts[0]}<article>{parts[1]}</article></body></html>"))
    got = {r.page_id: r for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), field).collect()}
    for i, url, page in rows:
        want = brute_text(page, field)
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, want, len(want))
    assert h.extract(spark.createDataFrame([], "page_id long, url string, html string"), field).count() == 0
