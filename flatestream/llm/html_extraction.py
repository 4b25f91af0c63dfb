"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text without a block element inside. Each block has features of its ancestors'
tags and class words and of its text. The field scores the labels boilerplate and article along the page; Viterbi finds
the best sequence. It is trained here, on pages that a generator writes together with their labels.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TRAINING_PAGES = 400  # the bound of the labelled sample
# Fixed values of HTML.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style iframe noembed noframes xmp textarea".split())
CLOSES_P = BLOCK - {"button", "caption", "legend", "option", "optgroup"}
SELF_NESTING = {"li": {"ul", "ol", "menu", "dir"}, "dd": {"dl"}, "dt": {"dl"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tr": {"table"}, "option": {"select"}}
SAME = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}
DEEPEST = 256  # block elements nested deeper are read as if they stood side by side, as browsers do
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW}
NAMES = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
LONG_REFERENCE = re.compile(r"&#(?:[xX]0*([0-9a-fA-F]*)|0*([0-9]*));?")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# What boilerplate says, whatever its class names; these are features, the field weighs them.
SAYS = re.compile(
    r"\b(copyright|all rights reserved|privacy|terms|cookies?|consent|subscribe|newsletter|sign up|log in|login|register|posted by|written by|repl(?:y|ies)|comments?|share|follow us|read more|related|advertisement|sponsored|great post|thanks for|search|menu|home|contact|previous|next|tags?)\b", re.I
)


@dataclass(slots=True)
class Block:
    text: str
    tags: tuple[str, ...]
    words: frozenset[str]
    linked: int


def unescaped(text: str) -> str:
    """Character references decoded; numbers of many digits, which name no character, give U+FFFD."""
    if "&#" in text:
        text = LONG_REFERENCE.sub(lambda m: "\ufffd" if len(m[1] or m[2] or "") > 7 else m[0], text)
    return html_lib.unescape(text) if "&" in text else text


def leaf_blocks(page: str | None, known: frozenset[str] | None = None) -> list[Block]:
    """Leaf blocks in page order, with references decoded and white space folded; blocks without text are left out.

    A block's tags are its innermost one, then the distinct ones around it; its words are those of the class, id and role of all
    elements around it (of `known` ones only, where given). One pass: no place of the page is read more than a bounded number of times.
    Script, style, iframe, noembed, noframes, xmp and textarea are left out up to their end tag (or the page's end); all other
    elements are read, and their text is for the field to judge. Where a quote in a tag never closes, tags end at the next >.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    opened, around, flat = Counter(), Counter(), Counter()
    parts: list[str] = []
    links, linked = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, ((stack[-1][0],) if stack else ()) + tuple(sorted(opened)), frozenset(around), min(linked, len(text))))
            parts.clear()
        linked = 0

    def read(text: str) -> None:
        nonlocal linked
        if text:
            text = unescaped(text)
            parts.append(text)
            linked += len(text) if links else 0

    def pop() -> None:
        name, names = stack.pop()
        for counter, gone in ((opened, (name,)), (around, names)):
            for x in gone:
                counter[x] -= 1
                if not counter[x]:
                    del counter[x]

    def close(names: tuple[str, ...], walls: frozenset[str] | set[str] = frozenset()) -> None:
        """Pop the innermost element of `names` and what it holds, unless one of `walls` comes first."""
        if not any(n in opened for n in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in walls:
                return
            if stack[i][0] in names:
                while len(stack) > i:
                    pop()
                return

    at, text_from, quotes = 0, 0, True
    last = page.rfind(">")
    while (at := page.find("<", at)) >= 0 and at < last:
        begin = at
        at += 1
        if page.startswith("!--", at):
            read(page[text_from:begin])
            end = page.find("-->", at + 3)
            at = text_from = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith("![CDATA[", at):
            read(page[text_from:begin])
            end = page.find("]]>", at)
            at = text_from = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith(("!", "?"), at):
            read(page[text_from:begin])
            at = text_from = page.find(">", at) + 1
            continue
        closing = page.startswith("/", at)
        m = NAME.match(page, at + closing)
        if not m:
            continue
        end = QUOTED.match(page, m.end()) if quotes else None
        if not end:
            quotes = False
        read(page[text_from:begin])
        at = text_from = end.end() if end else page.find(">", m.end()) + 1
        name, rest = m[0].lower(), page[m.end() : at - 1]
        if name in RAW:
            if not closing:
                end = RAW_END[name].search(page, at)
                at = text_from = end.end() if end else len(page)
            continue
        if name == "a":
            links = 0 if closing else 1
        if name == "br":
            parts.append(" ")
        if name not in BLOCK:
            continue
        flush()
        links = 0
        if closing:
            if flat[name]:
                flat[name] -= 1
            else:
                close((name,))
            continue
        if name in CLOSES_P and stack and stack[-1][0] == "p":
            pop()
        if name in SELF_NESTING:
            close(SAME.get(name, (name,)), SELF_NESTING[name])
        if name in VOID:
            continue
        if len(stack) >= DEEPEST:
            flat[name] += 1
            continue
        found = " ".join(a or b or c for a, b, c in NAMES.findall(rest)) if "=" in rest else ""
        names = frozenset(w.lower() for w in WORD.findall(found)) if found else frozenset()
        names = names if known is None else names & known
        stack.append((name, names))
        opened[name] += 1
        around.update(names)
    read(page[text_from:])
    flush()
    return out


def block_features(blocks: list[Block]) -> list[list[str]]:
    found = []
    for i, b in enumerate(blocks):
        n, share = len(b.text), b.linked / len(b.text)
        f = ["bias", f"leaf={b.tags[0] if b.tags else '-'}", f"length={min(6, n.bit_length() // 2)}", f"linked={0 if share == 0 else 1 if share < 0.5 else 2}", f"first={i == 0}"]
        f += [f"in={t}" for t in set(b.tags)] + [f"word={w}" for w in sorted(b.words)]
        f += sorted({f"says={w.lower()}" for w in SAYS.findall(b.text[:400])}) if n < 400 else []
        f += [f"last={b.text[-1] if b.text[-1] in '.!?:;,…' else 'letter'}", f"sign={any(c in b.text for c in '©®™')}", f"spaces={min(3, b.text.count(' '))}"]
        found.append(f)
    return found


class ChainField:
    """Two labels, 1 for the article. Scores: a weight for each feature and label, for each pair of labels and for the first label."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.move, self.start = move, start
        self.weights = {x: tuple(emit[i].tolist()) for x, i in names.items()}
        self.words = frozenset(x[5:] for x in names if x.startswith("word="))

    def scores(self, blocks: list[Block]) -> list[tuple[float, float]]:
        out = []
        for f in block_features(blocks):
            known = [self.weights[x] for x in f if x in self.weights]
            out.append((sum(w[0] for w in known), sum(w[1] for w in known)))
        return out

    def viterbi(self, blocks: list[Block]) -> list[int]:
        """The best label sequence; of equal ones that with the lower labels."""
        if not blocks:
            return []
        scores = self.scores(blocks)
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = self.start[0] + scores[0][0], self.start[1] + scores[0][1]
        back = []
        for s0, s1 in scores[1:]:
            f0, f1 = a + m00 < b + m10, a + m01 < b + m11
            back.append((int(f0), int(f1)))
            a, b = (b + m10 if f0 else a + m00) + s0, (b + m11 if f1 else a + m01) + s1
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    @classmethod
    def fit(cls, pages: list[tuple[list[Block], list[int]]], rounds: int = 120, decay: float = 1e-3) -> ChainField:
        """Gradient ascent (Adam) on the conditional log-likelihood, all pages side by side."""
        feats = [block_features(b) for b, _ in pages]
        names = {x: i for i, x in enumerate(sorted({x for p in feats for f in p for x in f}))}
        size, most = len(pages), max(len(p) for p in feats)
        x = np.zeros((size, most, len(names)), np.float32)
        y, mask = np.zeros((size, most), int), np.zeros((size, most), bool)
        for i, (p, (_, labels)) in enumerate(zip(feats, pages, strict=True)):
            mask[i, : len(p)] = True
            y[i, : len(p)] = labels
            for j, f in enumerate(p):
                x[i, j, [names[k] for k in f]] = 1
        params = [np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        gold = np.eye(2)[y] * mask[..., None]
        both = mask[:, 1:]
        gold_move = np.einsum("nta,ntb->ab", gold[:, :-1] * both[..., None], gold[:, 1:])
        for step in range(1, rounds + 1):
            emit, move, start = params
            s = x @ emit.astype(np.float32)
            alpha, beta = np.zeros((size, most, 2)), np.zeros((size, most, 2))
            alpha[:, 0] = start + s[:, 0]
            for t in range(1, most):
                alpha[:, t] = np.where(mask[:, t, None], np.logaddexp.reduce(alpha[:, t - 1, :, None] + move, axis=1) + s[:, t], alpha[:, t - 1])
            for t in range(most - 2, -1, -1):
                beta[:, t] = np.where(mask[:, t + 1, None], np.logaddexp.reduce(move + (s[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2), 0)
            log_z = np.logaddexp.reduce(alpha[:, -1], axis=1)
            node = np.exp(alpha + beta - log_z[:, None, None]) * mask[..., None]
            pair = np.exp(alpha[:, :-1, :, None] + move + (s[:, 1:] + beta[:, 1:])[:, :, None, :] - log_z[:, None, None, None]) * both[..., None, None]
            grads = [np.einsum("ntf,nta->fa", x, (gold - node).astype(np.float32)), gold_move - pair.sum((0, 1)), (gold - node)[:, 0].sum(0)]
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                g = g / size - decay * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls(names, *params)


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 5) -> list[tuple[list[Block], list[int]]]:
    """Pages of many layouts with their labels: the generator marks what belongs to the article."""
    rng = random.Random(seed)
    mark = "\x01"
    named = {"alert", "dialog"}  # class words with a meaning; others are no features
    syllables = "an be da en for ge hi in ka lo mu ne or pa que ra so ti un ver wa xi za the and was".split()

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high)))

    def sentence(low: int = 4, high: int = 60) -> str:
        return words(low, high).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def wrap(kinds: list[str], inner: str) -> str:
        head = rng.choice(kinds)
        return f"<{head}>{inner}</{head.split()[0]}>"

    def classed(tag: str, names: str) -> list[str]:
        """A tag with one of the class names, or with one that says nothing, or none."""
        k = len(names.split())
        named.update(names.split())
        return [f'{tag} {rng.choice(["class", "id"])}="{x}"' for x in names.split()] + [f'{tag} class="{unknown()}"'] * (1 + k // 4) + [tag] * (k // 6)

    def unknown() -> str:
        return rng.choice([f"c{rng.randrange(99)}", words(1, 1) + str(rng.randrange(9)), "".join(rng.choices("bcdfghjklmnpqrstvwx", k=3)), f"box-{rng.randrange(9)}"])

    def says(*phrases: str) -> str:
        return rng.choice(phrases) + rng.choice(["", " " + words(1, 5), " " + words(1, 3) + "."])

    def menu() -> str:
        items = "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(rng.randint(2, 9)))
        return wrap(["nav", *classed("div", "nav menu navbar breadcrumb breadcrumbs navigation")], f"<ul>{items}</ul>")

    def advert() -> str:
        return wrap([*classed("div", "ad ads advert advertisement sponsored promo banner"), 'aside class="ad"'], rng.choice([f"<p>{sentence(3, 30)}</p>", sentence(3, 30), f'<a href="#">{words(2, 8)}</a>', f"<p>{says('Advertisement', 'Sponsored')}</p>"]))

    def notice() -> str:
        return wrap([*classed("div", "cookie cookies consent notice newsletter subscribe popup banner gdpr alert"), 'div role="alert"', 'div role="dialog"'], rng.choice([f"<p>{sentence(4, 30)}</p>", f"<p>{says('We use cookies', 'Subscribe to our newsletter', 'Your privacy', 'By using this site you consent to cookies', 'Sign up')}</p>"]) + rng.choice(["", "<button>OK</button>"]))

    def form() -> str:
        return f"<form>{rng.choice(['', '<label>'])}{words(1, 6)}<input name=q><button>{words(1, 2)}</button></form>"

    def comments() -> str:
        talk = lambda: rng.choice([sentence(3, 50), sentence(3, 50), says("Great post!", "Thanks for sharing", "I agree,", "Nice comment", "Reply")])
        inner = "".join(wrap(["p", *classed("div", "comment reply"), "li"], rng.choice(["", f"<p>{words(1, 2)}</p>", f"<p>{says('Posted by', 'Reply', 'Comment by')}</p>"]) + f"<p>{talk()}</p>") for _ in range(rng.randint(1, 5)))
        return wrap([*classed("section", "comments responses discussion"), *classed("div", "comments disqus replies"), 'ol class="comments"'], rng.choice(["", "<h2>Comments</h2>", f"<h3>{words(1, 3)}</h3>"]) + inner)

    def sidebar() -> str:
        inner = "".join(rng.choice([f'<li><a href="#">{words(2, 8)}</a></li>', f"<p>{sentence(3, 30)}</p>", f"<h3>{words(1, 4)}</h3>"]) for _ in range(rng.randint(1, 6)))
        return wrap(["aside", *classed("div", "sidebar related widget recommended popular"), *classed("section", "related sidebar")], inner)

    def share() -> str:
        return wrap(classed("div", "share social sharing tags byline meta"), rng.choice([f'<a href="#">{words(1, 2)}</a> <a href="#">{words(1, 2)}</a>', says("Share", "Posted by", "Written by", "Tags", "Follow us")]))

    def story() -> str:
        parts = [rng.choice(["", f"<h1>{mark}{words(2, 10)}</h1>", f"<h1>{mark}{sentence(1, 12)}</h1>"])]
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14])):
            text = mark + sentence(1, rng.choice([3, 12, 60, 200]))
            if rng.random() < 0.15:
                text += f' <a href="#">{words(1, 4)}</a> {words(0, 9)}'
            parts.append(rng.choice([f"<p>{text}</p>"] * 6 + [f"<p>{text}", f"<p><b>{text}<br>", f"<h2>{mark}{words(1, 8)}</h2>", f"<ul><li>{mark}{sentence(1, 15)}</li><li>{mark}{sentence(1, 15)}</li></ul>", f"<blockquote>{text}</blockquote>", f"<pre>{text}</pre>", f"<div>{text}</div>", f"<table><tr><td>{mark}{words(1, 4)}</td><td>{mark}{words(1, 4)}</td></tr></table>"]))
            if rng.random() < 0.08:
                parts.append(rng.choice([advert, share, sidebar, form, notice, menu])())
        if rng.random() < 0.15:
            parts.append(rng.choice([comments, share])())
        return wrap(["article", "article", "main", *classed("div", "content article post story entry main text body"), 'section class="story"'], "".join(parts))

    out, made = [], []
    for _ in range(n):
        head = f"<html><head><title>{words(2, 10)}</title><style>p{{}}</style></head><body>"
        before = [menu()] * (rng.random() < 0.8) + [wrap(["header", "header", *classed("div", "header masthead top")], f"<h2>{words(1, 4)}</h2><p>{sentence(2, 9)}</p>")] * (rng.random() < 0.4) + [notice()] * (rng.random() < 0.4) + [advert()] * (rng.random() < 0.6) + [form()] * (rng.random() < 0.3)
        after = [sidebar()] * (rng.random() < 0.4) + [comments()] * (rng.random() < 0.4) + [advert()] * (rng.random() < 0.3) + [notice()] * (rng.random() < 0.2) + [form()] * (rng.random() < 0.2) + [menu()] * (rng.random() < 0.2)
        rng.shuffle(before)
        rng.shuffle(after)
        foot = rng.choice([f"<footer>&copy; {words(1, 3)} &middot; {sentence(3, 12)}</footer>", wrap(classed("div", "footer bottom copyright legal"), f"<p>{says('Copyright 2024', 'All rights reserved', '&copy;', 'Terms and privacy')}</p>"), f'<div class="footer"><p>{sentence(3, 12)}</p></div>', f"<footer><p>{sentence(3, 40)}</p></footer>", ""])
        body = story()
        if rng.random() < 0.2:
            body = f"<main>{body}</main>"
        made.append(head + "".join(before) + body + "".join(after) + foot + "</body></html>")
    for page in made:
        blocks = leaf_blocks(page, frozenset(named))
        labels = [int(mark in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(mark, "") or "-"
        if sum(labels):
            out.append((blocks, labels))
    return out


def train(n: int = TRAINING_PAGES) -> ChainField:
    return ChainField.fit(labelled_pages(n))


def extract(pages: DataFrame, field: ChainField | None = None) -> DataFrame:
    """All columns of pages but html, then text and n_chars (its code points).

    The text joins the blocks labelled as article, in page order, by one \\n. A null or empty page, or one without an
    article block, has the empty text and 0. Unclosed and stray tags, comments and quotes are read as far as they go. An empty table gives no
    rows. Repeated rows stay; columns of pages named text or n_chars are replaced.
    """
    field = field or train()
    kept = [c for c in pages.columns if c not in ("html", "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page in batch.column("html"):
                blocks = leaf_blocks(page.as_py(), field.words)
                texts.append("\n".join(b.text for b, label in zip(blocks, field.viterbi(blocks), strict=True) if label))
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, "text", "n_chars"])

    rows = pages.select(*kept, "html")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "html")
    return rows.mapInArrow(run, f"{schema}, text string, n_chars long" if schema else "text string, n_chars long")
