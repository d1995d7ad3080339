"""Main-text extraction from HTML by a linear-chain conditional random field.

A page is cut into leaf blocks: the text between two tags of block elements. Features of a block are its ancestors' tags,
the words of their class, id and role, and a few shapes of its text. The field has two labels, main text and the rest; it is
trained here on labelled pages (TRAINING_PAGES pages made from seeded layouts, whose labels are known) and decodes each page by
Viterbi. Its weights are a table of at most a few thousand numbers, sent to every task.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINING_PAGES = 200
STEPS = 100
SCHEMA = "page_id long, url string, text string, n_chars long"

#: Elements of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img noscript object param".split())
#: Formulas stand in the line, and so do their parts.
INLINE |= frozenset("math annotation menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What these hold is no text of the page, up to their end tag and, where there is none, to the end of the page.
RAW = ("script", "style", "template", "iframe", "textarea", "title")
#: These hold no text either, but end at a block of the page as well, and where the tag closes itself.
DRAWN = ("svg", "select")
BREAKS_OUT = "address article aside blockquote body center dd div dl dt fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td th thead tr ul".split()
#: Elements whose start closes an open p, and elements that close their own kind.
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES_SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: A quoted value ends where a tag may go on; where quotes don't pair up, the tag ends at the next > all the same.
_ATTRIBUTES = r"""((?:"[^"]*"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z)|[^>"'])*+(?=>|\Z)|[^>]*)"""
#: Elements that tell nothing of what they hold, and words of notices, forms and menus.
PLAIN = frozenset("html body div p span center font table tbody tr td pre blockquote h1 h2 h3 ul ol li".split())
NOTICE_WORDS = frozenset("cookie cookies copyright rights reserved privacy terms policy subscribe newsletter login log sign share tweet follow advertisement sponsored comment comments reply menu home search related read more click".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")(?=[\s/>])" + _ATTRIBUTES.replace("(", "(?:", 1) + r"(?:>|\Z).*?(?:</\1\s*>|\Z)"
    r"|<(" + "|".join(DRAWN) + r")(?=[\s/>])" + _ATTRIBUTES.replace("(", "(?:", 1) + r"(?:(?<=/)>|>(?:[^<]|<(?!/?(?:" + "|".join(BREAKS_OUT) + r")[\s/>]|/\2\s*>))*+(?:</\2\s*>)?|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)" + _ATTRIBUTES + r"(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z]+")


class Block(NamedTuple):
    """ancestors and names: each once, whatever the depth."""

    text: str
    parent: str
    ancestors: tuple[str, ...]
    names: tuple[str, ...]
    linked: int


class _Open:
    """The open elements. Counts, so that a block costs no walk up a deep page."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.tags: Counter[str] = Counter()
        self.names: Counter[str] = Counter()
        self.known: tuple[tuple[str, ...], tuple[str, ...]] | None = ((), ())

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.stack.append((tag, names))
        if not self.tags[tag] or any(not self.names[n] for n in names):
            self.known = None
        self.tags[tag] += 1
        self.names.update(names)

    def close(self, names: tuple[str, ...]) -> None:
        """Closes the innermost element of these names and what is open in it."""
        while any(self.tags[n] for n in names):
            tag, own = self.stack.pop()
            self.tags[tag] -= 1
            self.names.subtract(own)
            self.known = None
            if tag in names:
                return

    def above(self) -> tuple[tuple[str, ...], tuple[str, ...]]:
        if self.known is None:
            self.tags, self.names = +self.tags, +self.names
            self.known = tuple(self.tags), tuple(self.names)
        return self.known


def leaf_blocks(page: str) -> list[Block]:
    """Blocks in page order; character references are decoded and white space runs are one space."""
    blocks: list[Block] = []
    open_ = _Open()
    parts: list[str] = []
    links = linked = 0

    def end() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            blocks.append(Block(text, open_.stack[-1][0] if open_.stack else "-", *open_.above(), linked))
        linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        got = html.unescape(raw) if "&" in raw else raw
        parts.append(got)
        linked += len(got) * (links > 0)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = (m[4] or "").lower()
        if not tag:
            if m[1] or m[2]:  # a raw element holds no text of the page and parts what stands beside it only if it is no script
                parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links = 0 if m[3] else 1
            continue
        end()
        if m[3]:
            open_.close((tag,))
        else:
            if tag in CLOSES_P:
                open_.close(("p",))
            if tag in CLOSES_SELF and open_.stack and open_.stack[-1][0] in CLOSES_SELF[tag]:
                open_.close(CLOSES_SELF[tag])
            if tag not in VOID and not (m[5] or "").endswith("/"):
                names = [p for x in _NAMED.findall(m[5] or "") for p in _PART.findall("".join(x).lower())]
                open_.push(tag, tuple(names))
    if at < len(page):
        text(page[at:])
    end()
    return blocks


def features(b: Block) -> list[str]:
    """Where the block stands, and what its text looks like: length, links, ending, capitals, commas, signs, and words that notices use."""
    size = len(b.text)
    out = ["bias", f"size{min(6, int(math.log2(size + 1)) // 2)}", f"link{min(3, 4 * b.linked // max(1, size))}", "parent:" + b.parent]
    out += ["in:" + t for t in b.ancestors]
    out += ["name:" + n for n in b.names]
    if not b.names and set(b.ancestors) <= PLAIN:
        out.append("plain")
    words = b.text.split(" ")
    out.append(f"words{min(5, len(words).bit_length())}")
    if b.text[-1] in ".!?":
        out.append("stop")
    if b.text[0].isupper():
        out.append("capital")
    if "," in b.text:
        out.append("comma")
    if "|" in b.text:
        out.append("bar")
    if "©" in b.text:
        out.append("copyright")
    if len(words) <= 40:
        out += ["word:" + w for w in {w.strip(".,:!?").lower() for w in words} & NOTICE_WORDS]
    return out


class Field(NamedTuple):
    """Feature weights for [rest, main], and moves[from, to]; index 2 of `from` is the page's start."""

    weights: dict[str, tuple[float, float]]
    moves: np.ndarray


#: The layouts of the labelled pages. Names of class or id for each kind of part.
NAMES = {
    "main": ("content", "article", "post", "entry", "story", "body", "main"),
    "nav": ("nav", "menu", "navigation", "navbar", "breadcrumb", "toc", "pagination"),
    "header": ("header", "masthead", "topbar", "banner", "logo"),
    "footer": ("footer", "copyright", "legal", "colophon"),
    "aside": ("sidebar", "aside", "widget", "related", "recommended", "rail"),
    "notice": ("cookie", "notice", "consent", "alert", "banner", "popup", "modal", "subscribe", "newsletter", "gdpr"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion"),
    "form": ("form", "search", "login", "signup", "contact"),
    "comments": ("comments", "comment", "replies", "discussion", "reply", "disqus"),
    "share": ("share", "social", "tags", "meta", "byline"),
}


#: What such parts say, in the labelled pages.
SAID = {
    "nav": ("Home", "Menu", "Search"),
    "header": ("Log in", "Sign up"),
    "footer": ("All rights reserved.", "Privacy policy", "Terms"),
    "aside": ("Related", "Read more"),
    "notice": ("We use cookies.", "Subscribe to our newsletter!"),
    "ad": ("Advertisement", "Sponsored"),
    "form": ("Search", "Login"),
    "comments": ("Comments", "Reply"),
    "share": ("Share", "Tweet", "Follow"),
}


def labelled_pages(count: int = TRAINING_PAGES, seed: int = 5) -> list[list[tuple[Block, int]]]:
    """Pages from seeded layouts; a block is labelled by a mark in its text, which is then taken out."""
    r = random.Random(seed)

    def words(n: int) -> str:
        style = r.choice(["{}", "{}", "{} |", "{}###", "{}***"])
        made = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(n)]
        if made and r.random() < 0.7:
            made[0] = made[0].capitalize()
        if n > 4 and r.random() < 0.6:
            made[n // 2] += ","
        return " ".join(style.format(w) for w in made) + r.choice([".", ".", "", "!"])

    def name(kind: str) -> str:
        return f' {r.choice(["class", "id"])}="{r.choice(NAMES[kind])}{r.choice(["", "", "-box", "_1", " block"])}"'

    def paragraphs(mark: str, low: int, high: int) -> str:
        return "".join(f"<{t}>{mark}{words(r.choice([2, 8, 30, 80]))}" + r.choice(["", "<br>" + words(5)]) + (f"</{t}>" if r.random() < 0.9 else "") for t in r.choices(["p", "p", "p", "p", "h2", "blockquote", "li", "pre"], k=r.randint(low, high)))

    def links(n: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/x">{words(r.randint(1, 3))}</a></{tag}>' for _ in range(n))

    def boilerplate(kind: str) -> str:
        inner = {
            "nav": lambda: f"<ul>{links(r.randint(2, 7))}</ul>",
            "header": lambda: r.choice(["<h1>", "<p>", "<div>"]) + words(3) + links(2, "span"),
            "footer": lambda: r.choice(["&copy; ", "<p>", ""]) + words(r.randint(3, 30)) + links(r.randint(0, 3), "span"),
            "aside": lambda: f"<h3>{words(2)}</h3>" + r.choice([links(4), paragraphs("", 1, 3)]),
            "notice": lambda: paragraphs("", 1, 2),
            "ad": lambda: r.choice([words(r.randint(2, 12)), paragraphs("", 1, 2)]),
            "form": lambda: f"<label>{words(2)}</label><input><button>{words(1)}</button>" + paragraphs("", 0, 1),
            "comments": lambda: f"<h3>{words(2)}</h3>" + "".join(f"<div{name('comments')}>{paragraphs('', 1, 2)}</div>" for _ in range(r.randint(1, 4))),
            "share": lambda: links(3, "span"),
        }[kind]()
        if r.random() < 0.4:
            inner = f"<{(tag := r.choice(['p', 'span', 'h3']))}>{r.choice(SAID[kind])} {words(r.choice([0, 2, 9]))}</{tag}>" + inner
        own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        tag = own if own and r.random() < 0.7 else r.choice(["div", "section", "aside" if kind in ("ad", "comments") else "div"])
        return f"<{tag}{name(kind) if tag != own or r.random() < 0.4 else ''}>{inner}</{tag}>"

    def page() -> list[tuple[Block, int]]:
        kinds = [k for k in ("nav", "header", "notice", "ad", "aside") if r.random() < 0.5]
        r.shuffle(kinds)
        tag = r.choice(["article", "article", "article", "main", "div", "section"])
        inside = f"<h1>\x01{words(6)}</h1>" * (r.random() < 0.8) + paragraphs("\x01", 1, 7)
        for kind in ("ad", "share", "aside", "form", "nav"):
            if r.random() < 0.12:
                inside += boilerplate(kind) + paragraphs("\x01", 0, 2)
        body = f"<{tag}{name('main') if tag in ('div', 'section') or r.random() < 0.3 else ''}>{inside}</{tag}>"
        after = [k for k in ("comments", "aside", "ad", "form", "nav", "share") if r.random() < 0.3] + ["footer"] * (r.random() < 0.85)
        whole = f"<html><head><title>{words(4)}</title></head><body>" + "".join(map(boilerplate, kinds)) + body + "".join(map(boilerplate, after)) + "</body></html>"
        return [(b._replace(text=b.text.replace("\x01", "") or "x"), int("\x01" in b.text)) for b in leaf_blocks(whole)]

    def plain() -> list[tuple[Block, int]]:
        """A page of text alone: paragraphs in the body or deep in elements without names, or no markup at all."""
        deep = r.choice([0, 0, 1, 3, 8])
        inside = r.choice([lambda: paragraphs("\x01", 1, 4), lambda: "\x01" + words(r.choice([3, 20, 60])), lambda: f"<h1>\x01{words(4)}</h1>" + paragraphs("\x01", 1, 3)])()
        whole = r.choice(["<html><body>{}</body></html>", "<body>{}", "{}", "<html><head><title>t</title></head><body>{}</body></html>"]).format("<div>" * deep + inside + "</div>" * deep)
        if r.random() < 0.3:
            whole = boilerplate(r.choice(["nav", "header", "notice"])) + whole
        return [(b._replace(text=b.text.replace("\x01", "") or "x"), int("\x01" in b.text)) for b in leaf_blocks(whole)]

    return [plain() if k % 5 == 4 else page() for k in range(count)]


def _lattice(scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward and backward log sums of one page, and the log partition."""
    n = len(scores)
    forward, backward = np.empty((n, 2)), np.zeros((n, 2))
    forward[0] = scores[0] + moves[2]
    for k in range(1, n):
        forward[k] = scores[k] + np.logaddexp.reduce(forward[k - 1][:, None] + moves[:2], axis=0)
    for k in range(n - 2, -1, -1):
        backward[k] = np.logaddexp.reduce(moves[:2] + (scores[k + 1] + backward[k + 1])[None, :], axis=1)
    return forward, backward, float(np.logaddexp.reduce(forward[-1]))


def train(pages: list[list[tuple[Block, int]]], steps: int = STEPS, decay: float = 0.02) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam."""
    pages = [p for p in pages if p]
    count: dict[str, int] = {}
    for p in pages:
        for b, _ in p:
            for f in features(b):
                count[f] = count.get(f, 0) + 1
    index = {f: k for k, f in enumerate(sorted(f for f, n in count.items() if n >= 3))}
    rows, lengths, gold = [], [], []
    for p in pages:
        lengths.append(len(p))
        gold += [y for _, y in p]
        rows += [[index[f] for f in features(b) if f in index] for b, _ in p]
    x = np.zeros((len(rows), len(index)), np.float32)
    for k, row in enumerate(rows):
        x[k, row] = 1
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    gold = np.array(gold)
    truth = np.eye(2)[gold]
    theta, moves = np.zeros((len(index), 2)), np.zeros((3, 2))
    m, v = [np.zeros_like(theta), np.zeros_like(moves)], [np.zeros_like(theta), np.zeros_like(moves)]
    for step in range(1, steps + 1):
        scores = x @ theta
        expected, moved = np.empty_like(truth), np.zeros((3, 2))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            forward, backward, z = _lattice(scores[a:b], moves)
            expected[a:b] = np.exp(forward + backward - z)
            moved[2] += expected[a] - truth[a]
            if b - a > 1:
                pair = np.exp(forward[:-1, :, None] + moves[None, :2] + (scores[a + 1 : b] + backward[1:])[:, None, :] - z)
                moved[:2] += pair.sum(axis=0)
                np.subtract.at(moved, (gold[a : b - 1], gold[a + 1 : b]), 1)
        for i, (value, slope) in enumerate(((theta, x.T @ (expected - truth) + decay * theta), (moves, moved + decay * moves))):
            m[i] = 0.9 * m[i] + 0.1 * slope
            v[i] = 0.99 * v[i] + 0.01 * slope**2
            value -= 0.15 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return Field({f: (float(theta[k, 0]), float(theta[k, 1])) for f, k in index.items()}, moves)


@cache
def default_field() -> Field:
    return train(labelled_pages())


def viterbi(blocks: list[Block], field: Field) -> list[int]:
    """1 for each block of main text."""
    if not blocks:
        return []
    (s00, s01), (s10, s11), (b0, b1) = field.moves.tolist()
    get, none = field.weights.get, (0.0, 0.0)
    back = []
    for k, b in enumerate(blocks):
        e0 = e1 = 0.0
        for f in features(b):
            w = get(f, none)
            e0 += w[0]
            e1 += w[1]
        if not k:
            a0, a1 = b0 + e0, b1 + e1
            continue
        from0, from1 = a1 + s10 > a0 + s00, a1 + s11 > a0 + s01
        back.append((from0, from1))
        a0, a1 = max(a0 + s00, a1 + s10) + e0, max(a0 + s01, a1 + s11) + e1
    y = [int(a1 > a0)]
    for from0, from1 in reversed(back):
        y.append(int(from1 if y[-1] else from0))
    return y[::-1]


def main_text(page: str, field: Field) -> str:
    blocks = leaf_blocks(page)
    return "\n\n".join(b.text for b, y in zip(blocks, viterbi(blocks, field), strict=True) if y)


def html_extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of pages: page_id, url, text (blocks of main text joined by two line ends; empty if none), n_chars.

    Null and empty html give an empty text. A page that breaks off, unclosed elements and unknown ones are read as far as they go, and a
    tag ends at its >, even where its quotes don't pair up. Very long and very deep pages are read whole. Equal scores go to the rest.
    Repeated rows give repeated results; an empty table none; other columns are ignored.
    """
    trained = field or default_field()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out = [main_text(x, trained) if x else "" for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(extract, SCHEMA)
