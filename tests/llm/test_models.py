"""The language models against plain Python: prediction by partial matching, Kneser-Ney, and the counts of the quality rules."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from wardline.llm import lm_scoring as L
from wardline.llm import quality as Q
from wardline.llm._lookup import HashArrays

SPACE = r"[^\x20\x09-\x0D]+"
TEXTS = ["the cat sat on the mat", "the cat ran", None, "", "zebra ünïcode THE", "a\tb  c\n\nd e f g h i j k", "the the the the the the the the the the the the", "line one\nline one\n \nx # $ %\nline one and so on for ten words", "the cat sat on the mat", "q" * 300]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None, "fr"][i % 3], "x", "y") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0], (None, "the dog", "en", "x", "y")], "doc_id long, text string, lang string, id string, _id string")


def test_hash_arrays():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    keys[:300] >>= np.uint64(40)  # many in one range
    table = HashArrays.of(keys, np.arange(5000.0))
    wanted = np.concatenate([keys, rng.integers(0, 2**64, 5000, dtype=np.uint64)])
    first = {}
    for k, v in zip(keys.tolist(), range(5000)):
        first.setdefault(k, v)
    assert table.get(wanted, -1.0).tolist() == [first.get(k, -1.0) for k in wanted.tolist()]
    assert HashArrays.of(keys[:0], np.zeros(0)).get(wanted, 7.0).tolist() == [7.0] * len(wanted)


def ppm(train, text, order):
    """log10 P of text and its end, by the definition: escape C, full exclusion, the uniform left for what no context has seen."""
    seen = defaultdict(Counter)
    for t in train:
        data = bytes(order) + t + b"\0"
        for i in range(order, len(data)):
            for k in range(order + 1):
                seen[data[i - k : i]][data[i]] += 1
    total = 0.0
    data = bytes(order) + text + b"\0"
    for i in range(order, len(data)):
        out = set()
        for k in range(order, -1, -1):
            left = {s: n for s, n in seen[data[i - k : i]].items() if s not in out}
            if not left:
                continue
            weight = sum(left.values()) + len(left)
            if data[i] in left:
                total += math.log10(left[data[i]] / weight)
                break
            total += math.log10(len(left) / weight)
            out |= left.keys()
        else:
            total -= math.log10(max(1, 256 - len(out)))
    return total


def test_score_is_ppm(docs):
    lower = lambda t: (t or "").encode().lower()  # noqa: E731 - of bytes: A-Z only
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    train = [lower(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    want = sorted(round(ppm(train, lower(t), L.ORDER), 6) for _, t in rows)
    for chars in (50, 10**6):
        assert sorted(round(r.score, 6) for r in L.lm_scoring(docs, chars).collect()) == pytest.approx(want)


def kneser_ney(texts, order):
    """P of each gram by the textbook recursion."""
    grams = Counter()
    for t in texts:
        data = bytes(order - 1) + re.sub(rb"[\t-\r ]+", b" ", (t or "").encode())
        grams.update(data[i : i + order] for i in range(len(data) - order + 1))
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cuts = {}
    for k, level in levels.items():
        c = [max(1, sum(n == i for n in level.values())) for i in (1, 2, 3, 4)]
        y = c[0] / (c[0] + 2 * c[1])
        raw = 1 - 2 * y * c[1] / c[0], 2 - 3 * y * c[2] / c[1], 3 - 4 * y * c[3] / c[2]
        cuts[k] = [0, *(min(hi, max(lo, x)) for x, lo, hi in zip(raw, (0.05, 0.1, 0.15), (0.95, 1.9, 2.85)))]

    def p(g):
        if not g:
            return 1 / 256
        beside = {h: n for h, n in levels[len(g)].items() if h[:-1] == g[:-1]}
        d = cuts[len(g)]
        n = beside[g]
        return (n - d[min(n, 3)] + sum(d[min(m, 3)] for m in beside.values()) * p(g[1:])) / sum(beside.values())

    return {g: p(g) for g in grams}


def test_kneser_ney(docs):
    got = {r.gram: r.log10_p for r in Q.kneser_ney(Q.gram_counts(docs)).collect()}
    want = kneser_ney([r.text for r in docs.collect()], Q.ORDER)
    assert got == pytest.approx({int.from_bytes(g, "big"): math.log10(p) for g, p in want.items()})


def base_rules(text):
    text = text or ""
    w = re.findall(SPACE, text)
    windows = defaultdict(list)
    for i in range(len(w) - 4):
        windows[tuple(w[i : i + 5])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


@pytest.mark.parametrize("entries", [Q.MODEL_ENTRIES, 0])
def test_counts_and_perplexity(docs, entries):
    rows = docs.collect()
    model = kneser_ney([r.text for r in rows], Q.ORDER)
    got = Q.quality_rules(docs, entries=entries).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    for r, g in itertools.zip_longest(sorted(rows, key=key), sorted(got, key=key)):
        want = base_rules(r.text)
        assert (g.doc_id, *(g[c] for c in Q.COUNTS)) == (r.doc_id, *want)
        assert g.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (g.base_failed and g.kept)
        data = bytes(Q.ORDER - 1) + re.sub(rb"[\t-\r ]+", b" ", (r.text or "").encode())
        bits = [-math.log10(model[data[i : i + Q.ORDER]]) for i in range(len(data) - Q.ORDER + 1)]
        assert g.log10_perplexity == pytest.approx(sum(bits) / max(1, len(bits)))
        assert g.log10_word_perplexity == pytest.approx(sum(bits) / max(1, want[0]))


def test_keep_good(spark, docs):
    verdict = defaultdict(bool)
    for r in Q.quality_rules(docs).collect():
        verdict[r.doc_id] |= not r.kept
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in docs.collect() if not verdict[r.doc_id])
