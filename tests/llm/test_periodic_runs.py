"""Periodic runs against all periods of all stretches."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from wardline.llm.periodic_runs import periodic_runs

SPACE = r"[^\x20\x09-\x0D]+"
KINDS = "doc_id long, text string, n_words string, Period string"


def all_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(w[i : i + length - p] == w[i + p : i + length] for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text, planted):
    w = re.findall(SPACE, text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if planted and doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, n, len(runs), *best, milli, hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def awkward():
    rng = random.Random(7)
    out = [None, "", " \n\t ", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "a b a b a b a", "x " + "p q r " * 9 + "p q y", "été x " * 8, "a a a a a a b " * 5, "the\x0bthe\x0cthe the the\rthe"]
    for size in (2, 3, 6, 400):
        for _ in range(40):
            n = rng.randint(1, 70)
            w = [f"w{rng.randrange(size)}" for _ in range(n)]
            s, p = rng.randrange(n), rng.randint(1, 1 + n // 5)
            w = [x if i < s or rng.random() < 0.01 else w[s + (i - s) % p] for i, x in enumerate(w)]
            out.append(" ".join(w) + rng.choice(["", "\n"]))
    return [*out, *out[-20:]]


@pytest.mark.parametrize("planted", [False, True])
def test_equals_brute_force(spark, planted):
    texts = awkward()
    ids = [None if i % 41 == 7 else (-i if i % 5 == 0 else 2**60 + i) if i % 3 else i for i in range(len(texts))]
    rows = [(d, t, "x", None) for d, t in zip(ids, texts, strict=True)] + [(5, "z z z z z z z", "x", None)] * 2
    got = sorted((tuple(r) for r in periodic_runs(spark.createDataFrame(rows, KINDS).repartition(3), planted=planted).collect()), key=repr)
    assert got == sorted((plain(d, t, planted) for d, t, *_ in rows), key=repr)
    assert any(r[2] > 1 for r in got)


def test_long_and_empty(spark):
    assert periodic_runs(spark.createDataFrame([], KINDS)).count() == 0
    unit = [f"u{k}" for k in range(5000)]
    text = " ".join(["start", *unit * 4, "u0", "u1", "end", *["na"] * 50_000])
    row = periodic_runs(spark.createDataFrame([(1, text, None, None)], KINDS)).first()
    assert (row.n_words, row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (70_004, 2, 20_004, 50_000, 1, 50_000_000)
    kept = " ".join(["start", *unit, "end", "na"])
    assert row.runs_sha256 == hashlib.sha256(b"1,20002,5000\n20004,50000,1\n").hexdigest() and row.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_query_on_given_texts(spark):
    from wardline.llm.queries import queries

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {(r.doc_id, *plain(r.doc_id, r.text, True)[1:]) for r in rows if len((r.text or "").split()) < 400}
    got = {tuple(r) for r in queries()["op11_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows) and want <= got
