"""Spelling variants against the plain counts and all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from wardline.llm.spelling import checksums, search_shard, spelling_variants

KINDS = "doc_id long, text string, word string, n string, FORM string"


def deletions(w):
    return {w[:k] + w[k + 1 :] for k in range(len(w))}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return a in deletions(b) or b in deletions(a)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def counted(rows, altered):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if altered and doc_id is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def plain(rows, altered):
    n, form, out = counted(rows, altered), {}, {}
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    for w, k in n.items():
        own = [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_size.get(size, []) if near(w, v)]
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * k else None
        out[w] = (len(own), best)
    got = set()
    for w, k in n.items():
        root = w
        while form[root]:
            root = form[root]
        got.add((w, k, out[w][0], form[w], n[out[w][1]] if form[w] else None, root))
    return got


def awkward():
    rng = random.Random(11)
    base = ["".join(rng.choice("abcéÀ÷") for _ in range(rng.randint(6, 11))) for _ in range(40)]
    base += ["common", "commonx", "xcommon", "comon", "aaaaaaa", "aaaaaa", "aaaaaaaa", "Zürich", "ZÜRICH", "zürich", "ab" * 40, "ab" * 40 + "a", "straße", "strasse"]
    words = []
    for k, w in enumerate(base):
        words += [w] * (5 ** (k % 4) + 5)
        for v in sorted(deletions(w))[:2]:
            words += [v] * (5 + k % 7)
        words += [w[:3] + "z" + w[4:]] * (4 + k % 3)
    words += ["chaine"] * 5 + ["chainée"] * 26 + ["chainées"] * 140
    rng.shuffle(words)
    rows, k = [(1, None), (2, ""), (3, " . 1"), (None, "common " * 7), (None, None), (4, "common's Common,COMMON")], 0
    while k < len(words):
        step = rng.choice([1, 10, 200])
        rows.append((rng.choice([k, -k, 2**60 + k]), rng.choice([" ", ", ", "1", "’", "Ā"]).join(words[k : k + step])))
        k += step
    return [*rows, *rows[5:9]]


@pytest.mark.parametrize(("altered", "block"), [(False, 1 << 14), (True, 1 << 14), (True, 8)])
def test_equals_all_pairs(spark, altered, block):
    rows = awkward()
    docs = spark.createDataFrame([(d, t, "x", None, "y") for d, t in rows], KINDS).repartition(3)
    got = [tuple(r) for r in spelling_variants(docs, altered=altered, block=block).collect()]
    want = plain(rows, altered)
    assert len(got) == len(want) and set(got) == want
    assert any(r[3] for r in got) and any(r[5] not in (r[0], r[3]) for r in got)


def test_empty_table(spark):
    assert spelling_variants(spark.createDataFrame([], KINDS)).count() == 0
    assert spelling_variants(spark.createDataFrame([(1, "short words only", None, None, None)] * 9, KINDS)).count() == 0


def test_checksums():
    import numpy as np

    data = np.frombuffer(b"abcdefgh" * 50, np.uint8)
    start, end = np.array([0, 3, 7, 8, 20]), np.array([1, 9, 7, 300, 84])
    seed = np.array([zlib.crc32(f"{d}:".encode()) for d in (1, -2, 3, 4, 5)], np.uint32)
    assert checksums(data, start, end, seed).tolist() == [zlib.crc32(data[a:b].tobytes(), int(s)) for a, b, s in zip(start, end, seed, strict=True)]


def test_search_schemes():
    import pyarrow as pa

    rng = random.Random(3)
    for letters in ("ab", "abc", "abcéÿ", "abcdefghij"):
        for size in (1, 2, 60):
            words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(size)})
            n, indexed = [rng.randint(5, 50) for _ in words], [rng.random() < 0.8 for _ in words]
            got = {}
            for side in (0, 1):
                for r in search_shard(pa.table({"word": words, "n": n, "indexed": indexed}), side).to_pylist():
                    total, best = got.get(r["word"], (0, (0, "")))
                    got[r["word"]] = (total + r["n_near"], min(best, (-r["best_n"], r["best"])))
            own = {x: [(-m, y) for y, m, i in zip(words, n, indexed, strict=True) if i and x != y and near(x, y)] for x in words}
            assert got == {x: (len(ys), min(ys)) for x, ys in own.items() if ys}


def test_query_on_given_texts(spark):
    from wardline.llm.queries import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert {tuple(r) for r in queries()["op13_spelling_variants"](spark, "/root/testdata/sf0.001").collect()} == plain(rows, True)
