"""Embedding near-duplicates against all cosines."""

import math

import numpy as np
import pytest

from wardline.llm.embedding_dedup import Tables, collision, embedding_dedup

KINDS = "vec_id long, embedding array<float>, n_links string, cid string, Component string"


def plain(rows, cosine=0.9):
    n = len(rows)
    units = []
    for i, v in rows:
        good = i is not None and v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v)
        x = np.array(v, np.float32).astype(float) if good else None
        units.append(x / np.linalg.norm(x) if good else None)
    linked = [[k for k in range(n) if k != j and units[j] is not None and units[k] is not None and len(units[j]) == len(units[k]) and units[j] @ units[k] >= cosine] for j in range(n)]
    out, seen = [None] * n, set()
    for j in range(n):
        if j not in seen:
            group, queue = {j}, [j]
            while queue:
                for k in linked[queue.pop()]:
                    if k not in group:
                        group.add(k)
                        queue.append(k)
            seen |= group
            least = min((rows[k][0] for k in group if rows[k][0] is not None), default=None)
            for k in group:
                out[k] = (rows[k][0], len(linked[k]), least, rows[k][0] == least)
    return out


def found(spark, rows, **how):
    docs = spark.createDataFrame([(i, v, "x", "y", None) for i, v in rows], KINDS).repartition(3)
    return [tuple(r) for r in embedding_dedup(docs, **how).collect()]


def families(seed, d=24):
    """Families of different spread, so that balls are whole, apart and opened; copies; and vectors of random direction."""
    rng = np.random.default_rng(seed)
    rows = [rng.standard_normal(d) for _ in range(150)]
    for spread, size in ((0.05, 60), (0.2, 60), (0.3, 80), (0.38, 90), (0.45, 60), (0.6, 40)):
        centre = rng.standard_normal(d)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            step = rng.standard_normal(d)
            rows.append((centre + spread * step / np.linalg.norm(step)) * rng.uniform(0.1, 9))
    copies = [rows[k] for k in rng.integers(0, len(rows), 60)] + [rows[200]] * 30 + [2 * rows[3], -rows[4]]
    vectors = [v.tolist() for v in rows + copies]
    ids = rng.permutation(len(vectors)) - 20
    return [(int(i) if i % 9 else int(i) + 2**60, v) for i, v in zip(ids, vectors, strict=True)]


@pytest.mark.parametrize(("seed", "block"), [(1, 1024), (2, 16)])
def test_equals_all_cosines_when_all_links_are_asked_for(spark, seed, block):
    rows = families(seed)
    assert sorted(found(spark, rows, recall=1 - 1e-9, block=block)) == sorted(plain(rows))


def test_awkward_rows(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 2.0]), (None, None), (7, [1.0, 2.0]), (8, [2.0, 4.0])]
    rows += [(9, [1.0, 2.0, 0.0]), (10, [-1.0, -2.0]), (7, [1.0, 2.0]), (7, [3.0, -1.0]), (11, [-0.0, 1.0]), (12, [0.0, 1.0]), (13, [1e-30, 2e-30]), (14, [1e30, 2e30]), (-5, [5.0])]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [r[:3] + (True,) if r[0] is None else r for r in plain(rows)]
    assert sorted(found(spark, rows), key=key) == sorted(want, key=key)
    assert found(spark, []) == []


def test_recall_and_precision_at_the_threshold(spark):
    """Of pairs just above the threshold at least nine tenths are found; no pair below it is."""
    rng = np.random.default_rng(5)
    rows, d = [], 64
    for k in range(400):
        a, b = rng.standard_normal((2, d))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.901 if k % 2 else 0.898
        rows += [(2 * k, a.tolist()), (2 * k + 1, (c * a + math.sqrt(1 - c * c) * b).tolist())]
    got = {r[0]: r for r in found(spark, rows)}
    assert all(got[4 * k][1] == 0 == got[4 * k + 1][1] for k in range(200))
    assert sum(got[4 * k + 2][1] == 1 and got[4 * k + 3][2] == 4 * k + 2 for k in range(200)) >= 180


def test_collision_probability():
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal(200_000) * 0.447, rng.uniform(0, 2, 200_000)
    assert abs(collision(0.447, 2) - (np.floor((a + b) / 2) == np.floor(b / 2)).mean()) < 0.005
    assert Tables.of(50_000, 0.9, 0.99, 2).projections > Tables.of(500, 0.9, 0.99, 2).projections


def test_query_on_given_vectors(spark):
    from wardline.llm.queries import queries

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries()["op12_embedding_dedup"](spark, "/root/testdata/sf0.01").collect()) == sorted(plain(rows))
