"""The pipeline: each stage on what the one before kept, and run() against plain Python over a small table."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from wardline.llm.quality import quality_rules

SPACE = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id string, sha string, n long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(30, 90))) + "." for _ in range(160)]
    texts += [texts[i] + " " for i in range(0, 40, 2)] + [texts[i].replace(".", " end.") for i in range(1, 41, 2)]  # copies and near copies
    texts += [None, "", "few words", "again " * 50, " ".join("#$%&|<>" * 3 for _ in range(40)), texts[5]]
    rows = [(i, t, "en" if i % 3 else "de", f"src{i % 5}", len(t or ""), "a", "b", 1) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([*rows, rows[7], (None, texts[9], None, None, 1, "a", "b", 1)], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def shingles(t):
    w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stages_by_brute_force(spark, folder, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in P.STAGES:
        got = stage(spark, docs, folder)
        if name != "best_fit_packing":
            assert got.columns == columns
        got.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs.collect(), spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = before, docs.collect()
    before, after = out["quality_rules"]
    bad = {r.doc_id for r in quality_rules(spark.read.parquet(f"{folder}/documents.parquet")).collect() if not r.kept}  # held to brute force in test_models
    assert Counter(after) == Counter(r for r in before if r.doc_id not in bad) and bad >= {200, 201, 202, 203, 204} and len(bad) < 20
    before, after = out["exact_dedup"]
    least = {}
    for r in before:
        t = norm(r.text)
        least[t] = min(x for x in (least.get(t), r.doc_id) if x is not None) if (least.get(t), r.doc_id) != (None, None) else None
    assert sorted(map(repr, after)) == sorted(map(repr, {(r.doc_id, norm(r.text)): r for r in before if least[norm(r.text)] == r.doc_id}.values()))
    before, after = out["ngram_jaccard_join"]
    sets, label = [shingles(r.text) for r in before], [r.doc_id for r in before]
    for _ in before:
        old = list(label)
        for a in range(len(sets)):
            for b in range(a):
                if label[a] is not None and label[b] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if old == label:
            break
    assert Counter(after) == Counter(r for r, m in zip(before, label, strict=True) if m == r.doc_id) and len(after) < len(before)
    before, after = out["mix_sources"]
    tokens = lambda rows: sum(len(re.findall(SPACE, r.text or "")) for r in rows)
    assert tokens(after) <= 0.8 * tokens(before) and set(after) <= set(before) and max(Counter(after).values()) <= 2 and tokens(after) > 0.7 * tokens(before)
    before, after = out["best_fit_packing"]
    from wardline.llm.queries import vocabulary

    tokenizer = Tokenizer.from_file(vocabulary())
    want = Counter()
    for r in before:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        want[(r.doc_id, 0, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after) == want
    held = Counter(r.sequence_id for r in after)
    assert max(held.values()) <= 64
    for sequence in held:
        at = 0
        for r in sorted((r for r in after if r.sequence_id == sequence), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert Counter(P.run(spark, folder).collect()) == Counter(after)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
