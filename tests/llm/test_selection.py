"""Mixing, exact and near duplicates, packing and language identification by brute force, on rows with nulls, repeats and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardline.llm import language_id as LID
from wardline.llm import ngram_join as N
from wardline.llm.exact_dedup import exact_dedup, keep_first_copies
from wardline.llm.mixing import HASH_BUCKETS, Mix, leaf_budgets, mix_sources, taken_columns
from wardline.llm.ngram_join import keep_one_of_each
from wardline.llm.packing import Limits, best_fit_packing, pack_pieces, token_pieces
from wardline.llm.queries import vocabulary
from wardline.llm._core import texts

SPACE = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, __id string, __domain string, __row string, of string, sha string, n long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, "a", "b", "c", "d", "e", 7) for i, t, lang, source in rows], SCHEMA)


def shares(tokens, mix):
    """The tree divided by plain recursion."""
    out = {}

    def usable(p):
        if len(p) == 3:
            return mix.max_epochs * tokens[p]
        return sum(usable(c) for c in children(p) if mix.weights.get(c, 1.0) > 0)

    def children(p):
        return sorted({leaf[: len(p) + 1] for leaf in tokens if leaf[: len(p)] == p})

    def divide(p, amount):
        if len(p) == 3:
            out[p] = amount
            return
        own = children(p)
        weight = {c: mix.weights.get(c, 1.0) for c in own}
        room = {c: usable(c) if weight[c] > 0 else 0 for c in own}
        share = dict.fromkeys(own, 0.0)
        left, open_ = min(amount, sum(room.values())), [c for c in own if weight[c] > 0 and room[c] > 0]
        while open_ and left > 1e-9:
            unit = left / sum(weight[c] for c in open_)
            full = [c for c in open_ if room[c] <= unit * weight[c]]
            for c in full or open_:
                share[c] = room[c] if full else unit * weight[c]
            if not full:
                break
            left -= sum(room[c] for c in full)
            open_ = [c for c in open_ if c not in full]
        for c in own:
            divide(c, share[c])

    divide((), mix.budget * sum(tokens.values()))
    return out


MIXES = [
    Mix({}, 0.5, 2), Mix({}, 1.0, 1), Mix({("d1",): 0.0}, 0.6, 1), Mix({("d0",): 5.0, ("d0", "en"): 3.0, ("d1", "fr", "src1"): 0.0}, 0.9, 3),
    Mix({("d0", "en"): 0.0, ("d-",): 9.0}, 1.0, 4), Mix({("d0",): 0.0, ("d1",): 0.0, ("d2",): 0.0, ("d-",): 0.0}, 0.5, 1),
]


@pytest.mark.parametrize("mix", MIXES)
def test_mixing(spark, mix):
    r = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 40))), r.choice(["en", "fr", None]), r.choice(["src0", "src1", "src2", "odd", None])) for i in range(300)]
    rows += [(None, "null id " * (k % 9), "en", "src1") for k in range(80)] + [(5, "again and again", "en", "src2")] * 50 + [(5, "again and again", "fr", "src1")] * 9 + [(7, None, "en", None)] * 3
    docs = table(spark, rows)
    domain = lambda s: f"d{int(s[3:]) % 4}" if s and s.startswith("src") else "d-"
    leaf = lambda x: (domain(x[3]), x[2] or "", x[3] or "")
    n = lambda t: len(re.findall(SPACE, t or ""))
    tokens = Counter()
    for x in rows:
        tokens[leaf(x)] += n(x[1])
    plan = shares(tokens, mix)
    got = leaf_budgets(spark.createDataFrame([(*p, t) for p, t in tokens.items()], "domain string, lang string, source string, n long"), mix)
    assert {(x.domain, x.lang, x.source): x.share for x in got.collect()} == pytest.approx(plan)
    marks = [x[0] for x in docs.select(F.xxhash64("doc_id", "text")).collect()]
    epochs = {p: int(plan[p] / t + 1e-12) if t else mix.max_epochs for p, t in tokens.items()}
    order = spark.createDataFrame([(k, epochs[leaf(x)], m) for k, (x, m) in enumerate(zip(rows, marks, strict=True))], "k int, full int, m long")
    h = {x[0]: x[1] for x in order.select("k", F.xxhash64(F.lit(mix.seed), "full", "m")).collect()}
    want = Counter()
    for p, t in tokens.items():
        own = sorted((k for k, x in enumerate(rows) if leaf(x) == p), key=lambda k: ((h[k] % 2**64 >> 20) % HASH_BUCKETS, h[k], n(rows[k][1])))
        rest, upto = (int(plan[p] - epochs[p] * t + 1e-9) if epochs[p] < mix.max_epochs else 0), 0
        for k in own:
            want.update((*rows[k], e) for e in range(epochs[p]))
            upto += n(rows[k][1])
            if upto <= rest and epochs[p] < mix.max_epochs:
                want[(*rows[k], epochs[p])] += 1
    taken = taken_columns(docs)
    assert taken.domain == "___domain"
    out = mix_sources(docs, mix)
    assert out.columns[: len(docs.columns)] == docs.columns
    found = out.collect()
    weight = lambda c: sum(n(k[1]) * v for k, v in c.items())
    have = Counter((x.doc_id, x.text, x.lang, x.source, x[taken.epoch]) for x in found)
    words = lambda c: Counter({k: v for k, v in c.items() if n(k[1])})  # noqa: E731 - rows without words at a prefix's end may fall either way
    assert words(have) == words(want) and weight(have) <= sum(plan.values()) + 1e-6


def test_exact_dedup_and_first_copies(spark, monkeypatch):
    rows = [(1, "a b", "x", "s"), (1, "a  b", "y", "s"), (2, "x y", "x", "s"), (2, "q", "x", "s"), (1, "q", "x", "s"), (None, "n", "x", "s"), (None, "n ", "x", "s"), (3, None, "x", "s"), (4, "", "x", "s")]
    rows += [(10 + i, "hot\ttext" if i % 2 else "hot text", "x", "s") for i in range(200)]
    docs = table(spark, rows)
    monkeypatch.setattr("wardline.llm.exact_dedup.HOT", 4)  # the hot text is one
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    ids = defaultdict(list)
    for i, t, *_ in rows:
        ids[norm(t)].append(i)
    win = {t: min((i for i in own if i is not None), default=None) for t, own in ids.items()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(repr((i, win[norm(t)], len(ids[norm(t)]), i == win[norm(t)], sha(norm(t)))) for i, t, *_ in rows)
    assert sorted(repr(tuple(x)) for x in exact_dedup(docs).collect()) == want
    kept = keep_first_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((x.doc_id if x.doc_id is not None else -1, norm(x.text)) for x in kept.collect()) == sorted((i if i is not None else -1, t) for t, i in win.items())


def linked(texts_, n, percent):
    sets = []
    for t in texts_:
        w = re.findall(SPACE, (t or "").lower())
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    near = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)
    return sets, near


@pytest.mark.parametrize("square", [512, 3])
def test_keep_one_of_each(spark, square, monkeypatch):
    monkeypatch.setattr(N, "SQUARE", square)
    r = random.Random(2)
    base = [[f"w{r.randint(0, 400)}" for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(base[i % 12])
        for _ in range(r.randint(0, 3)):
            w[r.randrange(60)] = f"x{r.randint(0, 9)}"
        rows.append((i, " ".join(["same", "five", "words", "open", "each", "text", *w][r.randint(0, 1) :]), "en", "s"))
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (None, rows[3][1], "en", "s"), (902, "two words", "en", "s"), (903, "Two words", "en", "s")]
    docs = table(spark, rows)
    sets, near = linked([x[1] for x in rows], 5, 80)
    label = [x[0] for x in rows]
    for _ in rows:
        before = list(label)
        for a in range(len(rows)):
            for b in range(a):
                if label[a] is not None and label[b] is not None and near(sets[a], sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    got = keep_one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, (x.doc_id for x in got.collect()))) == sorted(str(x[0]) for x, m in zip(rows, label, strict=True) if x[0] == m)


def test_shared_tokens(spark, monkeypatch):
    monkeypatch.setattr(N, "SQUARE", 4)
    r = random.Random(9)
    rows = sorted({(r.randint(0, 5), g, g % 4) for g in range(60) for _ in range(3)})
    got = {(x.a, x.b): (x["size"], x.overlap) for x in N.shared_tokens(spark.createDataFrame(rows, "token long, g long, size int")).collect()}
    tokens = defaultdict(set)
    for t, g, _ in rows:
        tokens[g].add(t)
    want = {(a, b): (min(a % 4, b % 4), len(tokens[a] & tokens[b])) for a in tokens for b in tokens if a < b and abs(a % 4 - b % 4) <= 1 and tokens[a] & tokens[b]}
    assert got == want


def test_pieces_and_packing(spark):
    from tokenizers import Tokenizer

    r = random.Random(1)
    strange = ["", None, "İstanbul ΣΑΣ", "a\x1cb", "<|endoftext|> x", "ﬁ ½ é", "tab\tnew\nline  two", "12345 don't we'll", "🙂👍🏽 日本語", " lead and trail ", "word " * 5000]
    rows = [(i, t, "en", "s") for i, t in enumerate(strange)] + [(None, "no id", "en", "s")] * 40 + [(3, "again", "en", "s")] * 40
    rows += [(100 + i, "".join(r.choice("ab .,'é\n1Zß") for _ in range(r.randint(0, 80))), "en", "s") for i in range(200)]
    tokenizer = Tokenizer.from_file(vocabulary())
    want = Counter()
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            piece = ids[at : at + 4096]
            want[(i, k, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()))] += 1
    docs = table(spark, rows)
    got = best_fit_packing(docs, vocabulary()).collect()
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    held = defaultdict(list)
    for x in got:
        held[x.sequence_id].append((x.offset, x.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(k[3] * n for k, n in want.items())
    assert len(held) <= -(-total // 4096) + 1
    pieces = token_pieces(docs, vocabulary()).cache()
    sizes = pack_pieces(pieces, bucket_pieces=30).groupBy(F.shiftright("sequence_id", 32)).count().collect()
    assert len(sizes) > 5 and max(x["count"] for x in sizes) <= 90  # null and repeated ids are spread too
    few = pack_pieces(pieces, Limits(documents=5, weights=(1.0, 1.0, 1.0), rule="dot")).groupBy("sequence_id").count().collect()
    assert max(x["count"] for x in few) <= 5


def test_parse_is_greedy_longest_match():
    r = random.Random(5)
    train = "".join(r.choice("abc ") for _ in range(400))
    sym = LID.segments(texts(pa.array([train])))[0]
    moves = LID.automaton_moves(sym).ravel()[None, :]
    learned = bytes(sym)
    rows = ["".join(r.choice("abcd ") for _ in range(r.randint(0, 900))) for _ in range(30)] + ["", "zzz", train]
    s, begin, end, row = LID.segments(texts(pa.array(rows)))
    got = LID.count_phrases(s, begin, end, moves)[0]
    for a, b, n in zip(begin, end, got, strict=True):
        left, phrases = bytes(s[a:b]), 0
        while left:
            size = 1
            while size < len(left) and left[: size + 1] in learned and left[:size] in learned:
                size += 1
            left, phrases = left[size:], phrases + 1
        assert n == phrases
    assert set(row.tolist()) <= set(range(len(rows)))


def test_many_languages(spark):
    r = random.Random(8)
    rows = [(i, " ".join("".join(r.choice(f"{chr(97 + i % 26)}{chr(97 + (i * 7) % 26)}xyz") for _ in range(6)) for _ in range(30)), f"l{i % 70}", "s") for i in range(280)]
    rows += [(900, None, "l1", "s"), (901, "123 !", "l1", "s"), (None, "some text", None, "s")]
    got = {x.doc_id: x for x in LID.language_id(table(spark, rows)).collect()}
    assert len(got) == 283 and got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0
    assert got[None].lang_pred.startswith("l") and all(0 <= x.score <= 1 for x in got.values())


def test_texts_go_to_cells_packed(spark):
    """What comes out of a packed text are its shingles, and it is far less than they are."""
    values = ["", "one", " ".join(f"word{i % 900} ü" for i in range(90_000)), "a b c d", "日本 語 の 文", " ".join(f"w{i % 50}" for i in range(700))]
    rows = N.packed(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string").coalesce(1)).orderBy("doc_id").toArrow()
    batch = rows.combine_chunks().to_batches()[0]
    got = list(N.unpacked_shingles(batch, 3))
    h, bounds = N.shingles(texts(pa.array(values)), 3)
    assert [x.tolist() for x in got] == [h[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert 2 * len(batch.column("packed")[2].as_py()) < 8 * len(got[2]) and batch.column("size").to_pylist() == [len(v.encode()) for v in values]
