"""The corpus operators against brute force on small and awkward tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from wardline.llm.exact_dedup import exact_dedup
from wardline.llm.html_extract import html_extract, labelled_pages, train, viterbi
from wardline.llm.language_id import language_id
from wardline.llm.license_scan import license_scan
from wardline.llm.lm_scoring import lm_scoring
from wardline.llm.mixing import Mix, mix_sources
from wardline.llm.ngram_join import ngram_jaccard_join
from wardline.llm.packing import Limits, best_fit, best_fit_packing
from wardline.llm.quality import quality_rules
from wardline.llm.queries import vocabulary
from wardline.llm.substring_dedup import substring_dedup

SPACE = r"[^\x20\x09-\x0D]+"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
BASE = " ".join(f"tok{i}" for i in range(60))
TEXTS = [None, "", "  \n\t", "one", BASE, BASE + "\n", BASE.replace("tok30", "other"), "x " + BASE + " y", "The GNU General Public License here. MIT license", LONG, LONG + " end", "the the the the the the the the the the the", "été à la plage et le soleil", BASE]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, norm string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, ["en", None, "fr"][i % 3], [None, "src1", "src2"][i % 3], None, "a", "b") for i, t in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, empty):
    for op in (exact_dedup, language_id, license_scan, lm_scoring, ngram_jaccard_join, quality_rules, substring_dedup, lambda d: mix_sources(d, Mix({})), lambda d: best_fit_packing(d, vocabulary())):
        assert op(empty).count() == 0
    assert html_extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_substring_dedup(docs):
    got, first = {r.doc_id: r for r in substring_dedup(docs).collect()}, {}
    for i, t in enumerate(TEXTS):
        w, gone = re.findall(SPACE, t or ""), set()
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), i) < i:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_substring_dedup_across_chunks(spark):
    """A window meets its copy in another chunk at every place of a text; null and repeated ids are no source for themselves."""
    passage = [f"p{k}" for k in range(13)]
    rows = [(i, " ".join([*(f"a{i}x{k}" for k in range(i % 7)), *passage, *(f"b{i}x{k}" for k in range(i % 5))])) for i in range(40)]
    rows += [(None, rows[3][1]), (50, "z1 z2 " * 20), (50, "z1 z2 " * 20), (51, None), (52, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for chars in (50, 10**6):
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in substring_dedup(docs, chars).collect())
        assert got == [(-1, 0), (0, 0), *((i, 13) for i in range(1, 40)), (50, 0), (50, 0), (51, 0), (52, 0)]


def test_license_scan(docs):
    got = {r.doc_id: r for r in license_scan(docs).collect()}
    assert (got[8].n_base, got[8].first_word, got[8].last_word, got[8].base_labels, got[8].score) == (2, 1, 6, "gpl,mit", 1.0)
    assert (got[0].n_words, got[0].labels, got[0].first_word) == (0, "", None)


def test_packing(docs):
    rows = best_fit_packing(docs, vocabulary()).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 4096 and {r.doc_id for r in rows} == set(range(len(TEXTS)))


def test_best_fit_keeps_every_constraint():
    import numpy as np

    length = np.array([10, 9, 8, 7, 6, 5, 4, 3, 2, 1] * 20)
    limits = Limits(tokens=20, documents=3, attention=150, weights=(1.0, 1.0, 1.0), rule="dot")
    bins, _ = best_fit(length, limits)
    for b in set(bins.tolist()):
        own = length[bins == b]
        assert own.sum() <= 20 and len(own) <= 3 and (own**2).sum() <= 150


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(docs, n, percent):
    sets = {}
    for i, t in enumerate(TEXTS):
        w = re.findall(SPACE, (t or "").lower())
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(docs, n, percent).collect()}
    assert got == {i: (len(sets[i]), label[i]) for i in sets}


def test_exact_dedup(docs):
    got, norm = {r.doc_id: r for r in exact_dedup(docs).collect()}, [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in TEXTS]
    for i, x in enumerate(norm):
        assert (got[i].keep_id, got[i].group_size, got[i].text_sha256) == (norm.index(x), norm.count(x), hashlib.sha256(x.encode()).hexdigest())


def test_lm_scoring(docs):
    got, c = {r.doc_id: r for r in lm_scoring(docs).collect()}, Counter()
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(TEXTS))]
    toks = [[*re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for t in TEXTS]
    for t, h in zip(toks, held, strict=True):
        c.update(t if not h else [])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(toks):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert got[i].base_score == pytest.approx(base) and got[i].score < 0


def test_html():
    field = train(labelled_pages())
    wrong = total = 0
    for page in labelled_pages(60, 77):
        guess = viterbi([b for b, _ in page], field)
        wrong += sum(g != y for g, (_, y) in zip(guess, page, strict=True))
        total += len(page)
    assert wrong <= 0.03 * total


def test_html_rows(spark):
    page = '<nav><ul><li><a href="/">Home</a></ul></nav><article><h1>A &amp; B</h1><p>One<br>two <b>bold<p>Three</article><footer>&copy; me</footer>'
    got = {r.page_id: r.text for r in html_extract(spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", page[:70])], "page_id long, url string, html string")).collect()}
    assert got[1] == "A & B\n\nOne two bold\n\nThree" and got[2] == got[3] == ""


def field():
    from wardline.llm.html_extract import default_field

    return default_field()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<p class="a>Hello there all.', "Hello there all."),
        ("<p title='it's>Broken quotes, but text.</p><p>More.</p>", "Broken quotes, but text.\n\nMore."),
        ("<body><p>One plain paragraph of words here.</p></body>", "One plain paragraph of words here."),
        ("just text, no markup &amp; all", "just text, no markup & all"),
        ("<div>" * 3000 + "Deep text of a page, here." + "</div>" * 3000, "Deep text of a page, here."),
        ("<nav><a href='/'>Home</a></nav><p>Main text, with a comma.</p><footer>All rights reserved.</footer>", "Main text, with a comma."),
        ("<article><p>a <b>b</b>\n c<script>no()</script></p><!-- <p>no</p> --><p>d&nbsp;e<p>f<img alt='x > y'>g</article", "a b c\n\nd e\n\nfg"),
        ("<article><p>one</p></article", "one"),
        ("<article><p>" + "long text, " * 50_000 + "</p></article>", ("long text, " * 50_000).strip()),
        ("<p>" * 20_000 + "<nav>x</nav", ""),
    ],
)
def test_html_of_awkward_pages(page, text):
    from wardline.llm.html_extract import main_text

    assert main_text(page, field()) == text


def test_html_equals_the_article_of_given_pages():
    """The given pages have one article each, which a plain reading of the element finds."""
    import duckdb

    from wardline.llm.html_extract import leaf_blocks, main_text

    for (page,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        assert main_text(page, field()) == "\n\n".join(b.text for b in leaf_blocks(page) if "article" in b.ancestors)


def test_viterbi_is_the_best_labelling():
    """Against all labellings of short pages."""
    import itertools

    from wardline.llm.html_extract import features

    f = field()
    for page in labelled_pages(40, 12):
        blocks = [b for b, _ in page][:8]

        def total(y, blocks=blocks):
            return sum(f.weights.get(x, (0.0, 0.0))[k] for b, k in zip(blocks, y) for x in features(b)) + sum(f.moves[a, b] for a, b in zip((2, *y), y))

        best = max(itertools.product((0, 1), repeat=len(blocks)), key=total)
        assert total(tuple(viterbi(blocks, f))) == pytest.approx(total(best))


def test_license_scan_by_brute_force(spark):
    """Base places by a search at every word; chains by trying all of them; whole texts and identifiers give their labels."""
    from wardline.llm.license_scan import PHRASES, TEMPLATES

    rng = __import__("random").Random(6)
    vocabulary = "the mit license gnu general public apache cc by is of under software x y".split()
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += [t.upper() for _, t in TEMPLATES] + ["SPDX-License-Identifier: MIT", "spdx license identifier", None, "", "GNU-General\tPublic\nLicense!", "a " * 30_000 + "mit license"]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for phrase, label in PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        want = (len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places})))
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == want
        assert set(got[i].base_labels.split(",")) - {""} <= set(got[i].labels.split(",")) and 0 <= got[i].score <= 1
    for k, (label, _) in enumerate(TEMPLATES):
        assert label in got[150 + k].labels.split(",") and got[150 + k].score == 1
    at = 150 + len(TEMPLATES)
    assert got[at].labels == "mit" and got[at + 1].labels == ""


def test_matching_statistics():
    """Every maximal match is found: the longest run of template words that ends at each word where it can't go on."""
    from wardline.llm.license_scan import Found, compile_licences, matching_statistics

    rng = __import__("random").Random(3)
    words = list("abcd")
    templates = tuple(("t", " ".join(rng.choice(words) for _ in range(25))) for _ in range(4))
    made = compile_licences({}, templates)
    ids = {w: k for k, w in enumerate(sorted({w for _, t in templates for w in t.split()}))}
    for _ in range(30):
        text = [rng.choice(words) for _ in range(40)]
        found = Found([], [])
        matching_statistics([ids[w] for w in text], 0, made, found)
        want = set()
        for t, (_, template) in enumerate(templates):
            own = template.split()
            for i in range(len(text)):
                for p in range(len(own)):
                    n = 0
                    while i + n < len(text) and p + n < len(own) and text[i + n] == own[p + n]:
                        n += 1
                    if n >= 3:
                        want.add((t, p, i, n))
        longest = {}
        for t, p, i, n in want:
            longest[i + n] = max(longest.get(i + n, 0), n)
        assert set(found.matches) <= {(t, p + d, i + d, n - d) for t, p, i, n in want for d in range(n)} and {(i + n, n) for _, _, i, n in found.matches} <= {(e, n) for e, n in longest.items()} | {(i + n - d, n - d) for _, _, i, n in want for d in range(n)}
        covered = {k for _, _, i, n in found.matches for k in range(i, i + n)}
        assert covered == {k for _, _, i, n in want for k in range(i, i + n)}


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in language_id(docs).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.97 * len(rows)


def test_quality(docs):
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert (got[0].n_words, got[0].base_failed, got[0].kept) == (0, True, False)
    assert (got[11].n_words, got[11].n_repeat_words, got[11].base_failed) == (11, 11, True)
    assert got[4].kept and not got[4].base_failed
