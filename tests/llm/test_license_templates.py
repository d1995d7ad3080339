"""Licence spans and labels against a plain matcher of each template and all chains of its matches."""

import random

import pytest

from wardline.llm.license_scan import TEMPLATES, Found, compile_licences, license_scan, matching_statistics


def maximal(text, template, least=3):
    """(place, word, length) of all common runs that go on neither to the left nor to the right."""
    out = []
    for i in range(len(text)):
        for p in range(len(template)):
            if text[i] == template[p] and not (i and p and text[i - 1] == template[p - 1]):
                n = 0
                while i + n < len(text) and p + n < len(template) and text[i + n] == template[p + n]:
                    n += 1
                if n >= least:
                    out.append((p, i, n))
    return out


def all_chains(matches, size):
    matches = sorted(matches, key=lambda m: (m[1], m[0], m[2]))
    best = []
    for i, (place, word, n) in enumerate(matches):
        got, start = n, word
        for (p2, w2, n2), (b2, s2) in zip(matches[:i], best, strict=False):
            over = max(0, w2 + n2 - word, p2 + n2 - place)
            if w2 < word and p2 < place and word - w2 - n2 <= size and over < n and b2 + n - over > got:
                got, start = b2 + n - over, s2
        best.append((got, start))
    return {(s, w + n - 1, min(1.0, g / size)) for (_, w, n), (g, s) in zip(matches, best, strict=True) if g >= (0.7 * size if size > 8 else size)}


def shared_templates(rng):
    letters = [f"w{k}" for k in range(6)]
    front, middle = ([rng.choice(letters) for _ in range(8)] for _ in range(2))
    out = [front, front + middle]
    for _ in range(4):
        out.append([rng.choice(letters) for _ in range(rng.randint(2, 9))] + rng.choice([middle, front]) + [rng.choice(letters) for _ in range(rng.randint(0, 9))])
    return tuple((f"l{k}", " ".join(t)) for k, t in enumerate(out))


def test_matches_are_each_templates_own():
    rng = random.Random(4)
    for _ in range(40):
        templates = shared_templates(rng)
        made = compile_licences({}, templates)
        ids = {w: k for k, w in enumerate(sorted({w for _, t in templates for w in t.split()}))}
        text = []
        while len(text) < 50:
            own = rng.choice(templates)[1].split()
            a = rng.randrange(len(own))
            text += own[a : a + rng.randint(1, len(own))] + rng.choices(list(ids), k=rng.randint(0, 2))
        found = Found([], [])
        matching_statistics([ids[w] for w in text], 0, made, found)
        want = {(t, *m) for t, (_, template) in enumerate(templates) for m in maximal(text, template.split())}
        assert len(found.matches) == len(set(found.matches)) and set(found.matches) == want


def test_spans_equal_all_chains_of_each_template(spark):
    rng = random.Random(9)
    templates = shared_templates(rng)
    rows = []
    for k in range(150):
        text = []
        while len(text) < rng.randint(5, 60):
            own = rng.choice(templates)[1].split()
            a = rng.choice([0, 0, rng.randrange(len(own))])
            text += own[a : a + rng.randint(2, 20)] + rng.choices(["w0", "w1", "w5", "other"], k=rng.randint(0, 3))
        rows.append((k, " ".join(text).upper() if k % 2 else ", ".join(text)))
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string"), compile_licences({}, templates)).collect()}
    for k, text in rows:
        w = text.lower().replace(",", "").split()
        want = {(label, *s) for label, t in templates for s in all_chains(maximal(w, t.split()), len(t.split()))}
        assert {(s.label, s.first_word, s.last_word, s.cover) for s in got[k].spans} == want
        assert got[k].labels == ",".join(sorted({s[0] for s in want})) and got[k].score == max((s[3] for s in want), default=0.0)


def test_a_template_is_found_whatever_another_goes_on_with(spark):
    """A word is put into each built-in template's words, one that another template goes on with or not: the same labels."""
    every = sorted({w for _, t in TEMPLATES for w in t.split()})
    rng = random.Random(1)
    rows = []
    for _, t in TEMPLATES:
        own = t.split()
        for at in (len(own), rng.randint(1, len(own))):
            rows += [" ".join([*own[:at], w, *own[at:]]) for w in ("zzz", *rng.sample(every, 6))]
    got = [r.labels for r in license_scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)).orderBy("doc_id").collect()]
    for k in range(0, len(rows), 7):
        assert all({*filter(None, got[k].split(","))} <= {*x.split(",")} for x in got[k : k + 7])


@pytest.mark.parametrize(
    ("line", "label"),
    [("GPL-2.0", "gpl"), ("GPL-3.0+", "gpl"), ("GPL-2.0-or-later", "gpl"), ("CC0-1.0", "cc0"), ("0BSD", "bsd"), ("LGPL-3.0-only", "lgpl"), ("LGPL-2.1+", "lgpl"), ("AGPL-3.0-only", "agpl"), ("AGPL-3.0", "agpl"), ("MIT", "mit"), ("Apache-2.0", "apache")],
)
def test_identifiers(spark, line, label):
    row = license_scan(spark.createDataFrame([(1, f"// SPDX-License-Identifier: {line}\nint main")], "doc_id long, text string")).first()
    assert label in row.labels.split(",") and row.score == 1.0
