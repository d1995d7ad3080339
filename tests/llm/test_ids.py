"""Ids beyond 2^53, negative and null ones come back as they are, from every operator."""

import pytest

from wardline.llm.exact_dedup import exact_dedup
from wardline.llm.html_extract import html_extract
from wardline.llm.language_id import language_id
from wardline.llm.license_scan import license_scan
from wardline.llm.lm_scoring import lm_scoring
from wardline.llm.mixing import Mix, mix_sources
from wardline.llm.ngram_join import ngram_jaccard_join
from wardline.llm.packing import best_fit_packing
from wardline.llm.periodic_runs import periodic_runs
from wardline.llm.quality import quality_rules
from wardline.llm.queries import vocabulary
from wardline.llm.substring_dedup import substring_dedup

IDS = [2**60 + 1, None, 2**60 + 2, -(2**60) - 3, 0, 1185921234567890123]


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["one two three four five six seven", None, "eight nine ten eleven twelve", "the quick brown fox", "", "lazy dogs and other beasts"]
    return spark.createDataFrame([(i, t, "en", "a", 1) for i, t in zip(IDS, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


OPS = [exact_dedup, language_id, license_scan, lm_scoring, ngram_jaccard_join, periodic_runs, quality_rules, substring_dedup, lambda d: best_fit_packing(d, vocabulary())]


@pytest.mark.parametrize("op", OPS, ids=["exact", "language", "license", "lm", "join", "periodic", "quality", "substring", "packing"])
def test_ids_are_kept(docs, op):
    got = [r.doc_id for r in op(docs).collect()]
    assert sorted(got, key=str) == sorted(IDS, key=str)


def test_mixing_takes_ids_as_they_are(docs):
    got = {r.doc_id for r in mix_sources(docs, Mix({}, budget=3.0, max_epochs=3)).collect()}
    assert got == set(IDS)


def test_page_ids_are_kept(spark):
    pages = spark.createDataFrame([(i, "u", "<p>text</p>") for i in IDS], "page_id long, url string, html string").coalesce(1)
    assert sorted((r.page_id for r in html_extract(pages).collect()), key=str) == sorted(IDS, key=str)
