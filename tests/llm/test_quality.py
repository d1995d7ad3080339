"""The perplexity bands of the quality rules reject on both sides and keep what is ordinary."""

import random

from wardline.llm.quality import quality_rules


def _text(rng, vocabulary, n=80):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def test_bands_reject_on_both_sides(spark):
    rng = random.Random(7)
    usual = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows = [(i, _text(rng, usual), "en") for i in range(100)]
    rows += [(100, " ".join("".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(80)), "en")]  # the usual letters, in no usual order
    rows += [(101, _text(rng, ["a" * k for k in range(3, 12)]), "en")]  # one letter again and again
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    high, low = got[100], got[101]
    assert not high.base_failed and not low.base_failed
    assert high.log10_perplexity > high.band_upper and not high.kept
    assert low.log10_perplexity < low.band_lower and not low.kept
    assert sum(got[i].kept for i in range(100)) >= 94


def test_passage_in_another_language_is_kept(spark):
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    usual = {lang: [word(letters) for _ in range(300)] for lang, letters in (("en", "aeioulnrst"), ("de", "bcdfghjkmpvwxyzäöü"))}
    rows = [(i, _text(rng, usual[lang]), lang) for i, lang in enumerate(["en", "de"] * 60)]
    rows += [(i, _text(rng, usual["en"], 40) + ". " + _text(rng, usual["de"], 40), lang) for i, lang in ((200, "en"), (201, "de"))]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[200].kept and got[201].kept
