"""Packing's ids by runs against the tokenizer, and how often it is asked."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wardline.llm._core import texts
from wardline.llm.packing import KIND, WordEncoder
from wardline.llm.queries import vocabulary

LATIN = [*"abZéÉßÿ19.,-_$<|>", "ing", "</w>", "Þ", "À", "ö", " ", " ", "\n", "\t\v\f\r"]
ODD = ["'", "'s", "'S", "Ÿ", "×", "÷", "µ", "ª", "<|", "<|endoftext|>", "<|ENDOFTEXT|>", "²", "٣", "\x00", "\x1c", "\x7f", "\x85", "\xa0", "　", "́", "̇", "İ", "Σ", "ς", "ﬁ", "日", "ᄒ", "ᅡ", "🙂", "ẞ", "K", "I"]


def same(encoder, rows):
    reference = encoder.tokenizer
    want = [np.array(reference.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in rows]
    assert encoder.encode(texts(pa.array(rows, pa.string()))) == want


@pytest.mark.parametrize("signs", [LATIN, LATIN + ODD, ODD])
def test_ids_are_the_tokenizers(signs):
    r = random.Random(7)
    encoder = WordEncoder(vocabulary(), 500)
    assert encoder.kinds is KIND
    for _ in range(40):
        same(encoder, ["".join(r.choices(signs, k=r.choice([0, 1, 2, 3, 9, 40]))) for _ in range(40)] + [None, "", "x<", "|y"])
    same(encoder, [])
    same(encoder, ["Long" * 5000 + "日本" * 3000])
    assert max(map(len, encoder.runs.young)) <= 64


def test_words_are_learned_once():
    """Cases, signs and junk behind a word ask for no tokens again."""
    encoder = WordEncoder(vocabulary(), 500)
    learn, asked = encoder.learn, []
    encoder.learn = lambda missing: asked.extend(missing) or learn(missing)
    same(encoder, ["Stadt stadt, STADT. (stadt) stadt### été", "Été; ÉTÉ ###stadt,***"])
    assert sorted(asked) == sorted(["stadt", ",", ".", "(", ")", "###", "été", ";", ",***"])
    same(encoder, ["stadt stadt. Été###"])
    assert len(asked) == 9


def test_other_tokenizers_get_whole_chunks(tmp_path):
    with open(vocabulary()) as file:
        cased = json.load(file)
    cased["normalizer"] = None
    (tmp_path / "cased.json").write_text(json.dumps(cased))
    encoder = WordEncoder(str(tmp_path / "cased.json"), 500)
    assert encoder.kinds is not KIND
    assert Tokenizer.from_file(vocabulary()).encode("The").ids != encoder.tokenizer.encode("The").ids
    same(encoder, ["The the, THE. Été 12", "", None, "it's <|endoftext|>"])
