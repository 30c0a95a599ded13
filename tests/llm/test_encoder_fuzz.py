"""The encoder against the library's plain call: odd characters in all places of a cut."""

import random

import numpy as np
import pytest
from test_operators import tokenizer

from glyphlake.llm import tokenize

FRAMES = ("a{}b", "a{}.b", "a.{}b", "a {} b", "{}a", "a{}", "a,{}.b", "x{}{}y", "Ab{} Cd", "1{}2.", " {}", "{} ", "a\n{}b", "a{}\n", "_{}.", "é{},É")


def same(name, texts):
    t, e = tokenizer(name), tokenize.Encoder(name)
    want = [x.ids for x in t.encode_batch_fast(texts, add_special_tokens=False)]
    wrong = [s for s, ids, w in zip(texts, e.encode_all(texts), want, strict=True) if np.frombuffer(ids, e.dtype).tolist() != w]
    assert not wrong, (name, len(wrong), wrong[:5])


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_latin_character_in_every_place(name):
    points = [*range(0x100), 0x130, 0x131, 0x17F, 0x1E9E, 0x2003, 0x2028, 0x3000, 0x301, 0x4E2D, 0x1F600, 0xFEFF]
    same(name, [f.replace("{}", chr(c)) for c in points for f in FRAMES])


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_fuzzed_strings(name):
    rng = random.Random(name)
    added = [t.content for t in tokenizer(name).get_added_tokens_decoder().values()]
    parts = [*" \n\tabCÉ.,1é'_-!(ßÀİ", "  ", " the", "word", "Foo", "\x1c", "\x1f", "\x85", " ", "́", "日", "😀", *added, *(a.upper() for a in added), "<|", "|>"]
    same(name, ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(50_000)])
