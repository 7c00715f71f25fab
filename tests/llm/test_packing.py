"""Ids of packed documents against the public library, with and without special tokens."""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leaksieve.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", "  ", "Hello, World's 1st... don't WE'LL 'tis 'd", "É été ÀÉ ñandú straße ÆØÅ", "été ä",
    "İstanbul ΣΑΣ ǅ ﬁ", "a​b a\xa0b \x85c\x1cd", "日本語 текст ١٢٣ ½²", "<|endoftext|> x <|ENDOFTEXT|>y", "$$$%%%&&& a.b,c;d!?",
    "\x00\x01 \x7f", "x" * 300 + "." * 300, "it's'll've 'S 'LL",
]


@lru_cache
def library(special: bool) -> Tokenizer:
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = not special
    return tokenizer


def ids_of(text: str, special: bool) -> list[int]:
    return library(special).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("special", [False, True])
def test_ids_are_those_of_the_library(special):
    rng = random.Random(1)
    made = ["".join(rng.choices("abzß éÉñ'., stdrevlm19$\n|<", k=200)) for _ in range(200)]
    encoder = packing.ChunkEncoder(PATH, memory=500, special=special)
    for low in range(0, len(made), 20):
        for text in (TEXTS, made[low : low + 20]):
            for one, ids in zip(text, encoder.encode([t.encode() for t in text]), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == ids_of(one, special)


def test_special_tokens_are_text_unless_asked_for(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    for special in (False, True):
        (row,) = packing.pack(docs, special_tokens=special).collect()
        assert np.frombuffer(row.ids, "<u4").tolist() == [*ids_of("a <|endoftext|> b", special), packing.END_ID]
    assert 49407 in ids_of("a <|endoftext|> b", True) and 49407 not in ids_of("a <|endoftext|> b", False)
