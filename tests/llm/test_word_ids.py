"""Ids of words: what the encoder looks up and learns, and that the library gives the same."""

from __future__ import annotations

import random

import public_tokenizers
from tokenizers import Tokenizer

from windrose.llm import packing

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ATOMS = ["a", "B", "J", "word", "WORD", "é", "É", "J̌", "ǰ", "̈", "İ", "Σ", ".", ",", "'s", "'S", "!", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "1", "23", "—", " ", "\n", "\x0b", "\x1c", "\x85", "\xa0", "\x01", "中", "̸", "-", "|"]


def test_words_that_differ_in_case_and_symbols_behind_them_are_learnt_once() -> None:
    encoder = packing.WordEncoder(TOKENIZER)
    texts = ["Word, word WORD. (word; Words", "", "word?! WORD,"]
    want = [Tokenizer.from_file(TOKENIZER).encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder.encode([t.encode() for t in texts])] == want
    assert {*encoder.known} == {b"", b"word", b"words", b"(word", b",", b".", b";", b"?!"}


def test_ids_are_those_of_the_library_on_made_up_words() -> None:
    draw, encoder, library = random.Random(3), packing.WordEncoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for _ in range(600):
        texts = ["".join(draw.choice(ATOMS) for _ in range(draw.randrange(14))) for _ in range(draw.choice((1, 2, 9)))]
        got = [x.tolist() for x in encoder.encode([t.encode() for t in texts])]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
