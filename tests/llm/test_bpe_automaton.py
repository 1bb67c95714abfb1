from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wayline.llm import bpe_automaton as B

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    return B.Codec(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_same_ids_as_the_library(codec, library):
    random.seed(1)
    parts = ["a", "aa", " ", "  ", "\n", "'", "'s", "'ll", "'vex", "é", "²", "½", "日本", "😀", "0", "12", "!", "...", "<|endoftext|>", "\x85", "\x1c", "　", "the", " The", "ing", "--", "\x00", "ſ", "''s", "\r\n"]
    for k in range(4000):
        text = "".join(random.choice(parts if k % 2 else "ab t e=-*") for _ in range(random.randint(0, 30)))
        ids = library.encode(text, add_special_tokens=False).ids
        packed = codec.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids, repr(text)
        assert codec.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_long_words_and_full_tables(codec, library, monkeypatch):
    for text in ("a" * 30000, "=-" * 5000, "thnttible" * 3000, "あ" * 5000):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(B.MergeAutomaton, "TABLE", 3)
    text = "one two three four five six seven eight nine ten unbelievable antidisestablishment"
    assert np.frombuffer(B.Codec(PATH).encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_ids_that_are_no_utf8(codec, library):
    ids = [codec.automaton.ids[b"\xe3"], codec.automaton.ids[b"a"]]
    assert codec.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_rows(docs_of):
    got = B.encode_decode(docs_of([None, "", "Hi there", "Hi there"], [1, 2, 3, None]), PATH, ids=True).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 4 and by[1].n_tokens == by[2].n_tokens == 0 and by[1].ids_sha256 == by[2].ids_sha256 and by[3].ids == by[None].ids
    assert B.encode_decode(docs_of([]), PATH).count() == 0
