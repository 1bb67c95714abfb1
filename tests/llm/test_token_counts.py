from __future__ import annotations

import random

import public_tokenizers
import pyarrow as pa
import pytest

from wayline.llm import queries
from wayline.llm import token_counts as T
from wayline.llm.common import table

PARTS = ["a", "the", " ", " ", "  ", "\n", "\t", "'s", "'", "é", "日本", "。", "<|endoftext|>", "<|", "|>", "12", "!", "\x85", "\x1c", "　", "​", " ̈", "   x", "\x00", "😀"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_split_texts_have_the_count_of_the_whole(name):
    counter = T.Counter(public_tokenizers.path(name))
    random.seed(7)
    for _ in range(300):
        text = "".join(random.choice(PARTS) for _ in range(random.randint(0, 150)))
        whole = counter.count([text])[0]
        assert sum(counter.count(list(counter.split(text, random.randint(1, 20))))) == whole, repr(text)
        assert sum(counter.count(counter.pieces(text))) == whole, repr(text)


def test_batches_of_bytes_do_not_change_counts(monkeypatch):
    monkeypatch.setattr(T, "KNOWN", 5)
    counter = T.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["word " * k + "é" * (k % 7) for k in range(60)] + [None, "", "x" * 3000, "no end\n" * 2000]
    sizes, tokens = counter.column(pa.array(texts), batch_bytes=100, group_chars=50)
    assert sizes.tolist() == [len((t or "").encode()) for t in texts]
    assert tokens.tolist() == [counter.count([t])[0] if t else 0 for t in texts]


def test_rows(docs_of):
    text = "Hi there <|endoftext|> " * 30000
    got = {r.doc_id: r for r in T.count_tokens(docs_of([None, "", "Hi there", "Hi there", text], [1, 2, 3, None, 5]), public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert (got[1].n_tokens, got[2].n_bytes, got[3].n_tokens, got[None].n_tokens) == (0, 0, 2, 2)
    assert got[5].over_limit and not got[3].over_limit and got[5].n_bytes == len(text)
    assert got[5].n_tokens == T.Counter(public_tokenizers.path("byte_bpe_50k.json")).count([text])[0]
    assert T.count_tokens(docs_of([]), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_query_against_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in queries.op11_token_counts(spark, "/root/testdata/sf0.001").collect()}
    for row in table(spark, "/root/testdata/sf0.001", "documents").collect():
        n = len(library.encode(row.text or "", add_special_tokens=False).ids)
        assert (got[row.doc_id].n_tokens, got[row.doc_id].n_bytes, got[row.doc_id].over_limit) == (n, len((row.text or "").encode()), n > 512)
