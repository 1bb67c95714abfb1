from __future__ import annotations

import pytest

#: Nulls, empty and long texts, repeats, and columns whose names clash with those that operators use.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, node long, sig string, shard int, kind string, score double"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", f"s{k % 3}" if k % 5 else None, None if t is None else len(t), "clash", 7, "x", 1, "k", 0.5) for k, (i, t) in enumerate(zip(ids, texts))]
        return spark.createDataFrame(rows, SCHEMA).repartition(3)
    return make
