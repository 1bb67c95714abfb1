from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import functions as F

from wayline.llm import crf_quality as C

SF = "/root/testdata/sf0.01"


def test_marginals_are_those_of_all_labellings():
    lines = C.lines_of([b"One line.\nTWO!! LINES!!\n\nThree | three | three", b"", b"x"])
    rng = np.random.default_rng(0)
    w, t = rng.normal(size=C.N_FEATURES), rng.normal(size=(2, 2))
    good = C.marginals(lines, w, t)
    ends = [*lines.first[1:], len(lines.features)]
    assert [b - a for a, b in zip(lines.first, ends)] == [3, 1, 1]
    for a, b in zip(lines.first, ends):
        s = lines.features[a:b] @ w
        total, each = 0.0, np.zeros(b - a)
        for labels in product((0, 1), repeat=b - a):
            p = np.exp(sum(s[k] * y for k, y in enumerate(labels)) + sum(t[x, y] for x, y in zip(labels, labels[1:])))
            total += p
            each += p * np.array(labels)
        assert np.allclose(each / total, good[a:b])


def test_features_do_not_depend_on_the_batch():
    texts = [b"a b c", b"", b"One one one\nTwo", "É è 12".encode(), b"x" * 5000]
    together = C.lines_of(texts)
    apart = np.concatenate([C.lines_of([t]).features for t in texts])
    assert np.allclose(together.features, apart)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = C.score(docs, C.fit(docs, labels, sample=400)).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    assert all(0 <= r.score <= 1 for r in rows)


def test_nulls_empty_and_unlabelled(spark, docs_of):
    docs = docs_of([None, "", "Fine words here.", "Fine words here."], [1, 2, 3, None])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = C.fit(docs, labels)
    got = C.score(docs, model).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.5} and not any(r.predicted for r in got)
    assert C.score(docs_of([]), model).count() == 0
    assert C.keep_good(docs, model).count() == 0 and C.keep_good(docs, model, threshold=0.5).columns == docs.columns


def test_held_out_is_the_checksum(spark):
    import zlib
    got = spark.range(200).select("id", C.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)
