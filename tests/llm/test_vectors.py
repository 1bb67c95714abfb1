from __future__ import annotations

import math

import numpy as np
import pytest

from wayline.llm import exact_topk, vp_search

SCHEMA = "vec_id long, embedding array<float>, label int, shard int, kind string, VEC_ID string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "k", "x") for i, v in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 6)).astype(np.float32).round(1).tolist()
    x[100:330] = [x[100]] * 230  # a hot vector
    return [*enumerate(x), (700, None), (800, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (900, [float("nan")] + [0.0] * 5), (1000, [0.0] * 6), (None, x[0]), (5, x[5]),
            (1100, [1.0, 2.0]), (1200, [1.5, 2.0]), (1300, [])]


def sound(rows, zero):
    return {i: np.array(v, np.float64) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and (zero or any(v))}


def test_factor_one_is_brute_force(spark, rows):
    x = sound(rows, zero=False)
    want = []
    for q in sorted(i for i in x if i % 100 == 0):
        near = sorted((float(np.sqrt(((x[q] - v) ** 2).sum())), i) for i, v in x.items() if i != q and len(v) == len(x[q]))[:10]
        want += [(q, k + 1, i, round(d, 9)) for k, (d, i) in enumerate(near)]
    got = vp_search.search(frame(spark, rows), shard_rows=100).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == want


def test_recall_of_the_registered_query(spark):
    from wayline.llm.queries import op2_vp_search
    sf = "/root/testdata/sf0.01"
    x = sound([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()], zero=False)
    got = op2_vp_search(spark, sf).collect()
    hits = 0
    for q in {r.query_id for r in got}:
        near = {i for _, i in sorted((((x[q] - v) ** 2).sum(), i) for i, v in x.items() if i != q)[:10]}
        hits += len(near & {r.vec_id for r in got if r.query_id == q})
    assert hits >= 0.9 * len(got)


def test_top_k_is_brute_force(spark, rows):
    x = {i: np.floor(256 * v).astype(int) for i, v in sound(rows, zero=True).items()}
    want = []
    for q in sorted(i for i in x if i % 50 == 0):
        best = sorted((-int(x[q] @ v), i) for i, v in x.items() if i != q and len(v) == len(x[q]))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = exact_topk.search(frame(spark, rows), cells=16, shard_rows=100).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want


def test_few_rows_and_none(spark):
    few = frame(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])])
    assert [(r.vec_id, r.score) for r in exact_topk.search(few).orderBy("rank").collect()] == [(1, 32768), (2, -65536)]
    assert [r.vec_id for r in vp_search.search(few).orderBy("rank").collect()] == [1, 2]
    for search in (exact_topk.search, vp_search.search):
        assert search(frame(spark, [])).count() == 0 and search(frame(spark, [(0, [1.0])])).count() == 0


def test_long_vectors_are_scored_exactly(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=3) * 10.0 ** rng.integers(-1, 9)).tolist()) for i in range(150)]
    rows += [(150, [1e6, 1.0, 0.0]), (151, [3e5, 3e5, -3e5]), (152, [2.0 ** 40, -(2.0 ** 40), 1.0]), (153, [1e30, 0.0, 0.0]), (200, [-1e30, 5.0, 0.0]), (154, [1e305, 1.0, 1.0])]  # the last one's whole numbers are those of doubles
    x = {i: [math.floor(256 * c) for c in v] for i, v in rows}
    limit = 2 ** 63 - 1
    want = []
    for q in sorted(i for i in x if i % 50 == 0):
        best = sorted((-max(-limit, min(limit, sum(a * b for a, b in zip(x[q], v)))), i) for i, v in x.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = exact_topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=40).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
