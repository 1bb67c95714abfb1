from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from wayline.llm import ranked_scan as S

FORM = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(S.TERM, (text or "").translate(FORM))


def brute(docs, items, k):
    tf = [(i, Counter(terms(t))) for i, t in docs if i is not None]
    tf = [(i, c) for i, c in tf if c]
    n, total, df = len(tf), sum(sum(c.values()) for _, c in tf), Counter(t for _, c in tf for t in c)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, c in wanted.items():
        scored = []
        for doc, have in tf:
            m = 75 + 25 * sum(have.values()) * n // total
            score = sum(reps * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * have[t] // (1000 * have[t] + 12 * m)) for t, reps in c.items() if t in have)
            if score > 0:
                scored.append((-score, doc))
        out += [(item, r + 1, doc, -s) for r, (s, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def case():
    random.seed(5)
    words = ["alpha", "Beta", "gamma", "été", "日本", "Z9", "be", "bet", "a", "İ", "ſ", "K"]
    docs = [(i, "".join(random.choice(words) + random.choice([" ", ", ", "\n", "--", " ", "_"]) for _ in range(random.randint(0, 40)))) for i in range(150)]
    docs += [(150, None), (151, ""), (152, " ,;"), (None, "alpha beta"), (153, docs[3][1]), (154, docs[3][1]), (155, "Alpha " * 200_000 + "x" * 10_000)]
    items = [(1, "alpha BETA beta"), (2, "été, 日本 gamma"), (3, "nowhere"), (4, None), (5, ""), (None, "alpha"), (6, "be bet a"), (7, "alpha"), (7, "z9 beta")]
    return docs, items


def rows(df):
    return sorted((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


def test_same_ranking_as_brute_force(spark, docs_of, case, monkeypatch):
    docs, items = case
    d = docs_of([t for _, t in docs], [i for i, _ in docs])
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, TERM int")
    want = brute(docs, items, 5)
    assert rows(S.search(d, q, k=5)) == want
    monkeypatch.setattr(S, "BLOCK_ROWS", 4)  # several automata
    monkeypatch.setattr(S, "CELLS", 8)
    assert rows(S.search(d, q, k=5)) == want


def test_empty_tables(spark, docs_of, case):
    docs, items = case
    none = spark.createDataFrame([], "item_id long, text string")
    assert S.search(docs_of(["alpha"]), none).count() == 0
    assert S.search(docs_of([]), spark.createDataFrame([(1, "alpha")], "item_id long, text string")).count() == 0


def test_segments_cut_no_term():
    random.seed(2)
    for size in (1, 2, 5, 50):
        for _ in range(100):
            text = "".join(random.choice("aB9 ,é-") for _ in range(random.randint(0, 60)))
            got = [w for part in S.segments(text.encode(), size) for w in part.split(b" ") if w]
            assert got == [w.encode() for w in terms(text)]
