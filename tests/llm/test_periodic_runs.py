from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np

from wayline.llm import periodic_runs as R
from wayline.llm import queries
from wayline.llm.common import table


def brute(words):
    """Every stretch of every lag, the smallest lag of each."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_many_texts_together():
    random.seed(3)
    for _ in range(300):
        texts = []
        for _ in range(random.randint(0, 6)):
            letters, words = random.choice([1, 2, 3, 5, 50]), []
            while len(words) < random.randint(0, 220):
                block = [random.randrange(letters) for _ in range(random.randint(1, 30))]
                words += random.choice([block, block * random.randint(2, 7) + block[:random.randint(0, len(block))]])
            texts.append(np.array(words, np.int64))
        assert [[tuple(r) for r in found.tolist()] for found in R.runs_in(texts)] == [brute(t.tolist()) for t in texts]


def test_long_texts_with_one_word_one_long_period_and_nested_runs():
    assert R.runs_in([np.zeros(300_000, np.int64)])[0].tolist() == [[0, 300_000, 1]]
    block = np.random.default_rng(1).integers(0, 3000, 50_000)
    assert R.runs_in([np.concatenate([[7000], np.tile(block, 5), [7001]])])[0].tolist() == [[1, 250_000, 50_000]]
    inner = ([1] * 9 + [2]) * 6
    assert [tuple(r) for r in R.runs_in([np.array(inner)])[0].tolist()] == brute(inner)


def test_words_and_collapsing_in_small_chunks():
    text = b" a b\ta b a\x0bb a b  c \xc2\xa0 a "
    assert [w for c in R.chunks(text, 3) for w in c.split()] == text.split()
    assert R.collapsed(text, 11, np.array([[0, 8, 2]])) == b"a b c \xc2\xa0 a"
    assert R.collapsed(text, 11, np.zeros((0, 3), np.int64)) == b" ".join(text.split())


def test_rows(docs_of):
    loop = "x y z " * 50_000
    got = {r.doc_id: r for r in R.find(docs_of([None, "", " \t ", "a b a b a b a b c", "a b a b a b a b c", loop], [1, 2, 3, 4, None, 6])).collect()}
    assert [got[k].n_words for k in (1, 2, 3)] == [0, 0, 0] and got[1].runs == [] and got[3].text == ""
    assert [tuple(r) for r in got[4].runs] == [(0, 8, 2)] == [tuple(r) for r in got[None].runs] and got[4].text == "a b c"
    assert [tuple(r) for r in got[6].runs] == [(0, 150_000, 3)] and got[6].text == "x y z"
    assert R.find(docs_of([])).count() == 0 and R.digests(R.find(R.planted(docs_of([])))).count() == 0
    by = {r.doc_id: r for r in R.digests(R.find(R.planted(docs_of([None, "", "a b"], [1, 2, None])))).collect()}
    assert by[1].start is None and by[1].n_runs == 0 and by[1].runs_sha256 == hashlib.sha256(b"").hexdigest()


def test_query_against_brute_force(spark):
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    docs = table(spark, "/root/testdata/sf0.001", "documents").collect()
    assert len(got) == len(docs) and sum(r.n_runs > 0 for r in got.values()) > 10
    for d in docs:
        words, h = re.findall(r"[^\x20\x09-\x0D]+", d.text or ""), zlib.crc32(str(d.doc_id).encode())
        n, g = len(words), h // 10
        if n > 6000:
            continue
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = brute(words)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest()
