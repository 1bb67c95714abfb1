from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

from wayline.llm import ngram_jaccard as N
from wayline.llm.components import components


def brute(rows, width, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    top = {i: i for i, _ in rows if i is not None}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for (a, x), (b, y) in combinations([(i, s) for (i, _), s in zip(rows, sets) if i is not None], 2):
        if x and y and den * len(x & y) >= num * len(x | y):
            a, b = sorted((find(a), find(b)))
            top[b] = a
    return sorted((str(i), len(s), str(None if i is None else find(i))) for (i, _), s in zip(rows, sets))


def corpus(seed):
    """Copies of copies, chains around the threshold, and passages that unlike texts share."""
    random.seed(seed)
    words = [f"w{k}" for k in range(400)]
    passage = random.choices(words, k=40)
    texts = [None, "", "  \n", "One", "one", "one two", "Éa b c", "éa b c"]
    for size in (6, 12, 14, 30, 60, 130, 300):
        base = random.choices(words, k=size)
        for _ in range(14):
            own = list(base)
            for _ in range(random.randint(0, max(1, size // 25))):
                k = random.randrange(len(own))
                own[k:k + random.randint(0, 1)] = random.choices(words, k=random.randint(0, 1))
            texts.append(" ".join(own))
            base = own if random.random() < 0.4 else base
        texts += [" ".join(base)] * 3
    texts += [" ".join(random.choices(words, k=random.randint(5, 40)) + passage + random.choices(words, k=4)) for _ in range(40)]
    rows = [*enumerate(texts), (None, "one"), (8, texts[8]), (9, texts[30])]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,num,frequent_from,bits", [(3, 90, 3, 20), (2, 75, 1, 8)])
def test_against_brute_force(docs_of, width, num, frequent_from, bits):
    rows = corpus(width + num)
    docs = docs_of([t for _, t in rows], [i for i, _ in rows])
    got = N.groups(docs, width, num, 100, frequent_from=frequent_from, table_bits=bits).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, width, num, 100)


def test_linked_sets_share_a_signature_whatever_the_classes():
    rng = np.random.default_rng(3)
    for num in (90, 80, 60):
        rule = N.Rule(num, 100)
        for _ in range(400):
            n = int(rng.integers(2, 600))
            x = np.unique(rng.integers(0, 1 << N.TOKEN_BITS, n))
            y = np.unique(np.concatenate([x[rng.random(len(x)) > rng.random() * (1 - num / 100)], rng.integers(0, 1 << N.TOKEN_BITS, int(rng.integers(0, 4)))]))
            both = len(np.intersect1d(x, y))
            if 100 * both < num * (len(x) + len(y) - both) or len(x) < 2 or len(y) < 2:
                continue
            frequent = rng.integers(0, 1 << 63, 1 << 4, dtype=np.uint64) * np.uint64(rng.integers(0, 3))
            common = np.full(1 << 4, (1 << 64) - 1, np.uint64)
            found = []
            for s in (x, y):
                found.append({(int(k), int(p)) for sig, pos in rule.signatures(rule.kept(s), len(s), common, frequent) for k, p in zip(sig, pos)})
            shared = {k for k, _ in found[0]} & {k for k, _ in found[1]}
            assert shared
            ends = [{k: len(s) - p for k, p in f} for f, s in zip(found, (x, y))]
            assert any((num + 100) * min(ends[0][k], ends[1][k]) >= num * (len(x) + len(y)) for k in shared)


def test_one_of_each_group_stays(docs_of):
    long = " ".join(f"v{k}" for k in range(60))
    docs = docs_of([long, long + " more", "other words stand here now", None, None, ""], [5, 3, 9, 1, None, 2])
    out = N.keep_one(docs)
    assert out.columns == docs.columns and sorted(str(r[0]) for r in out.collect()) == ["1", "2", "3", "9", "None"]
    assert N.groups(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        N.Rule(50, 100)


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 180)] + [(7, k) for k in range(300, 340)] + [(340, 1), (5, 5)]
    random.seed(1)
    random.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 100 for k in range(100, 181)) and all(got[k] == 7 for k in range(300, 340)) and got[340] == got[1] == 1 and 5 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tokens_are_stored_once_and_not_shuffled(docs_of, monkeypatch):
    seen, plain = [], N.settle
    monkeypatch.setattr(N, "settle", lambda df: seen.append(df.columns) or plain(df))
    N.groups(docs_of([" ".join(f"v{k}" for k in range(j, j + 60)) for j in range(20)])).collect()
    assert [c for c in seen if "tokens" in c and "mark" in c] == [["doc_id", "n", "key", "tokens", "mark"]]
    assert sum("tokens" in c for c in seen) == 2  # once more for the sets where components meet


def test_classes_of_tokens(spark):
    rng = np.random.default_rng(5)
    low = rng.integers(0, 1 << N.TOKEN_BITS, 3000) & ~np.int64(0xFFFFFF) | np.arange(3000)  # places apart
    times = rng.choice([1, 2, 3, 4, 9], len(low))
    sets = [[int(t) for t, c in zip(low, times) if c > k] for k in range(9)]
    rows = spark.createDataFrame([(k, len(t), t) for k, t in enumerate(sets)], "node long, n long, tokens array<long>").repartition(4)
    for bits in (24, 30):
        common, frequent = N._classes(rows, N.Rule(80, 100, 1.0), 3, bits)
        assert (N.in_bit_table(common, low) == (times > 1)).all() and (N.in_bit_table(frequent, low) == (times > 3)).all()


def test_copies_of_one_text_give_one_whole_set(docs_of):
    docs = N.pick(docs_of(["a b c d e f g"] * 300 + ["x y z u v w"] * 2, [7] * 300 + [7, 8]), doc_id="doc_id", text="text")
    got = N._full_sets(docs, 5, docs.sparkSession.createDataFrame([(7,)], "node long")).collect()
    assert [(r.node, len(r.tokens)) for r in sorted(got, key=lambda r: len(r.tokens))] == [(7, 2), (7, 3)]


def test_rounds_on_few_links_take_few_tasks(spark):
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = components(spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long").repartition(30))
        assert got.rdd.getNumPartitions() <= 8 and {r.component for r in got.collect()} == {0} and got.count() == 41
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_sketches_differ_in_no_more_bits_than_sets_in_tokens():
    rng = np.random.default_rng(8)
    for size in (1, 40, 300, 2000):
        x = np.unique(rng.integers(0, 1 << N.TOKEN_BITS, size))
        for gone in (0, 1, size // 5, size):
            y = np.union1d(x[gone:], rng.integers(0, 1 << N.TOKEN_BITS, gone))
            bits = int(np.bitwise_count((N.sketch(x) ^ N.sketch(y)).view(np.uint64)).sum())
            assert bits <= len(np.setxor1d(x, y)) and (bits == 0) == (gone == 0)


def test_unlike_copies_of_one_text_are_not_all_paired(docs_of, monkeypatch):
    random.seed(12)
    base = [f"v{k}" for k in range(146)]
    texts = []
    for _ in range(120):  # eight words left out of each: all share most of a text, few are alike
        own = [w for k, w in enumerate(base) if k not in set(random.sample(range(5, 140), 8))]
        texts.append(" ".join(own))
    seen, plain = [], N._linked
    monkeypatch.setattr(N, "_linked", lambda pairs, full, rule: seen.append(pairs.count()) or plain(pairs, full, rule))
    got = N.groups(docs_of(texts), frequent_from=3).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute([*enumerate(texts)], 5, 80, 100)
    assert seen[1] < 1000  # of 7,140


def test_signatures_are_stored_once_a_set(docs_of, monkeypatch):
    seen, plain = [], N.settle
    monkeypatch.setattr(N, "settle", lambda df: seen.append(df.columns) or plain(df))
    N.groups(docs_of([" ".join(f"v{k}" for k in range(j, j + 60)) for j in range(20)])).collect()
    assert ["node", "n", "sigs", "before"] in seen


def test_sets_of_many_texts_are_those_of_each():
    random.seed(2)
    texts = [None, "", " one ", "a b", *(" ".join(random.choices("abcdef", k=random.randint(0, 40))) for _ in range(200))]
    for chars in (1, 50, 1 << 17):
        got = list(N.token_sets(texts, 3, chars))
        assert [n for n, _ in got] == [len((t or "").split()) for t in texts]
        assert all(np.array_equal(s, N.tokens_of(t, 3)) and (np.diff(s) > 0).all() for t, (_, s) in zip(texts, got))
