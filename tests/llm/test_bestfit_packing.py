from __future__ import annotations

import random
from collections import Counter, defaultdict

from wayline.llm import bestfit_packing as B
from wayline.llm.queries import op5_bestfit_packing


def brute(pieces, capacity):
    """Best fit without an order of bins."""
    bins, out = [], []
    for size, source, cluster in pieces:
        fit = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= size and not b["s"] & source and not b["c"] & cluster]
        if fit:
            k = min(fit)[1]
        else:
            bins.append({"left": capacity, "s": 0, "c": 0})
            k = len(bins) - 1
        bins[k]["left"] -= size
        bins[k]["s"] |= source
        bins[k]["c"] |= cluster
        out.append(k)
    return out


def test_search_finds_the_tightest_compatible_bin():
    random.seed(6)
    for _ in range(60):
        pieces = [(random.randint(0, 40), random.choice([0, 1, 2, 4, 8]), random.choice([0, 0, 1, 2])) for _ in range(random.randint(0, 120))]
        assert B.best_fit(pieces, 50) == brute(pieces, 50)


def test_all_tokens_are_packed_and_conflicts_kept_apart(docs_of):
    random.seed(7)
    texts = [" ".join(["w"] * random.choice([0, 3, 10, 25, 60, 130])) + (f" x{k}" if k % 2 else "") for k in range(120)] + [None]
    rows = docs_of(texts)
    given = {r[0]: {"text": r[1], "source": r[3]} for r in rows.collect()}
    got = B.pack(rows, capacity=50, shard_docs=60).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_bin[r.bin_id].append(r)
    for i, t in enumerate(texts):
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.first_token for r in pieces] == [50 * k for k in range(len(pieces))] and sum(r.n_tokens for r in pieces) == len((t or "").split()) and pieces
    for parts in by_bin.values():
        parts.sort(key=lambda r: (r.offset, r.n_tokens))
        assert sum(r.n_tokens for r in parts) <= 50
        at = 0
        for r in parts:
            assert r.offset == at
            at += r.n_tokens
        sources = [given[r.doc_id]["source"] for r in parts if given[r.doc_id]["source"] is not None]
        bodies = [given[r.doc_id]["text"] for r in parts if given[r.doc_id]["text"] is not None]
        assert len(set(sources)) == len(sources) and len(set(bodies)) == len(bodies)


def test_repeated_ids_and_none(docs_of):
    got = B.pack(docs_of(["a b", "a b", "c"], [1, 1, None]), capacity=5).collect()
    assert sorted(((r.doc_id or 0), r.n_tokens) for r in got) == [(0, 1), (1, 2), (1, 2)]
    assert B.pack(docs_of([])).count() == 0


def test_query_keeps_near_copies_apart(spark, tmp_path):
    rows = []
    for k in range(6):
        words = [f"w{k}x{j}" for j in range(60)]
        changed = [*words[:30], "other", *words[31:]]
        rows += [(3 * k, " ".join(words), f"a{k}"), (3 * k + 1, " ".join(changed), f"b{k}"), (None, " ".join(changed).upper() + " !", f"c{k}")]
    rows += [(100, None, "n1"), (101, None, "n2"), (102, " ", "n3"), (103, " ", "n4")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op5_bestfit_packing(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and sum(r.n_tokens for r in got) == sum(len((t or "").split()) for _, t, _ in rows)
    bins = {r.doc_id: r.bin_id for r in got}
    assert all(bins[3 * k] != bins[3 * k + 1] for k in range(6)) and bins[102] != bins[103]
    # Three copies in each group, so three bins, each with one copy of every group.
    assert sorted(Counter(r.bin_id for r in got if r.n_tokens).values()) == [6, 6, 6]


def test_near_copies_bring_the_words_of_texts(docs_of, monkeypatch):
    docs = docs_of(["a b  c\td", "a b  c\td", "é\x0bx", " \n", None], [1, 2, None, 4, 5])
    near = B.near_copies(docs)
    assert sorted(r.n_words for r in near.collect()) == [2, 4]
    monkeypatch.setattr(B, "word_count", None)  # so texts are not searched for words again
    assert sorted((r.doc_id or 0, r.n_tokens) for r in B.pack(docs, near=near).collect()) == [(0, 2), (1, 4), (2, 4), (4, 0), (5, 0)]
