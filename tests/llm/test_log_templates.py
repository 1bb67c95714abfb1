from __future__ import annotations

import random
import re
from collections import defaultdict

from wayline.llm import log_templates as T


def templates(tokens, depth, similarity):
    """The line, and each form of it with one run of blocks left open."""
    out = {("line", *tokens)} if set(tokens) != {"<*>"} else set()
    free = max(0, len(tokens) - depth)
    most = free * (100 - similarity) // 100
    size, wide = max(1, most // 2), min(2, most)
    if wide:
        for at in range(depth, depth + size * (-(-free // size) - wide) + 1, size):
            form = [t if not at <= k < at + wide * size else None for k, t in enumerate(tokens)]
            if set(form[depth:]) - {None, "<*>"}:
                out.add((at, *form))
    return out


def brute(rows, depth=3, similarity=70):
    """rows: (doc_id, text); the text each keeps."""
    def mask(line):
        tokens = re.sub(r"[ \t\r\x0B\f]+", " ", line).strip(" ").split(" ")
        return ["<*>" if re.search("[0-9]", t) else t for t in tokens] if tokens != [""] else None
    owners = defaultdict(set)
    for i, t in rows:
        if t is not None and i is not None:
            for m in filter(None, map(mask, t.split("\n"))):
                for form in templates(m, depth, similarity):
                    owners[form].add(i)
    def keep(i, raw):
        m = mask(raw)
        return not m or i is None or all(min(owners[form]) == i for form in templates(m, depth, similarity))
    return [(i, None if t is None else "\n".join(raw for raw in t.split("\n") if keep(i, raw))) for i, t in rows]


ROWS = [(1, "job 12 done in 5 ms\nown line of one\n\nsame old line"), (2, "job 99 done in 7 ms\nanother line of two\nsame  old\tline"), (3, "same old line\nsame old line"),
        (4, "the cat sat on the mat all day long\nunique"), (5, "the cat sat on the mat all day short\nmore"), (6, "the cat sat by some other thing not alike\n"), (7, None), (8, ""),
        (None, "same old line"), (1, "same old line\nextra"), (9, "\n\n"), (10, "x" * 50000 + " 1 y\nsame old line"), (10, "x" * 50000 + " 1 y\nsame old line")]


def test_against_brute_force(docs_of):
    got = T.dedup(docs_of([t for _, t in ROWS], [i for i, _ in ROWS])).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(brute(ROWS), key=key)
    by = {(r.doc_id, r.n_lines, r.n_dropped) for r in got}
    assert {(2, 3, 2), (3, 2, 2), (5, 2, 1), (6, 2, 0), (7, 0, 0), (8, 1, 0)} <= by


def test_rows_left_with_nothing_go(docs_of):
    docs = docs_of([t for _, t in ROWS], [i for i, _ in ROWS])
    out = T.drop_lines(docs, size_col="n_chars")
    got = out.toDF("i", "t", "lang", "source", "n", *"abcdef").collect()
    assert out.columns == docs.columns
    assert 3 not in {r.i for r in got} and {7, 8, 9, 1, 2} <= {r.i for r in got}
    assert all(r.n == len(r.t) for r in got if r.t is not None and r.i in (2, 5))
    assert T.dedup(docs_of([])).count() == 0 and T.drop_lines(docs_of([])).count() == 0




def test_every_family_of_a_leaf_is_generalised(docs_of):
    top = [f"This old page was written by {x}" for x in ("Ann", "Bob", "Cy", "Dee", "Eve")]
    other = [f"This old page originally appears in {x}" for x in ("York", "Bath", "Hull")]
    numbers = ["12 7", "99 3", "12 7"]
    short = ["He went to Paris", "He went to London"]
    texts = top + other + numbers + short
    got = {r.doc_id: r.text for r in T.dedup(docs_of(texts)).collect()}
    assert [i for i, t in enumerate(texts) if got[i] == t] == [0, 5, *range(8, 13)]


def test_random_families_by_brute_force(docs_of):
    random.seed(5)
    words = ["a", "b", "c", "9"]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(random.randint(0, 3)):
            base = [words[(k * 7 + random.choice((0, 0, 0, 0, 0, 0, 1))) % 4] for k in range(random.choice((1, 2, 5, 7, 8, 11, 14, 18, 24, 40)))]
            lines.append(" ".join(base))
        rows.append((i % 120, "\n".join(lines)))
    got = T.dedup(docs_of([t for _, t in rows], [i for i, _ in rows])).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(brute(rows))
    assert any(r.n_dropped for r in got) and any(r.n_lines and not r.n_dropped for r in got)


def test_only_likely_templates_are_exchanged_again(spark):
    every = spark.range(-30000, 30000).selectExpr("id as doc_id", "id as row", "xxhash64(id) as template")
    recurring = every.where("doc_id % 100 = 0").selectExpr("template", "doc_id as owner")
    got = {r.doc_id for r in T._likely(every, recurring).select("doc_id").collect()}
    assert got >= set(range(-30000, 30000, 100)) and len(got) < 700
    assert T._likely(every, recurring, 6).count() == 60000 and T._likely(every, recurring.limit(0)).count() == 0
