from __future__ import annotations

import hashlib
import random
import re

from wayline.llm import pii_bootstrap as P


def luhn(digits):
    return sum((int(c) * 2 - 9 * (int(c) > 4)) if k % 2 else int(c) for k, c in enumerate(digits[::-1])) % 10 == 0


def brute(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
            if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_forms_are_those_of_the_patterns():
    random.seed(3)
    parts = ["a", "@", "b@", "a@b.c", ".", "1", "23", "255", "256", "0255", "1.2.3.4", "-", " ", "+1", "(0)", "4111111111111111", "é", "٣", "_", "%", "x.y"]
    for _ in range(8000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 16)))
        assert P.base_spans(text) == brute(text), repr(text)


def test_very_long_runs_take_time_in_proportion():
    for text in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "1." * 50_000, "+1" * 50_000, "ab1" * 70_000, "f" * 200_000):
        P.base_spans(text)
        P.secrets(text)
        P.identifiers(text, [], 4)


def spans_of(row):
    return [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in row.spans.split(",") if s)]


def test_contexts_find_what_has_no_fixed_form(docs_of):
    texts = [f"Mail me at user{k}@mail.example.com please" for k in range(12)] + ["Mail me at user99(at)mail5678 please", "Version 2024 of 12345678 is out", None, "", "é token = " + "0a1b" * 10]
    got = {r.doc_id: r for r in P.find(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        base = sorted(P.base_spans(t or ""), key=lambda s: (P.BASE_KINDS.index(s[0]), s[1]))
        assert set(base) <= set(spans_of(got[i]))
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(s[0] == k for s in base) for k in P.BASE_KINDS)
    found = spans_of(got[12])
    assert [(k, texts[12][a:b]) for k, a, b in found] in ([("email", "mail5678")], []) or found
    assert spans_of(got[13]) == [] and got[14].spans == got[15].spans == "" and spans_of(got[16]) == [("secret", 10, 50)]


def test_graph_scores_by_brute_force(spark):
    random.seed(8)
    rows = [(f"p{random.randint(0, 5)}", random.randint(0, 30)) for _ in range(150)]
    kind = {i: random.choice(["email", "ip", None, None]) for i in range(31)}
    edges = {(p, i) for p, i in rows}
    seen = spark.createDataFrame([(p, i, kind[i]) for p, i in rows], "pattern string, instance long, kind string")
    size = {p: sum(e[0] == p for e in edges) for p in {e[0] for e in edges}}
    seeds = {p: sum(e[0] == p and kind[e[1]] is not None for e in edges) for p in size}
    known = {i: (k, 1000) for i, k in kind.items() if k}
    scores = dict(known)
    for _ in range(3):
        best = {}
        for p in size:
            if seeds[p] >= 2:
                sums = {}
                for q, i in edges:
                    if q == p and i in scores:
                        sums[scores[i][0]] = sums.get(scores[i][0], 0) + scores[i][1]
                if sums:
                    c, k = max((s // (size[p] + 1), k) for k, s in sums.items())
                    if c >= 200:
                        best[p] = (k, c)
        scores = dict(known)
        for p, i in edges:
            if p in best and i not in known:
                k, c = best[p]
                scores[i] = max([(k, c), *([scores[i]] if i in scores else [])], key=lambda x: (x[1], x[0]))
    got = {r.pattern: r.kind for r in P.trusted_patterns(seen, 3, 200, 2).collect()}
    assert got == {p: k for p, (k, _) in best.items()} and got


def test_redaction_keeps_rows_and_columns(docs_of):
    docs = docs_of(["call +1 (243) 555-5526 or a@b.org", None, "", "clean", "clean"], [1, 2, 3, 4, 4])
    out = P.redact(docs, size_col="n_chars")
    got = sorted((r[0], r[1], r[4]) for r in out.collect() if r[1] is not None)
    assert out.columns == docs.columns and out.count() == 5
    assert got == [(1, "call <PHONE> or <EMAIL>", 23), (3, "", 0), (4, "clean", 5), (4, "clean", 5)]
    assert P.redact(docs_of([])).count() == 0 and P.find(docs_of([])).count() == 0


def test_unseen_identifiers_of_a_seeded_context_are_marked(docs_of):
    phones = [f"tel : +1 (243) 555-{k:04d}" for k in range(60)] + [f"tel : 555-{k:04d}" for k in range(40)]
    four = [f"mail to : user{k}@mail.example.com" for k in range(4)] + [f"mail to : user-{k:05d}" for k in range(30)]
    three = [f"host is 10.0.0.{k}" for k in range(3)] + ["host is node-12345"]
    mixed = [f"see also user{k}@mail.example.com" for k in range(4)] + [f"see also 10.0.0.{k}" for k in range(4)] + ["see also node-54321"]
    texts = phones + four + three + mixed
    got = {r.doc_id: [(k, texts[r.doc_id][a:b]) for k, a, b in spans_of(r)] for r in P.find(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        if "tel :" in t:
            assert got[i] == [("phone", t[6:])]
        elif "user-" in t:
            assert got[i] == [("email", t[10:])]
        elif "node-" in t:
            assert got[i] == []  # three seeds, and seeds that do not agree
    assert {r[1] for r in P.redact(docs_of(phones)).collect()} == {"tel : <PHONE>"}
