from __future__ import annotations

import random
import re

import pytest

from wayline.llm import license_scan as L


def test_automaton_accepts_what_its_regular_expression_does():
    random.seed(5)
    words = "released under the terms of mit license licensed apache version 2 0 cc by nc 4 a creative commons copyright c 2020 1999 all rights reserved x y general public gnu 3".split()
    labels = [*L.BASE, *L.TEMPLATES]
    automaton = L.TokenAutomaton([*L.BASE, *L.TEMPLATES.values()])
    for _ in range(3000):
        text = [random.choice(words) for _ in range(random.randint(0, 25))]
        if random.random() < 0.7:
            at = random.randint(0, len(text))
            text[at:at] = random.choice([["copyright", "c", "2020", "x", "y", "all", "rights", "reserved"], ["released", "under", "the", "mit", "license"],
                                         ["licensed", "under", "the", "gnu", "general", "public", "license", "3"], ["licensed", "under", "cc", "by", "nc", "4", "0"]])
        joined = "".join(f" {w}" for w in text) + " "
        want = {k for k, t in zip(labels, [*L.BASE, *L.TEMPLATES.values()]) if re.search(" " + L.to_regex(t), joined)}
        found = automaton.scan([w.encode() for w in text])
        assert {labels[x[0]] for x in found} == want
        for k, a, b in found:
            assert re.fullmatch(L.to_regex([*L.BASE, *L.TEMPLATES.values()][k]), " ".join(text[a:b + 1]) + " ")


def test_mandatory_wording_and_bounds():
    a = L.TokenAutomaton([L.TEMPLATES["mit"]])
    assert a.scan(L.words_of("Released under the MIT License.")) and a.scan(L.words_of("released under the terms of the mit license"))
    assert not a.scan(L.words_of("released under the terms of mit license"))
    with pytest.raises(ValueError):
        L.TokenAutomaton(["<<var;match=any;min=1;max=1>> y"])


def test_rows_nulls_and_repeats(docs_of):
    texts = [None, "", "CC BY cc by; General Public License", "Ünder cc by", "x " * 20000 + "all rights reserved", "all rights reserved all rights reserved"]
    got = {r.doc_id: r for r in L.scan(docs_of(texts + texts[:1], [0, 1, 2, 3, 4, 5, None])).collect() if r.doc_id is not None}
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].labels, got[0].score) == (0, 0, None, "", 0.0) == (got[1].n_words, got[1].n_base, got[1].last_word, got[1].base_labels, got[1].score)
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels, got[2].score) == (7, 3, 0, 4, "cc-by,gpl", 0.5)
    assert got[3].n_base == 0 and got[3].n_words == 2
    assert (got[4].n_words, got[4].first_word) == (20003, 20000) and "reserved-notice" in got[4].labels and got[4].score == 1.0
    assert (got[5].n_base, got[5].first_word, got[5].last_word) == (2, 0, 3)
    assert L.scan(docs_of([])).count() == 0
