"""License scans: template markup compiled to token automata.

A template is wording with two kinds of markup:

    <<beginOptional>>words<<endOptional>>         may be left out
    <<var;name=holder;match=any;min=1;max=8>>     min to max words: any, number or year

Everything else is mandatory and has to stand in the text word for word. All
templates run together as one automaton whose deterministic transitions are
made as texts need them and kept in a table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from wayline.llm.common import pick

# The phrases that every scan reports.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

TEMPLATES = {
    "apache-2.0": "licensed under the apache license <<beginOptional>>version<<endOptional>> 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc-4.0": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by nc 4 0",
    "copyright-reserved": "copyright <<beginOptional>>c<<endOptional>> <<var;name=year;match=year;min=1;max=2>> "
                          "<<var;name=holder;match=any;min=1;max=8>> all rights reserved",
    "gpl-3.0": "licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license "
               "<<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>version<<endOptional>> 3",
    "mit": "released under the <<beginOptional>>terms of the<<endOptional>> mit license",
    "reserved-notice": "all rights reserved <<beginOptional>>by<<endOptional>> <<beginOptional>>the<<endOptional>> <<beginOptional>>authors<<endOptional>>",
    "spdx": "spdx license identifier <<var;name=id;match=any;min=1;max=3>>",
}

MARKUP = re.compile(r"<<beginOptional>>(.*?)<<endOptional>>|<<var;([^>]*)>>|([^\s<]+)")
ANY, NUMBER, YEAR = "any", "number", "year"
#: Words are runs of ASCII digits and letters and of everything beyond ASCII.
WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


def parse(markup: str) -> list[tuple]:
    """('word', w), ('optional', [words]) and ('var', match, min, max) in order."""
    out: list[tuple] = []
    for m in MARKUP.finditer(markup):
        if m[1] is not None:
            out.append(("optional", m[1].split()))
        elif m[2] is not None:
            keys = dict(x.split("=", 1) for x in m[2].split(";"))
            out.append(("var", keys.get("match", ANY), int(keys.get("min", 1)), int(keys.get("max", 1))))
        else:
            out.append(("word", m[3]))
    return out


def to_regex(markup: str) -> str:
    """The same language over words that are each followed by one blank."""
    shape = {ANY: "[^ ]+ ", NUMBER: "[0-9]+ ", YEAR: "[0-9]{4} "}
    parts = {"word": lambda p: p[1] + " ", "optional": lambda p: "(" + " ".join(p[1]) + " )?",
             "var": lambda p: f"({shape[p[1]]}){{{p[2]},{p[3]}}}"}
    return "".join(parts[p[0]](p) for p in parse(markup))


class TokenAutomaton:
    """All templates at once, started at every word."""

    #: Deterministic states kept at most; beyond it the table starts anew, without effect on results.
    TABLE = 50_000

    def __init__(self, templates: list[str]):
        self.arcs: list[list[tuple[bytes | str, int]]] = []  # bytes: that word; str: any word of that shape
        self.skips: list[list[int]] = []
        self.ends: dict[int, int] = {}
        self.starts: list[int] = []
        self.longest: list[int] = []
        for k, markup in enumerate(templates):
            at = self._state()
            self.starts.append(at)
            length = 0
            for part in parse(markup):
                if part[0] == "word":
                    at = self._chain(at, [part[1].encode()])
                    length += 1
                elif part[0] == "optional":
                    end = self._chain(at, [w.encode() for w in part[1]])
                    self.skips[at].append(end)
                    at, length = end, length + len(part[1])
                else:
                    at = self._chain(at, [part[1]] * part[2])
                    end = self._state()
                    self.skips[at].append(end)
                    for _ in range(part[3] - part[2]):
                        at = self._chain(at, [part[1]])
                        self.skips[at].append(end)
                    at, length = end, length + part[3]
            self.ends[at] = k
            self.longest.append(length)
        self.vocabulary = {w: k for k, w in enumerate(sorted({x for arcs in self.arcs for x, _ in arcs if isinstance(x, bytes)}))}
        self.root = self._closure(self.starts)
        firsts = [x for s in self.root for x, _ in self.arcs[s]]
        if any(isinstance(x, str) for x in firsts) or any(s in self.ends for s in self.root):
            raise ValueError("a template has to begin with a mandatory word")
        self.first_words = frozenset(firsts)
        self._clear()

    def _state(self) -> int:
        self.arcs.append([])
        self.skips.append([])
        return len(self.arcs) - 1

    def _chain(self, at: int, labels: list) -> int:
        for label in labels:
            to = self._state()
            self.arcs[at].append((label, to))
            at = to
        return at

    def _closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def _clear(self) -> None:
        self.states = [self.root]
        self.number = {self.root: 0}
        self.table: list[dict] = [{}]
        self.found: list[tuple[int, ...]] = [()]

    @staticmethod
    def shape(word: bytes) -> str:
        return (YEAR if len(word) == 4 else NUMBER) if word.isdigit() else ANY

    def _to(self, states, word: bytes) -> frozenset[int]:
        shape = self.shape(word)
        fits = {word, shape, ANY, NUMBER if shape == YEAR else shape}
        return self._closure({to for s in states for label, to in self.arcs[s] if label in fits})

    def step(self, state: int, word: bytes) -> int:
        key = word if word in self.vocabulary else self.shape(word)
        to = self.table[state].get(key)
        if to is None:
            nxt = self._to(self.states[state], word) | self.root
            to = self.number.get(nxt)
            if to is None:
                if len(self.states) >= self.TABLE:
                    self._clear()
                    to = self.number.get(nxt)
                if to is None:
                    to = self.number[nxt] = len(self.states)
                    self.states.append(nxt)
                    self.table.append({})
                    self.found.append(tuple(sorted(self.ends[s] for s in nxt if s in self.ends)))
                return to
            self.table[state][key] = to
        return to

    def scan(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, first word, last word) of every place where a template ends; of its beginnings the nearest."""
        if self.first_words.isdisjoint(words):
            return []
        out: list[tuple[int, int, int]] = []
        state, vocabulary = 0, self.vocabulary
        for i, word in enumerate(words):
            if state == 0 and word not in vocabulary:
                continue
            state = self.step(state, word)
            for k in self.found[state]:
                out.append((k, self._begin(k, words, i), i))
        return out

    def _begin(self, k: int, words: list[bytes], last: int) -> int:
        for first in range(last, last - self.longest[k], -1):
            states = self._closure([self.starts[k]])
            for i in range(first, last + 1):
                states = self._to(states, words[i])
            if any(self.ends.get(s) == k for s in states):
                return first
        raise AssertionError("an accepted template has a beginning")


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, spans array<struct<label:string,first:long,last:long>>")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License wording in every whole text, one row for each row of docs.

    labels are those of base phrases and of templates accepted; spans gives each
    place by its words, from 0. score is 1 if a template was accepted, 0.5 if
    only base phrases stand there, else 0. A null text counts as empty; a null
    id stays null; repeated rows give repeated results.
    """
    named = templates or TEMPLATES
    labels = [*BASE.values(), *named]
    wording = [*BASE, *named.values()]
    n_base = len(BASE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = TokenAutomaton(wording)
        schema = None
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                found = automaton.scan(words)
                base = [x for x in found if x[0] < n_base]
                starts = [x[1] for x in base]
                rows.append((len(words), len(base), min(starts, default=None), max(starts, default=None),
                             ",".join(sorted({labels[x[0]] for x in base})), ",".join(sorted({labels[x[0]] for x in found})),
                             1.0 if len(found) > len(base) else 0.5 if base else 0.0,
                             [{"label": labels[k], "first": a, "last": b} for k, a, b in found]))
            if schema is None:
                schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                                    ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                                    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())])))])
            columns = [batch.column(0), *(pa.array([r[k] for r in rows], schema.field(k + 1).type) for k in range(8))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    picked = pick(docs, doc_id=id_col, text=text_col)
    return picked.select(picked.doc_id.cast("long"), "text").mapInArrow(run, SCHEMA)


def oracle() -> str:
    """The query's columns in DuckDB SQL; templates become regular expressions over words."""
    at = {p: f"list_filter(range(1, len(w) + 1), lambda i: {' and '.join(f'w[i + {k}] = {chr(39)}{x}{chr(39)}' for k, x in enumerate(p.split()))})" for p in BASE}
    places = "list_concat(" + ", ".join(at.values()) + ")" if len(at) == 2 else "flatten([" + ", ".join(at.values()) + "])"
    base = ", ".join(f"case when contains(j, ' {p} ') then '{label}' end" for p, label in BASE.items())
    method = ", ".join(f"case when regexp_matches(j, ' {to_regex(t)}') then '{label}' end" for label, t in TEMPLATES.items())
    pack = "coalesce(array_to_string(list_sort(list_distinct(list_filter([{}], lambda x: x is not null))), ','), '')"
    return f"""
    with words as (
        select doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
    joined as (select doc_id, w, ' ' || array_to_string(w, ' ') || ' ' as j from words),
    found as (select doc_id, w, {places} as p, {pack.format(base)} as base_labels, {pack.format(base + ', ' + method)} as labels,
              {pack.format(method)} as own from joined)
    select doc_id, cast(len(w) as bigint) as n_words, cast(len(p) as bigint) as n_base,
           cast(list_min(p) - 1 as bigint) as first_word, cast(list_max(p) - 1 as bigint) as last_word, base_labels, labels,
           cast(case when own <> '' then 1.0 when base_labels <> '' then 0.5 else 0.0 end as double) as score
    from found"""
