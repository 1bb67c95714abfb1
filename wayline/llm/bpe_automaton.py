"""BPE encoding by a tokenization automaton.

The automaton's arcs are tokens and its accepted paths are exactly the correct
token sequences. It is made from the one that loops over all bytes by adding a
gadget for each merge (u, v) -> w in order of priority:

  * every state with an arc u whose end has an arc v gets an arc w, which leads
    where v led at that time;
  * the end of that arc u is replaced by a copy that lacks the arc v;
  * if u = v, the copy does not get the arc w either, as pairs form from the left.

A state is therefore known by the token that leads to it, and a gadget by its
two parts and its rank, so that the compiled form is a few arrays. Whether a
state has an arc follows from the gadgets; the answers fill the transition
table as texts ask for them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from wayline.llm.common import pick

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
# The endings that are split off after an apostrophe, and how a byte is written in vocabulary files.
ENDINGS = regex.compile(r"'(?:s|t|re|ve|m|ll|d)")
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file."""
    rest = [b for b in range(256) if b not in set(PRINTED)]
    return {chr(b): b for b in PRINTED} | {chr(256 + k): b for k, b in enumerate(rest)}


def character_classes() -> np.ndarray:
    """For every code point: letter, number, space or other."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = (x + 0x800 * (x >= 0xD800) for x in (m.start(), m.end() - 1))
            if a < 0xD800 <= b:
                out[a:0xD800] = out[0xE000:b + 1] = kind
            else:
                out[a:b + 1] = kind
    return out


def split_words(text: str, classes: np.ndarray) -> list[str]:
    """Runs of letters, numbers or others, each with one blank before it, and what is left of white space."""
    if not text:
        return []
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = classes[code]
    before, after = np.empty_like(kind), np.empty_like(kind)
    before[0], before[1:] = 255, kind[:-1]
    after[-1], after[:-1] = SPACE, kind[1:]
    blank = np.zeros(len(code), bool)
    blank[1:] = code[:-1] == 32
    space = kind == SPACE
    starts = (~space & (kind != before) & ~blank) | (space & ((before != SPACE) | (after != SPACE)))
    at = np.flatnonzero(starts).tolist()
    words = [text[a:b] for a, b in zip(at, [*at[1:], len(text)])]
    if "'" in text:
        out: list[str] = []
        for w in words:  # an ending cuts the run of letters after it
            if out and out[-1] == "'" and (m := ENDINGS.match("'" + w)):
                out[-1] = m[0]
                if len(m[0]) <= len(w):
                    out.append(w[len(m[0]) - 1:])
            else:
                out.append(w)
        words = out
    return words


class MergeAutomaton:
    #: Transitions and words kept at most; beyond it the tables start anew, without effect on results.
    TABLE = 400_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letter = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.labels: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.labels[i] = bytes(letter[c] for c in token)
        self.ids = {b: i for i, b in enumerate(self.labels) if b}
        for token, i in self.special.items():
            self.labels[i] = token.encode()
        #: Gadgets: the parts and rank of each merged token, and the rank at which a pair of neighbours (u << 32 | v) was shut.
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        self.shut: dict[int, int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            u, v = (vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            w = self.ids[self.labels[u] + self.labels[v]]
            if self.rank[w] >= 0:
                raise ValueError(f"two merges make {self.labels[w]!r}")
            self.left[w], self.right[w], self.rank[w] = u, v, r
            self.shut[u << 32 | v] = r
            if u == v:
                self.shut[u << 32 | w] = r
        #: The longest token that begins with these three bytes.
        self.reach: dict[bytes, int] = {}
        for b in self.ids:
            self.reach[b[:3]] = max(len(b), self.reach.get(b[:3], 0))
        self.made = {b for b, i in self.ids.items() if self.rank[i] >= 0 or len(b) == 1}
        self.table: dict[int, bool] = {}

    def _has_arc(self, x: int, y: int) -> bool:
        """Whether the state after one token has an arc for another, once all gadgets are in."""
        shut, rank = self.shut, self.rank
        before = len(rank)
        while True:
            if shut.get(x << 32 | y, before) < before:
                return False
            rx, ry = rank[x], rank[y]
            if rx > ry:  # the state was copied from that after the right part
                x, before = self.right[x], rx
            elif ry >= 0:  # the arc was added where its left part had one
                y, before = self.left[y], ry
            else:
                return True

    def encode(self, word: bytes) -> list[int]:
        """The one accepted path that spells the word.

        Paths are tried with long arcs first. No two paths spell the same
        beginning, so a place from which the end can't be reached is tried once.
        """
        ids, made, reach, table, labels = self.ids, self.made, self.reach, self.table, self.labels
        if word in made:
            return [ids[word]]
        size, path, at = len(word), [], 0
        end = min(size, reach.get(word[:3], 2))
        dead: set[int] = set()
        if len(table) > self.TABLE:
            table.clear()
        while at < size:
            while end > at:
                token = word[at:end]
                if token in made and end not in dead:
                    y = ids[token]
                    if not path:
                        break
                    key = path[-1] << 32 | y
                    arc = table.get(key)
                    if arc is None:
                        arc = table[key] = self._has_arc(path[-1], y)
                    if arc:
                        break
                end -= 1
            else:
                dead.add(at)
                if not path:
                    raise ValueError(f"no path spells {word!r}")
                end = at - 1
                at -= len(labels[path.pop()])
                continue
            path.append(y)
            at = end
            end = min(size, at + reach.get(word[at:at + 3], 2))
        return path


class Codec:
    def __init__(self, path: str, classes: np.ndarray | None = None):
        self.automaton = MergeAutomaton(path)
        self.classes = character_classes() if classes is None else classes
        self.known: dict[str, bytes] = {}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.automaton.special, key=len, reverse=True)))) if self.automaton.special else None

    def _word(self, word: str) -> bytes:
        if len(self.known) >= MergeAutomaton.TABLE:
            self.known.clear()
        out = self.known[word] = np.array(self.automaton.encode(word.encode("utf-8")), "<u4").tobytes()
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, known, at = [], self.known, 0
        cuts = [(m.start(), m.end()) for m in self.special.finditer(text)] if self.special else []
        for a, b in [*cuts, (len(text), len(text))]:
            out += [known.get(w) or self._word(w) for w in split_words(text[at:a], self.classes)]
            if b > a:
                out.append(np.array([self.automaton.special[text[a:b]]], "<u4").tobytes())
            at = b
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs one after another; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.automaton.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Encode and decode every whole text with the byte-level BPE of a tokenizer file.

    tokenizer is a path that every executor has. One row for each row of docs:
    number of ids and digests of the ids and of the decoded text; with ids=True
    also ids array<int>. Special tokens in a text are recognised. A null text
    counts as empty; a null id stays null.
    """
    classes = character_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokenizer, classes)
        for batch in batches:
            n, digest, decoded, all_ids = [], [], [], []
            for text in batch.column(1).to_pylist():
                packed = codec.encode(text or "")
                n.append(len(packed) // 4)
                digest.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(packed).encode()).hexdigest())
                if ids:
                    all_ids.append(np.frombuffer(packed, "<i4"))
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(digest, pa.string()),
                       "decoded_sha256": pa.array(decoded, pa.string())}
            if ids:
                columns["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    picked = pick(docs, doc_id=id_col, text=text_col)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return picked.select(picked.doc_id.cast("long"), "text").mapInArrow(run, schema)
