"""Token counts: Arrow batches go to the tokenizer library, and only lengths come back.

Texts are split at boundaries that no token crosses and that leave both sides'
tokens as they are, so that the sum over its pieces is the count of the whole. A
piece that a task has met before keeps its length; the others reach the library
in batches of about the same number of bytes, whatever the length of each.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from wayline.llm.common import pick

#: Bytes of a batch for the library, characters of text that are pieces at a time, and lengths that a task remembers (of
#: pieces up to so many characters); beyond that many it starts anew.
BATCH_BYTES = 256 << 10
GROUP_CHARS = 256 << 10
KNOWN, KNOWN_CHARS = 1 << 18, 64
#: Places in front of white space after what is surely none: the splitting rule of byte-level BPE never joins the two sides,
#: looks back at nothing, and looks ahead only from white space.
BEFORE_SPACE = re.compile("(?<=[^\\s\\x1c-\\x1f\\x85\\u180e\\u200b\\ufeff])(?=[ \\n\\t\\r])")
#: The same in texts without unusual white space: each piece is a run of white space and what follows it.
UNUSUAL = re.compile("[\x0b\\x0c\\x1c-\\x1f\\x85\\u180e\\u200b\\ufeff]|[^\\S \\n\\t\\r]")
SPACE_AND_REST = re.compile("[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: One blank between plain words, for models that write it as the first character of a piece.
PLAIN_BLANK = re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
BLANK = "▁"


class Counter:
    """The library's counts for one vocabulary file: .json by tokenizers, .model by sentencepiece.

    safe finds the places at which a text may be split, and is None where the
    file's rules don't show that there are any; texts are then counted whole.
    A blank that safe matches belongs to neither side.
    """

    def __init__(self, path: str):
        self.safe: re.Pattern[str] | None = None
        self.known: dict[str, int] = {}
        self.count: Callable[[list[str]], list[int]] = self._pieces(path) if path.endswith(".model") else self._tokens(path)

    def _tokens(self, path: str) -> Callable[[list[str]], list[int]]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        rule, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not re.search(r"\s", t["content"]) for t in added)
        if plain and spec.get("normalizer") is None and rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space"):
            self.safe = BEFORE_SPACE
        return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, path: str) -> Callable[[list[str]], list[int]]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        crossed = any(BLANK in model.id_to_piece(i).lstrip(BLANK) for i in range(model.get_piece_size()))
        if not crossed and model.encode("a", out_type=str)[0].startswith(BLANK) and model.piece_to_id(BLANK) != model.unk_id():
            self.safe = PLAIN_BLANK
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]

    def split(self, text: str, size: int) -> Iterator[str]:
        """Parts of some size characters or more; a text without a safe boundary stays whole."""
        at = 0
        while self.safe is not None and (m := self.safe.search(text, at + size)):
            yield text[at:m.start()]
            at = m.end()
        yield text[at:]

    def pieces(self, text: str) -> list[str]:
        """A text at all its safe boundaries."""
        if self.safe is None:
            return [text]
        if self.safe is BEFORE_SPACE and not UNUSUAL.search(text):
            return SPACE_AND_REST.findall(text)
        return self.safe.split(text)

    def _learn(self, pieces: set[str], batch_bytes: int) -> dict[str, int]:
        """Lengths of pieces not met before, asked for in batches balanced by bytes."""
        lengths: dict[str, int] = {}
        batch: list[str] = []
        held = 0
        for piece in pieces:
            batch.append(piece)
            held += len(piece.encode())
            if held >= batch_bytes:
                lengths.update(zip(batch, self.count(batch)))
                batch, held = [], 0
        if batch:
            lengths.update(zip(batch, self.count(batch)))
        self.known.update((p, n) for p, n in lengths.items() if len(p) <= KNOWN_CHARS)
        return lengths

    def column(self, texts: pa.Array, batch_bytes: int = BATCH_BYTES, group_chars: int = GROUP_CHARS) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of every text of a column."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.zeros(len(texts), np.int64)
        group: list[tuple[int, list[str]]] = []
        held = 0

        def flush() -> None:
            known = self.known
            if len(known) > KNOWN:
                known.clear()
            new = self._learn({p for _, pieces in group for p in pieces if p not in known}, batch_bytes)
            for i, pieces in group:
                out[i] += sum(new[p] if p in new else known[p] for p in pieces) if new else sum(map(known.__getitem__, pieces))
            group.clear()

        for i in np.flatnonzero(sizes).tolist():
            for part in self.split(texts[i].as_py(), group_chars):
                group.append((i, self.pieces(part)))
                held += len(part)
                if held >= group_chars:
                    flush()
                    held = 0
        if group:
            flush()
        return sizes, out


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How many tokens a vocabulary file's library makes of every whole text, one row for each row of docs.

    Nothing is added at a text's ends; special strings inside texts are handled
    as the library does by default. A null or empty text has no tokens and no
    bytes; a null id stays null; repeated rows are counted each; an empty table
    gives no rows; other columns may have any name. tokenizer is a path that
    every executor has. A text's bytes are those of its UTF-8 form.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer)
        for batch in batches:
            sizes, tokens = counter.column(batch.column(1))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array(sizes), "n_tokens": pa.array(tokens),
                                              "over_limit": pa.array(tokens > limit)})

    picked = pick(docs, doc_id=id_col, text=text_col)
    return picked.select(picked.doc_id.cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
