"""Ranked lexical search by scanning texts with an Aho-Corasick automaton of all query terms.

Documents are not indexed. The automaton's words are the items' terms with a
guard on both sides, and the text has each separator replaced by the guard, so
that only whole terms are found; each output is a term and maps to the items
that have it. One scan counts in how many documents each term stands, a second
one scores, and a task hands on only its k best documents of each item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.llm.common import ascii_lower, pick, pieces, settle

#: Characters of a term: ASCII letters and digits, and all beyond ASCII.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Each byte in lower case, or as the guard.
FORM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: An automaton's bound: items go to blocks of about so many characters of terms and rows of item and term.
BLOCK_CHARS, BLOCK_ROWS = 1 << 20, 1 << 19
#: Bytes of text scanned at once, and cells of a table of documents and items.
SCAN_BYTES, CELLS = 1 << 20, 1 << 22
DOCUMENTS, WORDS = -1, -2


def segments(text: bytes, size: int = SCAN_BYTES) -> Iterator[bytes]:
    """A text in its scanned form, guarded at both ends, in parts that cut no term."""
    at = 0
    while at < len(text):
        part = text[at:at + size].translate(FORM)
        if at + size < len(text) and not part.endswith(b" "):
            cut = part.rfind(b" ")
            while cut < 0:  # a term longer than a part
                more = text[at + len(part):at + len(part) + size].translate(FORM)
                end = more.find(b" ")
                part += more if end < 0 else more[:end]
                cut = len(part) if end >= 0 or not more else -1
            part = part[:cut]
        yield b" " + part + b" "
        at += max(len(part), 1)


class TermScan:
    """Counts the given terms in texts."""

    def __init__(self, terms: list[str]):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, term in enumerate(terms):
            # Bytes as the characters of the same number, as in the texts.
            self.automaton.add_word(f" {term.encode().decode('latin-1')} ", k)
        self.automaton.make_automaton()
        self.size = max(len(terms), 1)

    def _hits(self, parts: list[bytes], rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Keys row * size + term and how often each stands in these parts."""
        if not len(self.automaton):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.cumsum([len(p) for p in parts])
        found = np.fromiter(self.automaton.iter(b"".join(parts).decode("latin-1")), [("end", np.int64), ("term", np.int64)])
        row = np.array(rows, np.int64)[np.searchsorted(ends, found["end"], side="right")]
        return np.unique(row * self.size + found["term"], return_counts=True)

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of any kind in each text, and the row, number and count of the given ones that stand in it."""
        n = np.zeros(len(texts), np.int64)
        keys, counts, parts, rows, held = [], [], [], [], 0

        def flush() -> None:
            k, c = self._hits(parts, rows)
            keys.append(k)
            counts.append(c)
            parts.clear()
            rows.clear()

        for i, text in enumerate(texts):
            for part in segments(text.encode()) if text else ():
                guard = np.frombuffer(part, np.uint8) == 32
                n[i] += np.count_nonzero(guard[:-1] & ~guard[1:])
                parts.append(part)
                rows.append(i)
                held += len(part)
                if held >= SCAN_BYTES:
                    flush()
                    held = 0
        if parts:
            flush()
        key, at = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_inverse=True)
        tf = np.zeros(len(key), np.int64)
        np.add.at(tf, at, np.concatenate([*counts, np.zeros(0, np.int64)]))
        return n, key // self.size, key % self.size, tf


def _document_counts(docs: DataFrame, terms: list[str]) -> dict[int, int]:
    """Documents with each term, documents with any term at all, and all documents' terms with repeats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = TermScan(terms)
        df, documents, words = np.zeros(scan.size, np.int64), 0, 0
        for batch in pieces(batches):
            n, _, term, _ = scan.count(batch.column(1).to_pylist())
            df += np.bincount(term, minlength=scan.size)
            documents += int(np.count_nonzero(n))
            words += int(n.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.concatenate([seen, [DOCUMENTS, WORDS]])), "n": pa.array(np.concatenate([df[seen], [documents, words]]))})

    return {r.term: r.n for r in docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}


class Best:
    """The k best documents of every item so far, ties to the smaller id."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.zeros(items, np.int64)
        self.item = self.score = self.doc = np.zeros(0, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        open_to = score >= np.maximum(self.least[item], 1)
        item, score, doc = (np.concatenate([old, new[open_to]]) for old, new in ((self.item, item), (self.score, score), (self.doc, doc)))
        by = np.lexsort((doc, -score, item))
        item, score, doc = item[by], score[by], doc[by]
        place = np.arange(len(item)) - np.searchsorted(item, item, side="left")
        full = place == self.k - 1
        self.least[item[full]] = score[full]
        keep = place < self.k
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]


def _weights(counts: dict[int, int], terms: int) -> np.ndarray:
    n = counts.get(DOCUMENTS, 0)
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * counts.get(t, 0) + 1))) for t in range(terms)], np.int64)


def _scored(docs: DataFrame, terms: list[str], postings: pa.Table, counts: dict[int, int], items: pa.Array, k: int) -> DataFrame:
    """Each task's k best documents of every item of a block."""
    documents, words = counts.get(DOCUMENTS, 0), max(counts.get(WORDS, 0), 1)
    term = postings["term"].to_numpy()
    first = np.searchsorted(term, np.arange(len(terms) + 1))
    shared = docs.sparkSession.sparkContext.broadcast((terms, _weights(counts, len(terms)), first, postings["item"].to_numpy(), postings["reps"].to_numpy(), items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight, first, item_of, reps, items = shared.value
        scan, best, size = TermScan(terms), Best(len(items), k), len(items)
        per = max(CELLS // max(size, 1), 1)
        whole, rest = divmod(25 * documents, words)
        for batch in pieces(batches, min(512, per)):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            n, row, t, tf = scan.count(batch.column(1).to_pylist())
            m = 75 + n * whole + n * rest // words
            part = weight[t] * (1_000_000_000 * tf // (1000 * tf + 12 * m[row]))
            table = np.zeros(batch.num_rows * size, np.int64)
            fan = first[t + 1] - first[t]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(fan) // CELLS)) + 1, [len(t)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):  # each output's items, some millions at a time
                f = fan[a:b]
                at = np.arange(f.sum()) - np.repeat(np.cumsum(f) - f, f) + np.repeat(first[t[a:b]], f)
                np.add.at(table, np.repeat(row[a:b], f) * size + item_of[at], np.repeat(part[a:b], f) * reps[at])
            hit = np.flatnonzero(table)
            best.add(hit % size, table[hit], ids[hit // size])
        yield pa.RecordBatch.from_arrays([items.take(pa.array(best.item)), pa.array(best.doc), pa.array(best.score)], ["item_id", "doc_id", "score"])

    return docs.mapInArrow(run, "item_id long, doc_id long, score long")


def _top(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each item; candidates of many tasks are first thinned in parts, so that no item's all stand in one task."""
    order = (F.desc("score"), F.asc("doc_id"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    thinned = scored.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("r") <= k)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return thinned.select("item_id", rank.alias("rank"), "doc_id", "score").where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text") -> DataFrame:
    """The k best documents of every item: item_id, rank from 1, doc_id, score.

    A term of weight w that stands tf times in a document of n of L terms adds
    w * (10^9 tf div (1000 tf + 12 m)), m = 75 + 25 n N div L, for each time
    that the item has it; w = floor(1000 ln((2N + 2) / (2 df + 1))).

    Rows without an id take no part; a null or empty text has no terms, and a
    document without terms doesn't count in N. Repeated document rows count
    each; rows of one item id are one item. An item of which no term stands
    anywhere, and an empty table, give no rows; other columns may have any name.

    Items go to blocks of bounded size by a hash of their id, one automaton each,
    and the documents are scanned twice for each block. The terms of a single
    item, as its row, must fit a task.
    """
    spark = docs.sparkSession
    texts = pick(docs, doc_id=id_col, text=text_col).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = pick(items, item_id=item_col, text=item_text_col).where("item_id is not null")
    terms = settle(own.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"({TERM})"), 1)).alias("term"))
                   .groupBy("item_id", "term").agg(F.count("*").alias("reps")))
    size = terms.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("chars")).first()
    blocks = max(-(-size.rows // BLOCK_ROWS), -(-size.chars // BLOCK_CHARS), 1)
    scored = [_block(spark, texts, terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k) for b in range(blocks)]
    out = scored[0]
    for other in scored[1:]:
        out = out.unionByName(other)
    return _top(out, k)


def _block(spark: SparkSession, texts: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """One block's items, terms and postings, numbered here, and the scan that scores them."""
    rows = block.toArrow()
    names = rows["term"].combine_chunks().dictionary_encode() if rows.num_rows else pa.array([], pa.string()).dictionary_encode()
    ids = rows["item_id"].combine_chunks().dictionary_encode() if rows.num_rows else pa.array([], pa.int64()).dictionary_encode()
    postings = pa.table({"term": names.indices.cast(pa.int64()), "item": ids.indices.cast(pa.int64()), "reps": rows["reps"].combine_chunks() if rows.num_rows else pa.array([], pa.int64())}).sort_by("term")
    terms = names.dictionary.to_pylist()
    return _scored(texts, terms, postings, _document_counts(texts, terms), ids.dictionary, k)


def oracle(k: int = 20) -> str:
    """The same ranking in SQL."""
    words = f"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}'))"
    return f"""
WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {words} AS term FROM documents WHERE doc_id IS NOT NULL) GROUP BY ALL),
docs AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM docs),
wanted AS (SELECT item_id, term, count(*) AS reps FROM (SELECT item_id, {words} AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * max(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
scores AS (
  SELECT item_id, doc_id, sum(reps * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
  FROM wanted JOIN tf USING (term) JOIN weights USING (term) JOIN docs USING (doc_id), total GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0) WHERE rank <= {k}"""
