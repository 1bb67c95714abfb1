"""Periodic runs of words, by multi-scale minimizers.

A run is a stretch of words with smallest period q and at least four periods
(and six words) long that no neighbouring word extends. For periods in
(w/2, w] the w-grams of a run are equal exactly at multiples of q, since w is at
least q and the period has no smaller one. Minima over windows of w/2 w-grams
stand in a run at places q apart as the windows repeat, and a run of four
periods holds two whole windows that far apart. So two neighbouring minima of
equal value and a distance in (w/2, w] stand in every run: they seed an
extension word by word, which settles the run's exact ends. Periods up to four
are found by comparing every word with the one so many places before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import pick

#: Periods up to this one are found by direct comparison; the first scale is twice as wide.
DIRECT = 4
#: Words of texts that are searched at a time, and bytes of a text that are Python words at a time.
BATCH_BYTES = 1 << 20
WHITE = re.compile(rb"[ \t-\r]")


def chunks(data: bytes, size: int = BATCH_BYTES) -> Iterator[bytes]:
    """A text in pieces that begin and end with whole words."""
    at = 0
    while at < len(data):
        m = WHITE.search(data, at + size)
        end = m.start() if m else len(data)
        yield data[at:end]
        at = end


def word_numbers(data: bytes, known: dict[bytes, int]) -> np.ndarray:
    """Every word of a text as the number that known has or gets for it."""
    parts = [np.fromiter((known.setdefault(w, len(known)) for w in chunk.split()), np.int64) for chunk in chunks(data)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _sliding(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """Minima or maxima of all windows of a power of two."""
    step = 1
    while step < width:
        x = of(x[:-step], x[step:])
        step *= 2
    return x


def _first_difference(x: np.ndarray, at: int, lag: int) -> int:
    """The first place from at where a word differs from the one lag later."""
    step = 64
    while True:
        size = min(step, len(x) - lag - at)
        differs = np.flatnonzero(x[at:at + size] != x[at + lag:at + lag + size])
        if differs.size or size < step:
            return at + (int(differs[0]) if differs.size else size)
        at += size
        step *= 2


def _last_difference(x: np.ndarray, at: int, lag: int) -> int:
    """The place after the last one before at where a word differs from the one lag later."""
    step = 64
    while True:
        low = max(at - step, 0)
        differs = np.flatnonzero(x[low:at] != x[low + lag:at + lag])
        if differs.size or not low:
            return low + int(differs[-1]) + 1 if differs.size else 0
        at = low
        step *= 2


def _long_enough(length: np.ndarray | int, q: np.ndarray | int):
    return length >= np.maximum(6, 4 * q)


def _of_scale(x: np.ndarray, grams: np.ndarray, w: int) -> np.ndarray:
    """Runs with a period in (w/2, w], which may be a multiple of the smallest one."""
    edge = np.zeros(w // 2 - 1, np.uint64)
    least = np.concatenate([edge, _sliding(grams, w // 2, np.minimum), edge])
    minima = np.flatnonzero(_sliding(least, w // 2, np.maximum) == grams)
    value = grams[minima]
    rank = np.argsort(value, kind="stable")
    minima, value = minima[rank], value[rank]
    gap = np.diff(minima)
    seed = (value[1:] == value[:-1]) & (gap > w // 2) & (gap <= w)
    at, lag = minima[:-1][seed], gap[seed]
    by = np.lexsort((at, lag))
    rows, done_lag, done = [], 0, 0
    for m, q in zip(at[by].tolist(), lag[by].tolist()):
        if q == done_lag and m < done:  # within the stretch that the seed before was extended to
            continue
        first, done, done_lag = _last_difference(x, m, q), _first_difference(x, m, q), q
        if _long_enough(done - first + q, q):
            rows.append((first, done - first + q, q))
    return np.array(rows, np.int64).reshape(-1, 3)


def runs_in(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each sequence of words its runs, as rows of start, length, period sorted by start, then period.

    Sequences stand one after another, longest first, so that those long enough
    for a scale are a prefix; no word equals those that stand between them.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) + 1 if len(texts) else np.zeros(0, np.int64)
    x = np.empty(int(sizes.sum()) + len(texts) + 1, np.int64)
    x[0] = -1
    for k, i in enumerate(order):
        x[starts[k]:starts[k] + sizes[k]] = texts[i]
        x[starts[k] + sizes[k]] = -2 - k

    def upto(words: int) -> int:
        """The end of the sequences that have so many words, with what follows the last one."""
        n = int(np.searchsorted(-sizes, -words, side="right"))
        return int(starts[n - 1] + sizes[n - 1]) + 1 if n else 0

    found = [np.zeros((0, 3), np.int64)]
    for q in range(1, DIRECT + 1):
        part = x[:upto(max(6, 4 * q))]
        at = np.flatnonzero(part[:-q] == part[q:]) if len(part) > q else np.zeros(0, np.int64)
        if at.size:
            edge = np.flatnonzero(np.diff(at) != 1)
            first, last = at[np.concatenate([[0], edge + 1])], at[np.concatenate([edge, [at.size - 1]])]
            length = last - first + 1 + q
            keep = _long_enough(length, q)
            found.append(np.stack([first, length, np.full_like(first, q)], 1)[keep])
    grams, w = _mixed(x.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), 1
    while (w < DIRECT or upto(4 * (w + 1))) and len(grams) > w:
        grams = _mixed(grams[:-w] * np.uint64(0xA0761D6478BD642F) + grams[w:])
        w *= 2
        if w > DIRECT:
            found.append(_of_scale(x, grams[:upto(4 * (w // 2 + 1)) - w + 1], w))
    every = np.concatenate(found)
    # The same stretch may have multiples of its period too; the smallest comes first.
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    new = np.ones(len(every), bool)
    new[1:] = (every[1:, :2] != every[:-1, :2]).any(1)
    every = every[new]
    every = every[np.lexsort((every[:, 2], every[:, 0]))]
    owner = np.searchsorted(starts, every[:, 0], side="right") - 1
    out: list[np.ndarray] = [np.zeros((0, 3), np.int64)] * len(texts)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    for k in np.unique(owner).tolist():
        own = every[cuts[k]:cuts[k + 1]].copy()
        own[:, 0] -= starts[k]
        out[order[k]] = own
    return out


def collapsed(data: bytes, size: int, runs: np.ndarray) -> bytes:
    """The words that stand in no run after its first period, joined by one blank."""
    if not len(runs):
        return b" ".join(b" ".join(chunk.split()) for chunk in chunks(data))
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = (np.cumsum(change[:-1]) == 0).tolist()
    parts, at = [], 0
    for chunk in chunks(data):
        words = chunk.split()
        if part := b" ".join(w for w, k in zip(words, kept[at:at + len(words)]) if k):
            parts.append(part)
        at += len(words)
    return b" ".join(parts)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.cumsum(sizes) // BATCH_BYTES
        for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(upto)) + 1):
            if not len(part):
                continue
            rows = batch.slice(int(part[0]), len(part))
            texts = [t or b"" for t in rows.column(1).cast(pa.binary()).to_pylist()]
            known: dict[bytes, int] = {}
            words = [word_numbers(t, known) for t in texts]
            runs = runs_in(words)
            flat = np.concatenate([*runs, np.zeros((0, 3), np.int64)])
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
            kept = [collapsed(t, len(w), r).decode("utf-8", "replace") for t, w, r in zip(texts, words, runs)]
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "n_words": pa.array([len(w) for w in words], pa.int64()),
                                              "runs": pa.ListArray.from_arrays(pa.array(offsets), structs), "text": pa.array(kept, pa.string())})


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The periodic runs of every whole text, and the text with each run collapsed to its first period.

    Words are what stands between ASCII white space. One row for each row of
    docs: doc_id, n_words, runs array<start, length, period> by start, then
    period, and text, its kept words joined by one blank. Null and empty texts
    have no words and no runs; a null id stays null; repeated rows are searched
    each; an empty table gives no rows; other columns may have any name.
    Time grows as n log n with the words of a text, whatever its repetitions.
    """
    picked = pick(docs, doc_id=id_col, text=text_col)
    return picked.select(picked.doc_id.cast("long"), "text").mapInArrow(
        _scan, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string")


def digests(found: DataFrame) -> DataFrame:
    """Per document its number of runs, the longest one (ties: smallest start, then period), and digests of all runs and of the collapsed text."""
    def line(r: Column) -> Column:
        return F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))

    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period"))))
    bound = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), F.array_join(F.transform("runs", line), "").alias("lines"), "text")
    return bound.select("doc_id", "n_runs", F.col("top.start").alias("start"), (-F.col("top.less")).alias("length"), F.col("top.period").alias("period"),
                        F.expr("-1000 * top.less div top.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))


def planted(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth (by the checksum of its id) repeats itself from some word on.

    With h the checksum and g = h div 10, word i from a = g mod n on becomes word
    a + (i - a) mod p, where p = 1 + (n - a) div (3 + g mod 8).
    """
    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.expr("h div 10") % F.greatest(n, F.lit(1))
        p = F.lit(1) + F.call_function("div", n - a, F.lit(3) + F.expr("h div 10 % 8"))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.element_at(words, (a + (i - a) % p + 1).cast("int")))), " ")

    own = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    changed = F.transform(F.array(words), repeated)[0]  # the words are bound once, and split only where they change
    return (own.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
            .select("doc_id", F.when(F.col("h") % 10 == 0, changed).otherwise(F.col("text")).alias("text")))
