"""Document quality from a linear-chain conditional random field over lines.

Every line that is not empty gets a label, good or bad, from features of
itself and its neighbours. The chain is fitted on documents whose label stands
for all their lines; a document's score is the mean of its lines' marginal
probability of being good, weighted by their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import pick

LOWER, UPPER, DIGIT, SPACE, SYMBOL, CALL, STOP, BEYOND, REST = range(9)


def _classes() -> np.ndarray:
    out = np.full(256, REST, np.uint8)
    for kind, letters in ((LOWER, b"abcdefghijklmnopqrstuvwxyz"), (UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (DIGIT, b"0123456789"),
                          (SPACE, b" \t\n\r\x0b\x0c"), (SYMBOL, b"#$%&*|~^=<>{}[]\\/@_+`"), (CALL, b"!?"), (STOP, b".,;:'\"()-")):
        out[list(letters)] = kind
    out[0xC0:] = BEYOND  # first bytes of characters beyond ASCII
    return out


CLASSES = _classes()
#: Random values for the sum that stands for a word, by byte and by place modulo 64.
MIX = np.random.default_rng(7).integers(0, 1 << 63, (64, 256), dtype=np.int64)
OWN = 14
N_FEATURES = 3 * OWN
#: Bytes that are looked at together.
CHUNK = 1 << 20


@dataclass
class Lines:
    """Lines of some documents one after another; first: where each document's begin."""

    features: np.ndarray
    weight: np.ndarray
    first: np.ndarray


def _own(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(joined == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    kind = CLASSES[joined].astype(np.int64)
    begins = np.ones(len(joined), bool)
    begins[1:] = kind[:-1] == SPACE
    kind += 9 * (begins & (kind != SPACE))
    n = len(ends)
    at_word = np.flatnonzero(kind >= 9)
    line_of = np.repeat(np.arange(n), ends - starts + 1)
    counts = np.bincount(line_of * 18 + kind, minlength=18 * n).reshape(n, 18).astype(float)
    counts[:, SPACE] -= 1  # the line's end
    again = np.zeros(n)
    if len(at_word):
        cuts = np.concatenate([[0], at_word, [len(joined)]])
        place = np.arange(len(joined)) - np.repeat(cuts[:-1], np.diff(cuts))
        value = np.where(kind == SPACE, 0, MIX[place & 63, joined])
        word = np.add.reduceat(value, at_word)
        own_line = line_of[at_word]
        same = (word[1:] == word[:-1]) & (own_line[1:] == own_line[:-1])
        again = np.bincount(own_line[1:][same], minlength=n).astype(float)
    words, all_of = counts[:, 9:].sum(1), counts[:, :9] + counts[:, 9:]
    length = (ends - starts).astype(float)
    letters = all_of[:, LOWER] + all_of[:, UPPER] + all_of[:, BEYOND]
    w, x = words + 1, length + 1
    own = np.stack([np.ones(n), np.log(x) / 5, np.log(w) / 3, all_of[:, UPPER] / (letters + 1), all_of[:, SYMBOL] / w, all_of[:, CALL] / w,
                    10 * all_of[:, DIGIT] / x, letters / w / 5, all_of[:, STOP] / w, all_of[:, BEYOND] / (letters + 1),
                    counts[:, 9 + SYMBOL] / w, 10 * all_of[:, REST] / x, again / w, again > 0.3 * w], 1)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    first = np.searchsorted(starts, at)
    keep = length > 0
    keep[first] = True  # an empty text is one empty line
    kept = np.cumsum(keep)
    return own[keep], np.maximum(length[keep], keep[first].any() * 1e-9), kept[first] - 1


def lines_of(texts: list[bytes]) -> Lines:
    own, weight, first, at = [], [], [], 0
    k = 0
    while k < len(texts):
        size, end = 0, k
        while end < len(texts) and (end == k or size + len(texts[end]) < CHUNK):
            size += len(texts[end])
            end += 1
        o, w, f = _own(texts[k:end])
        own.append(o)
        weight.append(w)
        first.append(f + at)
        at += len(o)
        k = end
    x, begin = np.concatenate(own), np.concatenate(first)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[begin] = 0
    after[np.append(begin[1:], len(x)) - 1] = 0
    return Lines(np.concatenate([x, before, after], 1), np.concatenate(weight), begin)


def marginals(lines: Lines, w: np.ndarray, t: np.ndarray, pairs: bool = False):
    """P(good) of each line, and if asked for the expected transitions and log partition sums.

    t[a, b]: weight of a step from label a to b; label 1 is good.
    """
    n = len(lines.features)
    s = lines.features @ w
    size = np.diff(np.append(lines.first, n))
    order = np.argsort(-size, kind="stable")
    first, active = lines.first[order], len(size) - np.searchsorted(np.sort(size), np.arange(size.max()), side="right")
    e = np.stack([np.zeros(n), s], 1)
    forward, back = e.copy(), np.zeros((n, 2))
    for k in range(1, len(active)):
        i = first[:active[k]] + k
        p = forward[i - 1]
        forward[i, 0] += np.logaddexp(p[:, 0] + t[0, 0], p[:, 1] + t[1, 0])
        forward[i, 1] += np.logaddexp(p[:, 0] + t[0, 1], p[:, 1] + t[1, 1])
    for k in range(len(active) - 1, 0, -1):
        i = first[:active[k]] + k
        q = back[i] + e[i]
        back[i - 1, 0] = np.logaddexp(q[:, 0] + t[0, 0], q[:, 1] + t[0, 1])
        back[i - 1, 1] = np.logaddexp(q[:, 0] + t[1, 0], q[:, 1] + t[1, 1])
    both = forward + back
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
    if not pairs:
        return good
    log_z = np.logaddexp(both[:, 0], both[:, 1])
    inner = np.ones(n, bool)
    inner[lines.first] = False
    i = np.flatnonzero(inner)
    q = back[i] + e[i]
    steps = np.array([[np.exp(forward[i - 1, a] + t[a, b] + q[:, b] - log_z[i]).sum() for b in (0, 1)] for a in (0, 1)])
    return good, steps, log_z[lines.first]


def scores(lines: Lines, w: np.ndarray, t: np.ndarray) -> np.ndarray:
    good = marginals(lines, w, t)
    return np.clip(np.add.reduceat(good * lines.weight, lines.first) / np.add.reduceat(lines.weight, lines.first), 0, 1)


def train(lines: Lines, labels: np.ndarray, rounds: int = 150, rate: float = 0.2, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Likelihood ascent (Adam); every line of a document bears its label."""
    w, t = np.zeros(N_FEATURES), np.eye(2)
    size = np.diff(np.append(lines.first, len(lines.features)))
    y = np.repeat(labels, size)
    seen = lines.features.T @ y
    steps_seen = np.diag([(size - 1)[labels == 0].sum(), (size - 1)[labels == 1].sum()]).astype(float)
    n, m, v = len(labels), np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    for k in range(1, rounds + 1):
        good, steps, _ = marginals(lines, w, t, pairs=True)
        g = np.concatenate([seen - lines.features.T @ good, (steps_seen - steps).ravel()]) / n - decay * np.concatenate([w, t.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
        w, t = w + d[:N_FEATURES], t + d[N_FEATURES:].reshape(2, 2)
    return w, t


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Fit on a bounded sample: the `sample` labelled documents of smallest hashed id, none held out.

    Repeated labels of a document count as the smallest; null ones are left out.
    Without both labels the chain says 0.5 everywhere.
    """
    marked = pick(labels, doc_id="doc_id", label=label_col).where("doc_id is not null and label in (0, 1)")
    chosen = (marked.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = (pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen), "doc_id")
            .select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))
            .mapInArrow(_featured, "doc_id long, label int, features binary, weight binary").toArrow())
    table = rows.sort_by("doc_id")
    y = table["label"].to_numpy().astype(int)
    if len(set(y.tolist())) < 2:
        return np.zeros(N_FEATURES), np.eye(2)
    blocks = [np.frombuffer(b, float).reshape(-1, N_FEATURES) for b in table["features"].to_pylist()]
    size = np.array([len(b) for b in blocks])
    lines = Lines(np.concatenate(blocks), np.concatenate([np.frombuffer(b, float) for b in table["weight"].to_pylist()]),
                  np.concatenate([[0], np.cumsum(size)[:-1]]))
    return train(lines, y)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        lines = lines_of([t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()])
        cuts = list(zip(lines.first, np.append(lines.first[1:], len(lines.features))))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "label": batch.column(1).cast(pa.int32()),
                                          "features": pa.array([lines.features[a:b].tobytes() for a, b in cuts], pa.binary()),
                                          "weight": pa.array([lines.weight[a:b].tobytes() for a, b in cuts], pa.binary())})


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = 0.7, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Quality of every whole text, one row for each row of docs: doc_id, held_out, score, predicted.

    A null text counts as empty, an empty one as a single empty line. A null id
    stays null and is not held out.
    """
    w, t = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = scores(lines_of([(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]), w, t) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    picked = pick(docs, doc_id=id_col, text=text_col)
    return (picked.select(picked.doc_id.cast("long"), "text").mapInArrow(run, "doc_id long, score double")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


def keep_good(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they were, whose text scores at least the threshold."""
    w, t = model
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = scores(lines_of([(x or "").encode("utf-8", "surrogatepass") for x in batch.column(at).to_pylist()]), w, t)
                yield batch.filter(pa.array(got >= threshold))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
