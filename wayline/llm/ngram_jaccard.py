"""Exact Jaccard join of word-shingle sets by prefixes of token combinations.

A token is the hash of some consecutive words. A set of n tokens may lack
n - ceil(t * n) of them in any set that it links to. Tokens are ordered: those
of one set only first, then rare ones, frequent ones, and those that were not
counted. A prefix in this order is extended until its signatures can't all be
missed:

  * a token of one set only weighs one, and no other set can have it;
  * a rare or uncounted token is a signature by itself and weighs one;
  * frequent tokens are dealt by hash to a number of cells that follows the
    set's size; two tokens of one cell make a signature, and a cell of c tokens
    weighs c - 1, since that many must be missing for no pair to be left.

Two linked sets share a signature of both prefixes. Sets that share one are
compared token by token: first all with the most central set of their common
signature. Sets of signatures in which components still meet go through the
same steps once more, with all tokens counted, and are compared across
components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import bit_table, in_bit_table, pick, pieces, settle
from wayline.llm.components import components

ODD = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
TOKEN_BITS = 62


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _shingles(h: np.ndarray, size: int) -> np.ndarray:
    """A token for each run of size words, from the words' hashes."""
    out = np.full(max(0, len(h) - size + 1), size, np.uint64)
    for k in range(size):
        out = mixed(out + h[k:k + len(out)] * ODD[k % 64])
    return (out >> np.uint64(64 - TOKEN_BITS)).astype(np.int64)


def token_sets(texts: list[str | None], width: int, chars: int = 1 << 17) -> Iterator[tuple[int, np.ndarray]]:
    """The number of words of each text, and its distinct shingles as sorted integers; with fewer words than width all of them are one.

    Short texts are hashed together, about so many characters at a time.
    """
    waiting: list[list[bytes]] = []
    size = 0
    for text in texts:
        waiting.append((text or "").encode("utf-8", "surrogatepass").lower().split())
        size += len(text or "")
        if size >= chars:
            yield from _token_sets(waiting, width)
            waiting, size = [], 0
    yield from _token_sets(waiting, width)


def _token_sets(texts: list[list[bytes]], width: int) -> Iterator[tuple[int, np.ndarray]]:
    at = np.concatenate([[0], np.cumsum([len(words) for words in texts], dtype=np.int64)]).tolist()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(texts)), np.uint64, at[-1])
    every = _shingles(h, width)  # those across two texts are not used
    for a, b in pairwise(at):
        own = np.sort(every[a:b - width + 1] if b - a >= width else _shingles(h[a:b], b - a)) if b > a else np.zeros(0, np.int64)
        again = own[1:] == own[:-1]
        yield b - a, own[np.append(True, ~again)] if again.any() else own


def tokens_of(text: str | None, width: int) -> np.ndarray:
    return next(token_sets([text], width))[1]


class Rule:
    """Linked if den * |x & y| >= num * |x | y|."""

    def __init__(self, num: int, den: int, share: float | None = None):
        if not den < 2 * num <= 2 * den:
            raise ValueError("the threshold has to be above one half, and one at most")
        self.num, self.den = num, den
        #: Tokens below this are counted; the share covers a prefix of frequent ones in nearly all sets.
        self.counted = int(min(1.0, 1.5 * (1 - num / den) + 0.1 if share is None else share) * (1 << TOKEN_BITS))

    def need(self, n: int) -> int:
        """Weight of a prefix that can't be missed: one more than the tokens a linked set may lack."""
        return n + (-self.num * n // self.den) + 1

    def octaves(self, n: int) -> list[int]:
        """The set's own size class, and the next if linked sets may be in it."""
        own = n.bit_length() - 1
        return [own] + [own + 1] * (n * self.den // self.num >= 1 << (own + 1))

    @staticmethod
    def cells(octave: int) -> int:
        return 1 << max(0, octave - 4)

    def kept(self, tokens: np.ndarray) -> np.ndarray:
        """The counted tokens if they make a prefix whatever their frequencies, else all."""
        n = len(tokens)
        few = tokens[:np.searchsorted(tokens, self.counted)]
        return few if n > 1 and len(few) - self.cells(self.octaves(n)[-1]) >= self.need(n) else tokens

    def signatures(self, tokens: np.ndarray, n: int, common: np.ndarray, frequent: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(signatures, tokens that stand before them and can't be shared) for each size class."""
        known = tokens < self.counted
        hot = known & in_bit_table(frequent, tokens)
        shared = in_bit_table(common, tokens)
        rare, often, rest = tokens[known & shared & ~hot], tokens[hot], tokens[~known]
        alone = int((known & ~shared & ~hot).sum())
        need, out = max(0, self.need(n) - alone), []
        for octave in self.octaves(n):
            salt = ODD[octave]
            single, before = rare[:need], alone + np.arange(min(need, len(rare)))
            missing = need - len(single)
            pairs = np.zeros(0, np.uint64)
            if missing:
                cell = mixed(often.astype(np.uint64) * salt) % np.uint64(self.cells(octave))
                again = np.ones(len(often), bool)
                again[np.unique(cell, return_index=True)[1]] = False
                weight = np.cumsum(again)
                end = int(np.searchsorted(weight, missing)) + 1
                often_in, cell = often[:end], cell[:end]
                order = np.argsort(cell, kind="stable")
                t, c = often_in[order].astype(np.uint64), cell[order]
                found = []
                for lag in range(1, len(t)):
                    same = c[lag:] == c[:-lag]
                    if not same.any():
                        break
                    found.append(mixed(t[:-lag][same] * ODD[1] + t[lag:][same] * ODD[2] + salt))
                pairs = np.concatenate(found) if found else pairs
                missing = max(0, missing - (int(weight[min(end, len(weight)) - 1]) if len(weight) else 0))
                single = np.concatenate([single, rest[:missing]])
                before = np.concatenate([before, np.full(min(missing, len(rest)), alone + len(rare))])
            out.append((np.concatenate([mixed(single.astype(np.uint64) + salt), pairs]).astype(np.int64),
                        np.concatenate([before, np.full(len(pairs), alone + len(rare))])))
        return out


def _sets(docs: DataFrame, width: int, rule: Rule) -> DataFrame:
    """doc_id, n, words, key (null if empty) and the tokens that are kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n, words, key, kept = [], [], [], []
            for count, tokens in token_sets(batch.column(1).to_pylist(), width):
                n.append(len(tokens))
                words.append(count)
                key.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                kept.append(rule.kept(tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(words, pa.int64()), pa.array(key, pa.binary()), lists(kept)],
                                             ["doc_id", "n", "words", "key", "tokens"])

    return docs.mapInArrow(run, "doc_id long, n long, words long, key binary, tokens array<long>")


def lists(parts: list[np.ndarray], kind: type = np.int64) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*parts, np.zeros(0, kind)]).astype(kind)))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """For each value of the tokens' low nine bits whether an odd number of tokens has it, in eight words.

    Where the sketches of two sets differ, a token is in one of them only, so
    that their differing bits are no more than the tokens that are not common.
    """
    return np.packbits(np.bincount(tokens & 511, minlength=512) & 1 == 1, bitorder="little").view("<i8")


def _held(batch: pa.RecordBatch, held: np.ndarray | None) -> pa.RecordBatch:
    """The rows whose mark (the last column) is in the table; all rows without one."""
    return batch if held is None else batch.filter(pa.array(in_bit_table(held, batch.column(batch.num_columns - 1).to_numpy())))


SKETCH = [f"s{k}" for k in range(8)]


def _signatures(sets: DataFrame, rule: Rule, common: np.ndarray, frequent: np.ndarray, held: np.ndarray | None = None, sketched: bool = False) -> DataFrame:
    """node, n, the set's signatures and what stands before them, and the sketch if it is asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            batch = _held(batch, held)
            if not batch.num_rows:
                continue
            flat, at = batch.column(2).values.to_numpy(), batch.column(2).offsets.to_numpy()
            found: list[np.ndarray] = []
            before: list[np.ndarray] = []
            for k, n in enumerate(batch.column(1).to_pylist()):
                of = rule.signatures(flat[at[k]:at[k + 1]], n, common, frequent)
                found.append(np.concatenate([x for x, _ in of]))
                before.append(np.concatenate([x for _, x in of]))
            columns = [batch.column(0), batch.column(1), lists(found), lists(before, np.int32)]
            if sketched:
                bits = np.array([sketch(flat[a:b]) for a, b in pairwise(at)])
                columns += [pa.array(np.ascontiguousarray(bits[:, k])) for k in range(len(SKETCH))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "sigs", "before", *more])

    more = SKETCH if sketched else []
    return _columns(sets, ["node", "n", "tokens"], held).mapInArrow(run, "node long, n long, sigs array<long>, before array<int>" + "".join(f", {x} long" for x in more))


def _signature_rows(signatures: DataFrame) -> DataFrame:
    """sig, node, n, pos and the other columns."""
    rest = [x for x in signatures.columns if x not in ("sigs", "before")]
    each = signatures.select(*rest, F.inline(F.arrays_zip("sigs", "before")))
    return each.select(F.col("sigs").alias("sig"), F.col("before").cast("long").alias("pos"), *rest)


def _columns(sets: DataFrame, names: list[str], held: np.ndarray | None) -> DataFrame:
    return sets.where("n > 1").select(*names, *([] if held is None else ["mark"]))


def _full_sets(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """node, tokens: the whole set of each wanted node, or sets if its texts differ; each once, however many copies there are."""
    table, _ = bit_table(wanted, F.col("node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # of this task's rows
        for batch in pieces(batches):
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            some = batch.filter(pa.array(in_bit_table(table, ids) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)))
            nodes, texts = [], []
            for node, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                own = node, xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass"))
                if own not in seen:
                    seen.add(own)
                    nodes.append(node)
                    texts.append(text)
            sets = [tokens for _, tokens in token_sets(texts, width)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), lists(sets)], ["node", "tokens"])

    found = docs.mapInArrow(run, "node long, tokens array<long>").join(wanted, "node", "left_semi")
    return found.groupBy("node", F.xxhash64("tokens")).agg(F.first("tokens").alias("tokens")).select("node", "tokens")


def _classes(sets: DataFrame, rule: Rule, frequent_from: int, table_bits: int, held: np.ndarray | None = None) -> list[np.ndarray]:
    """Tables of the tokens in several sets, and of those in more than frequent_from.

    A bucket is a stretch of both tables. Tokens go to their bucket as sorted
    words of 32 bits: their place in it and further bits, so that tokens of one
    place are counted apart (a collision takes a rare token for a shared one).
    """
    top = min(10, max(0, table_bits - 6))
    low = min(32, table_bits - top)
    again = frequent_from + 1

    def packed(tokens: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        t = np.concatenate(tokens).astype(np.uint64)
        place, more = t & np.uint64((1 << low) - 1), t >> np.uint64(low + top)
        bucket = (t >> np.uint64(low)) & np.uint64((1 << top) - 1)
        word = (bucket << np.uint64(32)) | place | ((more << np.uint64(low)) & np.uint64((1 << 32) - 1))
        word.sort()
        keep = np.ones(len(word), bool)  # one more than frequent_from of a kind say as much as all
        keep[again:] = word[again:] != word[:-again]
        word = word[keep]
        bucket = (word >> np.uint64(32)).astype(np.int32)
        cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
        values = word.astype(np.uint32).astype("<u4")
        parts = [values[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(word)])]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int32()), pa.array(parts, pa.binary())], ["bucket", "words"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in pieces(batches):
            batch = _held(batch, held)
            t = batch.column(0).flatten().to_numpy()
            t = t[t < rule.counted]
            if len(t):
                waiting.append(t)
                size += len(t)
            if size >= 1 << 21:
                yield from packed(waiting)
                waiting, size = [], 0
        if size:
            yield from packed(waiting)

    def count(group: pa.Table) -> pa.Table:
        words = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in group.column(1)]))
        first = np.concatenate([[0], np.flatnonzero(words[1:] != words[:-1]) + 1])
        times = np.diff(np.append(first, len(words)))
        found = words[first].astype(np.int64) & ((1 << low) - 1)
        tables = []
        for least in (1, frequent_from):
            marked = np.zeros(1 << low, bool)
            marked[found[times > least]] = True
            tables.append(np.packbits(marked, bitorder="little").tobytes())
        return pa.table({"bucket": pa.array([group.column(0)[0].as_py()], pa.int32()), "common": pa.array([tables[0]], pa.binary()), "frequent": pa.array([tables[1]], pa.binary())})

    dealt = _columns(sets, ["tokens"], held).mapInArrow(send, "bucket int, words binary")
    found = dealt.groupBy("bucket").applyInArrow(count, "bucket int, common binary, frequent binary").toArrow()
    out = []
    for name in ("common", "frequent"):
        table = np.zeros((1 << top, (1 << low) // 8), np.uint8)
        for bucket, part in zip(found["bucket"].to_pylist(), found[name].to_pylist()):
            table[bucket] = np.frombuffer(part, np.uint8)
        out.append(table.reshape(-1).view("<u8"))
    return out


def _linked(pairs: DataFrame, full: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b and other columns) whose whole sets are similar enough."""
    both = (pairs.join(full.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
            .join(full.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b"))
    shared = F.size(F.array_intersect("x", "y"))
    return (both.withColumn("shared", shared)
            .where((rule.num + rule.den) * F.col("shared").cast("long") >= rule.num * (F.size("x") + F.size("y")).cast("long")).select(*pairs.columns).distinct())


def groups(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, frequent_from: int = 32, table_bits: int = 26, id_col: str = "doc_id", text_col: str = "text",
           words: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) and, if words, n_words. One row for each row of docs.

    Words are runs of anything but ASCII white space, A-Z in lower case; texts
    link when num / den of their distinct shingles of `width` words, or more,
    are common. Null and empty texts have no shingles and link with nothing.
    Rows of one id count as one document; rows without an id link with nothing
    and have no component. Equal sets are joined once, tokens in more than
    frequent_from different sets are frequent ones. The classes of tokens reach
    tasks as two tables of 2**table_bits bits: a fuller table takes more tokens
    for shared ones, which costs time and loses no link.
    """
    rule = Rule(num, den)
    docs = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Tokens are stored once and never shuffled: a table of bits says which row stands for its set. A row
    # that it names by mistake is a copy, which has the same links as the row that stands for it.
    extra = ["words"] if words else []
    rows = settle(_sets(docs, width, rule).select("doc_id", "n", *extra, "key", "tokens", F.xxhash64(F.monotonically_increasing_id()).alias("mark")))
    own = rows.where("key is not null and doc_id is not null")
    chosen = settle(own.groupBy("key").agg(F.min(F.struct("doc_id", "mark")).alias("own")).select("key", F.col("own.doc_id").alias("node"), F.col("own.mark").alias("mark")))
    named = settle(rows.select("doc_id", "n", *extra, "key").join(chosen.select("key", "node"), "key", "left").select("doc_id", "n", *extra, "node"))
    held, _ = bit_table(chosen, F.col("mark"), table_bits)
    sets = own.select(F.col("doc_id").alias("node"), "n", "tokens", "mark")
    several = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("hi")).where("a <> hi").select("doc_id", "a")
    same = several.join(named, "doc_id").select("a", F.col("node").alias("b")).where("a <> b").distinct()  # texts of one id

    # Signatures are made once and stored as two arrays a set.
    signatures = _signature_rows(settle(_signatures(sets, rule, *_classes(sets, rule, frequent_from, table_bits, held), held)))
    met = signatures.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("sig")
    shared = settle(signatures.join(met, "sig"))
    may = f"{num + den} * least(l.n - l.pos, r.n - r.pos) >= {num} * (l.n + r.n)"
    pivots = shared.groupBy("sig").agg(F.min(F.struct("pos", "node", "n")).alias("p")).select("sig", F.col("p.node").alias("node"), F.col("p.n").alias("n"), F.col("p.pos").alias("pos"))
    stars = settle(shared.alias("l").join(pivots.alias("r"), F.expr(f"l.sig = r.sig and l.node <> r.node and {may}"))
                   .select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct())
    full = _full_sets(docs, width, settle(stars.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    links = settle(_linked(stars, full, rule).unionByName(same))
    first = components(links)

    # Where components meet, all tokens of their sets are counted, so that the order tells more of them apart.
    placed = shared.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = settle(_several(placed).join(shared, "sig").select("node").distinct())
    rest = settle(_full_sets(docs, width, open_).withColumn("n", F.size("tokens").cast("long")))
    whole = Rule(num, den, 1.0)
    finer = (_signature_rows(settle(_signatures(rest, whole, *_classes(rest, whole, frequent_from, table_bits), sketched=True)))
             .join(first, "node", "left").withColumn("component", F.coalesce("component", "node")))
    finer = settle(finer.join(_several(finer), "sig"))
    # Linked sets differ in (den - num) / (den + num) of their tokens at most, and in no fewer than their sketches do.
    near = f"{num + den} * ({' + '.join(f'bit_count(l.{x} ^ r.{x})' for x in SKETCH)}) <= {den - num} * (l.n + r.n)"
    # A pair is made at its first common signature only: rare tokens stand in one order, all else behind them, so that
    # nowhere fewer tokens stand before it in either set, and what fails `may` there fails it at all others.
    own_sigs = finer.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("pos", "sig"))).alias("own")).select("node", F.transform("own", lambda x: x["sig"]).alias("sigs"))
    finer = finer.join(own_sigs, "node")
    once = "l.sig = element_at(array_intersect(l.sigs, r.sigs), 1)"
    pairs = (finer.alias("l").join(finer.alias("r"), F.expr(f"l.sig = r.sig and l.node < r.node and l.component <> r.component and {may} and {near} and {once}"))
             .select(F.col("l.node").alias("a"), F.col("r.node").alias("b"), F.col("l.component").alias("ca"), F.col("r.component").alias("cb")).distinct())
    # Further links join whole components, so that only those go through the rounds again.
    joined = components(_linked(pairs, rest, rule).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    again = first.join(joined.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    found = again.unionByName(joined.join(first, "node", "left_anti").select("node", "component"))
    return (named.join(found, "node", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id"),
                    *[F.col(x).alias("n_words") for x in extra]))


def _several(placed: DataFrame) -> DataFrame:
    """Signatures in which several components meet."""
    return placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("sig")


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns as they were, with the document of smallest id of each group; rows without an id stay."""
    gone = groups(docs, width, num, den, id_col=id_col, text_col=text_col).where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.join(gone, F.col(f"c{docs.columns.index(id_col)}") == F.col("gone"), "left_anti").toDF(*docs.columns)
