"""Best-fit packing of token sequences under conflicts.

Sequences longer than a bin are cut into full pieces and a rest. Documents are
dealt by hash to shards of bounded size, and each shard is packed by itself:
largest pieces first, each into the tightest bin that has room and holds
neither its source nor its duplicate cluster. Bins are kept in order of what is
left in them and carry both as bitmaps; the search goes from the first bin with
room to the next until one is compatible.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm import ngram_jaccard
from wayline.llm.common import ascii_lower, pick, settle

WORD = r"[^ \t\n\r\x0B\f]+"
SCHEMA = "bin_id long, offset long, doc_id long, piece long, first_token long, n_tokens long"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def best_fit(pieces: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """Bin of each piece (size, source bit, cluster bit), taken in the given order."""
    order: list[tuple[int, int]] = []  # (left, bin)
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in pieces:
        k = bisect_left(order, (size, -1))
        while k < len(order):
            number = order[k][1]
            if not sources[number] & source and not clusters[number] & cluster:
                break
            k += 1
        if k < len(order):
            left, number = order.pop(k)
        else:
            left, number = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[number] |= source
        clusters[number] |= cluster
        insort(order, (left - size, number))
        out.append(number)
    return out


def bits(values: list) -> list[int]:
    """A bit for each value that occurs more than once; nulls and single values conflict with nothing."""
    again = {v: n for n, v in enumerate(sorted(k for k, c in pd.Series(values, dtype=object).value_counts().items() if c > 1))}
    return [1 << again[v] if v in again else 0 for v in values]


def near_copies(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, text_col: str = "text") -> DataFrame:
    """text_id, near, n_words: the near-duplicate group and the number of words of each text that has words.

    Texts are told apart by their hash, not by the id of their row, so that
    repeated ids and rows without one have groups too.
    """
    texts = pick(docs, text=text_col).select(F.xxhash64("text").alias("text_id"), "text")
    found = ngram_jaccard.groups(texts, width, num, den, id_col="text_id", words=True).where("n_shingles > 0")
    return settle(found.groupBy(F.col("doc_id").alias("text_id")).agg(F.min("component_id").cast("string").alias("near"), F.max("n_words").alias("n_words")))


def pack(docs: DataFrame, capacity: int = 2048, shard_docs: int = 4096, n_tokens: Column | None = None, cluster: Column | None = None, id_col: str = "doc_id",
         text_col: str = "text", source_col: str = "source", near: DataFrame | None = None) -> DataFrame:
    """A row for each piece: bin_id, offset in the bin, doc_id, piece, first_token, n_tokens.

    n_tokens and cluster are expressions over text; by default the number of
    words, and a digest of the text in lower case, so that equal texts are one
    cluster. near, if given, has the clusters and words of all texts with words
    as near_copies() tells them, so that texts are not searched for words again;
    cluster then holds for other texts only, by default for those without words. Null sources conflict with
    nothing; a null text is empty and conflicts with no other, and a text
    without tokens is one piece of none. No two pieces in a bin share a source or a cluster, except that what is left
    of a document never meets its own full pieces, which fill bins by
    themselves. Bins of different shards never meet; the number of shards
    follows the rows.
    """
    rows = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    counted = near is not None and n_tokens is None
    some = F.col("text").rlike(WORD)
    words = F.when(some, F.lit(None)).otherwise(0) if counted else word_count(F.col("text")) if n_tokens is None else n_tokens
    group = F.md5(ascii_lower(F.col("text")).cast("binary")) if cluster is None else cluster
    if near is not None and cluster is None:
        group = F.when(~some, group)
    shards = max(1, -(-docs.count() // shard_docs))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), words.cast("long").alias("n"), F.col("source").cast("string").alias("source"), group.cast("string").alias("cluster"),
                        F.xxhash64("text").alias("text_id"))
    if near is not None:
        rows = rows.join(near, "text_id", "left").withColumn("cluster", F.coalesce("near", "cluster"))
        if counted:
            rows = rows.withColumn("n", F.coalesce("n", "n_words", F.raise_error(F.lit("near does not have all texts")).cast("long")))
    rows = (rows.select("doc_id", "n", "source", "cluster")
            .withColumn("shard", F.pmod(F.xxhash64("doc_id", "n", "cluster"), F.lit(shards))))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n", "doc_id", "cluster", "source"], na_position="last", kind="stable")
        part = part.assign(rest=part.n % capacity, full=part.n // capacity)
        todo = part.sort_values("rest", ascending=False, kind="stable")
        todo = todo[(todo.rest > 0) | (todo.n == 0)]
        number = best_fit(list(zip(todo.rest.tolist(), bits(todo.source.tolist()), bits(todo.cluster.tolist()))), capacity)
        opened = max(number, default=-1) + 1
        rest = pd.DataFrame({"bin": number, "doc_id": todo.doc_id.values, "piece": todo.full.values, "n_tokens": todo.rest.values})
        rest["offset"] = rest.groupby("bin").n_tokens.cumsum() - rest.n_tokens
        many = part[part.full > 0]
        full = pd.DataFrame({"doc_id": many.doc_id.repeat(many.full).values, "piece": [k for n in many.full for k in range(n)]})
        full["bin"], full["n_tokens"], full["offset"] = range(opened, opened + len(full)), capacity, 0
        out = pd.concat([x for x in (rest, full) if len(x)] or [rest], ignore_index=True)
        out["bin_id"] = out.bin.astype("int64") * shards + int(part.shard.iloc[0])
        out["first_token"] = out.piece.astype("int64") * capacity
        return out[["bin_id", "offset", "doc_id", "piece", "first_token", "n_tokens"]]

    return rows.groupBy("shard").applyInPandas(run, SCHEMA)
