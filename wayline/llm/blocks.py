"""Vectors in shards, each met by every query, without a group that one task has to hold as a whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import pick


def vectors(df: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """vec_id and vec array<double> of the rows that can take part.

    Null ids, null or empty vectors, null or non-finite components and (unless
    zero) vectors of zeros are left out. Rows of the same id count once, with
    the smallest vector.
    """
    vec = F.col("vec").cast("array<double>")
    fit = F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = pick(df, vec_id=id_col, vec=vec_col).select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where(fit).where(sound)
    if not zero:
        rows = rows.where(F.exists("vec", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def shards_for(rows: int, shard_rows: int) -> int:
    return max(1, -(-rows // shard_rows))


def meet(data: DataFrame, queries: DataFrame, shards: int, serve: Callable, schema: str, seed: int = 17) -> DataFrame:
    """Run every query on every shard.

    serve(ids, vectors) builds a shard's index and returns a function of
    (ids, vectors, extra) for blocks of queries, which gives an iterator of
    record batches. queries has vec_id, vec and extra binary. A shard's rows come
    first and are held, some thousands; queries stream past them. Only vectors
    of the same length meet.
    """
    own = data.select(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(shards)).cast("int").alias("shard"), F.size("vec").alias("size"),
                      F.lit(0).alias("kind"), "vec_id", "vec", F.lit(None).cast("binary").alias("extra"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.size("vec").alias("size"), F.lit(1).alias("kind"),
                           "vec_id", "vec", "extra")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, ask = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(a, b - a)
                ids = part.column(3).to_numpy()
                x = part.column(4).flatten().to_numpy().reshape(len(ids), -1)
                if tuple(keys[a, :2]) != shard:
                    shard, held, ask = tuple(keys[a, :2]), [], None
                if keys[a, 2] == 0:
                    held.append((ids, x))
                elif held:
                    if ask is None:
                        ask = serve(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                    for k in range(0, len(ids), 256):
                        yield from ask(ids[k:k + 256], x[k:k + 256], part.column(5).slice(k, 256))

    return own.unionByName(asked).repartition(F.col("shard")).sortWithinPartitions("shard", "size", "kind").mapInArrow(run, schema)
