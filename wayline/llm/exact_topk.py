"""Exact top-k by distributed selection on score histograms.

All scores of all queries are counted in a histogram of a few hundred cells;
the cell that holds a query's k-th score is cut into as many cells again, until
a cell is one score wide. Then the scores from that value up are kept and ties
at it go to smaller ids. A task reports its cells from the top down to the one
in which its own k-th score lies, as lower ones can't hold the global one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.blocks import meet, shards_for, vectors
from wayline.llm.common import settle

#: Sums of products are exact in double arithmetic below this, and in 64-bit integers below that.
EXACT, WHOLE = 1 << 52, 1 << 62
#: Scores beyond 64 bits count as this or its opposite.
LIMIT = (1 << 63) - 1


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products, rows by queries; exact for vectors of any length.

    No partial sum is larger than the product of the two lengths, by which rows
    and queries are told apart: doubles do for most, 64-bit integers for long
    ones and Python's for those beyond.
    """
    out = np.empty((len(x), len(q)), np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        long_x, long_q = (np.sqrt((v * v).sum(axis=1)) for v in (x, q))
        short = long_x * long_q.max(initial=0) < EXACT
        out[short] = x[short] @ q.T
        rest = np.flatnonzero(~short)
        if not len(rest):
            return out
        plain = long_q * long_x[rest].max() < EXACT
        out[np.ix_(rest, plain)] = x[rest] @ q[plain].T
        far = np.flatnonzero(~plain)
        whole = long_x[rest] * long_q[far].max(initial=0) < WHOLE
        narrow = whole & (long_x[rest] < WHOLE)
        if len(far) and long_q[far].max() < WHOLE and narrow.any():
            out[np.ix_(rest[narrow], far)] = x[rest[narrow]].astype(np.int64) @ q[far].astype(np.int64).T
            rest = rest[~narrow]
    if len(rest) and len(far):
        exact = [[sum(int(a) * int(b) for a, b in zip(v, w)) for w in q[far]] for v in x[rest]]
        out[np.ix_(rest, far)] = [[max(-LIMIT, min(LIMIT, s)) for s in row] for row in exact]
    return out


def search(df: DataFrame, every: int = 50, k: int = 5, cells: int = 512, scale: float = 256.0, shard_rows: int = 4096, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """The k highest integer inner products of each row whose id is divisible by `every`.

    Components become floor(scale * x). query_id, rank from 1, vec_id, score;
    ties go to smaller ids; a query's own id is no candidate. Null vectors and
    those with null or non-finite components take no part; rows of one id count
    once, with the smallest vector. Scores are exact; one beyond 64 bits counts as
    the nearest of them but the lowest. An empty table gives no rows; other
    columns may have any name.
    """
    def whole(x):
        y = F.greatest(F.lit(-1.7e308), F.least(F.lit(1.7e308), x * scale))
        return F.when(F.abs(y) < float(EXACT), F.floor(F.when(F.abs(y) < float(EXACT), y)).cast("double")).otherwise(y)  # larger ones are whole

    data = vectors(df, id_col, vec_col, zero=True).withColumn("vec", F.transform("vec", whole))
    data = settle(data)
    rows, longest = data.agg(F.count(F.lit(1)), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not rows:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # No product is larger than the longest vector's with itself.
    bound = min(int(longest * (1 + 1e-9)) + 1, LIMIT) if longest < LIMIT else LIMIT
    width = 1
    while width * cells <= 2 * bound + 1:
        width *= cells
    shards = shards_for(rows, shard_rows)
    queries = data.where(F.col("vec_id") % every == 0)

    def counted(low_need: DataFrame, width: int) -> DataFrame:
        """For each query the start of the cell of its k-th score, and how many scores it needs from there."""
        def serve(ids, x):
            def ask(query_ids, q, extra):
                low = np.array([np.frombuffer(e, np.int64) for e in extra.to_pylist()])
                s = products(x, q)
                out = [[], [], []]
                for j, i in enumerate(query_ids):
                    own = s[ids != i, j]
                    # Differences of any two scores fit unsigned integers.
                    cell = (own[own >= low[j, 0]].view(np.uint64) - low[j, :1].view(np.uint64)) // np.uint64(width)
                    at, n = np.unique(cell[cell < cells], return_counts=True)
                    above = np.cumsum(n[::-1])[::-1]
                    top = above - n < low[j, 1]  # cells that the task's own scores above don't fill
                    out[0].append(np.full(top.sum(), i))
                    out[1].append((low[j, :1].view(np.uint64) + at[top] * np.uint64(width)).view(np.int64))
                    out[2].append(n[top])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], ["query_id", "cell", "n"])
            return ask

        cells_of = meet(data, low_need, shards, serve, "query_id long, cell long, n long").groupBy("query_id", "cell").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("cell"))
        run = cells_of.withColumn("upto", F.sum("n").over(down))
        need = low_need.select("vec_id", "vec", "need")
        # With fewer candidates than k the lowest cell is the one.
        at = (run.join(need.select(F.col("vec_id").alias("query_id"), "need"), "query_id")
              .groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("upto") >= F.col("need"), F.struct("cell", (F.col("need") - F.col("upto") + F.col("n")).alias("need")))),
                                                  F.min(F.struct("cell", (F.col("need") - F.col("upto") + F.col("n")).alias("need")))).alias("at")))
        return packed(need.drop("need").join(at, F.col("vec_id") == F.col("query_id")).select("vec_id", "vec", F.col("at.cell").alias("low"), F.col("at.need").alias("need")))

    def packed(q: DataFrame) -> DataFrame:
        """low and need as two little-endian integers."""
        digits = lambda c: F.lpad(F.hex(c), 16, "0")
        turned = lambda c: F.array_join(F.transform(F.sequence(F.lit(15), F.lit(1), F.lit(-2)), lambda i: F.substring(digits(c), i, F.lit(2))), "")
        return q.withColumn("extra", F.unhex(F.concat(turned(F.col("low")), turned(F.col("need")))))

    state = packed(queries.withColumn("low", F.lit(-bound)).withColumn("need", F.lit(k).cast("long")))
    while True:
        state = settle(counted(state, width))
        if width == 1:
            break
        width //= cells

    def serve(ids, x):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]

        def ask(query_ids, q, extra):
            low = np.array([np.frombuffer(e, np.int64) for e in extra.to_pylist()])
            s = products(x, q)
            out = [[], [], []]
            for j, i in enumerate(query_ids):
                above = np.flatnonzero((s[:, j] > low[j, 0]) & (ids != i))
                tied = np.flatnonzero((s[:, j] == low[j, 0]) & (ids != i))[:low[j, 1]]
                take = np.concatenate([above, tied])
                out[0].append(np.full(len(take), i))
                out[1].append(ids[take])
                out[2].append(s[take, j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], ["query_id", "vec_id", "score"])
        return ask

    found = meet(data, state, shards, serve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle() -> str:
    return """
    with sound as (select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v from embeddings
                   where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scored as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
               from sound q join sound c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
    select query_id, cast(rank as integer) as rank, vec_id, score
    from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 5"""
