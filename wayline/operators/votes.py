"""Voting between competing readings of one frame.

A frame of a few dozen votes is put together in one exchange of the votes, and
they are compared there. In a larger one, copies of one position are merged first
and the rest summed up per grid cell: votes around one true position share a few
cells and are counted by those sums, and single votes are compared only across
the shell where a cell is partly within the tolerance. No larger frame is
gathered, and no all-pairs join is formed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.text import in_range
from wayline.session import settle

# Agreement (km), override distance (km), score of the glyph vote.
AGREE_KM = 1.0
OVERRIDE_KM = 50.0
GLYPH_SCORE = 0.85
#: Most votes of a frame that is gathered.
SMALL_FRAME = 64


def usable(df: DataFrame) -> DataFrame:
    return df.filter(in_range(F.col("x"), F.col("y"), F.col("z")))


def distinct_positions(votes: DataFrame, keys: list[str], order: str, extra: list[str]) -> DataFrame:
    """Merge equal positions of a frame, keeping count, first vote and best vote."""
    first = F.struct(order, "score", *extra)
    best = F.struct(F.col("score"), (-F.col(order)).alias("rev"))
    return usable(votes).groupBy(*keys, "x", "y", "z").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(first, F.col(order)).alias("first"),
        F.max_by(first, best).alias("best"))


# Cells are half a tolerance wide: everything in a cell and its direct neighbours
# agrees, everything four or more cells away does not, and only the shell between
# has to be compared vote by vote. Cells meet through tiles of eight cells.
_PER_TOLERANCE, _INNER, _OUTER, _TILE = 2, 1, 3, 8
_CELL = ["_ix", "_iy", "_iz"]


def _totals(n: str, best: str, xyz: list[str], order: str, weighted: bool = True) -> list[Column]:
    rank = F.struct(F.col(f"{best}.score"), (-F.col(f"{best}.{order}")).alias("rev"))
    sums = [F.sum(F.col(c) * F.col(n)) if weighted else F.sum(c) for c in xyz]
    return [F.sum(n).alias("size"), *[v.alias(f"sum_{c}") for v, c in zip(sums, "xyz")],
            F.max_by(best, rank).alias("best")]


def _cell_pairs(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of occupied cells that may hold agreeing votes, with flag ``inner``.

    Their number is bounded by geometry, not by the number of votes.
    """
    def tiles(c: str) -> Column:
        return F.array_distinct(F.array(F.floor((F.col(c) - _OUTER) / _TILE), F.floor((F.col(c) + _OUTER) / _TILE)))

    touched = F.flatten(F.transform(tiles("_ix"), lambda i: F.flatten(F.transform(
        tiles("_iy"), lambda j: F.transform(tiles("_iz"), lambda k: F.struct(
            i.alias("_tx"), j.alias("_ty"), k.alias("_tz")))))))
    here = cells.select(*keys, *_CELL, F.explode(touched).alias("_t")).select(*keys, *_CELL, "_t.*")
    there = cells.select(*keys, *[F.col(c).alias(f"_j{c[-1]}") for c in _CELL],
                         *[F.floor(F.col(c) / _TILE).alias(f"_t{c[-1]}") for c in _CELL],
                         "size", *[f"sum_{c}" for c in "xyz"], "best")
    far = F.greatest(*[F.abs(F.col(f"_i{c}") - F.col(f"_j{c}")) for c in "xyz"])
    return (here.join(there, [*keys, "_tx", "_ty", "_tz"]).filter(far <= _OUTER)
            .withColumn("inner", far <= _INNER).drop("_tx", "_ty", "_tz"))


def neighbourhoods(votes: DataFrame, keys: list[str], order: str = "ord", tol: float = AGREE_KM,
                   extra: tuple[str, ...] = ()) -> DataFrame:
    """Per distinct position: members within ``tol`` on every axis, their sums and best vote."""
    width = tol / _PER_TOLERANCE
    # Read four times below, so stored once.
    spots = settle(distinct_positions(votes, keys, order, list(extra)).withColumns(
        {f"_i{c}": F.floor(F.col(c) / width) for c in "xyz"}))
    cells = spots.groupBy(*keys, *_CELL).agg(*_totals("n", "best", list("xyz"), order))
    pairs = _cell_pairs(cells, keys)
    inside = pairs.filter("inner").groupBy(*keys, *_CELL).agg(
        *_totals("size", "best", ["sum_x", "sum_y", "sum_z"], order, weighted=False))

    other = spots.select(*keys, *[F.col(f"_i{c}").alias(f"_j{c}") for c in "xyz"], F.col("n").alias("on"),
                         F.col("best").alias("obest"), *[F.col(c).alias(f"o{c}") for c in "xyz"])
    shell = pairs.filter("not inner").select(*keys, *_CELL, "_jx", "_jy", "_jz")
    met = spots.select(*keys, *_CELL, *"xyz").join(shell, [*keys, *_CELL]).join(other, [*keys, "_jx", "_jy", "_jz"])
    for c in "xyz":
        met = met.filter(F.abs(F.col(f"o{c}") - F.col(c)) <= tol)
    outside = met.groupBy(*keys, *"xyz").agg(*_totals("on", "obest", ["ox", "oy", "oz"], order))

    fields = ["size", "sum_x", "sum_y", "sum_z", "best"]
    parts = (spots.drop("best").join(inside, [*keys, *_CELL]).select(*keys, *"xyz", "first", *fields)
             .unionByName(outside.withColumn("first", F.lit(None).cast(spots.schema["first"].dataType))))
    return parts.groupBy(*keys, *"xyz").agg(
        F.first("first", ignorenulls=True).alias("first"),
        *_totals("size", "best", ["sum_x", "sum_y", "sum_z"], order, weighted=False))


def _by_size(votes: DataFrame, keys: list[str], small: int) -> tuple[DataFrame, DataFrame | None]:
    """The votes of frames of at most ``small`` votes, and those of larger ones, if there are any."""
    large = settle(votes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > small).drop("_n"))
    if large.isEmpty():
        return votes, None
    return votes.join(large, keys, "left_anti"), votes.join(large, keys, "left_semi")


def _near(frame: Column, at: Callable[[str], Column], tol: float) -> Column:
    """The votes of a gathered frame that agree with a position."""
    return F.filter(frame, lambda v: (F.abs(v["x"] - at("x")) <= tol) & (F.abs(v["y"] - at("y")) <= tol) & (F.abs(v["z"] - at("z")) <= tol))


def _gathered(votes: DataFrame, keys: list[str], order: str, extra: list[str]) -> DataFrame:
    """One row per frame with its votes in order."""
    here = Window.partitionBy(*keys).orderBy(order)
    every = here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    vote = F.struct(F.col(order).alias("ord"), *"xyz", *extra)
    return (votes.select(*keys, F.collect_list(vote).over(every).alias("frame"), F.row_number().over(here).alias("_k"))
            .filter(F.col("_k") == 1).drop("_k"))


def agreeing(votes: DataFrame, keys: list[str], order: str = "ord", tol: float = AGREE_KM,
             small: int = SMALL_FRAME) -> DataFrame:
    """Per vote with a position in range: ``size``, the votes that agree with it, itself included."""
    few, many = _by_size(usable(votes).dropna(subset=keys).select(*keys, order, *"xyz", "score"), keys, small)
    sized = F.transform("frame", lambda v: F.struct(v["ord"].alias("ord"), F.size(_near(F.col("frame"), v.getField, tol)).cast("bigint").alias("size")))
    out = (_gathered(few, keys, order, []).select(*keys, F.explode(sized).alias("v"))
           .select(*keys, F.col("v.ord").alias(order), "v.size"))
    if many is None:
        return out
    sizes = neighbourhoods(many, keys, order, tol).select(*keys, *"xyz", "size")
    return out.unionByName(many.join(sizes, [*keys, *"xyz"]).select(*keys, order, "size"))


def _small_consensus(votes: DataFrame, keys: list[str], order: str, tol: float, extra: list[str]) -> DataFrame:
    frames = _gathered(votes, keys, order, ["score", *extra])
    frame = F.col("frame")
    sized = F.transform(frame, lambda v: F.struct(F.size(_near(frame, v.getField, tol)).alias("size"), (-v["ord"]).alias("rev"), v.alias("v")))
    top = frames.withColumn("_top", F.array_max(sized)).filter(F.col("_top.size") >= 2)
    near = top.withColumn("near", _near(frame, F.col("_top.v").getField, tol))
    best = F.array_max(F.transform("near", lambda v: F.struct(
        v["score"].alias("score"), (v["ord"] == F.col("_top.v.ord")).alias("own"), (-v["ord"]).alias("rev"), *[v[e].alias(e) for e in extra])))

    def mean(c: str) -> Column:
        return (F.aggregate("near", F.lit(0.0), lambda total, v: total + v[c]) / F.col("_top.size")).alias(c)

    return (near.withColumn("_best", best)
            .select(*keys, F.col("_top.size").cast("bigint").alias("size"), *[mean(c) for c in "xyz"],
                    F.col("_best.score").alias("score"), *[F.col(f"_best.{e}").alias(e) for e in extra]))


def _large_consensus(votes: DataFrame, keys: list[str], order: str, tol: float, extra: list[str]) -> DataFrame:
    groups = neighbourhoods(votes, keys, order, tol, tuple(extra)).filter(F.col("size") >= 2)
    rank = F.struct(F.col("size"), (-F.col(f"first.{order}")).alias("rev"))
    top = groups.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in groups.columns if c not in keys]), rank).alias("g"))
    g = F.col("g")
    chosen = F.when(g["first"]["score"] == g["best"]["score"], g["first"]).otherwise(g["best"])
    return (top.withColumn("_best", chosen)
            .select(*keys, g["size"].alias("size"),
                    *[(g[f"sum_{c}"] / g["size"]).alias(c) for c in "xyz"],
                    F.col("_best.score").alias("score"), *[F.col(f"_best.{e}").alias(e) for e in extra]))


def consensus(votes: DataFrame, keys: list[str], order: str = "ord", tol: float = AGREE_KM,
              extra: tuple[str, ...] = (), small: int = SMALL_FRAME) -> DataFrame:
    """Mean of the largest agreeing group of two or more; the earliest one on ties.

    Other fields come from the group's best-scoring vote. Among equal scores the
    vote the group was built around comes first, then the earliest.
    """
    few, many = _by_size(usable(votes).dropna(subset=keys).select(*keys, order, "score", *"xyz", *extra), keys, small)
    out = _small_consensus(few, keys, order, tol, list(extra))
    return out if many is None else out.unionByName(_large_consensus(many, keys, order, tol, list(extra)))


def best_pass(votes: DataFrame, keys: list[str], order: str = "ord", need_position: bool = False) -> DataFrame:
    """Highest score, earliest on ties; by default even when it has no position."""
    pool = votes.filter(F.col("x").isNotNull()) if need_position else votes
    keep = [c for c in votes.columns if c not in keys]
    rank = F.struct(F.col("score"), (-F.col(order)).alias("rev"))
    return (pool.groupBy(*keys).agg(F.max_by(F.struct(*keep), rank).alias("_r"))
            .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in keep]))


def glyph_votes(passes: DataFrame, glyphs: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """One vote per frame that has glyph coordinates, with the best text pass's other fields."""
    glyphs = glyphs.filter(F.col("x").isNotNull())
    best = best_pass(passes, keys, order).drop("x", "y", "z", "score", "pass")
    last = F.lit(2 ** 62)
    return (glyphs.select(*keys, "x", "y", "z").join(best, keys, "left")
            .withColumn("location", F.coalesce("location", F.lit("Unknown")))
            .withColumn("pass", F.lit("glyph")).withColumn("score", F.lit(GLYPH_SCORE))
            .withColumn(order, last).select(*passes.columns))


def with_glyph_votes(passes: DataFrame, glyph_rows: DataFrame) -> DataFrame:
    return passes.unionByName(glyph_rows)


def prefer_glyph(best: DataFrame, glyph_rows: DataFrame, keys: list[str], limit: float = OVERRIDE_KM) -> DataFrame:
    """Replace a best reading that disagrees with the glyph reading by more than ``limit``."""
    fields = ["x", "y", "z", "ooc", "location"]
    other = glyph_rows.select(*keys, F.struct(*fields).alias("_g"))
    joined = best.join(other, keys, "left")
    apart = F.greatest(*[F.abs(F.col(c) - F.col(f"_g.{c}")) for c in "xyz"])
    swap = F.coalesce(F.col("x").isNotNull() & (apart > limit), F.lit(False))
    return (joined.withColumn("overridden", swap)
            .select(*keys, "overridden", *[F.when(swap, F.col(f"_g.{c}")).otherwise(F.col(c)).alias(c) for c in fields]))
