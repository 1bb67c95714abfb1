"""From the raw text of competing recognition passes to one position per frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions import text as X
from wayline.operators import votes as O
from wayline.session import settle

VOTE = ["ord", "pass", "score", "x", "y", "z", "ooc", "location"]


def read_passes(passes: DataFrame, keys: list[str], glyphs: DataFrame | None = None) -> DataFrame:
    """Each pass's vote: the position of its last acceptable line, the system it names, and its score.

    ``passes``: keys, ``ord``, ``pass`` and ``text`` of many lines. The text is
    corrected, split position lines are rejoined, and every line is classified.
    A frame's glyph reading (``glyphs``: keys, ``x, y, z``, where there is one)
    takes the place of the coordinates that the lines say. A pass without a
    usable line votes with nulls.
    """
    who = [*keys, "ord", "pass"]

    def told(line: Column) -> Column:
        return X.let(X.reading_of(line), lambda r: F.struct(
            *[r[c].alias(c) for c in ("is_position", "location", "ooc", "x", "y", "z")], F.lower(r["fixed"]).contains("km").alias("km")))

    def placed(line: Column) -> Column:
        at = {c: line[c] if glyphs is None else F.when(line["is_position"], F.coalesce(F.col(f"_g.{c}"), line[c])) for c in "xyz"}
        return F.struct(*[at[c].alias(c) for c in "xyz"], line["ooc"].alias("ooc"))

    # All lines of a pass stay in its row; one that has no text has no lines.
    read = X.with_parsed(passes.select(*who, "text"), "text", lambda text: F.transform(
        X.trimmed_lines(X.rejoin_orphans(X.correct_literals(text))), told), "_lines").drop("text")
    if glyphs is not None:
        first = glyphs.filter(F.col("x").isNotNull()).select(*keys, F.struct("x", "y", "z").alias("_g"))
        read = read.join(first, keys, "left")
    good = F.filter(F.transform("_lines", placed), lambda p: X.in_range(p["x"], p["y"], p["z"]))
    named = F.filter(F.transform("_lines", lambda r: r["location"]), lambda name: name.isNotNull())

    def vote(good: Column, named: Column) -> Column:
        some = F.size(good) > 0
        score = 10 * F.size(named) + 10 * F.size(good) + F.when(some, 5).otherwise(0) + F.when(F.exists("_lines", lambda r: r["km"]), 5).otherwise(0)
        p = F.when(some, F.element_at(good, -1))
        return F.struct(F.coalesce(score.cast("double"), F.lit(0.0)).alias("score"), *[p[c].alias(c) for c in ("x", "y", "z", "ooc")],
                        F.when(F.size(named) > 0, F.element_at(named, -1)).otherwise("Unknown").alias("location"))

    return read.select(*who, X.let(F.struct(good.alias("g"), named.alias("n")), lambda v: vote(v["g"], v["n"])).alias("_v")).select(*who, "_v.*").select(*keys, *VOTE)


def text_to_fix(passes: DataFrame, keys: list[str], glyphs: DataFrame | None = None) -> DataFrame:
    """One row per frame: keys, ``x, y, z, ooc, location`` and how it was ``decided``.

    Two or more votes within the tolerance are averaged (``consensus``); else the
    best-scoring pass counts (``best``), unless the glyph reading is far from it
    (``glyph``). A frame without any usable line keeps a row.
    """
    fields = ["x", "y", "z", "ooc", "location"]
    # Votes are read several times below: each text is parsed once.
    votes = settle(read_passes(passes, keys, glyphs))
    extra = None
    if glyphs is not None:
        extra = settle(O.glyph_votes(votes, glyphs, keys))
        votes = O.with_glyph_votes(votes, extra)
    agreed = O.consensus(votes, keys, extra=("ooc", "location")).select(*keys, F.struct(*fields).alias("_agreed"))
    best = O.best_pass(votes, keys)
    if extra is None:
        best = best.select(*keys, F.lit(False).alias("overridden"), *fields)
    else:
        best = O.prefer_glyph(best, extra, keys)
    joined = best.join(agreed, keys, "left")
    some = F.col("_agreed").isNotNull()
    return joined.select(*keys, *[F.when(some, F.col(f"_agreed.{c}")).otherwise(F.col(c)).alias(c) for c in fields],
                         F.when(some, "consensus").when(F.col("overridden"), "glyph").otherwise("best").alias("decided"))
