"""From recognised lines to one reading per frame.

All per-frame rules are partial aggregates (first, last, best by an ordering
struct), so a frame of any size is reduced map-side and never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions import text as X

# Fixed value: lines recognised with less confidence are not parsed.
MIN_CONFIDENCE = 0.30


def flatten_detections(df: DataFrame, texts: str = "texts", scores: str = "scores") -> DataFrame:
    """One row per detection; a missing confidence counts as zero."""
    others = [c for c in df.columns if c not in (texts, scores)]
    zipped = F.arrays_zip(F.col(texts).alias("text"), F.col(scores).alias("score"))
    flat = df.select(*others, F.posexplode_outer(zipped).alias("pos", "d"))
    return flat.select(*others, "pos", F.col("d.text").alias("text"),
                       F.coalesce(F.col("d.score"), F.lit(0.0)).alias("score"))


def confident(df: DataFrame, floor: float = MIN_CONFIDENCE, score: str = "score") -> DataFrame:
    return df.filter(F.col(score) >= min(1.0, max(0.0, floor)))


def read_lines(df: DataFrame, text: str) -> DataFrame:
    """Correct, classify and parse every line; adds the fields of ``text.reading``."""
    return X.with_parsed(df, text, X.reading, "_read").select(*df.columns, "_read.*")


def _picked(df: DataFrame, keys: list[str], pick, order: Column, keep: list[str]) -> DataFrame:
    boxed = F.struct(*keep)
    return (df.groupBy(*keys).agg(pick(boxed, order).alias("_row"))
            .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in keep]))


def first_valid(df: DataFrame, keys: list[str], order: str = "line_no") -> DataFrame:
    keep = [c for c in df.columns if c not in keys]
    return _picked(df.filter(F.col("x").isNotNull()), keys, F.min_by, F.col(order), keep)


def last_valid(df: DataFrame, keys: list[str], order: str = "line_no") -> DataFrame:
    keep = [c for c in df.columns if c not in keys]
    return _picked(df.filter(F.col("accepted")), keys, F.max_by, F.col(order), keep)


def pass_scores(lines: DataFrame, keys: list[str]) -> DataFrame:
    """10 per recognised system, 10 per accepted position, 5 for any position, 5 for a km unit."""
    accepted = F.count_if(F.col("accepted"))
    score = (10 * F.count_if(F.col("location").isNotNull()) + 10 * accepted
             + F.when(accepted > 0, 5).otherwise(0)
             + F.when(F.bool_or(F.lower(F.col("fixed")).contains("km")), 5).otherwise(0))
    return lines.groupBy(*keys).agg(score.cast("bigint").alias("score"))


def frame_scores(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Mean confidence, plus a tenth when the frame gave a position."""
    bonus = F.when(F.bool_or("accepted"), 0.1).otherwise(0.0)
    return lines.groupBy(*keys).agg((F.avg("score") + bonus).alias("score"))


def read_counters(lines: DataFrame, keys: list[str], frame: str,
                  floor: float = MIN_CONFIDENCE) -> DataFrame:
    """Why frames were accepted or lost, per session."""
    kept = F.col("score") >= floor
    tried = kept & F.col("is_position")
    frames = lines.groupBy(*keys, frame).agg(
        F.count_if(F.col("score") < floor).alias("below_conf"),
        F.count_if(F.col("fixed").isNull()).alias("no_text"),
        F.count_if(tried & F.col("x").isNull()).alias("regex_fail"),
        F.count_if(tried & F.col("x").isNotNull() & ~F.col("accepted")).alias("out_of_range"),
        F.bool_or(kept & F.col("accepted")).alias("ok"))
    n, ok = F.count(F.lit(1)), F.count_if("ok")
    return frames.groupBy(*keys).agg(
        n.alias("frames"), ok.alias("accepted"),
        *[F.sum(c).alias(c) for c in ("below_conf", "no_text", "regex_fail", "out_of_range")],
        (100.0 * ok / F.greatest(F.lit(1), n)).alias("accept_pct"))


def every_frame(frames: DataFrame, reads: DataFrame, keys: list[str]) -> DataFrame:
    """Frames without a usable read keep a row: no coordinates, location Unknown."""
    return (frames.join(reads, keys, "left")
            .withColumn("location", F.coalesce("location", F.lit("Unknown"))))


def keep_known_location(passes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """For frames that lost their coordinates: the last location that is known."""
    known = F.when(F.col("location").isNotNull() & (F.col("location") != "Unknown"), F.col(order))
    return passes.groupBy(*keys).agg(
        F.bool_or(F.col("x").isNotNull()).alias("has_position"),
        F.coalesce(F.max_by("location", known), F.lit("Unknown")).alias("location"))
