"""Labelled-data curation: reading, filtering, deduplicating, splitting, sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions import text as X
from wayline.operators.ordered import Ordering, Walk, deal, last_known, mark_smallest, row_index, running_sum

# Routing thresholds, sampling stride and cap, largest random gap.
REVIEW_FROM, AUTO_FROM = 0.65, 0.85
STRIDE, FRAMES_PER_SOURCE = 15, 600
GAP_MAX = 15

# Characters a reader is expected to know.
NUMERIC = "0123456789.-"
UNIT = "km"
SEPARATOR = ":_ "


def parse_labels(lines: DataFrame, value: str = "value", trim: Callable[[Column], Column] | None = X.stripped) -> DataFrame:
    """``relpath<TAB>transcript``; only the first tab separates.

    Lines without a transcript after ``trim`` are left out. Without ``trim``
    transcripts stay as written, empty ones too.
    """
    parts = F.split(F.col(value), "\t", 2)
    others = [c for c in lines.columns if c != value]
    transcript = parts[1] if trim is None else trim(parts[1])
    out = lines.filter(F.col(value).contains("\t")).select(*others, parts[0].alias("relpath"), transcript.alias("transcript"))
    return out if trim is None else out.filter(F.col("transcript") != "")


def route(char: Column, score: Column) -> Column:
    return (F.when(char.isNull() | (score < REVIEW_FROM), "skip")
            .when(score < AUTO_FROM, "review").otherwise("auto"))


def first_seen(df: DataFrame, content: list[str], order: list[str]) -> DataFrame:
    """Earliest row of every content value.

    A partial aggregate: a third of all rows may be copies of one value and each
    task still sends one row of it.
    """
    keep = [c for c in df.columns if c not in content]
    return (df.groupBy(*content).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("_r"))
            .select(*[c if c in content else F.col(f"_r.{c}").alias(c) for c in df.columns]))


def routing_counters(df: DataFrame, keys: list[str], digest: str, order: str) -> DataFrame:
    """Frames, auto, review, uniques and skipped; later copies count as skipped."""
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("glyphs"), F.count_distinct("frame_id").alias("frames"))
    unique = (df.filter(F.col("route") != "skip").groupBy(*keys, digest)
              .agg(F.min_by("route", order).alias("route"))
              .groupBy(*keys).agg(F.count(F.lit(1)).alias("uniques"),
                                  F.count_if(F.col("route") == "auto").alias("auto"),
                                  F.count_if(F.col("route") == "review").alias("review")))
    zero = F.lit(0).cast("bigint")
    return (total.join(unique, keys, "left")
            .select(*keys, "frames", *[F.coalesce(c, zero).alias(c) for c in ("uniques", "auto", "review")],
                    (F.col("glyphs") - F.coalesce("uniques", zero)).alias("skipped")))


def resume(sources: DataFrame, journal: DataFrame, name: str, relpath: str = "relpath") -> DataFrame:
    """Sources whose stem, blanks as underscores, is no prefix in the journal yet."""
    prefix = F.replace(X.file_stem(F.col(name)), F.lit(" "), F.lit("_"))
    done = journal.select(X.source_prefix(X.file_stem(F.col(relpath))).alias("_p")).filter(F.col("_p").isNotNull()).distinct()
    return sources.join(done, prefix == F.col("_p"), "left_anti")


def with_media(labels: DataFrame, listing: DataFrame, key: str = "relpath") -> DataFrame:
    return labels.join(listing.select(key).distinct(), key, "left_semi")


def stride_sample(df: DataFrame, source: str, frame: str, stride: int = STRIDE,
                  per_source: int = FRAMES_PER_SOURCE, bucket_frames: int = 65536) -> DataFrame:
    """Every ``stride``-th frame, at most the first ``per_source`` of each source."""
    picked = df.filter(F.col(frame) % stride == 0)
    frames = picked.select(source, frame).distinct()
    kept = mark_smallest(frames, [source], frame, frame, F.lit(per_source),
                         F.floor(F.col(frame) / bucket_frames)).filter("chosen").drop("chosen")
    return picked.join(kept, [source, frame], "left_semi")


def keyed_number(*parts: Column) -> Column:
    """A number below 2**52 that the given values decide, the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("bigint")


def random_gap_sample(df: DataFrame, source: str, frame: str, seed: int, gap_max: int = GAP_MAX,
                      block_frames: int = 65536) -> DataFrame:
    """Frames hit by a walk from the first frame with uniform gaps of 1 to ``gap_max``.

    The k-th gap is a hash of seed, source and k, so reruns pick the same frames.
    Rows without source or frame are never picked.
    """
    frames = df.select(source, frame).distinct()
    numbered = Walk.along(frames, (source,), (frame,), float(block_frames)).add(_k=row_index())
    gap = keyed_number(F.lit(str(seed)), F.col(source).cast("string"), F.col("_k").cast("string")) % gap_max + 1
    walked = numbered.add(_end=running_sum(gap))
    hits = walked.select(source, (F.col("_end") - gap).alias("_at"))
    steps = numbered.select(source, frame, (F.col("_k") - 1).alias("_at"))
    return df.join(steps.join(hits, [source, "_at"], "left_semi").select(source, frame), [source, frame], "left_semi")


def _hash_prefix(c: str) -> Column:
    return F.substring(c, 1, 4)


def shuffle_split(df: DataFrame, key: Column, tie: str, ratio: float) -> DataFrame:
    """Random split with exactly ``max(1, floor(n * ratio))`` validation rows."""
    ranked = df.withColumn("_h", F.md5(key))
    wanted = F.greatest(F.lit(1), F.floor(F.col("_n") * ratio))
    return (mark_smallest(ranked, [], "_h", tie, wanted, _hash_prefix("_h"))
            .withColumn("split", F.when(F.col("chosen"), "val").otherwise("train")).drop("_h", "chosen"))


def stratified_split(df: DataFrame, label: str, key: Column, tie: str, ratio: float) -> DataFrame:
    """The same per class; a class with a single row goes to train."""
    ranked = df.withColumn("_h", F.md5(key))
    wanted = F.when(F.col("_n") > 1, F.greatest(F.lit(1), F.floor(F.col("_n") * ratio))).otherwise(F.lit(0))
    return (mark_smallest(ranked, [label], "_h", tie, wanted, _hash_prefix("_h"))
            .withColumn("split", F.when(F.col("chosen"), "val").otherwise("train")).drop("_h", "chosen"))


def weighted_resample(df: DataFrame, weight: Column, key: Column, seed: int, blocks: int = 65536) -> DataFrame:
    """As many draws with replacement as there are rows, each row in proportion to its weight.

    The rows take intervals of their weights one after another, in the order of a
    hash of ``key``; the k-th draw is a hash of seed and k and takes the row in
    whose interval it falls. Rows and draws meet as one ordered stream in blocks,
    so that neither heavy rows nor many draws of one row gather in a task. Rows
    of weight zero or null are never drawn; keys should differ.
    """
    names = df.columns
    rows = df.select(F.struct(*names).alias("_row"), F.coalesce(weight.cast("double"), F.lit(0.0)).alias("_w"),
                     keyed_number(key.cast("string")).alias("_h"), key.cast("string").alias("_id"), F.lit(0).alias("_all"))
    laid = Walk.along(rows, ("_all",), ("_h", "_id"), float(1 << 52) / blocks).add(_k=row_index(), _to=running_sum(F.col("_w")))
    total = rows.select(F.sum("_w").alias("_total"))
    intervals = laid.rows.filter("_w > 0").select((F.col("_to") - F.col("_w")).alias("_at"), F.lit(0).alias("_rank"), F.col("_k"), "_row")
    u = keyed_number(F.lit(str(seed)), F.col("_k").cast("string")) / F.lit(float(1 << 52))
    draws = laid.select((u * total.scalar()).alias("_at"), F.lit(1).alias("_rank"), "_k", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    both = intervals.unionByName(draws).select("*", F.lit(0).alias("_all"), F.floor(F.col("_at") / total.scalar() * blocks).alias("_block"))
    ordering = Ordering(("_all",), ("_at", "_rank", "_k"), ("_block",))
    met = Walk(deal(both, *ordering.parts), ordering).add(_drawn=last_known(F.col("_row")))
    return met.rows.filter("_rank = 1").select("_drawn.*").select(*names)


def real_and_synthetic(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    return real.withColumn("is_real", F.lit(True)).unionByName(synthetic.withColumn("is_real", F.lit(False)))


def unique_stems(df: DataFrame, stem: str, split: str, order: list[str]) -> DataFrame:
    """The first row of a stem keeps it; later ones get ``_<split>`` appended."""
    position = F.struct(*order)
    first = df.groupBy(stem).agg(F.min(position).alias("_first"))
    taken = ~(position == F.col("_first"))
    return (df.join(first, stem)
            .withColumn("unique_stem", F.when(taken, F.concat_ws("_", stem, split)).otherwise(F.col(stem))).drop("_first"))


def character_set(df: DataFrame, text: str) -> DataFrame:
    """Distinct characters of all texts; each row sends each of its characters once."""
    chars = F.explode(F.array_distinct(F.split(F.col(text), "")))
    return df.select(chars.alias("char")).filter(F.col("char") != "").distinct().orderBy("char")


def missing_classes(expected: DataFrame, found: DataFrame) -> DataFrame:
    return expected.subtract(found)


def class_counts(df: DataFrame, char: str, expected: Column) -> DataFrame:
    """Per class; unreadable and unexpected ones are counted apart."""
    bucket = F.when(F.col(char).isNull(), "unclassified").when(~expected, "unexpected_char").otherwise(F.col(char))
    return df.groupBy(bucket.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def is_expected(char: Column) -> Column:
    others = NUMERIC + UNIT + SEPARATOR
    return char.rlike("^[A-Za-z]$") | char.isin(*others)


def first_failures(df: DataFrame, failed: Column, order: list[str], n: int = 10) -> DataFrame:
    return df.filter(failed).orderBy(*order).limit(n)


def character_boxes(df: DataFrame, text: str, width: str, keep: list[str]) -> DataFrame:
    """Even slices of the width, one per character, and an end row of zero width.

    Slices are at least one pixel apart.
    """
    chars = F.concat(F.filter(F.split(F.col(text), ""), lambda c: c != ""), F.array(F.lit("\t")))
    # Text-sized values are dropped before the explode, so rows stay small.
    cut = (df.filter(F.length(text) > 0)
           .select(*keep, F.col(width).alias("_w"), F.length(text).alias("_n"), chars.alias("_chars")))
    glyphs = (cut.select("*", F.greatest(F.lit(1.0), F.col("_w") / F.col("_n")).alias("_s"))
              .select(*keep, "_w", "_n", "_s", F.posexplode("_chars").alias("pos", "char")))
    end = F.col("pos") == F.col("_n")
    x0 = F.bround(F.col("pos") * F.col("_s")).cast("bigint")
    x1 = F.bround((F.col("pos") + 1) * F.col("_s")).cast("bigint")
    whole = F.col("_w").cast("bigint")
    return glyphs.select(*keep, "pos", "char", F.when(end, whole).otherwise(x0).alias("x0"),
                         F.when(end, whole).otherwise(F.greatest(x1, x0 + 1)).alias("x1"))
