"""Recognition-quality reports. Everything is a partial aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions import text as X
from wayline.functions.display import fixed
from wayline.session import settle

# Confidence buckets, drift (km), mirror gap (km).
SCORE_BUCKETS = [(0.95, "0.95-1.00"), (0.85, "0.85-0.95"), (0.70, "0.70-0.85"), (0.50, "0.50-0.70")]
LOWEST_BUCKET = "<0.50"
DRIFT_KM = 10.0
MIRROR_KM = 5.0
MIN_MATCHED = 3

# What application log lines say.
LOG_LINE = r"^(\S+ \S+) - (\S+) - (\S+) - (.*)$"
LOG_MARKS = {
    "reads": "Position extracted",
    "consensus": "Multi-pass consensus",
    "rejections": "OCR rejection",
    "sign_flips": "OCR rejection: sign-flip",
    "axis_speeds": r"OCR rejection: implausible .-axis speed",
    "speeds": "OCR rejection: implausible 3D speed",
    "overrides": "ONNX sanity gate:",
}


def score_bucket(score: Column) -> Column:
    out = None
    for floor, name in SCORE_BUCKETS:
        out = F.when(score >= floor, name) if out is None else out.when(score >= floor, name)
    return out.otherwise(F.lit(LOWEST_BUCKET))


def histogram(df: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    return df.groupBy(*keys, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def histogram_map(df: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """Histogram as one key-sorted map; the number of buckets is fixed."""
    pairs = F.array_sort(F.collect_list(F.struct("bucket", "n")))
    return histogram(df, keys, bucket).groupBy(*keys).agg(F.map_from_entries(pairs).alias("histogram"))


def sample_outcome(method: Column, partial: Column) -> Column:
    return F.when(method.isNotNull(), "complete").when(partial > 0, "partial").otherwise("none")


def classify_lines(df: DataFrame, text: str) -> DataFrame:
    """Normalise and parse every line for diagnostics: no keyword pre-filter."""
    parsed = X.with_parsed(df, text, lambda t: X.position(X.normalize_line(t)), "pos")
    return (parsed.withColumn("partial", X.partial_count(F.col(text)))
            .withColumn("text_chars", F.length(text)))


def classify_samples(lines: DataFrame, keys: list[str], order: str = "line_no") -> DataFrame:
    """First match of a sample in reading order, and the outcome.

    Partial coordinates only count on lines before the first match, which
    matters for the outcome only when nothing matched.
    """
    hit = F.when(F.col("pos").isNotNull(), F.col(order))
    grouped = lines.groupBy(*keys).agg(
        F.min_by("pos", hit).alias("pos"), F.max("partial").alias("partial"),
        F.count(F.lit(1)).alias("detections"), F.min("score").alias("min_score"),
        F.sum("text_chars").alias("text_chars"))
    return grouped.withColumn("outcome", sample_outcome(F.col("pos.method"), F.col("partial")))


def upper_medians(df: DataFrame, keys: list[str], cols: list[str], width: float = 1.0) -> DataFrame:
    """Element ``n // 2`` of each column's sorted values, per key, exactly.

    Values are counted, the counts are bucketed, and only the bucket that holds
    the middle is looked at value by value.
    """
    tall = (df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in cols]))
                      .alias("_e")).select(*keys, "_e.c", "_e.v").filter(F.col("v").isNotNull()))
    values = (tall.groupBy(*keys, "c", "v").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("b", F.floor(F.col("v") / width)))
    group = [*keys, "c"]
    buckets = values.groupBy(*group, "b").agg(F.sum("n").alias("m"))
    upto = Window.partitionBy(*group).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    middle = (buckets.withColumn("below", F.coalesce(F.sum("m").over(upto), F.lit(0)))
              .withColumn("rank", F.floor(F.sum("m").over(Window.partitionBy(*group)) / 2))
              .filter((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("m")))
              .select(*group, "b", (F.col("rank") - F.col("below")).alias("skip")))
    inside = Window.partitionBy(*group).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (values.join(middle, [*group, "b"]).withColumn("seen", F.sum("n").over(inside))
             .filter(F.col("seen") > F.col("skip")).groupBy(*group).agg(F.min("v").alias("v")))
    wide = [F.max(F.when(F.col("c") == c, F.col("v"))).alias(f"{c}_mid") for c in cols]
    return found.groupBy(*keys).agg(*wide)


def suspect_reason(values: dict[str, Column], middles: dict[str, Column]) -> Column:
    """Drift beyond the limit on any axis, then mirrored signs, joined by ``; ``."""
    drift = [F.when(F.abs(v - middles[a]) > DRIFT_KM,
                    F.concat(F.lit(f"{a.upper()} drift "), fixed(v - middles[a], 1, signed=True), F.lit(" km")))
             for a, v in values.items()]
    flips = [F.when((v * middles[a] < 0) & (F.abs(F.abs(v) - F.abs(middles[a])) < MIRROR_KM),
                    F.lit(f"{a.upper()} sign flipped vs median")) for a, v in values.items()]
    text = F.concat_ws("; ", *drift, *flips)
    return F.when(text != "", text)


def flag_outliers(samples: DataFrame, run: list[str]) -> DataFrame:
    """Mark matched samples far from their run's median; runs need three matches.

    Samples are one small row per frame and are read several times here, so they
    are stored once rather than parsed again for every use.
    """
    samples = settle(samples)
    matched = samples.filter(F.col("x").isNotNull())
    enough = matched.groupBy(*run).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= MIN_MATCHED)
    mids = upper_medians(matched, run, ["x", "y", "z"]).join(enough, run).drop("_n")
    reason = suspect_reason({a: F.col(a) for a in "xyz"}, {a: F.col(f"{a}_mid") for a in "xyz"})
    return samples.join(mids, run, "left").withColumn("suspect", reason)


def outcome_summary(samples: DataFrame, keys: list[str]) -> DataFrame:
    n = F.count(F.lit(1))
    complete = F.count_if(F.col("outcome") == "complete")
    return samples.groupBy(*keys).agg(
        n.alias("samples"), complete.alias("complete"),
        F.count_if(F.col("outcome") == "partial").alias("partial"),
        F.count_if(F.col("outcome") == "none").alias("none"),
        F.coalesce(F.round(F.try_divide(complete, n), 3), F.lit(0.0)).alias("complete_rate"),
        F.count_if(F.col("suspect").isNotNull()).alias("suspects"))


def latency_summary(samples: DataFrame, keys: list[str], latency: str = "latency_ms",
                    detections: str = "detections", text_chars: str = "text_chars") -> DataFrame:
    """Empty input gives zeros. ``text_chars`` is the sample's total text length."""
    zero = F.lit(0.0)
    return samples.groupBy(*keys).agg(
        F.coalesce(F.avg(latency), zero).alias("mean_ms"),
        F.coalesce(F.max(latency).cast("double"), zero).alias("max_ms"),
        F.coalesce(F.avg(detections), zero).alias("mean_detections"),
        F.coalesce(F.try_divide(F.sum(text_chars), F.sum(detections)), zero).alias("mean_text"))


def sample_report(samples: DataFrame) -> DataFrame:
    """Flat per-sample table with display text for the position."""
    pos = F.concat(F.lit("("), fixed(F.col("x"), 3), F.lit(", "), fixed(F.col("y"), 3), F.lit(", "),
                   fixed(F.col("z"), 3), F.lit(")"))
    return samples.withColumn("matched", F.when(F.col("x").isNotNull(), pos).otherwise(F.lit("—"))
                              ).withColumn("min_score", fixed(F.coalesce("min_score", F.lit(0.0)), 2))


def split_log(lines: DataFrame, line: str = "line") -> DataFrame:
    names = ["time", "logger", "level", "message"]
    return lines.select("*", *[F.regexp_extract(line, LOG_LINE, i + 1).alias(n) for i, n in enumerate(names)])


def log_health(lines: DataFrame, keys: list[str], message: str) -> DataFrame:
    """Counts per mark and the two health verdicts of a session."""
    counts = {n: F.count_if(F.col(message).rlike(p)) for n, p in LOG_MARKS.items()}
    told = lines.groupBy(*keys).agg(*[c.alias(n) for n, c in counts.items()])
    share = F.try_divide(F.col("consensus"), F.col("reads"))
    lost = F.try_divide(F.col("rejections"), F.col("reads") + F.col("rejections"))
    return told.withColumns({"consensus_share": share, "rejection_share": lost,
                             "consensus_ok": F.coalesce(share > 0.5, F.lit(False)),
                             "rejections_ok": F.coalesce(lost < 0.1, F.lit(True))})


def accuracy(df: DataFrame, keys: list[str], predicted: str, label: str) -> DataFrame:
    right = F.count_if(F.col(predicted) == F.col(label))
    return df.groupBy(*keys).agg((right / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("accuracy"))


def rank_candidates(scores: DataFrame, candidate: str, member: str, score: str) -> DataFrame:
    """Candidates by mean score, best first; those without scores come last.

    Member scores are kept in a map; members are a fixed alphabet.
    """
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct(member, score))))
    return (scores.groupBy(candidate).agg(F.avg(score).alias("mean"), pairs.alias("scores"))
            .orderBy(F.col("mean").desc_nulls_last(), candidate))
