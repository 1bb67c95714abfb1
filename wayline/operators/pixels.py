"""Thresholds, text bands and glyph boxes from long-form pixel and box tables.

Pixels are counted per grey level or image row first. After that every window
partition is bounded by the image itself: 256 grey levels, image height, image
width. Copies never reach a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators.ordered import Ordering, previous, scan

# Channel lead, band density and heights, box limits, text gaps.
CHANNEL_LEAD = 15
BAND_DENSITY, BAND_ROWS = 0.04, 6
BAND_ROWS_ANY = 3
BAND_PAD = 4
BOX_MIN_WIDTH = 4
MERGE_GAP = 2
ROW_MIN_GLYPHS, ROW_MIN_CONFIDENT = 8, 6
ROW_PAD = 2
SPACE_GAP, DATASET_SPACE_GAP = 6, 18


def otsu_thresholds(pixels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Grey level with the largest between-class variance, the lowest on ties.

    Level ``t`` itself counts as background while scoring; afterwards values at
    or above the threshold are foreground. Without any variance it is 0.
    """
    levels = pixels.groupBy(*keys, F.col(value).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(*keys)
    scored = levels.select(
        *keys, "t", F.sum("n").over(upto).alias("wb"), F.sum(F.col("t") * F.col("n")).over(upto).alias("sb"),
        F.sum("n").over(every).alias("w"), F.sum(F.col("t") * F.col("n")).over(every).alias("s"))
    wf = F.col("w") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - F.try_divide(F.col("s") - F.col("sb"), wf)
    variance = F.col("wb").cast("double") * wf.cast("double") * gap * gap
    best = F.max_by("t", F.when(variance > 0, F.struct(variance.alias("v"), (-F.col("t")).alias("rev"))))
    return scored.groupBy(*keys).agg(F.coalesce(best, F.lit(0).cast("bigint")).alias("threshold"))


def with_foreground(pixels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    cuts = otsu_thresholds(pixels, keys, value)
    return pixels.join(cuts, keys).withColumn("fg", F.col(value) >= F.col("threshold"))


def leading_channel(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Per frame: red or green when its mean leads clearly, else the brightest channel."""
    means = pixels.groupBy(*keys).agg(F.avg("r").alias("_r"), F.avg("g").alias("_g"))
    lead = F.col("_r") - F.col("_g")
    return means.select(*keys, F.when(lead > CHANNEL_LEAD, "red").when(-lead > CHANNEL_LEAD, "green")
                        .otherwise("brightest").alias("channel"))


def channel_value(pixels: DataFrame, keys: list[str]) -> DataFrame:
    chosen = pixels.join(leading_channel(pixels, keys), keys)
    grey = (F.when(F.col("channel") == "red", F.col("r")).when(F.col("channel") == "green", F.col("g"))
            .otherwise(F.greatest("r", "g", "b")))
    return chosen.withColumn("v", grey)


def row_density(pixels: DataFrame, keys: list[str], row: str = "y") -> DataFrame:
    share = F.avg(F.col("fg").cast("double"))
    return pixels.groupBy(*keys, row).agg(share.alias("density"), F.count_if("fg").alias("lit"))


def text_bands(rows: DataFrame, keys: list[str], lit: Column, min_rows: int = BAND_ROWS, row: str = "y") -> DataFrame:
    """Unbroken runs of lit image rows: ``band`` (from the top), ``y0``, ``y1`` exclusive."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(row))
    runs = (rows.filter(lit).withColumn("_run", F.col(row) - place).groupBy(*keys, "_run")
            .agg(F.min(row).alias("y0"), (F.max(row) + 1).alias("y1"))
            .filter(F.col("y1") - F.col("y0") >= min_rows))
    return runs.withColumn("band", F.row_number().over(Window.partitionBy(*keys).orderBy("y0"))).drop("_run")


def nth_band(bands: DataFrame, keys: list[str], n: int, height: int) -> DataFrame:
    """The n-th band, padded but never past the middle of the gap to a neighbour."""
    down = Window.partitionBy(*keys).orderBy("band")
    above = F.lag("y1").over(down)
    below = F.coalesce(F.lead("y0").over(down), F.lit(height))
    top = F.greatest(F.col("y0") - BAND_PAD, F.coalesce(F.floor((above + F.col("y0")) / 2), F.col("y0") - BAND_PAD))
    bottom = F.least(F.col("y1") + BAND_PAD, F.floor((F.col("y1") + below) / 2))
    return (bands.select(*keys, "band", top.alias("top"), bottom.alias("bottom"))
            .filter(F.col("band") == n).select(*keys, "top", "bottom"))


def large_enough(boxes: DataFrame, width: int = BOX_MIN_WIDTH) -> DataFrame:
    return boxes.filter(F.col("w") >= width)


def supported_rows(boxes: DataFrame, keys: list[str], glyph: str = "glyph") -> DataFrame:
    return (boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("glyphs"), F.count(glyph).alias("confident"))
            .filter((F.col("glyphs") >= ROW_MIN_GLYPHS) & (F.col("confident") >= ROW_MIN_CONFIDENT)))


def merge_boxes(boxes: DataFrame, keys: list[str], gap: int = MERGE_GAP, tasks: int | None = None) -> DataFrame:
    """Merge boxes nearer than ``gap`` to the end of everything merged so far.

    ``tasks``, where given, is the number of tasks among which text rows are
    dealt; what a task holds in memory is its share of them.
    """
    spans = boxes.groupBy(*keys, "x").agg(F.max(F.col("x") + F.col("w")).alias("x1"), F.min("y").alias("y0"),
                                          F.max(F.col("y") + F.col("h")).alias("y1"))
    if tasks:
        spans = spans.repartition(tasks, *keys)
    across = Window.partitionBy(*keys).orderBy("x")
    reach = F.max("x1").over(across.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce((F.col("x") - reach >= gap).cast("int"), F.lit(0))
    island = F.sum("_apart").over(across.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = (spans.withColumn("_apart", apart).withColumn("_i", island).groupBy(*keys, "_i")
              .agg(F.min("x").alias("x"), F.min("y0").alias("y"), F.max("x1").alias("x1"), F.max("y1").alias("y1")))
    return merged.select(*keys, "x", "y", (F.col("x1") - F.col("x")).alias("w"), (F.col("y1") - F.col("y")).alias("h"))


def row_bounds(boxes: DataFrame, keys: list[str], width: int, height: int, glyph: str | None = None) -> DataFrame:
    """Padded bounding box per text row, clamped to the frame; optional first readable x."""
    low = lambda c: F.greatest(F.lit(0), F.min(c) - ROW_PAD)
    extra = [F.min(F.when(F.col(glyph).isNotNull(), F.col("x"))).alias("first_x")] if glyph else []
    return boxes.groupBy(*keys).agg(
        low("x").alias("x1"), low("y").alias("y1"),
        F.least(F.lit(width), F.max(F.col("x") + F.col("w")) + ROW_PAD).alias("x2"),
        F.least(F.lit(height), F.max(F.col("y") + F.col("h")) + ROW_PAD).alias("y2"), *extra
    ).filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def row_text(boxes: DataFrame, keys: list[str], glyph: str = "glyph", gap: int = SPACE_GAP,
             unknown: str | None = "?", tile_px: int = 64) -> DataFrame:
    """Characters in x order, with a space where the gap to the box before is wide.

    ``unknown`` stands for unreadable glyphs; None drops them. Pieces are put
    together per tile of the row and then once per row.
    """
    source = boxes if unknown is not None else boxes.filter(F.col(glyph).isNotNull())
    tiled = source.withColumn("_tile", F.floor(F.col("x") / tile_px))
    seen = scan(tiled, Ordering(tuple(keys), ("x", "id"), ("_tile",)), _end=previous(F.col("x") + F.col("w")))
    char = F.coalesce(glyph, F.lit(unknown or ""))
    piece = F.concat(F.when(F.col("x") - F.col("_end") > gap, F.lit(" ")).otherwise(F.lit("")), char)

    def joined(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct(*order, "piece")))
        return df.groupBy(*by).agg(F.array_join(F.transform(items, lambda i: i["piece"]), "").alias("piece"))

    tiles = joined(seen.withColumn("piece", piece), [*keys, "_tile"], ["x", "id"])
    return joined(tiles, keys, ["_tile"]).withColumnRenamed("piece", "text")


def with_classification(boxes: DataFrame, classified: DataFrame, keys: list[str]) -> DataFrame:
    return boxes.join(classified, keys)
