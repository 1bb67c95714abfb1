"""Vector templates: building them, scoring against them, choosing a class."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wayline.functions.text import let

# Rejection thresholds, shift reach, size of a mark taken for a dot.
CORRELATION_FLOOR, PROBABILITY_FLOOR = 0.78, 0.85
SHIFT_X, SHIFT_Y = 2, 1
DOT_HEIGHT, DOT_WIDTH, DOT_SCORE = 8, 6, 0.99

#: Items that go through one matrix product, and classes of a block of templates.
ITEM_ROWS, BLOCK_CLASSES = 1024, 1024


def centred(v: Column) -> Column:
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return let(F.try_divide(total, F.size(v)), lambda m: F.transform(v, lambda x: x - m))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def correlation(a: Column, b: Column) -> Column:
    """Centred cosine of two equally long vectors; 0 when either has no variance."""
    def of(p: Column, q: Column) -> Column:
        dot = F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return F.coalesce(F.try_divide(dot, norm(p) * norm(q)), F.lit(0.0))
    return let(centred(a), lambda p: let(centred(b), lambda q: of(p, q)))


def stretched(v: Column) -> Column:
    """Linear contrast stretch to [0, 1]; flat vectors stay as they are."""
    low, high = F.array_min(v), F.array_max(v)
    return F.when(high > low, F.transform(v, lambda x: (x - low) / (high - low))).otherwise(v)


def build_templates(samples: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector per class, centred and scaled to unit length; flat ones stay centred.

    Averages are partial sums per (class, position); a class is never gathered.
    """
    means = (samples.select(label, F.posexplode(vector).alias("pos", "v"))
             .groupBy(label, "pos").agg(F.avg(F.col("v").cast("double")).alias("v")))
    rows = means.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("_p"))
    unit = let(centred(F.transform("_p", lambda p: p["v"])), lambda c: let(
        norm(c), lambda n: F.when(n > 0, F.transform(c, lambda x: x / n)).otherwise(c)))
    return rows.select(label, unit.alias("template"))


def shifted(matrix: np.ndarray, shape: tuple[int, int], dx: int, dy: int) -> np.ndarray:
    """All circular shifts of every template, stacked as (shifts, classes, pixels)."""
    images = matrix.reshape(len(matrix), *shape)
    return np.stack([np.roll(images, (-y, -x), axis=(1, 2)).reshape(matrix.shape)
                     for y in range(-dy, dy + 1) for x in range(-dx, dx + 1)])


def _packed(items: DataFrame) -> DataFrame:
    """Some rows of items at a time as one row, with a number of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ITEM_ROWS):
                sink = pa.BufferOutputStream()
                part = batch.slice(at, ITEM_ROWS)
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_pydict({"_pack": pa.array([(task << 33) + made]), "_items": pa.array([sink.getvalue().to_pybytes()])})
                made += 1

    return items.mapInArrow(run, "_pack long, _items binary")


def score_against(items: DataFrame, vector: str, templates: DataFrame, label: str,
                  shape: tuple[int, int] | None = None, dx: int = 0, dy: int = 0, block_classes: int = BLOCK_CLASSES) -> DataFrame:
    """Best class and its correlation per item, as ``best`` and ``score``.

    A shift of the item equals the opposite shift of the template, so shifted
    templates are built once for many items. The first class wins ties; without
    templates both are null.

    Rows of about a thousand items meet blocks of about a thousand templates, one
    matrix product each; the best of an item's blocks stays. Neither side passes
    the driver, which only learns the number of classes.
    """
    blocks = max(-(-templates.count() // block_classes), 1)
    kind = templates.schema[label].dataType
    sides = templates.groupBy(F.pmod(F.xxhash64(label), F.lit(blocks)).cast("int").alias("_b")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(label).alias("c"), F.col("template").alias("t")))).alias("_block"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b")
    pairs = _packed(items).select("*", every).join(sides.select("_b", F.col("_block.c").alias("_labels"), F.col("_block.t").alias("_templates")), "_b", "left")
    names = items.columns
    scored = [T.StructField("best", kind), T.StructField("score", T.DoubleType())]
    arrow = to_arrow_schema(T.StructType([*items.schema.fields, *scored]))

    def product(v: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        stack = shifted(flat, shape, dx, dy) if shape else flat[None]
        v = v - v.mean(axis=1, keepdims=True)
        size = np.sqrt((v * v).sum(axis=1))[:, None]
        scores = (v @ stack.reshape(-1, stack.shape[2]).T).reshape(len(v), len(stack), -1).max(axis=1)
        scores = np.divide(scores, size, out=np.zeros_like(scores), where=size > 0)
        top = scores.argmax(axis=1)
        return top, scores[np.arange(len(v)), top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pack, data, labels, flat = (batch.column(c)[i] for c in ("_pack", "_items", "_labels", "_templates"))
                rows = pa.ipc.open_stream(data.as_py()).read_next_batch()
                best, score = pa.nulls(rows.num_rows, arrow.field("best").type), pa.nulls(rows.num_rows, pa.float64())
                if rows.num_rows and labels.is_valid:
                    v = np.stack([np.asarray(x, dtype="float64") for x in rows.column(vector).to_pylist()])
                    top, at = product(v, np.array(flat.as_py(), dtype="float64"))
                    best, score = labels.values.take(pa.array(top)).cast(arrow.field("best").type), pa.array(at)
                columns = [*[rows.column(c) for c in names], best, score]
                if blocks > 1:
                    columns += [pa.array(np.full(rows.num_rows, pack.as_py())), pa.array(np.arange(rows.num_rows))]
                yield pa.RecordBatch.from_arrays(columns, [*names, "best", "score", *(["_pack", "_i"] if blocks > 1 else [])])

    schema = T.StructType([*items.schema.fields, *scored])
    if blocks == 1:
        return pairs.mapInArrow(run, schema)
    each = pairs.mapInArrow(run, T.StructType([*schema.fields, T.StructField("_pack", T.LongType()), T.StructField("_i", T.LongType())]))
    rank = F.struct((-F.col("score")).alias("s"), F.col("best").alias("b"))
    row = F.struct(*[F.col(c) for c in names], "best", "score")
    # A block without templates has no score and loses to any other.
    won = each.groupBy("_pack", "_i").agg(F.coalesce(F.min_by(row, F.when(F.col("score").isNotNull(), rank)), F.first(row)).alias("_r"))
    return won.select("_r.*")


def accept_class(best: Column, score: Column, floor: float = CORRELATION_FLOOR, width: Column | None = None,
                 height: Column | None = None, has_dot: bool = True) -> Column:
    """``{char, score}``: rejected below the floor; small rejected marks become a dot
    when the alphabet has none."""
    char = F.when(score >= floor, best.cast("string"))
    if has_dot or width is None:
        return F.struct(char.alias("char"), score.alias("score"))
    dot = char.isNull() & (height <= DOT_HEIGHT) & (width <= DOT_WIDTH)
    return F.struct(F.when(dot, F.lit(".")).otherwise(char).alias("char"),
                    F.when(dot, F.lit(DOT_SCORE)).otherwise(score).alias("score"))


Classifier = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
CLASSIFIED = "char string, score double"


def classify_with(items: DataFrame, classifier: Classifier, keys: list[str], fallback: Classifier | None = None) -> DataFrame:
    """Run a user classifier over batches; it yields ``keys``, ``char`` and ``score``.

    ``fallback`` takes over in a task whose classifier fails before its first
    batch of results, for instance because its model cannot be loaded there.
    """
    schema = T.StructType([*[items.schema[k] for k in keys], T.StructField("char", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def watched() -> Iterator[pd.DataFrame]:
            for pdf in batches:
                held[:] = [pdf]
                yield pdf

        def rest() -> Iterator[pd.DataFrame]:
            yield from held
            yield from batches

        try:
            results = classifier(watched())
            first = next(results, None)
        except Exception:
            if fallback is None:
                raise
            yield from fallback(rest())
            return
        if first is not None:
            yield first
            yield from results

    return items.mapInPandas(run, schema)
