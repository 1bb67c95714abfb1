"""Ordered operators that stay parallel inside one key.

A plain window over ``partitionBy(session)`` sends a whole session to one task.
Here a key is cut into *blocks* (ranges of its ordering column), the window runs
per ``(key, block)``, and one small row per block carries the running value into
the next block:

    local window per (key, block)  +  exclusive scan over block totals

Rows are dealt by ``(key, block)`` once, and both the totals and the windows stand
above that one exchange. Further running values, also such as use earlier ones,
may be added to rows already dealt (``Walk``) without another exchange of rows. A
key holding a third of all rows is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ordering:
    """How rows of one key are ordered, and how that order is cut into blocks.

    ``blocks`` must never decrease along ``order``.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    blocks: tuple[str, ...]

    @property
    def parts(self) -> list[str]:
        return [*self.keys, *self.blocks]


@dataclass(frozen=True)
class Carry:
    kind: str
    value: Column


def running_sum(value: Column) -> Carry:
    """Sum of this row and all earlier ones."""
    return Carry("sum", value)


def running_max(value: Column) -> Carry:
    """Largest non-null value up to and including this row."""
    return Carry("max", value)


def last_known(value: Column) -> Carry:
    """Latest non-null value up to and including this row."""
    return Carry("last", value)


def earlier_known(value: Column) -> Carry:
    """Latest non-null value strictly before this row."""
    return Carry("earlier", value)


def previous(value: Column) -> Carry:
    """Value on the row just before, nulls included."""
    return Carry("previous", value)


def row_index() -> Carry:
    """1-based position inside the key."""
    return Carry("sum", F.lit(1).cast("bigint"))


def by_time(df: DataFrame, keys: tuple[str, ...] | list[str], order: tuple[str, ...] | list[str],
            width: float, block: str = "_block") -> tuple[DataFrame, Ordering]:
    """Cut by fixed-width ranges of the first ordering column."""
    cut = df.withColumn(block, F.floor(F.col(order[0]) / F.lit(float(width))))
    return cut, Ordering(tuple(keys), tuple(order), (block,))


def held(df: DataFrame) -> DataFrame:
    """The same rows; every column is in use here, and no filter from above gets below.

    What is below is then the same plan in all branches that read it, whatever
    each of them needs, so that Spark runs it once and reuses its exchange.
    """
    return df.where(F.hash(*df.columns) + F.rand(0) > F.lit(-3e9))


def deal(df: DataFrame, *by: str) -> DataFrame:
    """Exchange rows by some columns, once for all branches that read the result."""
    return held(df.repartition(*by))


def scan(df: DataFrame, ordering: Ordering, dealt: bool = False, **outputs: Carry) -> DataFrame:
    """Add one column per output, each a running value along ``ordering``.

    ``dealt`` says that the rows come from a scan along the same ordering, or
    from ``deal``, and need no exchange.
    """
    parts, order = ordering.parts, list(ordering.order)
    if not dealt:
        df = deal(df, *parts)
    position = F.struct(*order)
    here = Window.partitionBy(*parts).orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    just_before = here.rowsBetween(-1, -1)
    earlier_blocks = (Window.partitionBy(*ordering.keys).orderBy(*ordering.blocks)
                      .rowsBetween(Window.unboundedPreceding, -1))

    totals, carries, local, combined = [], [], [], {}
    for name, out in outputs.items():
        total, carry, mine = f"_t_{name}", f"_c_{name}", f"_l_{name}"
        value = out.value
        if out.kind == "sum":
            totals.append(F.sum(value).alias(total))
            carries.append(F.sum(total).over(earlier_blocks).alias(carry))
            local.append(F.sum(value).over(upto).alias(mine))
            combined[name] = F.when(
                F.col(mine).isNull() & F.col(carry).isNull(), F.lit(None)
            ).otherwise(F.coalesce(F.col(mine), F.lit(0)) + F.coalesce(F.col(carry), F.lit(0)))
        elif out.kind == "max":
            totals.append(F.max(value).alias(total))
            carries.append(F.max(total).over(earlier_blocks).alias(carry))
            local.append(F.max(value).over(upto).alias(mine))
            combined[name] = F.greatest(F.col(mine), F.col(carry))
        elif out.kind in ("last", "earlier"):
            totals.append(F.max_by(value, F.when(value.isNotNull(), position)).alias(total))
            carries.append(F.last(total, ignorenulls=True).over(earlier_blocks).alias(carry))
            frame = upto if out.kind == "last" else before
            local.append(F.last(value, ignorenulls=True).over(frame).alias(mine))
            combined[name] = F.coalesce(F.col(mine), F.col(carry))
        elif out.kind == "previous":
            boxed = F.struct(value.alias("v"))
            totals.append(F.max_by(boxed, position).alias(total))
            carries.append(F.last(total).over(earlier_blocks).alias(carry))
            local.append(F.last(boxed).over(just_before).alias(mine))
            combined[name] = F.coalesce(F.col(mine), F.col(carry))["v"]
        else:
            raise ValueError(f"unknown running value: {out.kind}")

    block_totals = deal(df.groupBy(*parts).agg(*totals), *ordering.keys)
    carried = deal(block_totals.select(*parts, *carries), *parts)
    windowed = df.select("*", *local)
    joined = windowed.join(carried, parts, "left")
    return joined.select(*df.columns, *[c.alias(n) for n, c in combined.items()])


@dataclass(frozen=True)
class Walk:
    """Rows dealt along an ordering, to which running values are added."""

    rows: DataFrame
    ordering: Ordering

    @classmethod
    def along(cls, df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], width: float) -> Walk:
        cut, ordering = by_time(df, keys, order, width)
        return cls(deal(cut, *ordering.parts), ordering)

    def add(self, **outputs: Carry) -> Walk:
        return Walk(scan(self.rows, self.ordering, dealt=True, **outputs), self.ordering)

    def change(self, rows: DataFrame) -> Walk:
        """Other columns or fewer rows, still dealt as before."""
        return Walk(rows, self.ordering)

    def select(self, *columns) -> DataFrame:
        return self.rows.select(*columns)


def overlapped(df: DataFrame, index: Column, reach: int, rows_per_block: int,
               block: str = "_span", guest: str = "_guest") -> DataFrame:
    """Cut a densely numbered key into spans whose first rows see ``reach`` rows back.

    Rows near the end of a span are copied into the next one and flagged as
    guests, so a bounded frame can run per ``(key, span)``. Drop guests after.
    """
    zero = index - F.lit(1)
    span = F.floor(zero / F.lit(rows_per_block))
    tail = (zero % F.lit(rows_per_block)) >= F.lit(rows_per_block - reach)
    copies = F.when(
        tail,
        F.array(F.struct(span.alias("s"), F.lit(False).alias("g")),
                F.struct((span + 1).alias("s"), F.lit(True).alias("g"))),
    ).otherwise(F.array(F.struct(span.alias("s"), F.lit(False).alias("g"))))
    return (df.withColumn("_copy", F.explode(copies))
            .withColumn(block, F.col("_copy.s")).withColumn(guest, F.col("_copy.g"))
            .drop("_copy"))


def mark_smallest(df: DataFrame, keys: list[str], ranked_by: str, tie: str, wanted: Column,
                  bucket: Column, flag: str = "chosen") -> DataFrame:
    """Flag the ``wanted`` smallest rows of each key without sorting a key in one task.

    ``bucket`` is a coarse, order-preserving prefix of ``ranked_by``. Buckets
    wholly below or above the cut are settled by comparison alone; only the one
    bucket that straddles it is ranked row by row. ``wanted`` may use ``_n``, the
    number of rows of the key.
    """
    tagged = df.withColumn("_bucket", bucket)
    counts = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_m"))
    below = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    rooms = (counts
             .withColumn("_n", F.sum("_m").over(Window.partitionBy(*keys)))
             .withColumn("_room", wanted - F.coalesce(F.sum("_m").over(below), F.lit(0)))
             .select(*keys, "_bucket", "_m", "_room"))
    joined = tagged.join(rooms, [*keys, "_bucket"])
    straddles = (F.col("_room") > 0) & (F.col("_room") < F.col("_m"))
    settled = joined.filter(~straddles).withColumn(flag, F.col("_room") >= F.col("_m"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(ranked_by, tie))
    ranked = joined.filter(straddles).withColumn(flag, rank <= F.col("_room"))
    return settled.select(*df.columns, flag).unionByName(ranked.select(*df.columns, flag))
