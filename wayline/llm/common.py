"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Columns of exactly the given names, under new ones.

    Other columns may carry any name, also one that differs in case only or
    that an operator uses itself.
    """
    at = {new: df.columns.index(old) for new, old in wanted.items()}
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(new) for new, i in at.items()])


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one is chosen here only where none is named, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that only so many texts are Python objects at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def bit_table(df: DataFrame, value: Column, bits: int = 24, marked: Column | None = None) -> list[np.ndarray]:
    """Set membership of longs in a table of 2**bits bits, by their low bits and whatever the number of rows.

    A value that was not in the rows may be reported as one that was, never the
    other way round. Up to 2**bits / 64 words of eight bytes reach the driver.
    A second table has the marked rows only.
    """
    at = value.cast("long").bitwiseAND((1 << bits) - 1)
    words = (df.where(value.isNotNull()).select(at.alias("at"), (F.lit(False) if marked is None else marked).alias("marked"))
             .selectExpr("shiftright(at, 6) as w", "shiftleft(1L, cast(at % 64 as int)) as b", "marked")
             .groupBy("w").agg(F.bit_or("b").alias("all"), F.coalesce(F.bit_or(F.when(F.col("marked"), F.col("b"))), F.lit(0)).alias("marked"))).toArrow()
    out = []
    for name in ("all", "marked"):
        table = np.zeros(1 << (bits - 6), np.int64)
        table[words["w"].to_numpy()] = words[name].to_numpy()
        out.append(table.view(np.uint64))
    return out


def in_bit_table(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.astype(np.uint64) & np.uint64(len(table) * 64 - 1)
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
