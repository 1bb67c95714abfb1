"""Blocked scans against plain windows, on data where one key holds most rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wayline.operators import ordered as O
from wayline.operators import tracks as K


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        key = 0 if rng.random() < 0.6 else rng.randrange(1, 6)
        rows.append((key, rng.uniform(0, 500), i, rng.choice([None, 1, 2, 3, 5])))
    return spark.createDataFrame(rows, "k bigint, t double, i bigint, v bigint").repartition(7)


def test_every_running_value_equals_the_plain_window(data):
    cut, ordering = O.by_time(data, ["k"], ["t", "i"], 13.0)
    v = F.col("v")
    got = O.scan(cut, ordering, s=O.running_sum(v), m=O.running_max(v), last=O.last_known(v),
                 before=O.earlier_known(v), prev=O.previous(v), n=O.row_index())
    w = Window.partitionBy("k").orderBy("t", "i")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = data.select("k", "i", F.sum("v").over(upto).alias("s"), F.max("v").over(upto).alias("m"),
                       F.last("v", True).over(upto).alias("last"), F.last("v", True).over(before).alias("before"),
                       F.lag("v").over(w).alias("prev"), F.row_number().over(w).cast("bigint").alias("n"))
    assert sorted(got.select(want.columns).collect(), key=str) == sorted(want.collect(), key=str)


def test_a_hot_key_is_shuffled_by_block(data):
    cut, ordering = O.by_time(data, ["k"], ["t", "i"], 13.0)
    plan = O.scan(cut, ordering, s=O.running_sum(F.col("v")))._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if "Window" in line and "_l_s" in line]
    assert wide and all("_block" in line for line in wide)


def exchanges(df):
    """What the run plan reads and exchanges by hash, without reused parts."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "ReusedExchange" not in line], plan


def test_running_values_in_a_row_share_one_exchange_of_rows(data):
    w = O.Walk.along(data, ("k",), ("t", "i"), 13.0).add(s=O.running_sum(F.col("v")), n=O.row_index())
    w = w.add(top=O.running_max(F.col("s") % 7)).add(last=O.earlier_known(F.col("top")))
    hashed, plan = exchanges(w.select("k", "i", "s", "n", "last"))
    assert len([line for line in hashed if "_block" in line and "REPARTITION_BY_COL" in line]) <= 4  # rows once, carries thrice
    assert plan.count("Scan ExistingRDD") == 1
    plain = Window.partitionBy("k").orderBy("t", "i")
    want = data.withColumn("s", F.sum("v").over(plain)).withColumn("n", F.row_number().over(plain).cast("bigint")).withColumn("top", F.max(F.col("s") % 7).over(plain))
    want = want.withColumn("last", F.last("top", True).over(plain.rowsBetween(Window.unboundedPreceding, -1)))
    assert sorted(w.select("k", "i", "s", "n", "last").collect(), key=str) == sorted(want.select("k", "i", "s", "n", "last").collect(), key=str)


def test_flagship_reads_events_once_and_exchanges_by_hash_eight_times(spark):
    from wayline.plans import catalogue
    hashed, plan = exchanges(catalogue.queries()["flagship_navigation"](spark, "/root/testdata/sf0.001"))
    assert len([line for line in plan.splitlines() if "Scan parquet" in line and "event_id" in line]) == 1
    assert len(hashed) <= 8, hashed


def test_spans_give_bounded_frames_across_their_borders(data):
    cut, ordering = O.by_time(data, ["k"], ["t", "i"], 13.0)
    numbered = O.scan(cut, ordering, n=O.row_index())
    spans = O.overlapped(numbered, F.col("n"), 4, 50)
    w = Window.partitionBy("k", "_span").orderBy("n").rowsBetween(-4, 0)
    got = spans.withColumn("s", F.sum("v").over(w)).filter("not _guest").select("k", "i", "s")
    plain = Window.partitionBy("k").orderBy("n").rowsBetween(-4, 0)
    want = numbered.withColumn("s", F.sum("v").over(plain)).select("k", "i", "s")
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


@pytest.mark.parametrize("n", [0, 1, 37, 10_000])
def test_mark_smallest_matches_a_full_sort(data, n):
    marked = O.mark_smallest(data, ["k"], "t", "i", F.lit(n), F.floor(F.col("t") / 25))
    rank = F.row_number().over(Window.partitionBy("k").orderBy("t", "i"))
    want = data.withColumn("chosen", rank <= n)
    assert marked.count() == data.count()
    assert sorted(marked.select("i", "chosen").collect()) == sorted(want.select("i", "chosen").collect())


def test_gap_of_exactly_three_seconds_does_not_cut(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (1, 2, 3.0), (1, 3, 6.5)], "sid bigint, seq bigint, t_capture double")
    got = [r["gap_segment"] for r in K.gap_segments(df).orderBy("seq").collect()]
    assert got == [0, 0, 1]


def test_missing_zone_never_cuts(spark):
    rows = [(1, 1, 0.0, "a"), (1, 2, 1.0, None), (1, 3, 2.0, "a"), (1, 4, 3.0, "b"), (1, 5, 4.0, None), (1, 6, 5.0, "a")]
    df = spark.createDataFrame(rows, "sid bigint, seq bigint, t_capture double, ooc string")
    assert [r["segment"] for r in K.zone_segments(df).orderBy("seq").collect()] == [0, 0, 0, 1, 1, 2]


def test_clear_hides_earlier_targets(spark):
    ticks = spark.createDataFrame([(1, i, float(i)) for i in range(1, 7)], "sid bigint, seq bigint, t_capture double")
    events = spark.createDataFrame([(1, 2.0, "set", 7), (1, 4.0, "clear", 7), (1, 5.5, "set", 8)],
                                   "sid bigint, ts double, action string, suppkey bigint")
    got = [(r["suppkey"], r["epoch"]) for r in K.active_target(ticks, events, 2.0).orderBy("seq").collect()]
    assert got == [(None, 0), (7, 1), (7, 1), (None, 2), (None, 2), (8, 3)]


def test_zone_grace_and_latch(spark):
    rows = [(1, 1, 0.0, 1, 0.0, "x"), (1, 2, 181.0, 1, 0.0, "x"), (1, 3, 182.0, 1, 0.0, "zz"), (1, 4, 900.0, 1, 0.0, "x")]
    df = spark.createDataFrame(rows, "sid bigint, seq bigint, t_capture double, epoch bigint, t_set double, ooc string")
    got = K.zone_lock(df, F.col("ooc") == "zz", F.lit(True), F.lit("zz")).orderBy("seq").collect()
    assert [r["in_zone"] for r in got] == [True, False, True, True]
    assert [r["grace_left_s"] for r in got] == [180.0, 0.0, None, None]
