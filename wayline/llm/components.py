"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import settle


#: Links that a task is given at least, before there is another: rounds on few links are hardly more than tasks.
TASK_LINKS = 50_000


def _large_star(links: DataFrame, tasks: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks).distinct().coalesce(tasks)


def _small_star(links: DataFrame, tasks: int) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return (down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))).coalesce(tasks).distinct().coalesce(tasks))


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that links reach. links: a, b; nodes without one are not returned.

    The number of rounds is logarithmic in the longest path; only a count and a
    checksum of each round reach the driver. The number of tasks follows the
    links, not the session's number of shuffle partitions.
    """
    links = settle(links.where("a <> b").select("a", "b"))
    count = links.count()
    if not count:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    tasks = 2 + count // TASK_LINKS
    links, state = links.coalesce(tasks), None
    while True:
        links = settle(_small_star(_large_star(links, tasks), tasks))
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct().coalesce(tasks))
