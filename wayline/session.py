"""Session defaults for tests and the bench.

Operators take whatever session they are given; nothing below is required on a
cluster, where these settings come from the submit command.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "wayline", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shares(scan: DataFrame) -> int:
    """Tasks for a stage over the rows of a plain file scan, so many that a task's share does not grow with the input."""
    return max(scan.sparkSession.sparkContext.defaultParallelism, 8 * scan.rdd.getNumPartitions())


def spread(scan: DataFrame) -> DataFrame:
    """Use all cores for a costly stage over a plain file scan with few splits.

    A scan of many files has more splits than cores and is left alone. Each split is
    dealt to several tasks, so that a task's share does not grow with the input.
    """
    cores, splits = scan.sparkSession.sparkContext.defaultParallelism, scan.rdd.getNumPartitions()
    return scan if splits >= 2 * cores else scan.repartition(shares(scan))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; one is chosen only where none is (tests, single machine)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder the session names.

    Used between long stages so that a lost executor costs one stage, not the
    whole history. A local folder is chosen only when the session names none
    (tests, single machine).
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
