"""Comparing file manifests, checking paths, pruning versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.text import version_key

# Device names, files and folders an update must not carry.
RESERVED = r"(?i)(^|/)(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|/|$)"
UNSAFE = r"[\\:*?\"<>|\x00-\x1f]|^$|^/|/$|//|(^|/)\.{1,2}(/|$)|[ .](/|$)"
USER_DATA = r"(?i)^(config\.ini|data/user_poi\.json)$|^(logs|updates|\.git)(/|$)|(^|/)(\.env|\.venv)|(^|/)__pycache__(/|$)"
SHA256 = "^[0-9a-f]{64}$"


def path_problem(path: Column) -> Column:
    return (F.when(path.isNull() | path.rlike(UNSAFE), "unsafe").when(path.rlike(RESERVED), "reserved")
            .when(path.rlike(USER_DATA), "user_data"))


def manifest_problems(manifest: DataFrame, digest_pattern: str | None = SHA256) -> DataFrame:
    """Entries with a bad path, a bad digest, or a path that differs only in case from another.

    Twins are counted by a partial aggregate and joined back.
    """
    twins = (manifest.groupBy(F.lower("path").alias("_p")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    judged = manifest.join(twins, F.lower(manifest["path"]) == F.col("_p"), "left")
    bad = F.col("digest").isNull() | (~F.col("digest").rlike(digest_pattern) if digest_pattern else F.lit(False))
    problem = F.coalesce(path_problem(F.col("path")), F.when(F.col("_n").isNotNull(), "duplicate"), F.when(bad, "digest"))
    return judged.withColumn("problem", problem).filter("problem is not null").drop("_p", "_n")


def manifest_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changed or added and deleted paths; paths that differ in case only are the same file."""
    a = old.select(F.lower("path").alias("_p"), F.col("path").alias("old_path"), F.col("digest").alias("_a"))
    b = new.select(F.lower("path").alias("_p"), F.col("path").alias("new_path"), F.col("digest").alias("_b"))
    both = a.join(b, "_p", "full_outer")
    change = (F.when(F.col("new_path").isNull(), "deleted").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed"))
    return (both.withColumn("change", change).filter("change is not null")
            .select(F.coalesce("new_path", "old_path").alias("path"), "change", F.col("_b").alias("digest")))


def require_changes(delta: DataFrame) -> DataFrame:
    if delta.isEmpty():
        raise ValueError("nothing changed between the two manifests")
    return delta


def prunable(versions: DataFrame, keep: int, protected: DataFrame | None = None, name: str = "name",
             version: str = "version") -> DataFrame:
    """Entries that are neither among the newest ``keep`` nor protected."""
    keyed = versions.withColumn("_k", version_key(F.col(version))).filter(F.col("_k").isNotNull())
    newest = keyed.orderBy(F.col("_k").desc(), F.col(name).desc()).limit(keep).select(name)
    spared = newest.union(protected.select(name)) if protected is not None else newest
    return keyed.join(spared.distinct(), name, "left_anti").drop("_k")
