"""Reading and writing telemetry, catalogues, label files, logs and file trees."""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline import schemas
from wayline.functions.text import decode_label, stripped
from wayline.operators.catalogue import WIRE, wire_form
from wayline.operators.curation import parse_labels

# Session files carry their launch time; images have these endings; names of folders spell out these characters.
SESSION_FILE = r"telemetry-(\d{8}-\d{6})"
UNSAFE = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
IMAGE_FILE = r"(?i)\.(png|jpg|bmp)$"


def _read_text(spark: SparkSession, path: str) -> DataFrame:
    """Text of very many small folders: a few tasks list them, not one task a folder."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.text(path)
    finally:
        spark.conf.set(name, before)


def _local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder's plain path where it is on a mounted disk, else None."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def write_folders(lines: DataFrame, path: str, folder: str, value: str = "value") -> None:
    """Text of very many small folders ``<folder>=<name>``, one file a folder and task.

    On a mounted disk Spark's own writer starts a process to set a file's mode,
    and the driver moves the files one after another. Tasks then write the
    files themselves: under a hidden name first, so that a repeated task puts the
    same file in its place.
    """
    local = _local_folder(lines.sparkSession, path)
    if local is None:
        lines.select(folder, value).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(folder).text(path)
        return
    os.makedirs(local)

    def write(batches):
        task, name, out, n = TaskContext.get(), None, None, 0
        hidden, shown = f".part-{task.partitionId():05d}-{task.taskAttemptId()}", f"part-{task.partitionId():05d}.txt"

        def close():
            if out is not None:
                out.close()
                os.replace(f"{name}/{hidden}", f"{name}/{shown}")

        for batch in batches:
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key = f"{local}/{folder}={UNSAFE.sub(lambda c: f'%{ord(c[0]):02X}', key)}"
                if key != name:
                    close()
                    os.makedirs(key, exist_ok=True)
                    name, out, n = key, open(f"{key}/{hidden}", "wb"), n + 1
                out.write((line or b"") + b"\n")
        close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    rows = lines.select(F.coalesce(F.nullif(F.col(folder), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__")), F.col(value).cast("binary"))
    rows.sortWithinPartitions(rows.columns[0]).mapInArrow(write, "files bigint").agg(F.sum("files")).collect()


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry lines of many sessions, whatever keys each of them has.

    A line is parsed once, as a variant; a value of another type than its column
    is null. Keys outside the schema are text in ``extra``. A line that is no
    JSON object keeps only ``_corrupt``. ``sid`` is the launch stamp in the name
    of the file or of its folder.
    """
    lines = _read_text(spark, path).select(F.regexp_extract(F.col("_metadata.file_path"), SESSION_FILE, 1).alias("sid"), "value",
                                         F.try_parse_json("value").alias("_v"))
    sound = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    known = [f for f in schemas.TELEMETRY.fields if f.name != "_corrupt"]
    names = F.array(*[F.lit(f.name) for f in known])
    extra = F.map_filter(F.from_json("value", "map<string,string>"), lambda k, v: ~F.array_contains(names, k))
    return lines.select("sid", *[F.when(sound, F.try_variant_get("_v", f"$.{f.name}", f.dataType.simpleString())).alias(f.name) for f in known],
                        F.when(~sound, F.col("value")).alias("_corrupt"), F.when(sound, extra).alias("extra"))


def read_telemetry_extra(spark: SparkSession, path: str) -> DataFrame:
    """Keys outside the schema, as a map of text per line."""
    return read_telemetry(spark, path).select("sid", "extra")


def stamped(records: DataFrame) -> DataFrame:
    """Wall time is filled in when absent."""
    now = F.current_timestamp().cast("double")
    wall = F.coalesce("t_wall", now) if "t_wall" in records.columns else now
    return records.withColumn("t_wall", wall)


def write_telemetry(records: DataFrame, path: str, enabled: bool = True) -> None:
    """Append as JSON lines; disabled means no output at all."""
    if enabled:
        stamped(records).write.mode("append").json(path)


def stream_telemetry(records: DataFrame, path: str, checkpoint: str, enabled: bool = True):
    """Append a stream of tracker results as JSON lines; None when disabled."""
    if not enabled:
        return None
    return (stamped(records).writeStream.format("json").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append").start())


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    matches = fs.globStatus(hadoop)
    return matches is not None and len(matches) > 0


def read_catalogue(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One object or an array per file; missing or unreadable files give no rows.

    ``lines`` reads tables written by ``write_catalogue``, one object per line.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], schemas.POI)
    df = (spark.read.schema(schemas.POI_READ).option("multiLine", not lines).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt").json(path))
    # Mentioning a data column keeps counting legal: Spark refuses queries that
    # read the corrupt-record column alone.
    intact = F.concat_ws("", F.col("_corrupt"), F.substring("name", 1, 0)) == ""
    return df.filter(intact).select(*WIRE)


def write_catalogue(pois: DataFrame, path: str) -> None:
    """The wire schema as JSON lines, so that any number of tasks can write."""
    wire_form(pois).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_one(pois: DataFrame, name: str, path: str) -> None:
    write_catalogue(pois.filter(F.col("name") == name), path)


def read_labels(spark: SparkSession, path: str, trim: Callable[[Column], Column] | None = stripped) -> DataFrame:
    """Label lines read as text: quotes are data, so no CSV reader.

    ``split`` is that of the folder, where ``write_labels`` made one. ``trim`` is
    that of ``parse_labels``.
    """
    split = F.nullif(F.regexp_extract(F.col("_metadata.file_path"), "/split=([^/]+)/[^/]+$", 1), F.lit(""))
    return parse_labels(spark.read.text(path).select("value", split.alias("split")), trim=trim)


def write_labels(labels: DataFrame, path: str, stems_only: bool = False) -> None:
    """One text folder per split."""
    line = F.col("stem") if stems_only else F.concat_ws("\t", "relpath", "transcript")
    labels.select("split", line.alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def write_characters(chars: DataFrame, path: str) -> None:
    """Sorted character dictionary, one per line. An alphabet fits one file."""
    chars.select(F.col("char").alias("value")).coalesce(1).sortWithinPartitions("value").write.mode("overwrite").text(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def _under(root: str) -> Column:
    """Path relative to ``root``, with forward slashes."""
    return F.regexp_extract(F.col("path"), rf"{posixpath.normpath(root)}/(.*)$", 1)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root``.

    File readers skip names that start with ``_`` or ``.``. Folders that encode a
    character this way are read by listing them explicitly.
    """
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def hash_manifest(spark: SparkSession, root: str) -> DataFrame:
    return read_tree(spark, root).select(_under(root).alias("path"), F.sha2("content", 256).alias("digest"))


def read_classes(spark: SparkSession, real: str, synthetic: str | None = None) -> DataFrame:
    """Images of class-labelled folders with ``char``, dense ``label`` and ``is_real``.

    All folders are read at once; class and provenance come from a file's path.
    Folders that start with ``_`` are classes only if that spells a character.
    Classes are numbered in sorted order.
    """
    roots = [(posixpath.normpath(root), is_real) for root, is_real in ((real, True), (synthetic, False)) if root and _exists(spark, f"{root}/*")]
    if not roots:
        return spark.createDataFrame([], "path string, content binary, char string, is_real boolean, label int")
    is_real, folder = F.lit(None).cast("boolean"), F.lit(None).cast("string")
    for root, flag in roots:
        below = F.regexp_extract("path", rf"(?:^|:|/){re.escape(root.split(':', 1)[-1].lstrip('/'))}/([^/]+)/[^/]+$", 1)
        folder, is_real = F.coalesce(folder, F.nullif(below, F.lit(""))), F.coalesce(is_real, F.when(below != "", F.lit(flag)))
    found = (spark.read.format("binaryFile").load([f"{root}/*" for root, _ in roots]).select("path", "content", folder.alias("_folder"), is_real.alias("is_real"))
             .withColumn("char", decode_label(F.col("_folder"))))
    images = found.filter(F.col("path").rlike(IMAGE_FILE) & ((F.col("char") != F.col("_folder")) | ~F.col("_folder").startswith("_"))).drop("_folder")
    numbered = images.select("char").distinct().select("char", (F.dense_rank().over(Window.orderBy("char")) - 1).alias("label"))
    return images.join(numbered, "char").select("path", "content", "char", "is_real", "label")
