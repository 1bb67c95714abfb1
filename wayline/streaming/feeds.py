"""Sources, event-time statistics and sinks around the session tracker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline import schemas


def read_inputs(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Micro-batches of session inputs from JSON files; a message bus in production
    delivers the same schema."""
    reader = spark.readStream.schema(schemas.SESSION_INPUT)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def as_commands(targets: DataFrame, points: DataFrame) -> DataFrame:
    """Target commands with the point they name, in the input schema."""
    joined = targets.join(points, "suppkey", "left")
    cols = {f.name: F.lit(None).cast(f.dataType) for f in schemas.SESSION_INPUT.fields}
    cols.update(sid=F.col("sid"), event=F.col("action"), t_capture=F.col("ts"), seq=F.lit(0).cast("bigint"),
                source_epoch=F.lit(0).cast("bigint"), t_name=F.col("name"), tx=F.col("x"), ty=F.col("y"), tz=F.col("z"),
                t_ooc=F.col("ooc"), kind=F.col("kind"), ts=F.timestamp_seconds(F.col("ts")))
    return joined.select(*[c.cast(schemas.SESSION_INPUT[n].dataType).alias(n) for n, c in cols.items()])


def as_ticks(track: DataFrame) -> DataFrame:
    cols = {f.name: F.lit(None).cast(f.dataType) for f in schemas.SESSION_INPUT.fields}
    cols.update({c: F.col(c) for c in ("sid", "t_capture", "seq", "x", "y", "z", "ooc")})
    cols.update(event=F.lit("tick"), source_epoch=F.lit(0), ts=F.timestamp_seconds(F.col("t_capture")))
    return track.select(*[c.cast(schemas.SESSION_INPUT[n].dataType).alias(n) for n, c in cols.items()])


def as_inputs(ticks: DataFrame, commands: DataFrame) -> DataFrame:
    """Recorded ticks and commands, as ``tracker.replay`` takes them, in the input schema."""
    told = commands.withColumnsRenamed({"ts": "t_capture", "action": "event"}).withColumn("seq", F.lit(0))
    rows = ticks.withColumn("event", F.lit("tick")).unionByName(told, allowMissingColumns=True).withColumn("ts", F.timestamp_seconds(F.col("t_capture")))
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in schemas.SESSION_INPUT.fields])


def sink_batches(rows: DataFrame, path: str, checkpoint: str):
    """Append what is there now as Parquet, a folder per micro-batch; a batch that runs again replaces its own rows."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stability_windows(ticks: DataFrame, width: str = "10 seconds", watermark: str = "10 seconds") -> DataFrame:
    """Capture rate and coordinate spread per session and tumbling window."""
    spread = [(F.max(c) - F.min(c)).alias(f"spread_{c}") for c in "xyz"]
    return (ticks.filter(F.col("event") == "tick").withWatermark("ts", watermark)
            .groupBy("sid", F.window("ts", width).alias("w"))
            .agg(F.count(F.lit(1)).alias("ticks"), F.avg(F.col("x").isNotNull().cast("double")).alias("capture_rate"), *spread))


def pause_sessions(ticks: DataFrame, gap: str = "3 seconds", watermark: str = "10 seconds") -> DataFrame:
    """Statistics per stretch without pauses. A pause of exactly ``gap`` splits here;
    ``tracks.gap_segments`` is exact."""
    return (ticks.filter(F.col("event") == "tick").withWatermark("ts", watermark)
            .groupBy("sid", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("ticks")))


def first_seen_stream(df: DataFrame, content: list[str], watermark: str = "10 minutes") -> DataFrame:
    return df.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(content)


def to_telemetry(results: DataFrame) -> DataFrame:
    """Tracker rows as telemetry records; guidance is null without a target."""
    ticks = results.filter(F.col("event") == "tick")
    return ticks.select(
        "sid", "t_capture", F.unix_micros("ts").cast("double").alias("_us"), "status", "reason", "x", "y", "z", "ooc", "location", "target",
        *[F.when(F.col("target").isNotNull(), F.col(c)).alias(c) for c in ("yaw_off", "pitch_off", "dist_km")],
        F.round("speed_km_s", 6).alias("speed_km_s"), "integrity", "coord_age_s"
    ).withColumn("t_wall", F.col("_us") / 1e6).drop("_us")
