"""Files in and out, and event-time statistics on streams."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from wayline import schemas
from wayline.sources import files as S
from wayline.streaming import feeds


def test_heterogeneous_telemetry(spark, tmp_path):
    lines = ['{"t_capture":1.0,"status":"ok","x":1.5,"y":2.0,"z":3.0,"t_wall":100.0,"novel":"k"}',
             '{"t_capture":2.0,"status":"no_read","reason":"no_coords"}', "not json"]
    (tmp_path / "telemetry-20240102-030405.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "telemetry-20240102-040506.jsonl").write_text(lines[1] + "\n")
    got = S.read_telemetry(spark, str(tmp_path)).orderBy("sid", "t_capture").collect()
    assert {r["sid"] for r in got} == {"20240102-030405", "20240102-040506"} and len(got) == 4
    assert [r["_corrupt"] for r in got if r["_corrupt"]] == ["not json"]
    ok = next(r for r in got if r["status"] == "ok")
    assert ok["x"] == 1.5 and ok["reason"] is None
    extra = [r["extra"] for r in S.read_telemetry_extra(spark, str(tmp_path)).collect() if r["extra"]]
    assert extra == [{"novel": "k"}]


def test_telemetry_sink_fills_wall_time_and_can_be_off(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, None)], "t_capture double, t_wall double")
    out = str(tmp_path / "out")
    S.write_telemetry(df, out, enabled=False)
    assert not (tmp_path / "out").exists()
    S.write_telemetry(df, out)
    S.write_telemetry(df, out)
    back = spark.read.schema("t_capture double, t_wall double").json(out)
    assert back.count() == 4 and back.filter("t_capture = 1.0 and t_wall = 5.0").count() == 2
    assert back.filter("t_wall is null").count() == 0


def test_catalogue_files(spark, tmp_path):
    one = {"name": "A", "x": 1, "y": 2, "z": 3, "location": "L", "kind": "space", "more": 1}
    (tmp_path / "one.json").write_text(json.dumps(one))
    (tmp_path / "many.json").write_text(json.dumps([one, {**one, "name": "B", "ooc": "q"}], indent=2))
    (tmp_path / "bad.json").write_text("{oops")
    assert sorted(r["name"] for r in S.read_catalogue(spark, str(tmp_path)).collect()) == ["A", "A", "B"]
    assert S.read_catalogue(spark, str(tmp_path / "absent.json")).count() == 0
    assert S.read_catalogue(spark, str(tmp_path / "bad.json")).count() == 0
    out = str(tmp_path / "out")
    S.write_catalogue(S.read_catalogue(spark, str(tmp_path / "many.json")), out)
    back = S.read_catalogue(spark, out, lines=True).orderBy("name").collect()
    assert [(r["name"], r["ooc"], r["category"]) for r in back] == [("A", None, ""), ("B", "q", "")]
    S.export_one(S.read_catalogue(spark, str(tmp_path / "many.json")), "B", out + "1")
    assert [r["name"] for r in S.read_catalogue(spark, out + "1/*.json").collect()] == ["B"]


def test_label_files(spark, tmp_path):
    rows = [("images/a.png", 'he said "hi"\tx', "train"), ("images/b.png", "Pos:", "val")]
    S.write_labels(spark.createDataFrame(rows, "relpath string, transcript string, split string"), str(tmp_path / "l"))
    back = S.read_labels(spark, str(tmp_path / "l" / "split=train"))
    assert [tuple(r)[:2] for r in back.select("relpath", "transcript").collect()] == [rows[0][:2]]
    S.write_characters(spark.createDataFrame([("b",), ("a",), (":",)], "char string"), str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("part-*.txt")).read_text()
    assert text.split() == [":", "a", "b"]


def test_file_trees(spark, tmp_path):
    for rel in ("real/7/a.png", "real/7/b.JPG", "real/7/notes.txt", "real/_dot/d.png", "real/_to_review/x.png", "synth/k/e.bmp", "synth/7/f.png"):
        path = tmp_path / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(rel.encode())
    got = S.read_classes(spark, str(tmp_path / "real"), str(tmp_path / "synth")).collect()
    assert sorted((r["char"], r["label"], r["is_real"]) for r in got) == [
        (".", 0, True), ("7", 1, False), ("7", 1, True), ("7", 1, True), ("k", 2, False)]
    assert S.read_classes(spark, str(tmp_path / "none")).count() == 0
    manifest = {r["path"]: r["digest"] for r in S.hash_manifest(spark, str(tmp_path / "synth")).collect()}
    assert manifest == {p: hashlib.sha256(f"synth/{p}".encode()).hexdigest() for p in ("k/e.bmp", "7/f.png")}


def test_log_files(spark, tmp_path):
    from wayline.operators import quality as Q
    lines = ["2024-01-01 00:00:00,000 - ocr - INFO - [otsu] Position extracted: zone - x", "2024-01-01 00:00:01,000 - main - WARNING - OCR rejection: sign-flip on X",
             "2024-01-01 00:00:01,000 - ocr - DEBUG - Multi-pass consensus: X=1"]
    (tmp_path / "app.log").write_text("\n".join(lines))
    df = Q.split_log(S.read_log(spark, str(tmp_path)))
    assert {(r["logger"], r["level"]) for r in df.collect()} == {("ocr", "INFO"), ("main", "WARNING"), ("ocr", "DEBUG")}
    h = Q.log_health(df.withColumn("sid", F.lit(1)), ["sid"], "message").first()
    assert (h["reads"], h["consensus"], h["rejections"], h["consensus_ok"], h["rejections_ok"]) == (1, 1, 1, True, False)


def _input(spark, rows):
    full = [tuple({"event": "tick", "source_epoch": 0, **r}.get(f.name) for f in schemas.SESSION_INPUT.fields) for r in rows]
    return spark.createDataFrame(full, schemas.SESSION_INPUT).withColumn("ts", F.timestamp_seconds(F.col("t_capture") + 1e9))


def test_streaming_statistics_and_sink(spark, tmp_path):
    ticks = [{"sid": 1, "seq": i, "t_capture": float(i), "x": float(i) if i % 2 else None, "y": 0.0, "z": 0.0} for i in range(20)]
    _input(spark, ticks).coalesce(1).write.json(str(tmp_path / "in"))

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        try:
            q.processAllAvailable()
            _input(spark, [{"sid": 9, "seq": 0, "t_capture": 1e6 + q.lastProgress["batchId"]}]).write.mode("append").json(str(tmp_path / "in"))
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.table(name)

    stream = lambda: feeds.read_inputs(spark, str(tmp_path / "in"))
    windows = run(feeds.stability_windows(stream()), "stability").filter("sid = 1").collect()
    assert sorted((r["ticks"], r["capture_rate"], r["spread_x"]) for r in windows) == [(10, 0.5, 8.0), (10, 0.5, 8.0)]
    stretches = run(feeds.pause_sessions(stream()), "stretches").filter("sid = 1").collect()
    assert [r["ticks"] for r in stretches] == [20]
    assert run(feeds.first_seen_stream(stream(), ["sid"]), "firsts").filter("sid = 1").count() == 1
    q = S.stream_telemetry(stream().filter("sid = 1").select("t_capture", "x"), str(tmp_path / "sink"), str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.read.schema("t_capture double, t_wall double").json(str(tmp_path / "sink")).filter("t_wall is not null").count() == 20
    assert S.stream_telemetry(stream(), "x", "y", enabled=False) is None


def test_a_session_is_written_by_one_task(spark):
    """Whatever the number of tasks, a session's folder holds one file."""
    import glob

    import __spark_entry__
    from wayline.session import shared_folder

    place, name = f"{shared_folder(spark).removeprefix('file:')}/telemetry-*", "spark.sql.adaptive.coalescePartitions.enabled"
    known, before = set(glob.glob(place)), spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        rows = __spark_entry__.queries()["s1_telemetry_lines"](spark, "/root/testdata/sf0.01").count()
    finally:
        spark.conf.set(name, before)
    written, = set(glob.glob(place)) - known
    folders = glob.glob(f"{written}/session=*")
    assert rows == 10000 and len(folders) > 100
    assert all(len(glob.glob(f"{f}/part-*")) == 1 for f in folders)


def test_small_folders_are_written_as_by_spark(spark, tmp_path):
    """The same folders and lines as Spark's writer, but no second file for each one."""
    names = ["telemetry-20240101-000001", "a b", "x/y:z=1", "50%", "#1", "\u00fc", "", None]
    rows = [(names[i % len(names)], None if i == 3 else f"line {i} \u00e4") for i in range(400)]
    df = spark.createDataFrame(rows, "session string, value string").repartition(4, "session")
    S.write_folders(df, str(tmp_path / "ours"), "session")
    df.write.partitionBy("session").text(str(tmp_path / "sparks"))
    told = lambda name: sorted((r["session"] or "", r["value"]) for r in spark.read.text(str(tmp_path / name)).collect())
    folders = lambda name: sorted(p.name for p in (tmp_path / name).iterdir() if p.is_dir())
    assert folders("ours") == folders("sparks") and told("ours") == told("sparks") and len(told("ours")) == 400
    assert all(f.name.startswith("part-") for f in (tmp_path / "ours").glob("*/*"))
    S.write_folders(df.limit(0), str(tmp_path / "none"), "session")
    assert S.read_telemetry(spark, str(tmp_path / "none")).count() == 0
