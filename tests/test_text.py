"""Goldens of text repair and parsing, and a check against plain regular expressions."""

from __future__ import annotations

import random
import re
from functools import reduce

import pytest
from pyspark.sql import functions as F

from wayline.functions import text as X
from wayline.operators import readings as R
from wayline.session import spread


def col(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_literal_corrections(spark):
    assert col(spark, ["Zane: R0ot Camdir", "Zone; 00c Stanton", "GGC_L2"], X.correct_literals) == [
        "Zone: Root CamDir", "Zone: OOC Stanton", "OOC_L2"]


def test_normal_form(spark):
    pairs = [
        ("OOC_L2Pos: 1.0000km", "OOC_L2 Pos: 1.0000km"),
        ("Pos:__1.0000km", "Pos: 1.0000km"),
        ("A5C5059P05: 1", "A5C5059Pos: 1"),
        ("x P0s 5", "x Pos 5"),
        ("586.4G26km", "586.4026km"),
        ("-103.597Zk 1", "-103.5972km 1"),
        ("12.3456kh -1", "12.3456km -1"),
        ("12.3456km7", "12.3456km"),
        ("-748,258km", "-748.258km"),
        ("x J48.2580km", "x 748.2580km"),
        ("-263 .8255km", "-263.8255km"),
        ("12 3456km", "12.3456km"),
        ("Pos: 1.000km - 263.8255km", "Pos: 1.000km -263.8255km"),
        ("Pos:-748.2", "Pos: -748.2"),
    ]
    assert col(spark, [a for a, _ in pairs], X.normalize_line) == [b for _, b in pairs]


def parsed(spark, lines, normal=True):
    fn = (lambda c: X.position(X.normalize_line(c))) if normal else X.position
    return [None if p is None else (p["x"], p["y"], p["z"], p["method"]) for p in col(spark, lines, fn)]


def test_parse_cascade(spark):
    got = parsed(spark, [
        "Zone: Z Pos: 4090.56m 12.7720km -36.9037km",
        "Zone: Z Pos: 100.50m -20.25m 3.00m",
        "Zone: Z Pos: -748.2809km -103.5753km -263.82km",
        "OOC_Stanton_3 -748.2809km -103.5753km -263.8265km",
        "nowhere -748.2809km -103.5753km -263.8265km",
        "Zone: Z Pos: 41335653km -1235653km 7775653km",
        "Zone: Z Pos: 1.0000km 2.0000km",
        "OOC_Stanton_3 99999.1000km -103.5753km -263.8265km",
        "Zone: Z Pos: 999999999km 1335653km 1335653km",
    ])
    assert got == [
        (4.09056, 12.772, -36.9037, "strict"), (0.1005, -0.02025, 0.003, "strict"),
        (-748.2809, -103.5753, -263.82, "relaxed"), (-748.2809, -103.5753, -263.8265, "headless"), None,
        (4133.5653, -123.5653, 777.5653, "decimal_recovery"), None, None, None]


def _reference(line):
    """The same cascade with Python's own regular expressions, tried in turn."""
    axis, cut = X._AXIS, X._AXIS_CUT
    for method, pattern in (("strict", rf"pos:?\s*{axis}\s*{axis}\s*{axis}"), ("relaxed", rf"pos:?\s*{axis}\s*{axis}\s*{cut}"),
                            ("headless", rf"{axis}\s*{axis}\s*{cut}")):
        if method == "headless" and not re.search(X.ZONE_HINT, line):
            continue
        m = re.search(pattern, line, re.I)
        if m:
            g = m.groups()
            xyz = [float(g[i]) if g[i] else float(g[i + 1]) / 1000 for i in (0, 2, 4)]
            if method != "headless" or all(abs(c) < 30000 for c in xyz):
                return (*xyz, method)
    found = re.findall(X.UNDOTTED, line)[:3]
    if len(found) == 3:
        xyz = [(-1 if s else 1) * int(d) / 10000 for s, d in found]
        if all(abs(c) < 30000 for c in xyz):
            return (*xyz, "decimal_recovery")
    return None


def test_parse_agrees_with_plain_regular_expressions(spark):
    rng = random.Random(3)
    parts = ["Pos:", "pos ", "Zone: OOC_Stanton_1 ", "ArcCorp ", "12.345km", "-7.1234 km", "5.12m", "9.99km", "1.2345m",
             "41335653km", "-123456km", " ", "  ", "km", "-", "\t", "m", "k", "3.14km", "30001.0000km"]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    assert parsed(spark, lines, normal=False) == [_reference(line) for line in lines]


def test_normal_form_agrees_with_plain_regular_expressions(spark):
    rng = random.Random(5)
    alphabet = "Pp9o0aAsS56:;,. -_kKmhZJGO12i|"
    lines = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(3, 30))) for _ in range(3000)]

    def plain(line):
        for pattern, by in X.NORMAL_FORM:
            line = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", by), line)
        return line

    got = col(spark, lines, X.normalize_line)
    assert got == [plain(line) for line in lines]


def test_keyword_misread_depends_on_its_terminator(spark):
    assert col(spark, ["P05:x", "P05;x", "P05 x", "P05x", "9as.", "xP05:", "99as:"], X.normalize_line) == [
        "Pos:x", "Pos:x", "Pos x", "Posx", "Pos:", "xP05:", "Poss:"]


def test_orphans_are_rejoined(spark):
    texts = ["Zone: A Pos:\n-1.0km -2.0km 3.0k", "Zone: A Pos: 1.0km\n2.0km 3.0km\nrest", "Zone: A Pos: 1.0km\n2.0km\n3.0km\n4.0km",
             "oc Pos: -0.67m -33\n5.0km 6.0km", "Zone: A Pos: 1.0km\nZone: B", "plain\ntext", "a Pos:\nb Pos:\n1.5km 2.5km 3.5km"]
    assert col(spark, texts, X.rejoin_orphans) == [
        "Zone: A Pos: -1.0km -2.0km 3.0k", "Zone: A Pos: 1.0km 2.0km 3.0km\nrest",
        "Zone: A Pos: 1.0km 2.0km 3.0km\n4.0km", "oc Pos: -0.67m -33\n5.0km 6.0km", "Zone: A Pos: 1.0km\nZone: B",
        "plain\ntext", "a Pos:\nb Pos: 1.5km 2.5km 3.5km"]


def test_absolute_frames_are_refused_and_zone_keeps_its_prefix(spark):
    df = spark.createDataFrame([(1, 0, 0.9, "Root Pos: 1.0000km 2.0000km 3.0000km"), (1, 1, 0.9, "SolarSystem Pos: 1.0000km 2.0000km 3.0000km"),
                                (2, 0, 0.9, "Zone: Z Pos: 1.0000km 2.0000km 3.0000km"), (2, 1, 0.9, "Zone: SolarSystem_9948564368677 x")],
                               "frame_id int, line_no int, score double, text string")
    got = {(r["frame_id"], r["line_no"]): r for r in R.read_lines(df, "text").collect()}
    assert not got[1, 0]["accepted"] and not got[1, 1]["accepted"]
    assert got[2, 0]["accepted"] and got[2, 0]["ooc"] == "Zone: Z"
    assert got[2, 1]["location"] == "Stanton" and not got[2, 1]["is_position"]


@pytest.mark.parametrize("name,want", [("v1.2.3", "1.2.3"), ("0.0.10", "0.0.10"), ("01.2.3", None), ("1.2", None), ("v1.2.3-rc", None)])
def test_versions(spark, name, want):
    assert col(spark, [name], X.normalize_version) == [want]


def test_paths_and_folders(spark):
    assert col(spark, ["images/a_b_000123_row0.png", "x/.hidden", "plain"], X.file_stem) == ["a_b_000123_row0", ".hidden", "plain"]
    assert col(spark, ["a_b_000123_row0", "a_b", "ab"], X.source_prefix) == ["a_b", None, None]
    chars = list(":. -Aa7")
    folders = col(spark, chars, X.encode_label)
    assert folders == ["_colon", "_dot", "_space", "_dash", "_upA", "a", "7"]
    assert col(spark, folders, X.decode_label) == chars


def test_steps_left_out_would_change_nothing(spark):
    """The guarded steps against all steps, on lines made of what the patterns look at."""
    draw = random.Random(7)
    parts = ["Pos", "pos:", "Pos:", "P05:", "9a5", "Zone:", "Zane:", "GGC", "R0ot", " ", "  ", "\t", "\n", "_", "-", ".", ",", "km", "k", "kh", "K", "m", "l",
             "1", "5", "0", "12", "345", "6789", "123456", "1.2345km", "61km", "-7.25m", "G", "O", "Z", "J", "I", "i", "|", "\u0001", "a", "x ", "Ooc "]
    lines = ["".join(draw.choices(parts, k=draw.randint(1, 14))) for _ in range(20000)]
    df = spark.createDataFrame([(t,) for t in lines], "t string").repartition(8)
    every = reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), X.NORMAL_FORM, F.col("t"))
    replaced = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), X.CORRECTIONS, F.col("t"))
    told = df.select("t", X.normalize_line(F.col("t")).alias("n"), every.alias("all"), X.correct_literals(F.col("t")).alias("c"), replaced.alias("r"))
    assert told.filter("n <> `all` or c <> r").collect() == []
    assert told.filter("n <> t").count() > 10000 and told.filter("n = t").count() > 300
    none = df.limit(1).select(X.normalize_line(F.lit(None).cast("string")).alias("n"), X.correct_literals(F.lit(None).cast("string")).alias("c")).first()
    assert (none["n"], none["c"]) == (None, None)


def test_a_large_scan_is_dealt_to_more_tasks_than_cores(spark, tmp_path):
    spark.range(100).repartition(5).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(256 * 2 ** 20))  # a split per file
    try:
        assert spread(spark.read.parquet(str(tmp_path / "t"))).rdd.getNumPartitions() == 40
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_white_space_is_what_patterns_take_for_it(spark):
    df = spark.createDataFrame([(chr(i),) for i in range(1, 65536) if not 55296 <= i <= 57343], "c string").select(F.concat("c", F.lit("a b"), "c", "c").alias("t"))
    assert df.filter(X.stripped(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+\z", "")).count() == 0
    assert df.filter(X.stripped(F.col("t")) == "a b").count() == len(X.WHITE)
