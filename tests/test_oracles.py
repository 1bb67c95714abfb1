"""Registered queries against their SQL twins at the smallest scale."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import check_oracles as C
from wayline.functions import text as X

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return C.duck_connection(SF)


# One query per operator family; set WAYLINE_ALL_QUERIES=1, or run
# tools/check_oracles.py, for all of them.
SAMPLE = ["a5_outlier_flags", "a7_consensus", "a13_routing_counters", "a14_otsu_threshold", "f11_velocity_bearing", "f23_position_parse",
          "flagship_navigation", "j6_import_replace", "j13_manifest_delta", "j14_template_scores", "p3_validation", "r3_gap_segments",
          "t4_glyph_override", "t12_stratified_split", "w1_rolling_median", "w2_plausibility_gate", "w6_distance_smoothing",
          "w9_zone_lock", "w11_kalman_filter", "r1_session_tracker", "r8_grace_expiry", "s1_telemetry_lines", "t10_random_gap_sample", "t13_weighted_resample", "text_to_fix", "w20_merge_boxes", "w21_row_text", "w25_orphan_rejoin"]
NAMES = sorted(entry_module.queries()) if os.environ.get("WAYLINE_ALL_QUERIES") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_oracle(spark, duck, name):
    query, sql = entry_module.queries()[name], entry_module.oracle_sql().get(name)
    state, rows, _, note = C.compare(spark, duck, name, query, sql, SF)
    assert state in ("ok", "rows-only"), note
    assert rows >= 0


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["sid", "seq", "target", "in_zone", "dist_km", "yaw_deg", "dist_text", "arrow"] and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


ODD_TEXTS = [None, "", "   ", " a ", "\u00a0b\u3000", "\x0bc\x0c", "\u2028d \u2028", "\x1ce\x85", "\tf\n", "\u200bg", "h\r\n\ti"]


@pytest.mark.parametrize("name,texts", [("s5_label_lines", ODD_TEXTS), ("s6_label_files", ODD_TEXTS), ("s6_label_files", ["only one"]), ("s6_label_files", [None])])
def test_labels_of_odd_texts_match_the_oracle(spark, tmp_path, name, texts):
    rows = [(i, texts[i % len(texts)], "en", "web 1" if i % 4 else None, 0) for i in range(27 * len(texts) if len(texts) > 1 else 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    con = C.duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    query, sql = entry_module.queries()[name], entry_module.oracle_sql()[name]
    state, _, _, note = C.compare(spark, con, name, query, sql, str(tmp_path))
    assert state == "ok", note


def test_space_characters_are_trimmed_as_in_the_oracle(spark):
    want = C.duckdb.connect().execute("select i from range(1, 65536) t(i) where i not between 55296 and 57343 and trim(chr(i::int)) = ''").fetchall()
    text = spark.createDataFrame([(i, chr(i)) for i in range(1, 65536) if not 55296 <= i <= 57343], "i int, c string")
    got = text.filter(X.without_spaces(F.concat("c", F.lit("x"), "c")) == "x").select("i").collect()
    assert sorted(r["i"] for r in got) == sorted(r[0] for r in want)
