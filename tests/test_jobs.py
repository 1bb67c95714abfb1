"""Votes, quality, catalogue, curation, pixels, templates and manifests on small fixtures."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.operators import catalogue as C
from wayline.operators import curation as U
from wayline.operators import fixes as X
from wayline.operators import pixels as P
from wayline.operators import quality as Q
from wayline.operators import snapshots as N
from wayline.operators import templates as M
from wayline.operators import votes as O

VOTE = "frame_id int, ord int, pass string, score double, x double, y double, z double, ooc string, location string"


def brute_consensus(votes):
    out = {}
    for frame in {v[0] for v in votes}:
        valid = [v for v in sorted(votes, key=lambda v: v[1]) if v[0] == frame and v[4] is not None
                 and all(abs(c) < 30000 for c in v[4:7])]
        best = None
        for i, ref in enumerate(valid):
            group = [ref] + [o for j, o in enumerate(valid) if j != i and all(abs(o[k] - ref[k]) <= 1.0 for k in (4, 5, 6))]
            if len(group) >= 2 and (best is None or len(group) > len(best)):
                best = group
        if best:
            top = max(best, key=lambda v: v[3])
            mean = [sum(v[k] for v in best) / len(best) for k in (4, 5, 6)]
            out[frame] = (len(best), *[round(m, 6) for m in mean], top[3], top[7])
    return out


@pytest.mark.parametrize("spread,step", [(3.0, 0.25), (0.3, 0.01), (12.0, 0.001)])
def test_consensus_equals_brute_force_with_a_hot_frame(spark, spread, step):
    rng = random.Random(int(spread * 10))
    votes = []
    for i in range(400):
        frame = 0 if i % 3 else rng.randrange(1, 60)
        pos = [None] * 3 if rng.random() < 0.1 else [round(round(rng.uniform(0, spread) / step) * step + 100, 4) for _ in range(3)]
        votes.append((frame, i, f"p{i}", float(rng.randrange(5)), *pos, f"z{i}", "Unknown"))
    df = spark.createDataFrame(votes, VOTE)
    got = {r["frame_id"]: (r["size"], *[round(r[c], 6) for c in "xyz"], r["score"], r["ooc"])
           for r in O.consensus(df, ["frame_id"], extra=("ooc",)).collect()}
    assert got == brute_consensus(votes)


@pytest.mark.parametrize("small", [0, 5, 64])
def test_frames_gathered_and_frames_in_cells_agree(spark, small):
    rng = random.Random(5)
    votes = [(i % 9 if i % 2 else 0, i, "p", float(rng.randrange(3)), *[round(rng.uniform(0, 2.5), 1) + 9.0 for _ in range(3)], f"z{i}", "Unknown") for i in range(150)]
    df = spark.createDataFrame(votes, VOTE)
    got = {r["frame_id"]: (r["size"], *[round(r[c], 6) for c in "xyz"], r["score"], r["ooc"])
           for r in O.consensus(df, ["frame_id"], extra=("ooc",), small=small).collect()}
    assert got == brute_consensus(votes)
    sizes = {(r["frame_id"], r["ord"]): r["size"] for r in O.agreeing(df, ["frame_id"], small=small).collect()}
    assert sizes == {(v[0], v[1]): sum(v[0] == o[0] and all(abs(v[k] - o[k]) <= 1.0 for k in (4, 5, 6)) for o in votes) for v in votes}


def test_small_frames_meet_in_one_exchange_of_the_votes(spark):
    df = spark.range(600).selectExpr("cast(id div 4 as int) as frame_id", "cast(id as int) as ord", "'p' as pass", "1.0D as score",
                                     *[f"id % 3 / 2.0D as {c}" for c in "xyz"], "'z' as ooc", "'u' as location")
    for out in (O.consensus(df, ["frame_id"], extra=("ooc",)), O.agreeing(df, ["frame_id"])):
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_best_pass_may_lack_a_position_and_glyph_overrides(spark):
    votes = [(1, 1, "a", 10.0, None, None, None, None, "Unknown"), (1, 2, "b", 5.0, 1.0, 1.0, 1.0, "z", "Unknown"),
             (2, 1, "a", 9.0, 500.0, 0.0, 0.0, "z", "Stanton"), (2, 2, "b", 9.0, 2.0, 0.0, 0.0, "y", "Unknown")]
    df = spark.createDataFrame(votes, VOTE)
    best = {r["frame_id"]: r for r in O.best_pass(df, ["frame_id"]).collect()}
    assert best[1]["x"] is None and best[2]["ord"] == 1
    assert O.best_pass(df, ["frame_id"], need_position=True).filter("frame_id = 1").first()["ord"] == 2
    glyphs = O.glyph_votes(df, spark.createDataFrame([(2, 1.0, 0.0, 0.0)], "frame_id int, x double, y double, z double"), ["frame_id"])
    row = O.prefer_glyph(O.best_pass(df, ["frame_id"]), glyphs, ["frame_id"]).filter("frame_id = 2").first()
    assert row["overridden"] and row["x"] == 1.0 and row["ooc"] == "z" and row["location"] == "Stanton"


def test_upper_median_and_outliers(spark):
    rng = random.Random(2)
    rows = [(run, i, rng.uniform(-50, 50), float(rng.randrange(4)), rng.uniform(0, 1e4)) for run in range(4) for i in range(run + 2 if run < 3 else 301)]
    df = spark.createDataFrame(rows, "run int, i int, x double, y double, z double")
    got = {r["run"]: r for r in Q.upper_medians(df, ["run"], ["x", "y", "z"]).collect()}
    for run in range(4):
        for k, c in enumerate("xyz"):
            values = sorted(r[2 + k] for r in rows if r[0] == run)
            assert got[run][f"{c}_mid"] == values[len(values) // 2]
    few = spark.createDataFrame([(1, 748.0, 0.0, 0.0), (1, -747.0, 0.0, 0.0)], "run int, x double, y double, z double")
    assert Q.flag_outliers(few, ["run"]).filter("suspect is not null").count() == 0
    more = few.union(spark.createDataFrame([(1, 748.1, 0.0, 0.0)], few.schema))
    assert [r["suspect"] for r in Q.flag_outliers(more, ["run"]).filter("x < 0").collect()] == ["X drift -1495.0 km; X sign flipped vs median"]


def test_empty_groups_and_histogram_map(spark):
    df = spark.createDataFrame([(1, 0.96), (1, 0.2), (1, 0.3)], "run int, score double")
    assert Q.histogram_map(df, ["run"], Q.score_bucket(F.col("score"))).first()["histogram"] == {"0.95-1.00": 1, "<0.50": 2}
    ranked = spark.createDataFrame([("a", "0", 0.5), ("b", "0", 0.9), ("c", "0", None)], "c string, m string, s double")
    assert [r["c"] for r in Q.rank_candidates(ranked, "c", "m", "s").collect()] == ["b", "a", "c"]


RAW = "name string, x string, y string, z string, location string, ooc string, kind string, category string, description string"


def test_validation_messages_and_quarantine(spark):
    good = ("  A ", "1", "2.5", "-3", "", "", " Surface ", "exploration", None)
    rows = [good, (None, *good[1:]), ("  ", *good[1:]), ("A", "one", *good[2:]), (*good[:6], "orbit", "", ""), (*good[:7], "nope", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + RAW)
    v = C.validate(df)
    errors = [r["error"] for r in v.orderBy("i").collect()]
    assert errors[:5] == [None, "Missing required field: 'name'.", "Field 'name' must not be empty.", "Fields x/y/z must be numeric.",
                          "Field 'kind' must be 'surface' or 'space' (got 'orbit')."]
    assert errors[5].startswith("Unknown category 'nope'. Expected one of: cave, circuit,")
    valid, refused = C.split_valid(v)
    assert valid.count() + refused.count() == len(rows)
    row = valid.first()
    assert (row["name"], row["x"], row["location"], row["ooc"], row["kind"], row["description"]) == ("A", 1.0, "Unknown", None, "surface", "")


def test_documents_are_all_or_nothing(spark):
    one = '{"name":"A","x":1,"y":2,"z":3,"location":"L","kind":"space"}'
    bad = '{"name":"A","x":"q","y":2,"z":3,"location":"L","kind":"space"}'
    docs = spark.createDataFrame([(1, one), (2, f"[{one},{bad}]"), (3, " "), (4, "[]"), (5, "hello"), (6, f"[{one}]")], "doc int, body string")
    entries, verdicts = C.parse_documents(docs, ["doc"], "body")
    got = {r["doc"]: (r["accepted"], r["error"]) for r in verdicts.collect()}
    assert got == {1: (True, None), 2: (False, "Entry #2: Fields x/y/z must be numeric."), 3: (False, "File is empty."),
                   4: (False, "JSON array is empty — nothing to import."), 5: (False, "JSON root must be an object or an array."), 6: (True, None)}
    _, single = C.parse_documents(docs, ["doc"], "body", single=True)
    assert {r["doc"] for r in single.filter("accepted").collect()} == {1, 6}


def test_update_keeps_fields_not_supplied_and_import_policies(spark):
    cols = "pos int, name string, x double, y double, z double, ooc string, kind string"
    base = spark.createDataFrame([(1, "A", 1.0, 1.0, 1.0, "zone", "space"), (2, "A", 1.0, 1.0, 1.0, "other", "space"), (3, "a (2)", 0.0, 0.0, 0.0, None, "space")], cols)
    change = spark.createDataFrame([("A", 1.0, 1.0, 1.0, "B", None)], "name string, x double, y double, z double, new_name string, new_ooc string")
    got = [(r["name"], r["ooc"]) for r in C.update_first(base, change).orderBy("pos").collect()]
    assert got == [("B", "zone"), ("A", "other"), ("a (2)", None)]
    new = spark.createDataFrame([("a", 9.0, 9.0, 9.0, None, None), ("n", 9.0, 9.0, 9.0, None, None)], "name string, x double, y double, z double, ooc string, kind string")
    names = lambda policy: sorted(r["name"] for r in C.upsert(base, new, policy).collect())
    assert names("replace") == ["A", "a", "a (2)", "n"]
    assert names("keep_both") == ["A", "A", "a (2)", "a (3)", "n"]
    assert names("abort") == ["A", "A", "a (2)", "n"]
    assert C.delete_matching(base, base.filter("pos = 1")).count() == 1


def one_by_one(base, new, policy):
    """The catalogue after each import in turn."""
    rows = list(base)
    literal = {n.lower() for n in new}
    for name in new:
        at = next((i for i, r in enumerate(rows) if r.lower() == name.lower()), None)
        if at is not None and policy == "abort":
            continue
        if at is not None and policy == "replace":
            rows.pop(at)
        if at is not None and policy == "keep_both":
            taken, i = {r.lower() for r in rows} | literal, 2
            while f"{name} ({i})".lower() in taken:
                i += 1
            name = f"{name} ({i})"
        rows.append(name)
    return sorted(rows)


@pytest.mark.parametrize("policy", ["replace", "keep_both", "abort"])
def test_import_of_repeated_names_equals_one_import_after_another(spark, policy, monkeypatch):
    monkeypatch.setattr(C, "NAME_BLOCK", 2.0)
    rng = random.Random(8)
    schema = "pos long, name string, x double, y double, z double, kind string"
    for _ in range(3):
        base = [rng.choice(["A", "a", "B", "c"]) + rng.choice(["", "", " (2)", " (3)", " (5)", " (02)", " (99999999999999999999)"]) for _ in range(rng.randrange(25))]
        new = [rng.choice(["A", "b", "C", "d", "D", "e"]) for _ in range(40)] + ["c (4)"]
        frame = lambda names: spark.createDataFrame([(i, n, 0.0, 0.0, 0.0, None) for i, n in enumerate(names)], schema)
        got = C.upsert(frame(base), frame(new).repartition(3), policy, arrival="pos").collect()
        assert sorted(r["name"] for r in got) == one_by_one(base, new, policy)


def test_text_becomes_one_fix_per_frame(spark):
    near = "Zone: Here Pos:\n 1.0000km 2.0000km 3.0000km"
    rows = [(1, 1, "a", None), (1, 2, "b", ""), (2, 1, "a", "Zone: SolarSystem_Stan\n" + near), (2, 2, "b", near.replace("1.0000", "1.5000")),
            (3, 1, "a", near), (3, 2, "b", "Root Pos: 1.0000km 2.0000km 3.0000km"), (4, 1, "a", near), (4, 2, "b", near.replace("1.0000", "900.0000"))]
    df = spark.createDataFrame(rows, "frame_id int, ord int, pass string, text string")
    glyphs = spark.createDataFrame([(4, 7.0, 8.0, 9.0), (3, None, None, None)], "frame_id int, x double, y double, z double")
    key = ["frame_id"]
    plain = {r["frame_id"]: (r["x"], r["ooc"], r["location"], r["decided"]) for r in X.text_to_fix(df, key).collect()}
    assert plain == {1: (None, None, "Unknown", "best"), 2: (1.25, "Zone: Here", "Stanton", "consensus"), 3: (1.0, "Zone: Here", "Unknown", "best"),
                     4: (1.0, "Zone: Here", "Unknown", "best")}
    helped = {r["frame_id"]: (r["x"], r["decided"]) for r in X.text_to_fix(df, key, glyphs).collect()}
    assert helped == {1: (None, "best"), 2: (1.25, "consensus"), 3: (1.0, "best"), 4: (7.0, "consensus")}
    assert X.text_to_fix(df.limit(0), key, glyphs.limit(0)).count() == 0
    # Votes are stored: nothing that reads them parses a text again.
    assert "RLIKE" in X.read_passes(df, key, glyphs)._jdf.queryExecution().toString()
    assert "RLIKE" not in X.text_to_fix(df, key, glyphs)._jdf.queryExecution().toString()


def test_five_thousand_classes_are_scored_in_blocks(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(5000, 16))
    df = spark.createDataFrame([(i, f"c{i:04d}", v.tolist()) for i, v in enumerate(vectors)], "id long, label string, v array<double>").repartition(3)
    templates = M.build_templates(df, "label", "v")
    got = {r["id"]: r for r in M.score_against(df, "v", templates, "label").collect()}
    assert len(got) == 5000 and all(r["best"] == r["label"] and abs(r["score"] - 1) < 1e-9 for r in got.values())
    few = M.score_against(df.filter("id < 5"), "v", templates.filter("label < 'c0003'"), "label", (4, 4), 1, 1, block_classes=1).collect()
    one = M.score_against(df.filter("id < 5"), "v", templates.filter("label < 'c0003'"), "label", (4, 4), 1, 1).collect()
    assert sorted((r["id"], r["best"], round(r["score"], 9)) for r in few) == sorted((r["id"], r["best"], round(r["score"], 9)) for r in one) and len(one) == 5
    assert [(r["best"], r["score"]) for r in M.score_against(df.limit(1), "v", templates.limit(0), "label").collect()] == [(None, None)]


def test_parameter_limits(spark):
    rows = [("sigma_a", "0", 0.001), ("sigma_a", "junk", 1.0), ("gate_nis", "1e9", 1e5), ("arrival_radius_m", "1e9", 1e9), ("coast_s", None, 2.0)]
    df = spark.createDataFrame(rows, "n string, v string, want double")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", C.clamp_parameter(F.col("n"), F.col("v"))).collect())


def test_splits_are_disjoint_whole_and_exact(spark):
    df = spark.range(1000).select("id", (F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 7)).alias("label"))
    s = U.shuffle_split(df, F.col("id").cast("string"), "id", 0.1)
    assert s.count() == 1000 and s.filter("split = 'val'").count() == 100
    strat = U.stratified_split(df.union(spark.createDataFrame([(5000, 99)], df.schema)), "label", F.col("id").cast("string"), "id", 0.2)
    got = {(r["label"], r["split"]): r["n"] for r in strat.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    sizes = Counter(r["label"] for r in df.collect())
    assert all(got[label, "val"] == max(1, int(n * 0.2)) for label, n in sizes.items()) and (99, "val") not in got


def test_random_walk_sampling_matches_its_definition(spark):
    df = spark.range(0, 4000).select((F.col("id") % 2).alias("src"), (F.col("id") / 2).cast("bigint").alias("frame"))
    got = U.random_gap_sample(df, "src", "frame", seed=3, block_frames=100)
    for src in (0, 1):
        frames = sorted(r["frame"] for r in got.filter(F.col("src") == src).collect())
        gaps = np.diff(frames)
        assert frames[0] == 0 and gaps.min() >= 1 and gaps.max() <= 15 and 6.5 < gaps.mean() < 9.5
        assert frames[-1] > 2000 - 16


def test_weighted_resampling_shares(spark):
    df = spark.range(20000).select("id", (F.col("id") % 4 == 0).alias("real"))
    out = U.weighted_resample(df, F.when(F.col("real"), 3.0).otherwise(1.0), F.col("id"), seed=1)
    n, real = out.count(), out.filter("real").count()
    assert n == 20000 and abs(real / n - 0.5) < 0.02 and out.select("id").distinct().count() < n
    again = U.weighted_resample(df.repartition(7), F.when(F.col("real"), 3.0).otherwise(1.0), F.col("id"), seed=1)
    assert sorted(again.collect()) == sorted(out.collect())


def test_a_row_that_outweighs_all_others_is_drawn_as_often(spark):
    df = spark.range(2000)
    out = U.weighted_resample(df, F.when(F.col("id") == 7, 1e6).otherwise(1.0), F.col("id"), seed=3)
    assert out.count() == 2000 and out.filter("id <> 7").count() < 30
    none = U.weighted_resample(df, F.when(F.col("id") < 3, F.col("id")), F.col("id"), seed=3)
    assert none.count() == 2000 and {r["id"] for r in none.distinct().collect()} == {1, 2}
    assert U.weighted_resample(df.filter("id < 0"), F.lit(1.0), F.col("id"), seed=3).count() == 0


def test_stride_cap_labels_and_stems(spark):
    df = spark.range(1000).select(F.lit("s").alias("src"), F.col("id").alias("frame"))
    kept = sorted(r["frame"] for r in U.stride_sample(df, "src", "frame", 15, 20, bucket_frames=64).collect())
    assert kept == [15 * i for i in range(20)]
    lines = spark.createDataFrame([("a\tb\tc",), ("no tab",), ("x\t  ",), ('q\t"quoted"',)], "value string")
    assert sorted(map(tuple, U.parse_labels(lines).collect())) == [("a", "b\tc"), ("q", '"quoted"')]


def test_first_seen_keeps_the_earliest_of_many_copies(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("h"), (1000 - F.col("id")).alias("o"))
    got = {r["h"]: r["o"] for r in U.first_seen(df, ["h"], ["o"]).collect()}
    assert len(got) == 667 and got["hot"] == 1


def brute_otsu(values):
    hist = np.bincount(values, minlength=256).astype(float)
    best, cut = 0.0, 0
    for t in range(256):
        wb, wf = hist[:t + 1].sum(), hist[t + 1:].sum()
        if wb == 0 or wf == 0:
            continue
        gap = (hist[:t + 1] * np.arange(t + 1)).sum() / wb - (hist[t + 1:] * np.arange(t + 1, 256)).sum() / wf
        if wb * wf * gap * gap > best * (1 + 1e-12):
            best, cut = wb * wf * gap * gap, t
    return cut


def test_otsu_bands_and_boxes(spark):
    rng = np.random.default_rng(1)
    groups = {0: rng.integers(0, 256, 500), 1: np.r_[np.full(300, 40), np.full(50, 220)], 2: np.full(20, 7)}
    df = spark.createDataFrame([(g, int(v)) for g, vs in groups.items() for v in vs], "g int, v bigint")
    got = {r["g"]: r["threshold"] for r in P.otsu_thresholds(df, ["g"]).collect()}
    assert got == {g: brute_otsu(vs) for g, vs in groups.items()}
    lit = [*range(3, 12), *range(20, 24), *range(30, 40), *range(44, 50)]
    rows = spark.createDataFrame([(1, y, 1.0 if y in lit else 0.0) for y in range(50)], "frame_id int, y int, density double")
    bands = P.text_bands(rows, ["frame_id"], F.col("density") > P.BAND_DENSITY)
    assert [(r["y0"], r["y1"]) for r in bands.orderBy("band").collect()] == [(3, 12), (30, 40), (44, 50)]
    third = P.nth_band(bands, ["frame_id"], 3, 50).first()
    assert (third["top"], third["bottom"]) == (42, 50)
    assert P.nth_band(bands, ["frame_id"], 4, 50).count() == 0
    boxes = spark.createDataFrame([(1, 0, 10, 0, 5, 5), (2, 0, 11, 1, 2, 9), (3, 0, 16, 0, 4, 5), (4, 0, 22, 0, 4, 5)], "id int, row_idx int, x int, y int, w int, h int")
    merged = [(r["x"], r["y"], r["w"], r["h"]) for r in P.merge_boxes(boxes, ["row_idx"]).orderBy("x").collect()]
    assert merged == [(10, 0, 10, 10), (22, 0, 4, 5)]
    glyphs = boxes.withColumn("glyph", F.when(F.col("id") != 2, F.col("id").cast("string")))
    assert P.row_text(glyphs, ["row_idx"], gap=1, tile_px=8).first()["text"] == "1? 3 4"


def test_text_rows_are_merged_in_as_many_tasks_as_asked_for(spark):
    boxes = spark.range(3000).selectExpr("id % 70 as row_idx", "cast(id * 13 % 120 as int) as x", "cast(id % 7 as int) as y", "cast(id % 3 + 1 as int) as w", "cast(4 as int) as h")
    dealt = P.merge_boxes(boxes, ["row_idx"], tasks=23)
    assert dealt.rdd.getNumPartitions() == 23
    assert sorted(dealt.collect()) == sorted(P.merge_boxes(boxes, ["row_idx"]).collect())


def test_templates_shift_reject_and_fallback(spark):
    rng = np.random.default_rng(3)
    base = rng.random((3, 24))
    rows = [(i, f"c{i % 3}", [float(v) for v in base[i % 3] + rng.normal(0, 0.01, 24)]) for i in range(30)]
    df = spark.createDataFrame(rows, "i int, label string, v array<float>")
    tpl = M.build_templates(df, "label", "v")
    rolled = [(i, label, [float(x) for x in np.roll(np.array(v).reshape(4, 6), (1, -2), (0, 1)).ravel()]) for i, label, v in rows]
    moved = spark.createDataFrame(rolled, df.schema)
    scored = M.score_against(moved, "v", tpl, "label", (4, 6), M.SHIFT_X, M.SHIFT_Y)
    assert scored.filter("best <> label or score < 0.95").count() == 0
    flat = spark.createDataFrame([(0, "x", [1.0] * 24)], df.schema)
    assert M.score_against(flat, "v", tpl, "label").first()["score"] == 0.0
    bad = M.accept_class(F.lit("7"), F.lit(0.5), width=F.lit(6), height=F.lit(8), has_dot=False)
    assert tuple(spark.range(1).select(bad.alias("k")).first()["k"]) == (".", 0.99)

    def broken(batches):
        raise RuntimeError("model missing")
        yield

    def plain(batches):
        for pdf in batches:
            yield pdf[["i"]].assign(char="?", score=0.0)

    assert M.classify_with(df, broken, ["i"], fallback=plain).count() == 30


def test_manifest_rules(spark):
    m = lambda rows: spark.createDataFrame(rows, "path string, digest string")
    d = "0" * 64
    bad = m([("a/b.txt", d), ("A/B.txt", d), ("ok.txt", d), ("../x", d), ("con.log", d), ("logs/x", d), ("x/.env.local", d), ("y.txt", "12"), ("trail. /x", d)])
    got = {r["path"]: r["problem"] for r in N.manifest_problems(bad).collect()}
    assert got == {"a/b.txt": "duplicate", "A/B.txt": "duplicate", "../x": "unsafe", "con.log": "reserved", "logs/x": "user_data",
                   "x/.env.local": "user_data", "y.txt": "digest", "trail. /x": "unsafe"}
    delta = N.manifest_delta(m([("a", "1"), ("b", "1"), ("c", "1")]), m([("A", "1"), ("b", "2"), ("d", "1")]))
    assert {(r["path"], r["change"]) for r in delta.collect()} == {("b", "changed"), ("c", "deleted"), ("d", "changed")}
    with pytest.raises(ValueError):
        N.require_changes(N.manifest_delta(m([("a", "1")]), m([("A", "1")])))
    versions = spark.createDataFrame([(f"p{v}", v) for v in ("1.2.0", "1.10.0", "v1.9.9", "0.1.0", "bad", "2.0.0")], "name string, version string")
    keep = spark.createDataFrame([("p0.1.0",)], "name string")
    assert {r["name"] for r in N.prunable(versions, 2, keep).collect()} == {"p1.2.0", "pv1.9.9"}


def test_sources_with_a_long_common_beginning_are_resumed_apart(spark):
    start = "s" * 40
    sources = spark.createDataFrame([(f"{start}a",), (f"{start}b",)], "src string")
    journal = spark.createDataFrame([(f"x/{start}a_000001_row0.png",)], "relpath string")
    assert [r.src for r in U.resume(sources, journal, "src").collect()] == [f"{start}b"]


def test_all_white_space_is_trimmed(spark):
    lines = spark.createDataFrame([("a.png\t\r",), ("b.png\t Pos 1\r",), ("c.png\t x\t",)], "value string")
    assert sorted(tuple(r) for r in U.parse_labels(lines).collect()) == [("b.png", "Pos 1"), ("c.png", "x")]


def test_search_finds_coordinates_as_plain_numbers(spark):
    rows = [("a", 0.0005, 1e7, 3.0, ""), ("b", 12.5, 0.0, -1e30, "")]
    df = spark.createDataFrame(rows, "name string, x double, y double, z double, category string")
    found = lambda needle: [r.name for r in C.search(df, needle).collect()]
    assert found("0.0005") == found("10000000.0") == ["a"] and found("12.5") == ["b"] and found("e-4") == []
