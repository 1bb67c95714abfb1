"""Distances, bearings and display text with hand-computed values."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from wayline.functions import display as D
from wayline.functions import geometry as G
from wayline.functions import zones as Z
from wayline.plans import geometry_queries


def one(spark, column):
    return spark.range(1).select(column.alias("o")).first()["o"]


def at(*xyz):
    return G.Vec(*[F.lit(float(c)) for c in xyz])


def sphere(lon, lat=0.0, r=300.0):
    a, b = math.radians(lon), math.radians(lat)
    return at(r * math.cos(b) * math.sin(a), r * math.cos(b) * math.cos(a), r * math.sin(b))


@pytest.mark.parametrize("deg,want", [(181, -179), (-181, 179), (360, 0), (180, -180), (-180, -180), (540, -180)])
def test_angles_wrap(spark, deg, want):
    assert one(spark, G.normalize_angle(F.lit(float(deg)))) == want


def test_angular_average_wraps(spark):
    assert abs(one(spark, G.ema_angle(F.lit(170.0), F.lit(-170.0), 0.5))) == 180
    assert one(spark, G.ema_angle(F.lit(170.0), F.lit(-170.0), 0.1)) == pytest.approx(172)


def test_great_circle(spark):
    s = F.lit("surface")
    assert one(spark, G.great_circle_distance(sphere(0), sphere(120))) == pytest.approx(300 * 2 * math.pi / 3)
    assert one(spark, G.great_circle_distance(sphere(0), sphere(180))) == pytest.approx(300 * math.pi)
    assert one(spark, G.great_circle_distance(sphere(0), sphere(0))) == pytest.approx(0, abs=1e-9)
    assert one(spark, G.guided_distance(at(0, 0, 0), at(3, 4, 100), s)) == 5.0
    assert one(spark, G.guided_distance(at(0, 0, 0), at(3, 4, 100), F.lit("space"))) == pytest.approx(math.sqrt(10025))
    assert one(spark, G.great_circle_bearing(at(0, 0, 0), at(0, 0, 0))) == 0.0


def test_bearings(spark):
    b = one(spark, G.absolute_bearing(at(0, 0, 0), at(0, 0, 5), F.lit("space")))
    assert (b["yaw_deg"], b["pitch_deg"]) == (0.0, 90.0)
    still = at(0, 0, 0)
    assert one(spark, G.velocity_bearing(still, at(0, 0, 0), at(1, 1, 1), F.lit("space"))) is None
    fwd = at(0, 1, 0)
    cases = [((-10, 0, 0), 90), ((10, 0, 0), -90), ((0, -10, 0), -180), ((0, 10, 0), 0)]
    for target, yaw in cases:
        assert one(spark, G.velocity_bearing(fwd, at(0, 0, 0), at(*target), F.lit("space")))["yaw_off"] == pytest.approx(yaw)
    assert tuple(one(spark, G.velocity_bearing(fwd, at(1, 1, 1), at(1, 1, 1), F.lit("space")))) == (0.0, 0.0)


def test_straight_back_keeps_the_sign_of_zero(spark):
    """As in ``math.atan2``: -180 for a difference of zero, 180 for a negative zero."""
    for dx in (0.0, -0.0):
        want = math.degrees(math.atan2(-dx, -5.0))
        assert one(spark, G.heading(F.lit(dx), F.lit(-5.0))) == want
    assert one(spark, G.flat_heading(at(1, 7, 0), at(1, 2, 0))) == -180.0
    assert one(spark, G.great_circle_bearing(at(0, 0, 300), at(0, -300, 0))) == -180.0
    assert one(spark, G.absolute_bearing(at(1, 7, 0), at(1, 2, 3), F.lit("space")))["yaw_deg"] == -180.0


def test_straight_ahead_keeps_the_sign_of_zero(spark):
    """As in ``math.atan2``: -0 for a difference of zero, which the text shows."""
    rows = spark.createDataFrame([(0.0, 5.0), (-0.0, 5.0)], "dx double, dy double")
    got = [r["h"] for r in rows.select(G.heading(F.col("dx"), F.col("dy")).alias("h")).collect()]
    assert [math.copysign(1, h) for h in got] == [-1, 1] and got == [0, 0]
    ahead = spark.createDataFrame([(1.0, 2.0, 0.0, 1.0, 7.0, 0.0)], "px double, py double, pz double, tx double, ty double, tz double")
    text = D.format_axis_delta(G.great_circle_bearing(G.vec("p"), G.vec("t")) * 7.0)
    assert ahead.select(text.alias("o")).first()["o"] == f"{math.degrees(math.atan2(-0.0, 5.0)) * 7:+.1f}" == "-0.0"
    assert [one(spark, D.fixed(F.lit(v), 0, signed=True)) for v in (0.0, -0.0, -0.2)] == ["+0", "-0", "-0"]


def test_numbers_as_text(spark):
    axis = [(5.4, "+5.4"), (50.0, "+50"), (1500.0, "+1.5k"), (-0.02, "-0.0"), (-2.5, "-2.5"), (12.5, "+12"), (13.5, "+14")]
    for km, want in axis:
        assert one(spark, D.format_axis_delta(F.lit(km))) == want == (f"{km:+.1f}" if abs(km) < 10 else f"{km:+.0f}" if abs(km) < 1000 else f"{km / 1000:+.1f}k")
    assert one(spark, D.format_axis_delta(F.lit(None).cast("double"))) == "?"
    for d, values in ((3, (-0.0005, 0.0005, 0.00049, 0.0015, -2.0005)), (1, (0.05, -0.05, 0.049, 0.15)), (0, (0.5, 0.51, 1.5, -0.4))):
        assert [one(spark, D.fixed(F.lit(v), d)) for v in values] == [f"{v:.{d}f}" for v in values]
    for km in (0.0005, 0.0025, 0.9996, 1.005, 2.675, 12345.678):
        want = f"{km * 1000:.0f} m" if km < 1 else f"{km:.2f} km"
        assert one(spark, D.format_distance(F.lit(km))) == want
    assert one(spark, D.format_distance(F.lit(None).cast("double"))) == "---"


def test_arrows(spark):
    none = F.lit(None).cast("double")
    assert one(spark, D.velocity_arrow(F.lit(40.0), F.lit(-25.0))) == "→40° ▼25°"
    assert one(spark, D.velocity_arrow(F.lit(170.0), none)) == "↓"
    assert one(spark, D.world_arrow(F.lit(0.0), F.lit(30.0))) == "↑▲30°"
    assert one(spark, D.world_arrow(F.lit(-45.0), F.lit(5.0))) == "↖"


def test_an_arrow_without_motion_is_what_the_sql_says(spark):
    row = dict(px=0.0, py=0.0, pz=0.0, tx=3.0, ty=4.0, tz=0.0, vx=0.0, vy=0.0, vz=0.0, kind="space", deg=0.0, ord=1, age=1.0)
    df = spark.createDataFrame([row, {**row, "vy": 1.0}])
    got = df.select("vy", geometry_queries._columns()["f16_velocity_arrow"]["txt"].alias("t")).collect()
    want = duckdb.sql(f"select {geometry_queries._SQL['f16_velocity_arrow']['txt']} from (select {', '.join(f'{v!r}::double as {k}' for k, v in row.items() if isinstance(v, float))}, 'space' as kind)")
    assert {r["vy"]: r["t"] for r in got} == {0.0: want.fetchall()[0][0], 1.0: "←37°"}


def test_colour_ramps_treat_missing_ages_differently(spark):
    age = F.lit(None).cast("double")
    assert one(spark, D.colour_ramp(age, D.PLAIN_STOPS, False)) == "#40ff40"
    assert one(spark, D.colour_ramp(age, D.PANEL_STOPS, True)) == "#E5484D"
    assert one(spark, D.colour_ramp(F.lit(1.5), D.PLAIN_STOPS, False)) == "#9ff640"


def test_zone_matching(spark):
    pairs = [("Zone:OOC_Stanton_3_ArcCorp", "ArcCorp"), ("OOC_Stanton1_Hurston", "OOC Stanton1-Hurston"), ("0OC_Stanton1", "OOC_Stanton1"),
             ("abc", "xabcx"), ("Hurston", "Microtech"), (None, "a"), ("", "a")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r["zones_match"] for r in Z.with_zone_match(df, "a", "b").orderBy("i").collect()]
    assert got == [True, True, True, False, False, False, False]
    assert got == [Z.zones_match_local(a, b) for a, b in pairs]


def test_label_priority(spark):
    base = dict(unavailable=F.lit(False), has_target=F.lit(True), in_zone=F.lit(True), name=F.lit("P"), target_zone=F.lit("A_1"),
                zone=F.lit("B_2"), distance_km=F.lit(5.0), yaw_off=F.lit(40.0), pitch_off=F.lit(-25.0), confident=F.lit(True),
                kind=F.lit("space"), world_yaw=F.lit(0.0), world_pitch=F.lit(0.0), coast_age=F.lit(0.0), integrity=F.lit("FRESH"))
    say = lambda **kw: one(spark, D.guidance_label(**{**base, **kw}))
    assert say() == "▶ P\n  5.00 km  →40° ▼25°"
    assert say(kind=F.lit("surface")) == "▶ P\n  5.00 km  →40°"
    assert say(confident=F.lit(False)) == "▶ P\n  5.00 km  ↑"
    assert say(distance_km=F.lit(0.3)) == "▶ P\n  300 m  ●"
    assert say(coast_age=F.lit(0.5), integrity=F.lit("COASTING")) == "▶ P\n  5.00 km  →40° ▼25°  DR"
    assert say(coast_age=F.lit(5.0), integrity=F.lit("LOST")).endswith("  LOST")
    assert say(distance_km=F.lit(None).cast("double")) == "▶ P\n  ---"
    assert say(in_zone=F.lit(False)) == "▶ P\n  zone: A 1\n  current: B 2"
    assert say(has_target=F.lit(False)) == "NO TARGET"
    assert say(unavailable=F.lit(True)).startswith("CAPTURE UNAVAILABLE")
