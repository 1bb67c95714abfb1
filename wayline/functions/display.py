"""Text shown to the pilot: distances, arrows, colours, guidance labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sector glyphs clockwise from straight ahead, and the vertical
# dead band in degrees.
ARROWS = ["↑", "↗", "→", "↘", "↓", "↙", "←", "↖"]
PITCH_DEADBAND_DEG = 10.0

# Age in seconds and colour at that age.
PLAIN_STOPS = [(0.0, "#40ff40"), (3.0, "#ffee40"), (7.0, "#ffaa00"), (12.0, "#ff4040")]
PANEL_STOPS = [(0.0, "#6FE8FF"), (3.0, "#D9A368"), (7.0, "#FF7A45"), (12.0, "#E5484D")]
FRESHNESS = ["LIVE", "AGING", "STALE", "LOST"]


def fixed(value: Column, digits: int, signed: bool = False) -> Column:
    """Decimal text of the exact binary value, ties to even, with an optional plus sign.

    ``format_number`` rounds that way (``format_string`` rounds the shortest
    decimal form, ties away from zero); its thousands separators are removed.
    Values below the last shown digit are settled here, because it drops those
    just above the tie. A negative zero keeps its sign.
    """
    unit = 10.0 ** -digits
    tie = F.lit(float(f"5e-{digits + 1}"))
    size = F.abs(value)
    shown = F.when(size > tie if digits == 0 else size >= tie, f"{unit:.{digits}f}").otherwise(f"{0:.{digits}f}")
    minus = (value < 0) | ((value == 0) & (value.cast("string") == "-0.0"))
    plus = "+" if signed else ""
    tiny = F.concat(F.when(minus, "-").otherwise(plus), shown)
    text = F.translate(F.format_number(value, digits), ",", "")
    return F.when(size < unit, tiny).otherwise(F.concat(F.when(value > 0, plus).otherwise(""), text) if signed else text)


def format_distance(km: Column) -> Column:
    metres = F.concat(fixed(km * 1000.0, 0), F.lit(" m"))
    far = F.concat(fixed(km, 2), F.lit(" km"))
    return F.when(km.isNull(), F.lit("---")).when(km < 1.0, metres).otherwise(far)


def format_axis_delta(km: Column) -> Column:
    size = F.abs(km)
    return (F.when(km.isNull(), F.lit("?"))
            .when(size < 10, fixed(km, 1, signed=True))
            .when(size < 1000, fixed(km, 0, signed=True))
            .otherwise(F.concat(fixed(km / 1000.0, 1, signed=True), F.lit("k"))))


def pitch_indicator(deg: Column) -> Column:
    amount = F.concat(fixed(F.abs(deg), 0), F.lit("°"))
    return (F.when(deg.isNull() | (F.abs(deg) < PITCH_DEADBAND_DEG), F.lit(""))
            .when(deg > 0, F.concat(F.lit("▲"), amount))
            .otherwise(F.concat(F.lit("▼"), amount)))


def world_arrow(yaw: Column, pitch: Column) -> Column:
    turned = F.pmod(yaw + 360.0, F.lit(360.0))
    sector = F.floor((turned + 22.5) / 45.0).cast("int") % 8
    glyph = F.element_at(F.array(*[F.lit(a) for a in ARROWS]), sector + 1)
    return F.when(yaw.isNull(), F.lit("")).otherwise(F.concat(glyph, pitch_indicator(pitch)))


def velocity_arrow(yaw_off: Column, pitch_off: Column) -> Column:
    size = F.abs(yaw_off)
    amount = F.concat(fixed(size, 0), F.lit("°"))
    turn = (F.when(size < 20.0, F.lit("↑")).when(size > 150.0, F.lit("↓"))
            .when(yaw_off > 0, F.concat(F.lit("→"), amount))
            .otherwise(F.concat(F.lit("←"), amount)))
    vertical = pitch_indicator(pitch_off)
    return F.when(vertical == "", turn).otherwise(F.concat(turn, F.lit(" "), vertical))


def freshness_level(age: Column) -> Column:
    return (F.when(age.isNull(), F.lit(3)).when(age < 3.0, F.lit(0)).when(age < 7.0, F.lit(1))
            .when(age < 12.0, F.lit(2)).otherwise(F.lit(3)))


def _channels(colour: str) -> tuple[int, int, int]:
    return tuple(int(colour[i:i + 2], 16) for i in (1, 3, 5))


def colour_ramp(age: Column, stops: list[tuple[float, str]], null_is_old: bool) -> Column:
    """Piecewise linear RGB over ``stops``, channels truncated to whole numbers.

    Ages at or outside the ends take the end colour as written.
    """
    missing = stops[-1][1] if null_is_old else stops[0][1]
    out = (F.when(age.isNull(), F.lit(missing)).when(age >= stops[-1][0], F.lit(stops[-1][1]))
           .when(age <= stops[0][0], F.lit(stops[0][1])))
    for (t0, c0), (t1, c1) in zip(stops, stops[1:]):
        share = (age - t0) / (t1 - t0)
        parts = [F.lpad(F.lower(F.hex((F.lit(a) + share * (b - a)).cast("int"))), 2, "0")
                 for a, b in zip(_channels(c0), _channels(c1))]
        out = out.when(age <= t1, F.concat(F.lit("#"), *parts))
    return out


def display_zone(zone: Column) -> Column:
    text = F.trim(F.translate(zone, "_", " "))
    return F.when(zone.isNull() | (zone == ""), F.lit("?")).otherwise(text)


# Fixed value: no target shown nearer than this (m) gets a direction arrow.
ARRIVAL_RADIUS_M = 400.0


def guidance_label(*, unavailable: Column, has_target: Column, in_zone: Column, name: Column,
                   target_zone: Column, zone: Column, distance_km: Column, yaw_off: Column,
                   pitch_off: Column, confident: Column, kind: Column, world_yaw: Column,
                   world_pitch: Column, coast_age: Column, integrity: Column,
                   arrival_radius_m: float = ARRIVAL_RADIUS_M) -> Column:
    """The first policy that applies: source lost, no target, wrong zone, no
    distance, otherwise distance with arrival mark or arrow and staleness tag."""
    title = F.concat(F.lit("▶ "), name)
    elsewhere = F.concat(title, F.lit("\n  zone: "), display_zone(target_zone),
                         F.lit("\n  current: "), display_zone(zone))
    vertical = F.when(F.coalesce(kind == "surface", F.lit(False)), F.lit(None).cast("double")
                      ).otherwise(pitch_off)
    world = world_arrow(world_yaw, world_pitch)
    arrow = (F.when(distance_km * 1000.0 < arrival_radius_m, F.lit("  ●"))
             .when(yaw_off.isNotNull() & confident,
                   F.concat(F.lit("  "), velocity_arrow(yaw_off, vertical)))
             .when(world != "", F.concat(F.lit("  "), world)).otherwise(F.lit("")))
    tag = F.when(coast_age > 0.05, F.when(integrity == "COASTING", F.lit("  DR"))
                 .otherwise(F.lit("  LOST"))).otherwise(F.lit(""))
    return (F.when(unavailable, F.lit("CAPTURE UNAVAILABLE\nSelect a connected monitor in Options."))
            .when(~has_target, F.lit("NO TARGET"))
            .when(~in_zone, elsewhere)
            .when(distance_km.isNull(), F.concat(title, F.lit("\n  ---")))
            .otherwise(F.concat(title, F.lit("\n  "), format_distance(distance_km), arrow, tag)))
