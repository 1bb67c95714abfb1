"""Distance, bearing and angle column expressions.

Positions are triples of columns in km, measured from the centre of the body the
zone belongs to. The horizontal frame points Y forward and has X inverted, so a
world heading is ``atan2(-dx, dy)``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: points nearer to the centre than this (km) are not body-centred
# vectors, and surface navigation falls back to the flat plane.
MIN_BODY_RADIUS_KM = 100.0


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column


def vec(prefix: str = "") -> Vec:
    return Vec(F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z"))


def magnitude(a: Vec) -> Column:
    return F.sqrt(a.x * a.x + a.y * a.y + a.z * a.z)


def is_surface(kind: Column) -> Column:
    return F.coalesce(kind == "surface", F.lit(False))


def normalize_angle(deg: Column) -> Column:
    """Wrap degrees into [-180, 180)."""
    return F.pmod(deg + 180.0, F.lit(360.0)) - 180.0


def ema_angle(prev: Column, new: Column, alpha: float) -> Column:
    """One smoothing step over angles; the first angle is taken as it is."""
    turn = normalize_angle(new - prev)
    return F.when(prev.isNull(), new).otherwise(normalize_angle(prev + turn * alpha))


def effective_dz(pos: Vec, target: Vec, kind: Column) -> Column:
    return F.when(is_surface(kind), F.lit(0.0)).otherwise(target.z - pos.z)


def body_relative(a: Vec, b: Vec) -> Column:
    return (magnitude(a) >= MIN_BODY_RADIUS_KM) & (magnitude(b) >= MIN_BODY_RADIUS_KM)


def flat_distance(a: Vec, b: Vec) -> Column:
    return F.hypot(b.x - a.x, b.y - a.y)


def turned_from_y(dx: Column, dy: Column) -> Column:
    """``atan2(-dx, dy)`` in degrees. Spark's ``atan2`` drops the sign of a zero, which tells -180 from 180 and -0 from 0."""
    back = F.when(dx.cast("string") == "-0.0", F.lit(180.0)).otherwise(F.lit(-180.0))
    return F.when((dx == 0) & (dy < 0), back).when((dx == 0) & (dy > 0), -dx).otherwise(F.degrees(F.atan2(-dx, dy)))


def heading(dx: Column, dy: Column) -> Column:
    """World heading of a horizontal vector; a zero vector heads 0."""
    return F.when((dx == 0) & (dy == 0), F.lit(0.0)).otherwise(turned_from_y(dx, dy))


def flat_heading(a: Vec, b: Vec) -> Column:
    return heading(b.x - a.x, b.y - a.y)


def great_circle_distance(a: Vec, b: Vec) -> Column:
    dot = a.x * b.x + a.y * b.y + a.z * b.z
    cross = magnitude(Vec(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x))
    arc = (magnitude(a) + magnitude(b)) / 2.0 * F.atan2(cross, dot)
    return F.when(body_relative(a, b), arc).otherwise(flat_distance(a, b))


def great_circle_bearing(a: Vec, b: Vec) -> Column:
    """Heading of the great circle leaving ``a`` towards ``b``.

    The tangent is the part of ``b`` orthogonal to ``a``. It vanishes for
    identical, colinear and antipodal points, which use the flat heading.
    """
    scale = F.try_divide(a.x * b.x + a.y * b.y + a.z * b.z, a.x * a.x + a.y * a.y + a.z * a.z)
    tx, ty = b.x - scale * a.x, b.y - scale * a.y
    usable = body_relative(a, b) & ~((tx == 0) & (ty == 0))
    return F.when(usable, turned_from_y(tx, ty)).otherwise(flat_heading(a, b))


def space_distance(a: Vec, b: Vec) -> Column:
    dx, dy, dz = b.x - a.x, b.y - a.y, b.z - a.z
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def guided_distance(pos: Vec, target: Vec, kind: Column) -> Column:
    return F.when(is_surface(kind), great_circle_distance(pos, target)).otherwise(
        space_distance(pos, target))


def target_distance(pos: Vec, target: Vec, kind: Column, in_zone: Column) -> Column:
    """Distance to the target, null outside its zone or without a position."""
    return F.when(in_zone & pos.x.isNotNull() & target.x.isNotNull(),
                  guided_distance(pos, target, kind))


def delta_vector(pos: Vec, target: Vec, kind: Column) -> Column:
    known = pos.x.isNotNull() & target.x.isNotNull()
    return F.when(known, F.struct(
        (target.x - pos.x).alias("dx"), (target.y - pos.y).alias("dy"),
        effective_dz(pos, target, kind).alias("dz")))


def pitch(horizontal: Column, dz: Column) -> Column:
    upright = F.when(dz > 0, F.lit(90.0)).when(dz < 0, F.lit(-90.0)).otherwise(F.lit(0.0))
    return F.when(horizontal == 0, upright).otherwise(F.degrees(F.atan2(dz, horizontal)))


def absolute_bearing(pos: Vec, target: Vec, kind: Column) -> Column:
    """``{dx, dy, dz, yaw_deg, pitch_deg, distance_km}`` or null."""
    dx, dy = target.x - pos.x, target.y - pos.y
    dz = effective_dz(pos, target, kind)
    ground = is_surface(kind)
    yaw = F.when(ground, great_circle_bearing(pos, target)).otherwise(heading(dx, dy))
    up = F.when(ground, F.lit(0.0)).otherwise(pitch(F.hypot(dx, dy), dz))
    known = pos.x.isNotNull() & target.x.isNotNull()
    return F.when(known, F.struct(
        dx.alias("dx"), dy.alias("dy"), dz.alias("dz"), yaw.alias("yaw_deg"),
        up.alias("pitch_deg"), guided_distance(pos, target, kind).alias("distance_km")))


def velocity_bearing(v: Vec, pos: Vec, target: Vec, kind: Column) -> Column:
    """``{yaw_off, pitch_off}``: target direction minus motion direction, or null."""
    dx, dy = target.x - pos.x, target.y - pos.y
    dz = effective_dz(pos, target, kind)
    aim = F.when(is_surface(kind), great_circle_bearing(pos, target)).otherwise(heading(dx, dy))
    yaw_off = normalize_angle(aim - heading(v.x, v.y))

    def level(horizontal: Column, vertical: Column) -> Column:
        return F.when(horizontal > 0, F.degrees(F.atan2(vertical, horizontal))).otherwise(F.lit(0.0))

    pitch_off = normalize_angle(level(F.hypot(dx, dy), dz) - level(F.hypot(v.x, v.y), v.z))
    arrived = (dx == 0) & (dy == 0) & (dz == 0)
    known = (v.x.isNotNull() & pos.x.isNotNull() & target.x.isNotNull()
             & ~((v.x == 0) & (v.y == 0) & (v.z == 0)))
    zero = F.struct(F.lit(0.0).alias("yaw_off"), F.lit(0.0).alias("pitch_off"))
    return F.when(known, F.when(arrived, zero).otherwise(
        F.struct(yaw_off.alias("yaw_off"), pitch_off.alias("pitch_off"))))


# Fixed value: slowest horizontal speed (km/s) whose direction is trusted.
MIN_SPEED_KM_S = 0.05


def trusted_offsets(moving: Column, v: Vec, offsets: Column) -> Column:
    return F.when(moving & (F.hypot(v.x, v.y) >= MIN_SPEED_KM_S), offsets)
