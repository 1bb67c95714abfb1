"""Declared schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"double": T.DoubleType(), "string": T.StringType(), "bigint": T.LongType(),
          "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _fields(text: str) -> T.StructType:
    pairs = [item.split() for item in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


TELEMETRY = _fields(
    "t_capture double, t_wall double, status string, reason string, x double, y double, z double, "
    "ooc string, location string, target string, yaw_off double, pitch_off double, dist_km double, "
    "speed_km_s double, integrity string, coord_age_s double, _corrupt string")

POI = _fields("name string, x double, y double, z double, location string, ooc string, kind string, "
              "category string, description string")

POI_READ = T.StructType([*POI.fields, T.StructField("_corrupt", T.StringType())])

# One keyed stream carries ticks and commands. ``event``: tick, set, clear, reset
# (forget motion and target) or source (capture source changed).
SESSION_INPUT = _fields(
    "sid bigint, event string, t_capture double, seq bigint, x double, y double, z double, ooc string, "
    "location string, error string, source_epoch bigint, t_name string, tx double, ty double, tz double, t_ooc string, "
    "kind string, ts timestamp")

SESSION_OUTPUT = _fields(
    "sid bigint, event string, t_capture double, seq bigint, status string, reason string, x double, y double, "
    "z double, ooc string, target string, in_zone boolean, measured boolean, px double, py double, pz double, "
    "vx double, vy double, vz double, speed_km_s double, moving boolean, coast_age_s double, integrity string, "
    "dist_km double, yaw_off double, pitch_off double, confident boolean, coord_age_s double, location string, ts timestamp")
