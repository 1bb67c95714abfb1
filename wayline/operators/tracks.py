"""Windowed operators over session tracks.

Every running value goes through the blocked scan, so no operator here puts a
whole session into one task. Default order inside a session: ``t_capture, seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators.ordered import (Carry, Walk, earlier_known, last_known, overlapped, previous, row_index,
                                       running_sum)

KEYS = ("sid",)
ORDER = ("t_capture", "seq")

# Width of a time block in seconds; at five reads a second it holds 18 000 rows.
BLOCK_S = 3600.0

# Fixed values of the plausibility gate (km, km/s, s).
MIRROR_GAP_KM = 5.0
AXIS_JUMP_KM = 4.0
AXIS_SPEED_KM_S = 10.0
SPEED_KM_S = 15.0
GATE_HORIZON_S = 5.0

# Moving hysteresis (km/s), heading swing (deg) and recovery (s),
# zone grace (s), snapshot age (s), tracker reset gap (s), counter period.
ENTER_KM_S, EXIT_KM_S = 0.05, 0.03
FLIP_DEG, RECOVER_S = 60.0, 1.5
GRACE_S = 180.0
SNAPSHOT_AGE_S = 9.0
GAP_S = 3.0
REPORT_EVERY = 50
MEDIAN_READS = 7


def walk(df: DataFrame, block_s: float, keys=KEYS, order=ORDER) -> Walk:
    """One exchange of a track by session and time block."""
    return Walk.along(df, keys, order, block_s)


def last_fix(cols: list[str]) -> Carry:
    """The last known fix; all columns come from one row."""
    return last_known(F.when(F.col(cols[0]).isNotNull(), F.struct(*cols)))


def forward_fill(df: DataFrame, cols: list[str], block_s: float = BLOCK_S) -> DataFrame:
    """Carry the last known fix through dropouts; all columns come from one row."""
    filled = walk(df, block_s).add(_fix=last_fix(cols))
    return filled.select(*df.columns, *[F.col(f"_fix.{c}").alias(f"{c}_last") for c in cols])


def read_age(df: DataFrame, ok: Column, block_s: float = BLOCK_S) -> DataFrame:
    seen = walk(df, block_s).add(_seen=last_known(F.when(ok, F.col("t_capture"))))
    return seen.select(*df.columns, (F.col("t_capture") - F.col("_seen")).alias("coord_age_s"))


def _segmented(df: DataFrame, block_s: float, same=None) -> Walk:
    seen = walk(df, block_s).add(_before=earlier_known(F.col("ooc")))
    if same is None:
        marked = seen.rows.withColumn("_same", F.col("ooc") == F.col("_before"))
    else:
        marked = same(seen.rows, "ooc", "_before", "_same")
    turn = (F.col("ooc").isNotNull() & F.col("_before").isNotNull() & ~F.col("_same")).cast("bigint")
    return seen.change(marked.withColumn("_turn", turn))


def zone_segments(df: DataFrame, block_s: float = BLOCK_S, same=None) -> DataFrame:
    """Number the stretches of one zone. A missing zone never starts a new stretch.

    ``same(df, read, reference, flag)`` decides equality; the default is exact.
    """
    return _segmented(df, block_s, same).add(segment=running_sum(F.col("_turn"))).select(*df.columns, "segment")


def rolling_median(df: DataFrame, cols: list[str], reads: int = MEDIAN_READS,
                   block_s: float = BLOCK_S, rows_per_span: int = 16384) -> DataFrame:
    """Upper median of the last ``reads`` rows of the current zone stretch.

    Input rows are accepted reads. The frame is bounded, so spans of a stretch
    only need the last few rows of the span before.
    """
    staged = _segmented(df, block_s).add(segment=running_sum(F.col("_turn")), _i=row_index())
    spans = overlapped(staged.rows, F.col("_i"), reads - 1, rows_per_span)
    recent = (Window.partitionBy("sid", "segment", "_span").orderBy("_i")
              .rowsBetween(-(reads - 1), Window.currentRow))

    def middle(c: str) -> Column:
        values = F.sort_array(F.collect_list(c).over(recent))
        return F.get(values, F.floor(F.size(values) / 2).cast("int"))

    return (spans.select("*", *[middle(c).alias(f"{c}_med") for c in cols])
            .filter(~F.col("_guest"))
            .select(*df.columns, "segment", *[f"{c}_med" for c in cols]))


def gate_reason(new: list[Column], old: list[Column], dt: Column, same_zone: Column) -> Column:
    """First plausibility rule a jump breaks, or null."""
    def each(rule) -> Column:
        out = None
        for a, b in zip(old, new):
            out = rule(a, b) if out is None else out | rule(a, b)
        return out

    flip = each(lambda a, b: (a * b < 0) & (F.abs(F.abs(a) - F.abs(b)) < MIRROR_GAP_KM))
    jump = each(lambda a, b: F.abs(b - a) > AXIS_JUMP_KM)
    fast = each(lambda a, b: F.try_divide(F.abs(b - a), dt) > AXIS_SPEED_KM_S)
    d = [b - a for a, b in zip(old, new)]
    far = F.try_divide(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]), dt) > SPEED_KM_S
    checked = same_zone & (dt > 0) & (dt <= GATE_HORIZON_S)
    return F.when(checked, F.when(flip, "sign_flip").when(jump, "axis_jump")
                  .when(fast, "axis_speed").when(far, "speed"))


def lag_gate(df: DataFrame, block_s: float = BLOCK_S) -> DataFrame:
    """Stateless gate: every fix against the fix before it, accepted or not."""
    seen = walk(df.filter(F.col("x").isNotNull()), block_s).add(_p=previous(F.struct("x", "y", "z", "ooc", "t_capture")))
    p = F.col("_p")
    same = ~((F.col("ooc") != "") & (p["ooc"] != "") & (F.col("ooc") != p["ooc"]))
    reason = gate_reason([F.col(c) for c in "xyz"], [p[c] for c in "xyz"],
                         F.col("t_capture") - p["t_capture"], F.coalesce(same, F.lit(True)))
    return seen.select(*df.columns, reason.alias("reason"))


def moving_flag(df: DataFrame, speed: str, block_s: float = BLOCK_S,
                enter: float = ENTER_KM_S, leave: float = EXIT_KM_S) -> DataFrame:
    """Hysteresis: the latest crossing of either threshold decides."""
    v = F.col(speed)
    crossing = F.when(v >= enter, F.lit(True)).when(v < leave, F.lit(False))
    return walk(df, block_s).add(moving=last_known(crossing)).select(*df.columns, F.coalesce("moving", F.lit(False)).alias("moving"))


def heading_confidence(df: DataFrame, heading: str, block_s: float = BLOCK_S, keys=KEYS) -> DataFrame:
    """Unsteady for a while after a large swing between consecutive headings."""
    seen = walk(df, block_s, keys).add(_before=earlier_known(F.col(heading)))
    swing = F.abs(F.pmod(F.col(heading) - F.col("_before") + 180.0, F.lit(360.0)) - 180.0)
    flipped = F.when(swing > FLIP_DEG, F.col("t_capture"))
    marked = seen.add(_last=last_known(flipped))
    steady = F.coalesce(F.col("t_capture") >= F.col("_last") + RECOVER_S, F.lit(True))
    return marked.select(*df.columns, steady.alias("confident"))


def _told(ticks: DataFrame, events: DataFrame, payload: tuple[str, ...], block_s: float, **also: Carry) -> Walk:
    """Commands and ticks as one ordered stream, a command before a tick of the same time, and what holds at each row."""
    command = F.struct("action", F.col("ts").alias("t_set"), *payload)
    stream = (ticks.withColumn("_rank", F.lit(1)).withColumn("_cmd", F.lit(None).cast(
        events.select(command.alias("c")).schema["c"].dataType))
        .unionByName(events.select("sid", F.col("ts").alias("t_capture"), F.lit(0).alias("_rank"),
                                   command.alias("_cmd")), allowMissingColumns=True)
        .withColumn("seq", F.coalesce("seq", F.lit(0))))
    told = walk(stream, block_s, order=("t_capture", "_rank", "seq")).add(
        _now=last_known(F.col("_cmd")), epoch=running_sum(F.col("_cmd").isNotNull().cast("bigint")), **also)
    live = F.col("_now.action") == "set"
    return told.change(told.rows.filter(F.col("_rank") == 1).select(
        *ticks.columns, *told.ordering.blocks, "_rank", "epoch", *also,
        *[F.when(live, F.col(f"_now.{c}")).alias(c) for c in ("t_set", *payload)]))


def active_target(ticks: DataFrame, events: DataFrame, block_s: float = BLOCK_S,
                  payload: tuple[str, ...] = ("suppkey",)) -> DataFrame:
    """Backward as-of join: the command in force at each tick.

    Commands and ticks are merged into one ordered stream, a command before a
    tick of the same time. ``clear`` is itself a command, so it hides earlier
    ones. Adds ``epoch`` (number of commands so far), ``t_set`` and the payload.
    What a command's target is known by should be in the payload; joining it to
    the few commands is cheaper than to all ticks.
    """
    return _told(ticks, events, payload, block_s).select(*ticks.columns, "epoch", "t_set", *payload)


#: The error of a tick at which there was nothing to capture; such a tick changes nothing.
UNAVAILABLE = "capture_unavailable"
#: Commands of one moment in the order in which they take effect; ticks come after them.
COMMANDS = ("source", "reset", "clear", "set")


def commanded(ticks: DataFrame, commands: DataFrame, payload: tuple[str, ...], block_s: float = BLOCK_S) -> DataFrame:
    """What the commands so far have left in force at each tick, in one exchange.

    ``set``, ``clear`` and ``reset`` open a new ``epoch`` and decide the target;
    ``source`` replaces the source of captures, after which the grace of a target
    starts anew (``t_set``) and ticks that claim another ``source_epoch`` are
    dropped. ``restarts`` counts changes of source, ``resets`` these and resets.
    """
    place = F.array_position(F.array(*map(F.lit, COMMANDS)), F.col("action")).cast("int")
    command = F.struct("action", F.col("ts").alias("at"), "source_epoch", *payload)
    told = commands.select("sid", F.col("ts").alias("t_capture"), place.alias("_rank"), command.alias("_cmd"), F.lit(0).cast("bigint").alias("seq"))
    stream = (ticks.withColumn("_rank", F.lit(len(COMMANDS) + 1)).withColumn("_cmd", F.lit(None).cast(told.schema["_cmd"].dataType))
              .unionByName(told, allowMissingColumns=True))
    action = F.col("_cmd.action")
    source, target = F.coalesce(action == "source", F.lit(False)), F.coalesce(action != "source", F.lit(False))
    rows = walk(stream, block_s, order=("t_capture", "_rank", "seq")).add(
        _now=last_known(F.when(target, F.col("_cmd"))), _source=last_known(F.when(source, F.col("_cmd"))),
        epoch=running_sum(target.cast("bigint")), restarts=running_sum(source.cast("bigint")),
        resets=running_sum((source | (action == "reset")).cast("bigint"))).rows
    live = F.col("_now.action") == "set"
    current = F.coalesce("source_epoch", F.lit(0)) == F.coalesce("_source.source_epoch", F.lit(0))
    return rows.filter((F.col("_rank") > len(COMMANDS)) & current).select(
        *ticks.columns, "epoch", "restarts", F.coalesce("resets", F.lit(0)).alias("resets"),
        F.when(live, F.greatest("_now.at", "_source.at")).alias("t_set"), *[F.when(live, F.col(f"_now.{c}")).alias(c) for c in payload])


def _zone_columns(has_target: Column, target_zone: Column, grace_s: float, scope: Column | None = None) -> dict[str, Column]:
    locked = F.coalesce(F.col("_hit") == (F.col("epoch") if scope is None else scope), F.lit(False))
    waited = F.col("t_capture") - F.col("t_set")
    return {"locked": locked & has_target,
            "in_zone": F.when(~has_target, F.lit(False)).when(target_zone.isNull(), F.lit(True))
                        .otherwise(locked | (waited <= grace_s)),
            "grace_left_s": F.when(has_target & ~locked, F.greatest(F.lit(0.0), F.lit(grace_s) - waited))}


def _latest_match(match: Column, scope: Column | None = None) -> Carry:
    """The scope of the latest match: the target is confirmed from a match on until the scope changes."""
    return last_known(F.when(F.coalesce(match, F.lit(False)), F.col("epoch") if scope is None else scope))


def zone_lock(ticks: DataFrame, match: Column, has_target: Column, target_zone: Column,
              grace_s: float = GRACE_S, block_s: float = BLOCK_S, scope: Column | None = None) -> DataFrame:
    """Zone confirmation since the target was set, and the grace time left.

    Confirmed for good by the first match; before that, true while the grace
    lasts. A target without a zone is always in zone. ``scope`` (``epoch``) never
    decreases along a session; a confirmation holds while it stays the same.
    """
    latched = walk(ticks, block_s).add(_hit=_latest_match(match, scope))
    return latched.rows.withColumns(_zone_columns(has_target, target_zone, grace_s, scope)).select(
        *ticks.columns, "locked", "in_zone", "grace_left_s")


def navigated(ticks: DataFrame, events: DataFrame, payload: tuple[str, ...], match: Column, has_target: Column,
              target_zone: Column, fix: tuple[str, ...] = ("x", "y", "z"), grace_s: float = GRACE_S,
              block_s: float = BLOCK_S) -> DataFrame:
    """active_target, zone_lock and forward_fill in one exchange of the ticks.

    ``match`` and the others may use the payload.
    """
    told = _told(ticks, events, payload, block_s, _fix=last_fix(list(fix))).add(_hit=_latest_match(match))
    return told.rows.withColumns(_zone_columns(has_target, target_zone, grace_s)).select(
        *ticks.columns, "epoch", "t_set", *payload, "locked", "in_zone", "grace_left_s",
        *[F.col(f"_fix.{c}").alias(f"{c}_last") for c in fix])


def running_counters(df: DataFrame, flags: dict[str, Column], every: int = REPORT_EVERY,
                     block_s: float = BLOCK_S) -> DataFrame:
    """Cumulative counters, reported on every ``every``-th row of a session."""
    counted = walk(df, block_s).add(frames=row_index(), **{n: running_sum(c.cast("bigint")) for n, c in flags.items()})
    return counted.select(*df.columns, "frames", *flags).filter(F.col("frames") % every == 0)


def reuse_repeats(df: DataFrame, content: Column, result: Column, block_s: float = BLOCK_S) -> DataFrame:
    """A row whose content equals the row before reuses the result of the run's first row."""
    seen = walk(df.withColumn("_content", content).withColumn("_result", result), block_s).add(_before=previous(F.struct("_content")))
    fresh = ~F.coalesce(F.col("_before._content").eqNullSafe(F.col("_content"))
                        & F.col("_before").isNotNull(), F.lit(False))
    boxed = F.when(fresh, F.struct(F.col("_result").alias("v")))
    reused = seen.add(_kept=last_known(boxed))
    return reused.select(*df.columns, (~fresh).alias("reused"), F.col("_kept.v").alias("result"))


def runs_of(df: DataFrame, flag: Column, order: tuple[str, ...], block_s: float,
            longer_than: int) -> DataFrame:
    """Unbroken runs of flagged rows longer than ``longer_than``."""
    marked = df.withColumn("_flag", flag.cast("bigint"))
    told = walk(marked, block_s, order=order).add(_i=row_index(), _f=running_sum(F.col("_flag")))
    return (told.rows.filter(F.col("_flag") == 1).groupBy("sid", (F.col("_i") - F.col("_f")).alias("_run"))
            .agg(F.count(F.lit(1)).alias("length"), F.min(order[0]).alias("first"))
            .filter(F.col("length") > longer_than).drop("_run"))


def gap_segments(df: DataFrame, gap_s: float = GAP_S, block_s: float = BLOCK_S) -> DataFrame:
    """Number the stretches without a pause longer than ``gap_s``."""
    seen = walk(df, block_s).add(_before=previous(F.col("t_capture")))
    cut = F.coalesce((F.col("t_capture") - F.col("_before")) > gap_s, F.lit(False)).cast("bigint")
    return seen.add(gap_segment=running_sum(cut)).select(*df.columns, "gap_segment")


def current_source_only(ticks: DataFrame, control: Column, claimed: Column,
                        block_s: float = BLOCK_S) -> DataFrame:
    """Drop results that were captured under an earlier source than the current one."""
    told = walk(ticks, block_s).add(source_epoch=running_sum(control.cast("bigint")))
    return told.rows.filter(F.col("source_epoch") == claimed).select(*ticks.columns, "source_epoch")


def tick_status(error: Column, x: Column, reason: Column) -> list[Column]:
    """Outcome of a tick and why."""
    status = (F.when(error, "no_read").when(x.isNull(), "no_read")
              .when(reason.isNotNull(), "rejected").otherwise("ok"))
    why = (F.when(error, "ocr_error").when(x.isNull(), "no_coords")
           .when(reason.isNotNull(), "implausible_velocity"))
    return [status.alias("status"), why.alias("reason")]


def mask_guidance(df: DataFrame, target: str, cols: list[str]) -> DataFrame:
    """Guidance means nothing without a target."""
    return df.withColumns({c: F.when(F.col(target).isNotNull(), F.col(c)) for c in cols})


def snapshots_allowed(df: DataFrame, max_age_s: float = SNAPSHOT_AGE_S) -> DataFrame:
    return df.filter(F.col("x_last").isNotNull() & (F.col("coord_age_s") <= max_age_s))


def window_stability(df: DataFrame, width_s: float = 10.0) -> DataFrame:
    """Capture rate and coordinate spread per tumbling window."""
    return df.groupBy("sid", F.floor(F.col("t_capture") / width_s).alias("bucket")).agg(
        F.count(F.lit(1)).alias("ticks"), F.avg(F.col("x").isNotNull().cast("double")).alias("capture_rate"),
        *[(F.max(c) - F.min(c)).alias(f"spread_{c}") for c in "xyz"],
        F.var_samp("x").alias("var_x"))
