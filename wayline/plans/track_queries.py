"""Session-track queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.functions import display as D
from wayline.functions import geometry as G
from wayline.functions import zones as Z
from wayline.operators import tracks as K
from wayline.plans import geometry_queries as GQ
from wayline.plans import views as V
from wayline.plans.registry import dr, query, r

B = V.BLOCK_S
_O = "partition by sid order by t_capture, seq"
_FIX = "f as (select * from track where x is not null)"


def _track(spark, sf_dir):
    return V.track(spark, sf_dir)


def _fixes(spark, sf_dir):
    return _track(spark, sf_dir).filter(F.col("x").isNotNull())


_SEG = (_FIX + f", sg0 as (select *, lag(ooc) over ({_O}) as zb from f), sg as (select *, "
        f"cast(sum(case when ooc<>zb then 1 else 0 end) over ({_O} rows unbounded preceding) as bigint) as segment from sg0)")


@query("w3_forward_fill", V.duck("track", body=f"select sid, seq, {dr('last_value(x ignore nulls) over w')} as x_last, {dr('last_value(z ignore nulls) over w')} as z_last from track window w as ({_O} rows unbounded preceding)"))
def w3(spark, sf_dir):
    return (K.forward_fill(_track(spark, sf_dir), ["x", "y", "z"], B)
            .select("sid", "seq", r(F.col("x_last")).alias("x_last"), r(F.col("z_last")).alias("z_last")))


@query("w4_zone_segments", V.duck("track", body=_SEG + " select sid, seq, segment from sg"))
def w4(spark, sf_dir):
    return K.zone_segments(_fixes(spark, sf_dir), B).select("sid", "seq", "segment")


@query("w5_read_age", V.duck("track", body=f"select sid, seq, {dr('t_capture - last_value(case when x is not null then t_capture end ignore nulls) over w')} as age from track window w as ({_O} rows unbounded preceding)"))
def w5(spark, sf_dir):
    return (K.read_age(_track(spark, sf_dir), F.col("x").isNotNull(), B)
            .select("sid", "seq", r(F.col("coord_age_s")).alias("age")))


@query("p17_snapshot_admission", V.duck("track", body=f"select sid, seq from (select sid, seq, t_capture - last_value(case when x is not null then t_capture end ignore nulls) over w as age from track window w as ({_O} rows unbounded preceding)) where age <= 9"))
def p17(spark, sf_dir):
    aged = K.read_age(_track(spark, sf_dir), F.col("x").isNotNull(), B).withColumn("x_last", F.col("coord_age_s"))
    return K.snapshots_allowed(aged).select("sid", "seq")


def _med(c):
    return f"list_sort(list({c}) over w)[cast(floor(len(list({c}) over w)/2) as int)+1] as {c}_med"


@query("w1_rolling_median", V.duck("track", body=_SEG + f", md as (select sid, seq, {_med('x')}, {_med('y')}, {_med('z')} from sg window w as (partition by sid, segment order by t_capture, seq rows between 6 preceding and current row)) select sid, seq, {dr('x_med')} as x_med, {dr('y_med')} as y_med, {dr('z_med')} as z_med from md"))
def w1(spark, sf_dir):
    return (K.rolling_median(_fixes(spark, sf_dir), ["x", "y", "z"], block_s=B, rows_per_span=32)
            .select("sid", "seq", *[r(F.col(f"{c}_med")).alias(f"{c}_med") for c in "xyz"]))


_GATE_RULES = """case when not (ooc<>'' and po<>'' and ooc<>po) and dt > 0 and dt <= 5 then
 case when (px*x<0 and abs(abs(px)-abs(x))<5) or (py*y<0 and abs(abs(py)-abs(y))<5) or (pz*z<0 and abs(abs(pz)-abs(z))<5) then 'sign_flip'
 when abs(x-px)>4 or abs(y-py)>4 or abs(z-pz)>4 then 'axis_jump'
 when abs(x-px)/dt>10 or abs(y-py)/dt>10 or abs(z-pz)/dt>10 then 'axis_speed'
 when sqrt((x-px)*(x-px)+(y-py)*(y-py)+(z-pz)*(z-pz))/dt>15 then 'speed' end end"""
_LAGGED = (_FIX + f", lg as (select *, lag(x) over w as px, lag(y) over w as py, lag(z) over w as pz, lag(ooc) over w as po, t_capture - lag(t_capture) over w as dt from f window w as ({_O})),"
           f" gt as (select *, {_GATE_RULES} as reason from lg)")


@query("w2a_lag_gate", V.duck("track", body=_LAGGED + " select sid, seq, reason from gt"))
def w2a(spark, sf_dir):
    return K.lag_gate(_track(spark, sf_dir), B).select("sid", "seq", "reason")


@query("p15_tick_status", V.duck("track", body=_LAGGED + " select t.sid, t.seq, case when t.event_id%17=0 or t.x is null then 'no_read' when gt.reason is not null then 'rejected' else 'ok' end as status, case when t.event_id%17=0 then 'ocr_error' when t.x is null then 'no_coords' when gt.reason is not null then 'implausible_velocity' end as reason from track t left join gt on t.sid=gt.sid and t.seq=gt.seq"))
def p15(spark, sf_dir):
    ticks = _track(spark, sf_dir)
    gated = K.lag_gate(ticks, B).select("sid", "seq", F.col("reason").alias("why"))
    return (ticks.join(gated, ["sid", "seq"], "left")
            .select("sid", "seq", *K.tick_status(F.col("event_id") % 17 == 0, F.col("x"), F.col("why"))))


_SPEED = "((event_id*7919)%100)/cast(1000 as double)"


@query("w7_moving_hysteresis", V.duck("track", body=f"s as (select *, {_SPEED} as v from track) select sid, seq, coalesce(last_value(case when v>=0.05 then true when v<0.03 then false end ignore nulls) over ({_O} rows unbounded preceding), false) as moving from s"))
def w7(spark, sf_dir):
    return K.moving_flag(_track(spark, sf_dir).withColumn("v", F.expr(_SPEED)), "v", B).select("sid", "seq", "moving")


_HEAD = "case when x is not null then cast((event_id*53)%360-180 as double) end"


@query("w8_heading_flip", V.duck("track", body=f"h as (select *, {_HEAD} as hd from track), h1 as (select *, last_value(hd ignore nulls) over ({_O} rows between unbounded preceding and 1 preceding) as hb from h), h2 as (select *, last_value(case when abs((hd-hb+180)-360*floor((hd-hb+180)/360)-180)>60 then t_capture end ignore nulls) over ({_O} rows unbounded preceding) as tf from h1) select sid, seq, coalesce(t_capture >= tf+1.5, true) as confident from h2"))
def w8(spark, sf_dir):
    df = _track(spark, sf_dir).withColumn("hd", F.expr(_HEAD))
    return K.heading_confidence(df, "hd", B).select("sid", "seq", "confident")


_J1 = """tg as materialized (select t.*, e.action, e.ts as t_set0, e.suppkey as sk0 from track t asof left join target_event e on t.sid=e.sid and t.t_capture >= e.ts),
tk as materialized (select *, case when action='set' then t_set0 end as t_set, case when action='set' then sk0 end as suppkey from tg)"""


def _targeted(spark, sf_dir):
    ticks = _track(spark, sf_dir)
    events = V.target_event(spark, sf_dir)
    return K.active_target(ticks, events, B)


@query("j1_active_target", V.duck("target_event", body=_J1 + f" select sid, seq, suppkey, {dr('t_set')} as t_set from tk"))
def j1(spark, sf_dir):
    return _targeted(spark, sf_dir).select("sid", "seq", "suppkey", r(F.col("t_set")).alias("t_set"))


_GRACE = 20.0
_J2 = _J1 + """, tp as materialized (select tk.*, p.name as t_name, p.x as tx, p.y as ty, p.z as tz, p.ooc as t_ooc, p.kind as kind from tk left join poi p on p.s_suppkey=tk.suppkey),
lk as materialized (select *, max(case when x is not null and ooc=t_ooc then 1 else 0 end) over (partition by sid, t_set0 order by t_capture, seq rows unbounded preceding) as hit from tp),
zl as materialized (select *, case when suppkey is null then false when t_ooc is null then true else hit=1 or t_capture-t_set <= 20 end as in_zone,
 suppkey is not null and hit=1 as locked, case when suppkey is not null and hit=0 then greatest(0::double, 20 - (t_capture-t_set)) end as left_s from lk)"""


_POINT = ("suppkey", "t_name", "tx", "ty", "tz", "t_ooc", "kind")


def _match():
    return F.col("x").isNotNull() & (F.col("ooc") == F.col("t_ooc"))


def _pointed(spark, sf_dir):
    """Commands with the point they aim at."""
    points = V.poi(spark, sf_dir).select(
        F.col("s_suppkey").alias("suppkey"), F.col("name").alias("t_name"), F.col("x").alias("tx"),
        F.col("y").alias("ty"), F.col("z").alias("tz"), F.col("ooc").alias("t_ooc"), "kind")
    return V.target_event(spark, sf_dir).join(points, "suppkey", "left")


def _with_points(spark, sf_dir):
    return K.active_target(_track(spark, sf_dir), _pointed(spark, sf_dir), B, _POINT)


def _navigated(spark, sf_dir):
    return K.navigated(_track(spark, sf_dir), _pointed(spark, sf_dir), _POINT, _match(), F.col("suppkey").isNotNull(),
                       F.col("t_ooc"), grace_s=_GRACE, block_s=B)


def _locked(spark, sf_dir):
    return K.zone_lock(_with_points(spark, sf_dir), _match(), F.col("suppkey").isNotNull(), F.col("t_ooc"), _GRACE, B)


@query("j2_target_point", V.duck("target_event", "poi", body=_J2 + f" select sid, seq, t_name, {dr('tx')} as tx from tp"))
def j2(spark, sf_dir):
    return _with_points(spark, sf_dir).select("sid", "seq", "t_name", r(F.col("tx")).alias("tx"))


@query("p16_mask_guidance", V.duck("target_event", body=_J1 + " select sid, seq, case when suppkey is not null then y end as dist_km from tk"))
def p16(spark, sf_dir):
    df = _targeted(spark, sf_dir).withColumn("dist_km", F.col("y"))
    return K.mask_guidance(df, "suppkey", ["dist_km"]).select("sid", "seq", "dist_km")


@query("w9_zone_lock", V.duck("target_event", "poi", body=_J2 + " select sid, seq, locked, in_zone from zl"))
def w9(spark, sf_dir):
    return _locked(spark, sf_dir).select("sid", "seq", "locked", "in_zone")


@query("w10_grace_left", V.duck("target_event", "poi", body=_J2 + f" select sid, seq, {dr('left_s')} as left_s from zl"))
def w10(spark, sf_dir):
    return _locked(spark, sf_dir).select("sid", "seq", r(F.col("grace_left_s")).alias("left_s"))


_NAV = _J2 + f""", ff as materialized (select *, event_id%29=0 as gone, case when event_id%3=0 then cast((event_id*53)%360-180 as double) end as yo, case when event_id%4<>0 then cast((event_id*17)%120-60 as double) end as po, event_id%5<>0 as sure, (event_id%4)*0.04::double as cage, event_id%2=0 as coasts, last_value(x ignore nulls) over w as px, last_value(y ignore nulls) over w as py, last_value(z ignore nulls) over w as pz from zl window w as ({_O} rows unbounded preceding)),
gd as materialized (select *, {GQ._YAW} as yaw, {GQ._PITCH} as up, case when in_zone and px is not null then {GQ._DIST} end as dist from ff)"""
# What the fixture lacks comes from the event's number: no capture, the offsets of the motion, its steadiness, dead reckoning.
_LABEL = f"""case when gone then concat('CAPTURE UNAVAILABLE',chr(10),'Select a connected monitor in Options.') when suppkey is null then 'NO TARGET' when not in_zone then concat('▶ ',t_name,chr(10),'  zone: ',trim(replace(t_ooc,'_',' ')),chr(10),'  current: ',trim(replace(ooc,'_',' ')))
 when dist is null then concat('▶ ',t_name,chr(10),'  ---') else concat('▶ ',t_name,chr(10),'  ',{GQ._dist_text('dist')}, case when dist*1000<400 then '  ●' when yo is not null and sure then concat('  ',{GQ._velocity('yo', "case when kind='surface' then null else po end")}) else concat('  ',{GQ._world('yaw','up')}) end,
  case when cage > 0.05 then case when coasts then '  DR' else '  LOST' end else '' end) end"""


def _guided(spark, sf_dir):
    df = _navigated(spark, sf_dir)
    pos = G.Vec(*[F.col(f"{c}_last") for c in "xyz"])
    tgt = G.vec("t")
    bearing = G.absolute_bearing(pos, tgt, F.col("kind"))
    return (df.withColumn("bearing", bearing)
            .withColumn("dist_km", G.target_distance(pos, tgt, F.col("kind"), F.col("in_zone"))))


@query("flagship_navigation", V.duck("target_event", "poi", body=_NAV + f" select sid, seq, t_name as target, in_zone, {dr('dist')} as dist_km, case when px is not null then {dr('yaw')} end as yaw_deg, {GQ._dist_text('dist')} as dist_text, case when px is null or tx is null then '' else {GQ._world('yaw','up')} end as arrow from gd"))
def flagship(spark, sf_dir):
    df = _guided(spark, sf_dir)
    return df.select("sid", "seq", F.col("t_name").alias("target"), "in_zone", r(F.col("dist_km")).alias("dist_km"),
                     r(F.col("bearing.yaw_deg")).alias("yaw_deg"),
                     D.format_distance(F.col("dist_km")).alias("dist_text"),
                     D.world_arrow(F.col("bearing.yaw_deg"), F.col("bearing.pitch_deg")).alias("arrow"))


@query("f17_guidance_label", V.duck("target_event", "poi", body=_NAV + f" select sid, seq, {_LABEL} as label from gd"))
def f17(spark, sf_dir):
    df = _guided(spark, sf_dir)
    return df.select("sid", "seq", D.guidance_label(
        unavailable=F.expr("event_id % 29 = 0"), has_target=F.col("suppkey").isNotNull(), in_zone=F.col("in_zone"),
        name=F.col("t_name"), target_zone=F.col("t_ooc"), zone=F.col("ooc"), distance_km=F.col("dist_km"),
        yaw_off=F.expr("case when event_id%3=0 then cast((event_id*53)%360-180 as double) end"),
        pitch_off=F.expr("case when event_id%4<>0 then cast((event_id*17)%120-60 as double) end"), confident=F.expr("event_id % 5 <> 0"),
        kind=F.col("kind"), world_yaw=F.col("bearing.yaw_deg"), world_pitch=F.col("bearing.pitch_deg"),
        coast_age=F.expr("(event_id % 4) * 0.04D"), integrity=F.expr("if(event_id % 2 = 0, 'COASTING', 'LOST')")).alias("label"))


@query("w15_running_counters", V.duck("track", body=f"c as (select sid, seq, row_number() over ({_O}) as frames, cast(count(x) over w as bigint) as accepted, cast(sum(case when x is null then 1 else 0 end) over w as bigint) as lost from track window w as ({_O} rows unbounded preceding)) select * from c where frames%50=0"))
def w15(spark, sf_dir):
    x = F.col("x")
    return (K.running_counters(_track(spark, sf_dir), {"accepted": x.isNotNull(), "lost": x.isNull()}, block_s=B)
            .select("sid", "seq", "frames", "accepted", "lost"))


@query("w16_repeat_suppression", V.duck("track", body=f"a as (select *, lag(ooc) over ({_O}) as ob, row_number() over ({_O}) as i from track), b as (select *, i>1 and ob is not distinct from ooc as reused from a), c as (select *, max(case when not reused then i end) over ({_O} rows unbounded preceding) as fi from b) select c.sid, c.seq, c.reused, f.x as result from c join a f on f.sid=c.sid and f.i=c.fi"))
def w16(spark, sf_dir):
    return (K.reuse_repeats(_track(spark, sf_dir), F.col("ooc"), F.col("x"), B)
            .select("sid", "seq", "reused", "result"))


@query("w24_rejection_runs", V.duck("log_line", body="a as (select *, case when line like '%OCR rejection%' then 1 else 0 end as f, row_number() over (partition by sid order by event_id) as i from log_line), b as (select *, i - sum(f) over (partition by sid order by event_id rows unbounded preceding) as run from a where true) select sid, count(*) as length, min(event_id) as first from b where f=1 group by sid, run having count(*) > 2"))
def w24(spark, sf_dir):
    # Healthy sessions stay at or under five; the fixture is short, so alert sooner.
    return K.runs_of(V.log_line(spark, sf_dir), F.col("line").contains("OCR rejection"),
                     ("event_id",), 2000.0, longer_than=2)


@query("r3_gap_segments", V.duck("track", body=f"a as (select *, t_capture - lag(t_capture) over ({_O}) as dt from track), b as (select *, cast(sum(case when dt>3 then 1 else 0 end) over ({_O} rows unbounded preceding) as bigint) as gap_segment from a) select sid, gap_segment, count(*) as ticks, {dr('max(t_capture)-min(t_capture)')} as span_s, {dr('min(x)')} as min_x from b group by 1,2"))
def r3(spark, sf_dir):
    return (K.gap_segments(_track(spark, sf_dir), block_s=B).groupBy("sid", "gap_segment")
            .agg(F.count(F.lit(1)).alias("ticks"), r(F.max("t_capture") - F.min("t_capture")).alias("span_s"),
                 r(F.min("x")).alias("min_x")))


@query("r4_stale_source_drop", V.duck("track", body=f"a as (select *, cast(sum(case when event_id%30=0 then 1 else 0 end) over ({_O} rows unbounded preceding) as bigint) as source_epoch from track) select sid, seq, source_epoch from a where source_epoch = seq // 30"))
def r4(spark, sf_dir):
    return (K.current_source_only(_track(spark, sf_dir), F.col("event_id") % 30 == 0, F.expr("seq div 30"), B)
            .select("sid", "seq", "source_epoch"))


_STAB = "select sid, cast(floor(t_capture/10) as bigint) as bucket, count(*) as ticks, {0} as capture_rate, {1} as spread_x, {2} as spread_z from track group by 1,2"


@query("r10_tumbling_kpis", V.duck("track", body=_STAB.format(dr("avg(case when x is not null then 1.0 else 0 end)"), dr("max(x)-min(x)"), dr("max(z)-min(z)"))))
def r10(spark, sf_dir):
    return (K.window_stability(_track(spark, sf_dir))
            .select("sid", "bucket", "ticks", r(F.col("capture_rate")).alias("capture_rate"),
                    r(F.col("spread_x")).alias("spread_x"), r(F.col("spread_z")).alias("spread_z")))


@query("a22_session_records", "select user_id as sid, count(*) as records from events group by 1")
def a22(spark, sf_dir):
    return V.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("sid")).agg(F.count(F.lit(1)).alias("records"))


_JZ = _J2 + """, zp as (select distinct ooc as read, t_ooc as reference from tp where t_ooc is not null union select distinct ooc, substr(t_ooc,7) from tp where t_ooc is not null),
zn as (select *, regexp_replace(lower(read),'[^a-z0-9]+','','g') as a, regexp_replace(lower(reference),'[^a-z0-9]+','','g') as b from zp)"""


@query("j3_zone_match_plain", V.duck("target_event", "poi", body=_JZ + " select read, reference, a=b or (least(length(a),length(b))>=5 and (a like concat('%',b,'%') or b like concat('%',a,'%'))) as plain from zn"))
def j3_plain(spark, sf_dir):
    seen = _with_points(spark, sf_dir).filter(F.col("t_ooc").isNotNull())
    refs = F.explode(F.array(F.col("t_ooc"), F.expr("substr(t_ooc, 7)")))
    pairs = seen.select(F.col("ooc").alias("read"), refs.alias("reference")).distinct()
    plain = Z.plain_match(Z.normalize_zone(F.col("read")), Z.normalize_zone(F.col("reference")))
    return pairs.select("read", "reference", plain.alias("plain"))


# Fixture zones have one length and differ in the last character only, for which
# the similarity ratio is 2*(length-1)/(2*length).
@query("j3_fuzzy_zone_match", V.duck("target_event", "poi", body=_J2 + " select sid, seq, coalesce(ooc=t_ooc or 2.0*(length(replace(replace(ooc,'_',''),': ',''))-1)/(2*length(replace(replace(ooc,'_',''),': ',''))) >= 0.85, false) and t_ooc is not null as zones_match from tp"))
def j3(spark, sf_dir):
    return Z.with_zone_match(_with_points(spark, sf_dir), "ooc", "t_ooc").select("sid", "seq", "zones_match")
