"""Stateful tracker queries; oracles are recursive and step all sessions at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.operators import tracker as S
from wayline.operators import tracks as K
from wayline.plans import geometry_queries as GQ
from wayline.plans import views as V
from wayline.plans.registry import dr, query, r
from wayline.session import settle

B = V.BLOCK_S

# Zone names that no similarity rule confuses, so that changes are real ones.
_ZONES = {"1": "Zone: Hurston_A", "2": "Zone: Cellin_Bay", "3": "Zone: Yela_Belt", "4": "Zone: Microtech_Cold"}


def _zoned(spark, sf_dir):
    last = F.substring("ooc", -1, 1)
    name = None
    for digit, zone in _ZONES.items():
        name = F.when(last == digit, zone) if name is None else name.when(last == digit, zone)
    return V.track(spark, sf_dir).withColumn("ooc", name)


_TZ = ("tz as materialized (select * replace (case right(ooc,1) "
       + " ".join(f"when '{d}' then '{z}'" for d, z in _ZONES.items()) + " end as ooc) from track)")

# Gate and median --------------------------------------------------------------
_MED = "list_sort(list_transform({l}, lambda e: e.{c}))[cast(floor(len({l})/2) as int)+1]"
_NEWBUF = "(case when g_left then [{'x':x,'y':y,'z':z}] else list_append(case when len(buf)>=7 then buf[2:7] else buf end, {'x':x,'y':y,'z':z}) end)"
_RULE = """case when ax is not null and not g_left and x is not null and t-tat>0 and t-tat<=5 then
 case when (ax*x<0 and abs(abs(ax)-abs(x))<5) or (ay*y<0 and abs(abs(ay)-abs(y))<5) or (az*z<0 and abs(abs(az)-abs(z))<5) then 'sign_flip'
 when abs(x-ax)>4 or abs(y-ay)>4 or abs(z-az)>4 then 'axis_jump'
 when abs(x-ax)/(t-tat)>10 or abs(y-ay)/(t-tat)>10 or abs(z-az)/(t-tat)>10 then 'axis_speed'
 when sqrt((x-ax)*(x-ax)+(y-ay)*(y-ay)+(z-az)*(z-az))/(t-tat)>15 then 'speed' end end"""
_GATE = _TZ + f""",
g(sid, seq, x, t, acc, reason, ax, ay, az, aooc, tat, buf) as (
 select sid, 0::bigint, null::double, 0::double, false, null::varchar, null::double, null::double, null::double, null::varchar, 0::double, []::struct(x double, y double, z double)[] from (select distinct sid from track)
 union all
 select sid, seq, x, t, acc, reason, case when acc then {_MED.format(l='nb', c='x')} else ax end, case when acc then {_MED.format(l='nb', c='y')} else ay end,
  case when acc then {_MED.format(l='nb', c='z')} else az end, case when acc then nooc else aooc end, case when acc then t else tat end, case when acc then nb else buf end
 from (select *, x is not null and reason is null as acc, {_NEWBUF} as nb from (select *, {_RULE} as reason from (
  select k.sid, k.seq, k.x, k.y, k.z, k.ooc as nooc, k.t_capture as t, g.ax, g.ay, g.az, g.aooc, g.tat, g.buf, (g.aooc is not null and k.ooc <> g.aooc) as g_left from g join tz k on k.sid=g.sid and k.seq=g.seq+1)))),
gg as (select * from g where seq > 0)"""


def _gated(spark, sf_dir):
    return S.gate_and_median(_zoned(spark, sf_dir), block_s=B)


@query("w2_plausibility_gate", V.duck("track", recursive=True, body=_GATE + f" select sid, seq, acc as accepted, reason, case when acc then {dr('ax')} end as x_med, case when acc then {dr('az')} end as z_med from gg"))
def w2(spark, sf_dir):
    return _gated(spark, sf_dir).select(
        "sid", "seq", "accepted", F.col("gate_reason").alias("reason"),
        r(F.col("x_med")).alias("x_med"), r(F.col("z_med")).alias("z_med"))


# Distance and angle smoothing ---------------------------------------------------
_RAW = "sqrt(x*x+y*y)/cast(100 as double)"
_MOV = "event_id%5 <> 0"


@query("w6_distance_smoothing", V.duck("track", recursive=True, body=f"""k as materialized (select sid, seq, case when x is not null then {_RAW} end as raw, {_MOV} as mv from track),
s(sid, seq, d) as (select sid, 0::bigint, null::double from (select distinct sid from track) union all
 select k.sid, k.seq, case when k.raw is null then s.d when not k.mv or s.d is null or k.raw*1000 < 400 or abs(k.raw-s.d)/greatest(s.d,0.001::double) > 0.3 then k.raw else 0.4::double*k.raw+(1-0.4::double)*s.d end from s join k on k.sid=s.sid and k.seq=s.seq+1)
select sid, seq, {dr('d')} as shown_km from s where seq>0"""))
def w6(spark, sf_dir):
    df = V.track(spark, sf_dir).withColumn("raw_km", F.expr(_RAW)).withColumn("mv", F.expr(_MOV))
    return (S.distance_smoothing(df, "raw_km", "mv", block_s=B)
            .select("sid", "seq", r(F.col("shown_km")).alias("shown_km")))


@query("w23_angle_smoothing", V.duck("track", recursive=True, body=f"""k as materialized (select sid, seq, cast((event_id*53)%360-180 as double) as a, t_capture - lag(t_capture) over (partition by sid order by t_capture, seq) as dt from track),
s(sid, seq, e) as (select sid, 0::bigint, null::double from (select distinct sid from track) union all
 select sid, seq, case when e is null or dt > 3 then a else (e+0.4::double*w+180)-360*floor((e+0.4::double*w+180)/360)-180 end from (
  select k.sid, k.seq, k.a, k.dt, s.e, (k.a-s.e+180)-360*floor((k.a-s.e+180)/360)-180 as w from s join k on k.sid=s.sid and k.seq=s.seq+1))
select sid, seq, {dr('e')} as yaw_smooth from s where seq>0"""))
def w23(spark, sf_dir):
    df = V.track(spark, sf_dir).withColumn("yaw", F.expr("cast((event_id*53)%360-180 as double)"))
    return (S.angle_smoothing(df, "yaw", 0.4, B).select("sid", "seq", r(F.col("yaw_smooth")).alias("yaw_smooth")))


# Kalman --------------------------------------------------------------------------
# Fixture jumps are kilometres per second, so a wide noise keeps the filter busy.
_TUNE = S.Tuning(sigma_a=2.0, sigma_z=0.5)
_Q, _RV, _V0 = "4.0::double", "0.25::double", "6.25::double"
_KF = f"""kf(sid, seq, init, hv, mv, t, ta, px, py, pz, vx, vy, vz, a, b, c, d, took) as (
 select sid, 0::bigint, false, false, false, null::double, null::double, 0::double, 0::double, 0::double, 0::double, 0::double, 0::double, 0::double, 0::double, 0::double, 0::double, false from (select distinct sid from track)
 union all
 select sid, seq, init2, hv2, case when mode in ('seed','clear','none') then case when mode='none' then mv else false end when not hv2 then false when mv then sp >= 0.03 else sp >= 0.05 end,
  t2, ta2, px2, py2, pz2, round(vx2*cl, 9), round(vy2*cl, 9), round(vz2*cl, 9), a2, b2, c2, d2, mode in ('seed','upd')
 from (select *, case when hv2 then case when mode='upd' and sp0 > 2.5 then 2.5::double/sp0 else 1::double end else 1::double end as cl, case when mode='upd' and sp0 > 2.5 then 2.5::double else sp0 end as sp
 from (select *, sqrt(vx2*vx2+vy2*vy2+vz2*vz2) as sp0 from (
 select *, case when mode='seed' then true when mode='clear' then false else init end as init2,
  case when mode in ('seed','clear') then false when mode='upd' then true else hv end as hv2,
  case when mode='seed' then tk when mode='clear' then null when mode='none' then t else tk end as t2,
  case when mode in ('seed','upd') then tk when mode='clear' then null else ta end as ta2,
  case mode when 'seed' then x when 'upd' then round(qx + k0*(x-qx), 9) when 'none' then px when 'clear' then px else qx end as px2,
  case mode when 'seed' then y when 'upd' then round(qy + k0*(y-qy), 9) when 'none' then py when 'clear' then py else qy end as py2,
  case mode when 'seed' then z when 'upd' then round(qz + k0*(z-qz), 9) when 'none' then pz when 'clear' then pz else qz end as pz2,
  case mode when 'seed' then 0 when 'upd' then vx + k1*(x-qx) else vx end as vx2,
  case mode when 'seed' then 0 when 'upd' then vy + k1*(y-qy) else vy end as vy2,
  case mode when 'seed' then 0 when 'upd' then vz + k1*(z-qz) else vz end as vz2,
  case mode when 'seed' then {_RV} when 'upd' then (1-k0)*a1 when 'none' then a when 'clear' then a else a1 end as a2,
  case mode when 'seed' then 0 when 'upd' then (1-k0)*b1 when 'none' then b when 'clear' then b else b1 end as b2,
  case mode when 'seed' then 0 when 'upd' then c1-k1*a1 when 'none' then c when 'clear' then c else c1 end as c2,
  case mode when 'seed' then {_V0} when 'upd' then d1-k1*b1 when 'none' then d when 'clear' then d else d1 end as d2
 from (select *, case when x is not null then case when not init then 'seed' when dt<=0 then 'none' when dt>3 or tk-ta>2 then 'seed'
    when (x-qx)*(x-qx)/s + (y-qy)*(y-qy)/s + (z-qz)*(z-qz)/s > 30 then 'gated' else 'upd' end
   else case when not init or dt<=0 then 'none' when dt>3 then 'clear' else 'coast' end end as mode
 from (select *, a1/s as k0, c1/s as k1 from (select *, a1+{_RV} as s from (
  select *, px+vx*dt as qx, py+vy*dt as qy, pz+vz*dt as qz, a+dt*(c+b)+dt*dt*d+{_Q}*(dt*dt*dt)/3.0::double as a1, b+dt*d+{_Q}*(dt*dt)/2.0::double as b1, c+dt*d+{_Q}*(dt*dt)/2.0::double as c1, d+{_Q}*dt as d1
  from (select k.sid, k.seq, k.x, k.y, k.z, k.t_capture as tk, k.t_capture-kf.t as dt, kf.* exclude (sid, seq) from kf join track k on k.sid=kf.sid and k.seq=kf.seq+1))))))))),
kk as (select *, case when ta is null or t is null then null else greatest(0::double, t-ta) end as age from kf where seq>0)"""


def _filtered(spark, sf_dir):
    return S.kalman_track(V.track(spark, sf_dir), _TUNE, B)


@query("w11_kalman_filter", V.duck("track", recursive=True, body=_KF + f" select sid, seq, took as measured, case when init then {dr('px', 4)} end as px, case when init then {dr('pz', 4)} end as pz, case when hv then {dr('vx', 4)} end as vx, case when hv then {dr('sqrt(vx*vx+vy*vy+vz*vz)', 4)} else 0 end as speed, mv as moving from kk"))
def w11(spark, sf_dir):
    return _filtered(spark, sf_dir).select(
        "sid", "seq", "measured", r(F.col("px"), 4).alias("px"), r(F.col("pz"), 4).alias("pz"),
        r(F.col("vx"), 4).alias("vx"), r(F.col("speed_km_s"), 4).alias("speed"), "moving")


@query("w12_dead_reckoning", V.duck("track", recursive=True, body=_KF + f" select k.sid, k.seq, {dr('k.px', 4)} as px, {dr('k.py', 4)} as py, {dr('age', 6)} as coast_age_s from kk k join track t on t.sid=k.sid and t.seq=k.seq where t.x is null and k.init"))
def w12(spark, sf_dir):
    return (_filtered(spark, sf_dir).filter(F.col("x").isNull() & F.col("px").isNotNull())
            .select("sid", "seq", r(F.col("px"), 4).alias("px"), r(F.col("py"), 4).alias("py"),
                    r(F.col("coast_age_s")).alias("coast_age_s")))


@query("w13_integrity", V.duck("track", recursive=True, body=_KF + " select sid, seq, case when age is null or age > 2 then 'LOST' when age <= 1e-9 then 'FRESH' else 'COASTING' end as integrity from kk"))
def w13(spark, sf_dir):
    return _filtered(spark, sf_dir).select("sid", "seq", "integrity")


# The whole tracker ------------------------------------------------------------------
_GRACE = 20.0


def _points(spark, sf_dir):
    """Points as a command names them, with zone names that no rule confuses."""
    zone = None
    for digit, name in _ZONES.items():
        hit = F.substring("ooc", -1, 1) == digit
        zone = F.when(hit, name) if zone is None else zone.when(hit, name)
    return V.poi(spark, sf_dir).select(
        F.col("s_suppkey").alias("suppkey"), F.col("name").alias("t_name"), F.col("x").alias("tx"), F.col("y").alias("ty"),
        F.col("z").alias("tz"), zone.alias("t_ooc"), "kind")


def session_ticks(spark, sf_dir):
    """Ticks that claim the source they were taken from, two of them too late; some failed, at some there was no capture."""
    return _zoned(spark, sf_dir).withColumns({
        "source_epoch": F.expr("(seq + 25) div 60"), "error": F.expr(f"case when event_id % 29 = 0 then '{K.UNAVAILABLE}' when event_id % 17 = 0 then 'engine' end"),
        "location": F.expr("case when event_id % 3 = 0 then 'Stanton' else 'Unknown' end")})


def session_commands(spark, sf_dir):
    """Targets set and cleared, resets, and changes of source."""
    ticks = V.track(spark, sf_dir)
    aims = V.target_event(spark, sf_dir).join(_points(spark, sf_dir), "suppkey", "left")
    others = ticks.filter("seq % 50 = 27 or seq % 60 = 33").select(
        "sid", F.col("t_capture").alias("ts"), F.expr("case when seq % 60 = 33 then 'source' else 'reset' end").alias("action"),
        F.expr("case when seq % 60 = 33 then seq div 60 + 1 end").alias("source_epoch"))
    return aims.unionByName(others, allowMissingColumns=True).select("sid", "ts", "action", "source_epoch", *S.TARGET)


def tracked(spark, sf_dir):
    return S.replay(session_ticks(spark, sf_dir), session_commands(spark, sf_dir), _TUNE, _GRACE, B)


_REPLAY = _TZ + f""",
cm as materialized (select sid, ts, action, suppkey, null::bigint as src from target_event union all
 select sid, t_capture, case when seq%60=33 then 'source' else 'reset' end, null, case when seq%60=33 then seq//60+1 end from track where seq%50=27 or seq%60=33),
mm as (select sid, t_capture as t, 5 as rk, seq, null::varchar as action, null::bigint as suppkey, null::bigint as src from track union all
 select sid, ts, case action when 'source' then 1 when 'reset' then 2 when 'clear' then 3 else 4 end, 0, action, suppkey, src from cm),
mw as (select *, cast(sum(case when action<>'source' then 1 else 0 end) over o as bigint) as epoch, last_value(case when action<>'source' then {{'a':action,'t':t,'k':suppkey}} end ignore nulls) over o as now,
  last_value(case when action='source' then {{'s':src,'t':t}} end ignore nulls) over o as cur, cast(sum(case when action='source' then 1 else 0 end) over o as bigint) as restarts,
  cast(sum(case when action in ('source','reset') then 1 else 0 end) over o as bigint) as resets from mm window o as (partition by sid order by t, rk, seq rows unbounded preceding)),
ti as materialized (select w.sid, w.seq, w.t, k.x, k.y, k.z, k.ooc, k.event_id%17=0 as failed, w.epoch, w.restarts, w.resets, case when w.now.a='set' then w.now.k end as suppkey,
  case when w.now.a='set' then greatest(w.now.t, coalesce(w.cur.t, w.now.t)) end as t_set, row_number() over (partition by w.sid order by w.t, w.seq) as n
 from mw w join tz k on k.sid=w.sid and k.seq=w.seq where w.rk=5 and k.event_id%29<>0 and (w.seq+25)//60 = coalesce(w.cur.s, 0)),
ga(sid, n, acc, reason, mx, my, mz, zr, ax, ay, az, aooc, tat, buf, sz, rs) as (
 select sid, 0::bigint, false, null::varchar, null::double, null::double, null::double, false, null::double, null::double, null::double, null::varchar, 0::double, []::struct(x double, y double, z double)[], null::varchar, 0::bigint from (select distinct sid from track)
 union all
 select sid, n, acc, reason, case when acc then nx end, case when acc then ny end, case when acc then nz end, acc and sz is not null and sz<>nooc,
  case when acc then nx else ax end, case when acc then ny else ay end, case when acc then nz else az end, case when acc then nooc else aooc end, case when acc then t else tat end,
  case when acc then nb else buf end, case when acc then nooc else sz end, rs
 from (select *, {_MED.format(l='nb', c='x')} as nx, {_MED.format(l='nb', c='y')} as ny, {_MED.format(l='nb', c='z')} as nz from (
  select *, x is not null and reason is null as acc, {_NEWBUF} as nb from (select *, {_RULE} as reason from (
   select k.sid, k.n, case when not k.failed then k.x end as x, k.y, k.z, k.ooc as nooc, k.t, k.restarts as rs,
    case when k.restarts=ga.rs then ax end as ax, case when k.restarts=ga.rs then ay end as ay, case when k.restarts=ga.rs then az end as az, case when k.restarts=ga.rs then aooc end as aooc,
    tat, case when k.restarts=ga.rs then buf else []::struct(x double, y double, z double)[] end as buf, case when k.restarts=ga.rs then sz end as sz,
    (k.restarts=ga.rs and ga.aooc is not null and k.ooc <> ga.aooc) as g_left from ga join ti k on k.sid=ga.sid and k.n=ga.n+1))))),
pt as materialized (select s_suppkey, name, x as tx, y as ty, z as tz, kind, case right(ooc,1) {' '.join(f"when '{d}' then '{z}'" for d, z in _ZONES.items())} end as t_ooc from poi),
tl as materialized (select i.*, g.acc, g.reason, g.mx, g.my, g.mz, g.zr, case when g.ax is not null then i.t - g.tat end as cage, p.name as t_name, p.tx, p.ty, p.tz, p.kind, p.t_ooc,
  max(case when g.acc and i.ooc=p.t_ooc then 1 else 0 end) over (partition by i.sid, i.epoch, i.restarts order by i.n rows unbounded preceding) as hit
 from ti i join ga g on g.sid=i.sid and g.n=i.n left join pt p on p.s_suppkey=i.suppkey),
fi as materialized (select *, case when tx is null then false when t_ooc is null then true else hit=1 or t-t_set <= {_GRACE} end as in_zone from tl),
ke(sid, n, rs, ep, init, hv, mv, t, ta, px, py, pz, vx, vy, vz, a, b, c, d, took, sd) as (
 select sid, 0::bigint, -1::bigint, -1::bigint, false, false, false, null::double, null::double, 0::double, 0::double, 0::double, 0::double, 0::double, 0::double, 0::double, 0::double, 0::double, 0::double, false, null::double from (select distinct sid from track)
 union all
 select sid, n, rs, ep, init2, hv2, mv2, t2, ta2, px2, py2, pz2, vx3, vy3, vz3, a2, b2, c2, d2, mode in ('seed','upd'),
  case when x is null then case when tx is not null and in_zone and init2 and ta2 is not null and t2-ta2 <= 2 then {{DIST}} else prevd end
   when raw is null then prevd when not mv2 or prevd is null or raw*1000 < 400 or abs(raw-prevd)/greatest(prevd, 0.001::double) > 0.3 then raw else 0.4::double*raw+(1-0.4::double)*prevd end
 from (select *, case when x is not null and tx is not null and in_zone then {{RAW}} end as raw, round(vx2*cl, 9) as vx3, round(vy2*cl, 9) as vy3, round(vz2*cl, 9) as vz3,
   case when mode in ('seed','clear') or not hv2 then false when mode='none' then mv when mv then sp >= 0.03 else sp >= 0.05 end as mv2
  from (select *, case when hv2 and mode='upd' and sp0 > 2.5 then 2.5::double/sp0 else 1::double end as cl, case when mode='upd' and sp0 > 2.5 then 2.5::double else sp0 end as sp
  from (select *, sqrt(vx2*vx2+vy2*vy2+vz2*vz2) as sp0 from ({{STEP}}))))),
kd as materialized (select fi.*, ke.init, ke.hv, ke.mv, ke.px, ke.py, ke.pz, ke.vx, ke.vy, ke.vz, ke.took, ke.sd, case when ke.ta is null or ke.t is null then null else greatest(0::double, ke.t-ke.ta) end as age,
  case when hv then sqrt(vx*vx+vy*vy+vz*vz) else 0 end as sp from ke join fi on fi.sid=ke.sid and fi.n=ke.n),
kv as (select *, age is null or age > 2 as lost, acc and mv and tx is not null and sqrt(vx*vx+vy*vy) >= 0.05 as sure, mv and hv as going from kd),
kb as (select * replace (case when acc then mx else px end as px, case when acc then my else py end as py, case when acc then mz else pz end as pz), px as fx, pz as fz from kv),
ko as (select *, case when acc then case when sure then {{'y':{GQ._YOFF}, 'p':{GQ._POFF}}} else {{'y':null::double, 'p':null::double}} end
   when tx is null then null when lost then {{'y':null::double, 'p':null::double}} when init and going then {{'y':{GQ._YOFF}, 'p':{GQ._POFF}}} end as off,
  case when sure then degrees(atan2(-vx, vy)) end as hd from kb),
kh as (select *, last_value(off ignore nulls) over (partition by sid, epoch, resets order by n rows unbounded preceding) as o,
  last_value(hd ignore nulls) over (partition by sid, resets order by n rows between unbounded preceding and 1 preceding) as hb from ko),
kr as (select *, last_value(case when abs((hd-hb+180)-360*floor((hd-hb+180)/360)-180) > 60 then t end ignore nulls) over (partition by sid, resets order by n rows unbounded preceding) as tf from kh)"""


def _replay_sql() -> str:
    """The filter's step of ``_KF``, over accepted reads and with what resets it."""
    step = _KF[_KF.index(" select *, case when mode='seed' then true"):_KF.index("from (select k.sid, k.seq, k.x")]
    known = """from (select *, tk - t as dt from (select i.sid, i.n, i.resets as rs, i.epoch as ep, i.mx as x, i.my as y, i.mz as z, i.t as tk, i.tx, i.ty, i.tz, i.kind, i.in_zone,
     ke.init and f.kept as init, ke.hv and f.kept as hv, ke.mv and f.kept as mv, case when f.kept then ke.t end as t, case when f.kept then ke.ta end as ta, case when i.epoch=ke.ep and i.resets=ke.rs then ke.sd end as prevd,
     ke.px, ke.py, ke.pz, ke.vx, ke.vy, ke.vz, ke.a, ke.b, ke.c, ke.d
     from ke join fi i on i.sid=ke.sid and i.n=ke.n+1, lateral (select i.resets=ke.rs and not (i.acc and i.zr) as kept) f))))))"""
    at = GQ._DIST
    for c in "xyz":
        at = at.replace(f"p{c}", f"@{c}")
    dist, raw = at, at
    for c in "xyz":
        dist, raw = dist.replace(f"@{c}", f"p{c}2"), raw.replace(f"@{c}", c)
    return _REPLAY.replace("{STEP}", step + known).replace("{DIST}", dist).replace("{RAW}", raw)


def _replayed(select: str) -> str:
    return V.duck("target_event", "poi", recursive=True, body=_replay_sql() + select)


_STATUS = "case when failed or x is null then 'no_read' when reason is not null then 'rejected' else 'ok' end"


@query("r1_session_tracker", _replayed(f""" select sid, seq, {_STATUS} as status, reason as gate_reason, in_zone, took as measured, mv as moving, case when lost then 'LOST' when age <= 1e-9 then 'FRESH' else 'COASTING' end as integrity,
 case when init then {dr('fx', 4)} end as px, {dr('sp', 4)} as speed_km_s, case when tx is not null then {dr('sd', 4)} end as dist_km, case when tx is not null then {dr('o.y', 3)} end as yaw_off,
 case when tx is not null then {dr('o.p', 3)} end as pitch_off, coalesce(t >= tf + 1.5, true) as confident, {dr('cage')} as coord_age_s from kr"""))
def r1(spark, sf_dir):
    return tracked(spark, sf_dir).select(
        "sid", "seq", "status", "gate_reason", "in_zone", "measured", "moving", "integrity", r(F.col("px"), 4).alias("px"),
        r(F.col("speed_km_s"), 4).alias("speed_km_s"), r(F.col("dist_km"), 4).alias("dist_km"), r(F.col("yaw_off"), 3).alias("yaw_off"),
        r(F.col("pitch_off"), 3).alias("pitch_off"), "confident", r(F.col("coord_age_s")).alias("coord_age_s"))


def _silent(spark, sf_dir, event, steps):
    """One kind of change, from those steps of the replay that it depends on; commands are read twice, so stored once."""
    commands = settle(session_commands(spark, sf_dir))
    return S.silent_changes(steps(session_ticks(spark, sf_dir), commands, _TUNE, _GRACE, B), commands, _TUNE, _GRACE, B, (event,))


_SILENT = _replay_sql() + f""", ev as (select sid, t, 5 as rk, seq, n, true as mv from kr union all
 select sid, ts, case action when 'source' then 1 when 'reset' then 2 when 'clear' then 3 else 4 end, 0, null, action in ('reset','source') from cm),
nx as (select *, lead(t) over o as nt, first_value(case when mv then t end ignore nulls) over (partition by sid order by t, rk, seq rows between 1 following and unbounded following) as nm from ev window o as (partition by sid order by t, rk, seq)),
sl as (select kr.*, nx.nt, nx.nm from kr join nx on nx.sid=kr.sid and nx.n=kr.n)"""


@query("r7_silent_loss", V.duck("target_event", "poi", recursive=True, body=_SILENT + f" select sid, seq, {dr('t + (2 - age)')} as t_lost from sl where not lost and (nm is null or t + (2 - age) < nm)"))
def r7(spark, sf_dir):
    return _silent(spark, sf_dir, "integrity", S.filtered).select("sid", "seq", r(F.col("t_change")).alias("t_lost"))


@query("r8_grace_expiry", V.duck("target_event", "poi", recursive=True, body=_SILENT + f" select sid, seq, {dr(f't_set + {_GRACE}')} as t_out from sl where in_zone and hit=0 and tx is not null and t_ooc is not null and (nt is null or t_set + {_GRACE} < nt)"))
def r8(spark, sf_dir):
    return _silent(spark, sf_dir, "zone", S.located).select("sid", "seq", r(F.col("t_change")).alias("t_out"))
