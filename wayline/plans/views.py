"""Inputs derived from the driver tables, as Spark DataFrames and as DuckDB SQL.

Every view is a projection of one table (or a key join of two), except ``track``,
whose running sums use the blocked scan. The DuckDB twin of each view feeds the
oracle strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators.ordered import Ordering, row_index, running_sum, scan
from wayline.session import spread

# Width of a time block in seconds of capture time. Fixture tracks span a few
# hundred seconds, so this cuts each session into several blocks.
BLOCK_S = 60.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Line order inside a frame. Unique as long as (line number, part, supplier, quantity) is; slots of
# 28, 24 and 6 bits hold the keys of part, supplier and quantity up to scale factor 1,300.
_ORD = "(((cast(l_linenumber as bigint)*268435456 + l_partkey)*16777216 + l_suppkey)*64 + cast(l_quantity as bigint))"

_HUD_SQL = f"""
with a as (select l_orderkey as frame_id, {_ORD} as line_no, l_suppkey%4+1 as zn, l_suppkey%8 as v,
  l_partkey%2000 as i1, l_suppkey%900 as i2, l_orderkey%700 as i3,
  lpad(cast(l_orderkey%10000 as string),4,'0') as d1, lpad(cast(l_partkey%10000 as string),4,'0') as d2,
  lpad(cast((l_orderkey*7)%10000 as string),4,'0') as d3, (l_partkey%101)/cast(100 as double) as score from lineitem)
select frame_id, line_no, v as variant, score, case v
 when 1 then concat('Zone: OOC_Stanton_',cast(zn as string),' Pos: ',cast(i1 as string),'.',substr(d1,1,2),'m -',cast(i2 as string),'.',d2,'km ',cast(i3 as string),'.',d3,'km')
 when 2 then concat('Zone: OOC_Stanton_',cast(zn as string),' Pos: ',cast(i1 as string),',',d1,'km -',cast(i2 as string),',',d2,'km ',cast(i3 as string),',',d3,'km')
 when 3 then concat('Zane: OOC_Stanton_',cast(zn as string),'Pos:_',cast(i1 as string),'.',d1,'kh -',cast(i2 as string),'.',d2,'km ',cast(i3 as string),'.',d3,'km')
 when 4 then concat('Zone: OOC_Stanton_',cast(zn as string),' P05:',cast(i1 as string),'.',d1,'km -',cast(i2 as string),'.',d2,'km ',cast(i3 as string),'.',substr(d3,1,2),'km')
 when 5 then concat('Root Pos: ',cast(i1 as string),'.',d1,'km -',cast(i2 as string),'.',d2,'km ',cast(i3 as string),'.',d3,'km')
 when 6 then concat('Zone: OOC_Stanton_',cast(zn as string),' Pos: 1',lpad(cast(i1 as string),4,'0'),d1,'km -1',lpad(cast(i2 as string),3,'0'),d2,'km 1',lpad(cast(i3 as string),3,'0'),d3,'km')
 when 7 then concat('Zone: OOC_Stanton_',cast(zn as string),' Pos: ',cast(i1 as string),'.',d1,'km -',cast(i2 as string))
 else concat('Zone: OOC_Stanton_',cast(zn as string),' Pos: ',cast(i1 as string),'.',d1,'km -',cast(i2 as string),'.',d2,'km ',cast(i3 as string),'.',d3,'km') end as text from a
"""

_PASS_SQL = f"""
select l_orderkey as frame_id, {_ORD} as ord, concat('p', cast(l_linenumber as string)) as pass, l_quantity as score,
 case when l_partkey%7=0 then null else cast((l_orderkey*37)%60001-30000 as double) + (l_partkey%5)*4/cast(10 as double) + case when l_suppkey%9=0 then 60 else 0 end end as x,
 case when l_partkey%7=0 then null else cast((l_orderkey*53)%60001-30000 as double) + (l_suppkey%5)*4/cast(10 as double) end as y,
 case when l_partkey%7=0 then null else cast((l_orderkey*71)%60001-30000 as double) end as z,
 case when l_partkey%7=0 then null else concat('Zone: OOC_Stanton_', cast(l_suppkey%4+1 as string)) end as ooc,
 case when l_suppkey%5=0 then 'Stanton' else 'Unknown' end as location
from lineitem
"""

_BOX_SQL = f"""
select l_orderkey as frame_id, {_ORD} as id, cast((l_suppkey%30) as int) as y, cast((l_suppkey%30)/10 as int) as row_idx_raw,
 cast((l_partkey*13)%120 as int) as x, cast(2+l_suppkey%14 as int) as w, cast(4+l_partkey%20 as int) as h,
 case when l_partkey%9=0 then null else substr('0123456789.-km', cast(l_suppkey%14+1 as int), 1) end as glyph,
 (l_partkey%101)/cast(100 as double) as score
from lineitem
"""

_PIXEL_SQL = """
select l_suppkey%20 as frame_id, l_partkey%60 as y, l_orderkey%40 as x,
 cast((l_partkey*31+l_suppkey*17)%90 + case when l_partkey%60 in (5,6,7,8,9,10,11,20,21,22,23,24,25,26,27,40,41,42,43,44,45,46) and l_orderkey%3=0 then 150 else 0 end as bigint) as v
from lineitem
"""

_POI_SQL = """
select s_suppkey, s_name as name, (s_suppkey*7919%80001-40000)/cast(100 as double) as x, (s_suppkey*6271%80001-40000)/cast(100 as double) as y,
 (s_suppkey*4447%80001-40000)/cast(100 as double) as z, n_name as location,
 case when s_suppkey%11=0 then null else concat('Zone: OOC_Stanton_', cast(s_suppkey%4+1 as string)) end as ooc,
 case when s_suppkey%3=0 then 'surface' else 'space' end as kind,
 case s_suppkey%12 when 0 then '' when 1 then 'hidden' when 2 then 'cave' when 3 then 'circuit' when 4 then 'tactical' when 5 then 'industry' when 6 then 'logistics' when 7 then 'loot' when 8 then 'racing' when 9 then 'exploration' when 10 then 'hostile_combat' else 'bogus' end as category
from supplier join nation on s_nationkey=n_nationkey
"""

_LEG_SQL = f"""
select l_orderkey as frame_id, {_ORD} as ord, cast((l_orderkey*37 + l_partkey)%1441 - 720 as double) as deg,
 ((l_orderkey*37)%60001-30000)/cast(100 as double) as px, ((l_partkey*531)%60001-30000)/cast(100 as double) as py,
 ((l_orderkey*71+l_partkey)%60001-30000)/cast(100 as double) as pz, p.x as tx, p.y as ty, p.z as tz, p.kind as kind, p.name as name, p.ooc as ooc,
 (l_partkey%201-100)/cast(100 as double) as vx, (l_orderkey%151-75)/cast(100 as double) as vy, (l_suppkey%101-50)/cast(100 as double) as vz,
 (l_orderkey%160)/cast(10 as double) as age
from lineitem join poi p on l_suppkey = p.s_suppkey
"""

_PAIR_SQL = """
select doc_id, concat('images/', coalesce(source,'src'), '_', lpad(cast(doc_id as string),6,'0'), '_row', cast(doc_id%3 as string), '.png') as relpath,
 translate(text, concat(chr(9),chr(10),chr(13)), '   ') as transcript, (doc_id*97)%14000 as width_px, source from documents
"""

_MANIFEST_OLD = """
select concat(p_name,'/',cast(p_partkey as string),'.bin') as path, md5(cast(p_partkey as string)) as digest, p_partkey from part where p_partkey%10<>3
"""

_MANIFEST_NEW = """
select concat(case when p_partkey%5=0 then upper(p_name) else p_name end,'/',cast(p_partkey as string),'.bin') as path,
 md5(cast(case when p_partkey%7=0 then -p_partkey else p_partkey end as string)) as digest, p_partkey from part where p_partkey%10<>7
"""

_LOG_SQL = """
select user_id as sid, event_id, concat('2024-01-01 00:00:00,000 - ocr - INFO - ', case event_type when 'click' then '[otsu] Position extracted: zone' when 'view' then 'Multi-pass consensus: X' when 'error' then case event_id%3 when 0 then 'OCR rejection: sign-flip on X' when 1 then 'OCR rejection: implausible Y-axis speed' else 'OCR rejection: implausible 3D speed' end when 'purchase' then 'ONNX sanity gate: best disagrees' else '[paddle-stats] frames' end) as line from events
"""

_TRACK_TAIL = """
select sid, seq, event_id, {T} as t_capture,
  case when event_type='error' then null when event_id%37=0 then -(50000+wx)/cast(100 as double) when event_id%41=0 then (56000+wx)/cast(100 as double) else (50000+wx)/cast(100 as double) end as x,
  case when event_type='error' then null else (wy-20000)/cast(100 as double) end as y,
  case when event_type='error' then null else (wz+30000)/cast(100 as double) end as z,
  concat('Zone: OOC_Stanton_', cast((sid + {Q})%4+1 as string)) as ooc
from w
"""

_TRACK_DUCK = """
with b as (select user_id as sid, event_id, event_type, epoch_us(ts) as us, cast(round(value*100) as bigint) as c,
  cast(regexp_extract(props,'[0-9]+',0) as bigint) as k from events),
w as (select b.*, row_number() over (partition by sid order by us,event_id) as seq,
  sum((c*7+k)%401-200) over (partition by sid order by us,event_id rows between unbounded preceding and current row) as wx,
  sum((c*11+k)%401-200) over (partition by sid order by us,event_id rows between unbounded preceding and current row) as wy,
  sum((c*13+k)%401-200) over (partition by sid order by us,event_id rows between unbounded preceding and current row) as wz from b)
""" + _TRACK_TAIL.format(T="(us // 10000)/cast(1000000 as double)", Q="seq // 25")

_TARGET_SQL = """
select sid, t_capture as ts, case when seq%40=39 then 'clear' else 'set' end as action,
 cast(1 + (sid*31+seq)%10 as bigint) as suppkey from track where seq%20=1 or seq%40=39
"""


def _from_sql(sql: str, *tables: str, costly: bool = False):
    """``costly`` views feed per-row work that is worth spreading over all cores."""
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        named = {t: table(spark, sf_dir, t) for t in tables}
        if costly:
            named = {t: spread(df) for t, df in named.items()}
        text = sql
        for t in tables:
            text = text.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t} ", f"join {{{t}}} ")
        return spark.sql(text, **named)
    return build


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    # Wall-clock stamps without zone: read them as UTC whatever the session zone is.
    us = F.expr("unix_micros(cast(convert_timezone('UTC', current_timezone(), ts) as timestamp))")
    base = (events.select(
        F.col("user_id").alias("sid"), "event_id", "event_type", us.alias("us"),
        F.round(F.col("value") * 100).cast("bigint").alias("c"),
        F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("k"))
        .withColumn("_block", F.expr(f"us div {int(BLOCK_S * 1e10)}")))
    step = lambda m: (F.col("c") * m + F.col("k")) % 401 - 200
    walked = scan(base, Ordering(("sid",), ("us", "event_id"), ("_block",)),
                  seq=row_index(), wx=running_sum(step(7)), wy=running_sum(step(11)),
                  wz=running_sum(step(13)))
    return spark.sql(_TRACK_TAIL.format(T="(us div 10000)/cast(1000000 as double)", Q="seq div 25")
                     .replace("from w", "from {w}"), w=walked)


def target_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_TARGET_SQL.replace("from track", "from {track}"), track=track(spark, sf_dir))


hud_line = _from_sql(_HUD_SQL, "lineitem", costly=True)
pass_vote = _from_sql(_PASS_SQL, "lineitem")
pixel = _from_sql(_PIXEL_SQL, "lineitem")
poi = _from_sql(_POI_SQL, "supplier", "nation")
pair = _from_sql(_PAIR_SQL, "documents", costly=True)
manifest_old = _from_sql(_MANIFEST_OLD, "part")
manifest_new = _from_sql(_MANIFEST_NEW, "part")
log_line = _from_sql(_LOG_SQL, "events")


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _from_sql(_BOX_SQL, "lineitem")(spark, sf_dir)
    return raw.withColumn("row_idx", F.expr("cast(y div 10 as int)")).drop("row_idx_raw")


def leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _LEG_SQL.replace("from lineitem", "from {lineitem}").replace("join poi", "join {poi}")
    return spark.sql(text, lineitem=spread(table(spark, sf_dir, "lineitem")), poi=poi(spark, sf_dir))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


_DUCK = {
    "track": _TRACK_DUCK,
    "target_event": _TARGET_SQL,
    "hud_line": _HUD_SQL,
    "pass_vote": _PASS_SQL,
    "box": f"select * exclude (row_idx_raw), cast(y // 10 as int) as row_idx from ({_BOX_SQL})",
    "pixel": _PIXEL_SQL,
    "poi": _POI_SQL,
    "leg": _LEG_SQL,
    "pair": _PAIR_SQL,
    "manifest_old": _MANIFEST_OLD,
    "manifest_new": _MANIFEST_NEW,
    "log_line": _LOG_SQL,
}
_NEEDS = {"target_event": ("track",), "leg": ("poi",)}


def duck(*names: str, body: str, recursive: bool = False) -> str:
    """``WITH`` prefix for the named views followed by ``body``.

    ``body`` may start with further common table expressions (``name as (...),``)
    and must end with the final ``select``.
    """
    wanted: list[str] = []
    for name in names:
        for need in (*_NEEDS.get(name, ()), name):
            if need not in wanted:
                wanted.append(need)
    ctes = ", ".join(f"{n} as materialized ({_DUCK[n].strip()})" for n in wanted)
    text = body.strip()
    glue = " " if text.lower().startswith("select") else ", "
    return f"with {'recursive ' if recursive else ''}{ctes}{glue}{text}"
