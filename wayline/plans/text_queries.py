"""Repairing and parsing text lines, and the per-frame reading rules built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.functions import text as X
from wayline.operators import readings as R
from wayline.plans import views as V
from wayline.plans.registry import dr, query, r

# SQL twins -----------------------------------------------------------------
# The oracle engine's patterns have no look-around, so each step is written with
# captured neighbours instead. Steps that need characters the fixture lines
# never contain (J, Z before a digit, G or O between digits, split decimals)
# are left out here and covered by unit tests.


def _fold(expr: str, steps: list[tuple[str, str]]) -> str:
    for pattern, by in steps:
        expr = f"regexp_replace({expr}, '{pattern}', '{by}', 'g')"
    return expr


def _corrected(e: str) -> str:
    for wrong, right in X.CORRECTIONS:
        if wrong in ("Zane:", "Zore:", "Rcot", "R0ot", "GGC"):
            e = f"replace({e}, '{wrong}', '{right}')"
    return e


_TOKEN = "[Pp9][0oOaA9qQ][sSa56]"
# Two passes per marker: a token right after another one is seen by the second.
_KEYWORD = ([(f"(^|[^A-Za-z]){_TOKEN}[:;,.!iI|]", "\\1" + "\u0002")] * 2
            + [(f"(^|[^A-Za-z]){_TOKEN}[ \\t]", "\\1" + "\u0003")] * 2
            + [(f"(^|[^A-Za-z]){_TOKEN}", "\\1" + "\u0004")] * 2
            + [("\u0002", "Pos:"), ("\u0003", "Pos "), ("\u0004", "Pos")])
_STEPS = [("(\\S)([Pp]os:)", "\\1 \\2"), ("(Pos:?)[\\s_]+", "\\1 "), *_KEYWORD,
          ("(\\d)k[^\\s\\-\\d]([\\s\\-\\d]|$)", "\\1km\\2"),
          ("(\\d)k([\\s\\-]|$)", "\\1km\\2"),
          ("(\\dkm)[a-zA-Z0-9](\\s|$)", "\\1\\2"),
          ("([\\d.])[lLiI1]?[kK][mMnNhH]([\\s_\\-\\d]|$)", "\\1km\\2"),
          ("km[\\s_]+(-?\\d)", "km \\1"), ("(\\d),(\\d)", "\\1.\\2"),
          ("(\\d)\\s+(\\d{3,4})(\\s*km)", "\\1.\\2\\3"),
          ("([Pp]os:)(-?\\d)", "\\1 \\2")]


def _normal(e: str) -> str:
    return _fold(e, _STEPS)


_AX = "(?:(-?\\d+\\.\\d{3,4})\\s*km|(-?\\d+\\.\\d{1,2})\\s*m)"
_LAST = "(?:(-?\\d+\\.\\d{3,4})\\s*km|(-?\\d+\\.\\d{1,2})\\s*m(?:[^kK]|$))"
_CUT = "(?:(-?\\d+\\.\\d{2,4})\\s*km|(-?\\d+\\.\\d{1,2})\\s*m(?:[^kK]|$))"
_S = f"pos:?\\s*{_AX}\\s*{_AX}\\s*{_LAST}"
_R = f"pos:?\\s*{_AX}\\s*{_AX}\\s*{_CUT}"
_H = f"{_AX}\\s*{_AX}\\s*{_CUT}"
_HINT = X.ZONE_HINT.replace("(?i)", "")
_G6 = "['a','b','c','d','e','f']"


def _km(s: str, a: str, b: str) -> str:
    return f"case when {s}.{a} <> '' then cast({s}.{a} as double) else cast({s}.{b} as double)/1000 end"


def parsed_ctes(source: str, line: str, out: str, keep: str) -> str:
    """CTE chain giving ``keep`` columns plus n, method, x, y, z."""
    ok = lambda p: f"regexp_matches(n, '{p}', 'i')"
    rec = "(case when len(dg) >= 3 and {0} < 30000 then case when sg[{1}]='-' then -({0}) else {0} end end)"
    rx = [rec.format(f"cast(dg[{i}] as double)/10000", i) for i in (1, 2, 3)]
    return f"""
{out}_n as materialized (select {keep}, {_normal(line)} as n from {source}),
{out}_g as materialized (select *, case when {ok(_S)} then 'strict' when {ok(_R)} then 'relaxed' when regexp_matches(n,'{_HINT}','i') and {ok(_H)} then 'headless' end as m,
  regexp_extract_all(n, '(-?)(\\d{{6,9}})\\s*km', 2, 'i') as dg, regexp_extract_all(n, '(-?)(\\d{{6,9}})\\s*km', 1, 'i') as sg from {out}_n),
{out}_h as materialized (select *, case m when 'strict' then regexp_extract(n, '{_S}', {_G6}, 'i') when 'relaxed' then regexp_extract(n, '{_R}', {_G6}, 'i') when 'headless' then regexp_extract(n, '{_H}', {_G6}, 'i') end as s from {out}_g),
{out}_x as materialized (select *, {_km('s','a','b')} as mx, {_km('s','c','d')} as my, {_km('s','e','f')} as mz, {rx[0]} as qx, {rx[1]} as qy, {rx[2]} as qz from {out}_h),
{out}_y as materialized (select *, m is not null and (m <> 'headless' or (abs(mx)<30000 and abs(my)<30000 and abs(mz)<30000)) as hit, qx is not null and qy is not null and qz is not null as resc from {out}_x),
{out} as materialized (select {keep}, n, case when hit then m when resc then 'decimal_recovery' end as method,
  case when hit then mx when resc then qx end as x, case when hit then my when resc then qy end as y, case when hit then mz when resc then qz end as z from {out}_y)"""


_LINE_KEEP = "frame_id, line_no, score, text, c"
_CORR = f"hl as materialized (select *, {_corrected('text')} as c from hud_line)"
_PARSED = _CORR + "," + parsed_ctes("hl", "c", "pl", _LINE_KEEP)
_POSLINE = ("(lower(c) like '%pos:%' and not (c like '%Zone:%' and c like '%SolarSystem%') "
            "and not regexp_matches(c, '(^|[^a-zA-Z])r[o0e]{1,3}t([^a-zA-Z]|$)|solar\\s*system', 'i'))")
_INR = "(abs(x)<30000 and abs(y)<30000 and abs(z)<30000)"
_ZONE = "case when trim(regexp_extract(c,'^(.*?)\\s*pos:?\\s*',1,'i'))='' then 'Unknown' else trim(regexp_extract(c,'^(.*?)\\s*pos:?\\s*',1,'i')) end"


def _lines(spark, sf_dir):
    return V.hud_line(spark, sf_dir)


def _parsed(spark, sf_dir):
    df = _lines(spark, sf_dir).withColumn("c", X.correct_literals(F.col("text")))
    return X.parse_position(df.withColumn("n", X.normalize_line(F.col("c"))), "n")


@query("f21_literal_corrections", V.duck("hud_line", body=f"select frame_id, line_no, {_corrected('text')} as fixed from hud_line"))
def f21(spark, sf_dir):
    return _lines(spark, sf_dir).select("frame_id", "line_no", X.correct_literals(F.col("text")).alias("fixed"))


@query("f22_line_normal_form", V.duck("hud_line", body=_CORR + f" select frame_id, line_no, {_normal('c')} as n from hl"))
def f22(spark, sf_dir):
    fixed = X.normalize_line(X.correct_literals(F.col("text")))
    return _lines(spark, sf_dir).select("frame_id", "line_no", fixed.alias("n"))


@query("f23_position_parse", V.duck("hud_line", body=_PARSED + f" select frame_id, line_no, method, {dr('x')} as x, {dr('y')} as y, {dr('z')} as z from pl"))
def f23(spark, sf_dir):
    return _parsed(spark, sf_dir).select(
        "frame_id", "line_no", F.col("pos.method").alias("method"),
        *[r(F.col(f"pos.{a}")).alias(a) for a in "xyz"])


@query("f25_zone_name", V.duck("hud_line", body=_CORR + f" select frame_id, line_no, {_ZONE} as zone from hl"))
def f25(spark, sf_dir):
    c = X.correct_literals(F.col("text"))
    return _lines(spark, sf_dir).select("frame_id", "line_no", X.zone_name(c).alias("zone"))


@query("p7_coordinate_range", V.duck("hud_line", body=_PARSED + f" select frame_id, line_no from pl where x is not null and {_INR}"))
def p7(spark, sf_dir):
    ok = X.in_range(F.col("pos.x"), F.col("pos.y"), F.col("pos.z"))
    return _parsed(spark, sf_dir).filter(ok).select("frame_id", "line_no")


@query("p8_absolute_frame", V.duck("hud_line", body="select frame_id, line_no from hud_line where regexp_matches(text, '(^|[^a-zA-Z])r[o0e]{1,3}t([^a-zA-Z]|$)|solar\\s*system', 'i')"))
def p8(spark, sf_dir):
    return _lines(spark, sf_dir).filter(X.is_absolute_frame(F.col("text"))).select("frame_id", "line_no")


@query("p9_metre_line", V.duck("hud_line", body="select frame_id, line_no from (select *, replace(text,'km','m') as t from hud_line where variant in (0,1,7)) where not regexp_matches(t,'\\d+\\.\\d+\\s*km\\b','i') and regexp_matches(t,'\\d+\\.\\d+\\s*m\\b','i') union all select frame_id, line_no from hud_line where variant not in (0,1,7) and not regexp_matches(text,'\\d+\\.\\d+\\s*km\\b','i') and regexp_matches(text,'\\d+\\.\\d+\\s*m\\b','i')"))
def p9(spark, sf_dir):
    t = F.when(F.col("variant").isin(0, 1, 7), F.replace("text", F.lit("km"), F.lit("m"))).otherwise(F.col("text"))
    return _lines(spark, sf_dir).filter(X.is_metre_line(t)).select("frame_id", "line_no")


@query("p10_confidence_floor", V.duck("hud_line", body="select frame_id, line_no, score from hud_line where score >= 0.30"))
def p10(spark, sf_dir):
    return R.confident(_lines(spark, sf_dir)).select("frame_id", "line_no", "score")


_DET = "det as materialized (select frame_id, line_no, 3 as n_text, [concat(split_part(text,' Pos',1)), split_part(text,' ',2), text] as texts, [score, score/2] as scores from hud_line)"


@query("s10_flatten_detections", V.duck("hud_line", body=_DET + " select frame_id, line_no, cast(i-1 as int) as pos, texts[i] as text, coalesce(scores[i], cast(0 as double)) as score from det, unnest([1,2,3]) as u(i)"))
def s10(spark, sf_dir):
    packed = _lines(spark, sf_dir).select(
        "frame_id", "line_no",
        F.array(F.split_part("text", F.lit(" Pos"), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2)),
                F.col("text")).alias("texts"),
        F.array(F.col("score"), F.col("score") / 2).alias("scores"))
    return R.flatten_detections(packed)


_SPLIT = ("sp as materialized (select frame_id, line_no, case when variant in (2,6) then replace(text,'km -','km' || chr(10) || '-') "
          "when variant=3 then replace(text,'Pos:_','Pos:' || chr(10)) else replace(text,' Pos: ',' Pos:' || chr(10) || ' ') end as t from hud_line)")


def _split_text():
    v, t = F.col("variant"), F.col("text")
    return (F.when(v.isin(2, 6), F.replace(t, F.lit("km -"), F.lit("km\n-")))
            .when(v == 3, F.replace(t, F.lit("Pos:_"), F.lit("Pos:\n")))
            .otherwise(F.replace(t, F.lit(" Pos: "), F.lit(" Pos:\n "))))


@query("w25_orphan_rejoin", V.duck("hud_line", body=_SPLIT + """,
k as (select *, string_split(t, chr(10)) as l from sp),
d as (select *, len(regexp_extract_all(l[1],'-?\\d+\\.\\d{1,4}')) as n1, len(regexp_extract_all(coalesce(l[2],''),'-?\\d+\\.\\d{1,4}')) as n2 from k)
select frame_id, line_no, case when len(l)=1 then t
 when lower(rtrim(l[1])) like '%pos:' and regexp_matches(l[2],'\\d') then concat(rtrim(l[1]),' ',trim(l[2]))
 when regexp_matches(l[1],'(^|[^A-Za-z])[Pp9][0oOaA9qQ][sSa56][:\\s;,.!iI|\\-]','i') and n1 < 3 and regexp_matches(trim(l[2]),'^-?\\d') and n2 > 0 then concat(rtrim(l[1]),' ',trim(l[2]))
 else t end as text from d"""))
def w25(spark, sf_dir):
    return _lines(spark, sf_dir).select("frame_id", "line_no", X.rejoin_orphans(_split_text()).alias("text"))


@query("g2_text_lines", V.duck("hud_line", body=_SPLIT + " select frame_id, line_no, cast(i-1 as int) as pos, trim(string_split(t,chr(10))[i]) as line from sp, unnest([1,2]) as u(i) where trim(coalesce(string_split(t,chr(10))[i],'')) <> ''"))
def g2(spark, sf_dir):
    df = _lines(spark, sf_dir).select("frame_id", "line_no", _split_text().alias("t"))
    return X.text_lines(df, "t", number="pos")


@query("a20_partial_coordinates", V.duck("hud_line", body="select frame_id, cast(max(case when regexp_matches(text,'[Pp9][0oOaA9qQ][sSa56][:\\s]\\s*-?\\d+\\.\\d|[Pp]os:?\\s*-?\\d+\\.\\d') then len(regexp_extract_all(text,'-?\\d+\\.\\d{2,4}')) else 0 end) as int) as partial from hud_line group by 1"))
def a20(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("frame_id").agg(F.max(X.partial_count(F.col("text"))).alias("partial"))


_J4 = "case when sid is null then null when sid like '%9948564368677%' or '9948564368677' like concat('%',sid,'%') or sid like '%Stanton%' or 'Stanton' like concat('%',sid,'%') then 'Stanton' else 'Unknown' end"
_SYSL = ("sys as materialized (select frame_id, line_no, regexp_replace(text, 'OOC_Stanton_[0-9]', concat('SolarSystem_', case variant when 0 then '9948564368677' when 1 then 'Stan' when 2 then '4368' when 3 then 'StantonX' "
         "else concat(cast(line_no%1000 as varchar), 'zz') end)) as line from hud_line)")


@query("j4_system_lookup", V.duck("hud_line", body=_SYSL + f", e as (select *, nullif(trim(regexp_extract(line,'Zone:\\s*SolarSystem[_-]?([\\d\\w]+?)(?:Pos|Zone|$|\\s)',1,'i')),'') as sid from sys) select frame_id, line_no, sid as system_id, {_J4} as location from e"))
def j4(spark, sf_dir):
    """The recognised lines, with a system's id where they name a zone."""
    v = F.col("variant")
    ident = (F.when(v == 0, "9948564368677").when(v == 1, "Stan").when(v == 2, "4368").when(v == 3, "StantonX")
             .otherwise(F.concat((F.col("line_no") % 1000).cast("string"), F.lit("zz"))))
    line = F.regexp_replace(F.col("text"), F.lit("OOC_Stanton_[0-9]"), F.concat(F.lit("SolarSystem_"), ident))
    return (_lines(spark, sf_dir).select("frame_id", "line_no", X.system_id(line).alias("system_id"))
            .withColumn("location", X.system_location(F.col("system_id"))))


@query("t1_first_valid_parse", V.duck("hud_line", body=_PARSED + f" select frame_id, arg_min(line_no,line_no) as line_no, arg_min(method,line_no) as method, {dr('arg_min(x,line_no)')} as x from pl where x is not null group by 1"))
def t1(spark, sf_dir):
    return (R.first_valid(_parsed(spark, sf_dir).select("frame_id", "line_no", "pos.*"), ["frame_id"])
            .select("frame_id", "line_no", "method", r(F.col("x")).alias("x")))


@query("t2_last_valid_line", V.duck("hud_line", body=_PARSED + f" select frame_id, arg_max(line_no,line_no) as line_no, arg_max({_ZONE},line_no) as ooc, {dr('arg_max(x,line_no)')} as x, {dr('arg_max(z,line_no)')} as z from pl where {_POSLINE} and x is not null and {_INR} group by 1"))
def t2(spark, sf_dir):
    lines = R.read_lines(_lines(spark, sf_dir), "text")
    return (R.last_valid(lines, ["frame_id"])
            .select("frame_id", "line_no", "ooc", r(F.col("x")).alias("x"), r(F.col("z")).alias("z")))


_READ = _PARSED + f""", rd as materialized (select *, {_POSLINE} as isp, ({_POSLINE} and x is not null and {_INR}) as good from pl)"""


@query("a8_pass_score", V.duck("hud_line", body=_READ + " select frame_id, cast(10*count(*) filter (good) + case when count(*) filter (good) > 0 then 5 else 0 end + case when bool_or(lower(c) like '%km%') then 5 else 0 end as bigint) as score from rd group by 1"))
def a8(spark, sf_dir):
    return R.pass_scores(R.read_lines(_lines(spark, sf_dir), "text"), ["frame_id"]).select("frame_id", "score")


@query("a9_frame_score", V.duck("hud_line", body=_READ + f" select frame_id, {dr('avg(score) + case when bool_or(good) then 0.1 else 0 end')} as score from rd where score >= 0.30 group by 1"))
def a9(spark, sf_dir):
    lines = R.read_lines(R.confident(_lines(spark, sf_dir)), "text")
    return R.frame_scores(lines, ["frame_id"]).select("frame_id", r(F.col("score")).alias("score"))


@query("a6_read_counters", V.duck("hud_line", body=_READ + """, fr as (select frame_id, frame_id%10 as sid, count(*) filter (score < 0.30) as below, count(*) filter (score >= 0.30) as kept,
 count(*) filter (score >= 0.30 and isp and x is null) as rf, count(*) filter (score >= 0.30 and isp and x is not null and not (abs(x)<30000 and abs(y)<30000 and abs(z)<30000)) as oor, coalesce(bool_or(good and score >= 0.30), false) as acc from rd group by 1)
select sid, count(*) as frames, count(*) filter (acc) as accepted, cast(sum(below) as bigint) as below_conf, cast(sum(rf) as bigint) as regex_fail, cast(sum(oor) as bigint) as out_of_range, round(100.0*count(*) filter (acc)/cast(greatest(1,count(*)) as double),6)+0::double as accept_pct from fr group by 1"""))
def a6(spark, sf_dir):
    lines = R.read_lines(_lines(spark, sf_dir), "text").withColumn("sid", F.col("frame_id") % 10)
    return (R.read_counters(lines, ["sid"], "frame_id")
            .select("sid", "frames", "accepted", "below_conf", "regex_fail", "out_of_range",
                    r(F.col("accept_pct")).alias("accept_pct")))


@query("j17_one_row_per_frame", V.duck("hud_line", body=_PARSED + f", best as (select frame_id, arg_max(x,line_no) as x, arg_max({_ZONE},line_no) as ooc from pl where {_POSLINE} and x is not null and {_INR} and score >= 0.6 group by 1) select o_orderkey as frame_id, {dr('x')} as x, ooc, 'Unknown' as location from orders left join best on frame_id=o_orderkey"))
def j17(spark, sf_dir):
    frames = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_id"))
    reads = R.last_valid(R.read_lines(R.confident(_lines(spark, sf_dir), 0.6), "text"), ["frame_id"])
    return (R.every_frame(frames, reads, ["frame_id"])
            .select("frame_id", r(F.col("x")).alias("x"), "ooc", "location"))
