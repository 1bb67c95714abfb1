"""Voting queries over competing passes of a frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.operators import fixes as T
from wayline.operators import readings as R
from wayline.operators import votes as O
from wayline.plans import text_queries as TX
from wayline.plans import views as V
from wayline.plans.registry import dr, query, r

KEY = ["frame_id"]
_INR = "x is not null and abs(x)<30000 and abs(y)<30000 and abs(z)<30000"
_PAIRS = f"""vv as materialized (select * from pass_vote where {_INR}),
pr as materialized (select a.frame_id, a.ord, a.score as sa, b.ord as ob, b.x, b.y, b.z, b.score as sb, b.ooc, b.location from vv a join vv b on a.frame_id=b.frame_id and abs(a.x-b.x)<=1 and abs(a.y-b.y)<=1 and abs(a.z-b.z)<=1),
cl as materialized (select frame_id, ord, count(*) as size, avg(x) as x, avg(y) as y, avg(z) as z, max(sb) as score, arg_max({{'o':ooc,'l':location}}, (sb, case when ob=ord then 1 else 0 end, -ob)) as best from pr group by 1,2),
cs as materialized (select * from (select *, row_number() over (partition by frame_id order by size desc, ord) as k from cl where size>=2) where k=1)"""
_GLY = "gl as (select o_orderkey as frame_id, cast((o_orderkey*37)%60001-30000 as double) as x, cast((o_orderkey*53)%60001-30000 as double) as y, cast((o_orderkey*71)%60001-30000 as double) as z from orders where o_custkey%2=0)"  # where nothing was read there is no vote
_BEST = "bp as (select * from (select *, row_number() over (partition by frame_id order by score desc, ord) as k from pass_vote) where k=1)"
_GV = f"{_GLY}, {_BEST}, gv as (select gl.frame_id, 4611686018427387904::bigint as ord, 'glyph' as pass, 0.85::double as score, gl.x, gl.y, gl.z, bp.ooc, coalesce(bp.location,'Unknown') as location from gl left join bp on gl.frame_id=bp.frame_id)"


def _glyphs(spark, sf_dir):
    """A row per order; in half of them no glyph was read."""
    o, read = V.table(spark, sf_dir, "orders"), F.col("o_custkey") % 2 == 0
    at = lambda m: F.when(read, ((F.col("o_orderkey") * m) % 60001 - 30000).cast("double"))
    return o.select(F.col("o_orderkey").alias("frame_id"), at(37).alias("x"), at(53).alias("y"), at(71).alias("z"))


@query("j11_vote_neighbourhood", V.duck("pass_vote", body=_PAIRS + " select frame_id, ord, size from cl"))
def j11(spark, sf_dir):
    return O.agreeing(V.pass_vote(spark, sf_dir), KEY)


@query("a7_consensus", V.duck("pass_vote", body=_PAIRS + f" select frame_id, size, {dr('x')} as x, {dr('y')} as y, {dr('z')} as z, score, best.o as ooc, best.l as location from cs"))
def a7(spark, sf_dir):
    c = O.consensus(V.pass_vote(spark, sf_dir), KEY, extra=("ooc", "location"))
    return c.select("frame_id", "size", *[r(F.col(a)).alias(a) for a in "xyz"], "score", "ooc", "location")


@query("j12_glyph_vote", V.duck("pass_vote", body=_GV + " select frame_id, pass, score, x, y, ooc, location from gv"))
def j12(spark, sf_dir):
    return (O.glyph_votes(V.pass_vote(spark, sf_dir), _glyphs(spark, sf_dir), KEY)
            .select("frame_id", "pass", "score", "x", "y", "ooc", "location"))


@query("u2_votes_with_glyph", V.duck("pass_vote", body=_GV + " select frame_id, count(*) as votes, max(score) as top from (select frame_id, score from pass_vote union all select frame_id, score from gv) group by 1"))
def u2(spark, sf_dir):
    passes = V.pass_vote(spark, sf_dir)
    return (O.with_glyph_votes(passes, O.glyph_votes(passes, _glyphs(spark, sf_dir), KEY))
            .groupBy("frame_id").agg(F.count(F.lit(1)).alias("votes"), F.max("score").alias("top")))


@query("t3_best_pass", V.duck("pass_vote", body=_BEST + " select frame_id, ord, pass, score, x, ooc from bp"))
def t3(spark, sf_dir):
    return O.best_pass(V.pass_vote(spark, sf_dir), KEY).select("frame_id", "ord", "pass", "score", "x", "ooc")


@query("t4_glyph_override", V.duck("pass_vote", body=_GV + ", j as (select bp.frame_id, bp.x, bp.ooc, bp.location, gv.x as gx, coalesce(bp.x is not null and greatest(abs(bp.x-gv.x),abs(bp.y-gv.y),abs(bp.z-gv.z))>50, false) as overridden from bp left join gv on gv.frame_id=bp.frame_id) select frame_id, overridden, case when overridden then gx else x end as x, ooc from j"))
def t4(spark, sf_dir):
    passes = V.pass_vote(spark, sf_dir)
    rows = O.glyph_votes(passes, _glyphs(spark, sf_dir), KEY)
    return O.prefer_glyph(O.best_pass(passes, KEY), rows, KEY).select("frame_id", "overridden", "x", "ooc")


@query("t14_known_location", V.duck("pass_vote", body="select frame_id, bool_or(x is not null) as has_position, coalesce(arg_max(location, ord) filter (location <> 'Unknown'), 'Unknown') as location from pass_vote group by 1"))
def t14(spark, sf_dir):
    return R.keep_known_location(V.pass_vote(spark, sf_dir), KEY, "ord")


# The whole way from text to a fix ----------------------------------------------------
_FIX = (TX._SPLIT.replace("select frame_id, line_no,", "select frame_id, line_no, variant,") + f""", fc as materialized (select *, {TX._corrected('t')} as tc from sp),
fk as (select *, string_split(tc, chr(10)) as l from fc), fd as (select *, len(regexp_extract_all(l[1],'-?\\d+\\.\\d{{1,4}}')) as n1, len(regexp_extract_all(coalesce(l[2],''),'-?\\d+\\.\\d{{1,4}}')) as n2 from fk),
fj as (select frame_id, line_no, variant, case when len(l)=1 then tc when lower(rtrim(l[1])) like '%pos:' and regexp_matches(l[2],'\\d') then concat(rtrim(l[1]),' ',trim(l[2]))
 when regexp_matches(l[1],'(^|[^A-Za-z])[Pp9][0oOaA9qQ][sSa56][:\\s;,.!iI|\\-]','i') and n1 < 3 and regexp_matches(trim(l[2]),'^-?\\d') and n2 > 0 then concat(rtrim(l[1]),' ',trim(l[2])) else tc end as j from fd),
fl as materialized (select frame_id, line_no, variant, i, trim(string_split(j,chr(10))[i]) as c from fj, unnest([1,2]) as u(i) where trim(coalesce(string_split(j,chr(10))[i],'')) <> ''),
""" + TX.parsed_ctes("fl", "c", "fp", "frame_id, line_no, variant, i, c") + f""",
{_GLY},
fr as (select p.frame_id, p.line_no, p.variant, p.i, p.c, {TX._POSLINE} as isp, case when {TX._POSLINE} then coalesce(gl.x, p.x) end as x, case when {TX._POSLINE} then coalesce(gl.y, p.y) end as y, case when {TX._POSLINE} then coalesce(gl.z, p.z) end as z, {TX._ZONE} as zone
 from fp p left join gl on gl.frame_id=p.frame_id),
fg as (select *, coalesce(isp and {TX._INR}, false) as good from fr),
fv as (select frame_id, line_no, max(variant) as variant, count(*) filter (good) as n, bool_or(lower(c) like '%km%') as km, arg_max({{'x':x,'y':y,'z':z,'o':zone}}, i) filter (good) as p from fg group by 1,2),
pv as (select h.frame_id, h.line_no as ord, cast(case when h.variant%4=1 then 10 else 0 end + 10*coalesce(n,0) + case when n>0 then 5 else 0 end + case when km then 5 else 0 end as double) as score,
 p.x as x, p.y as y, p.z as z, p.o as ooc, case when h.variant%4=1 then 'Stanton' else 'Unknown' end as location from hud_line h left join fv using (frame_id, line_no)),
pb as (select * from (select *, row_number() over (partition by frame_id order by score desc, ord) as k from pv) where k=1),
gp as (select gl.frame_id, 4611686018427387904::bigint as ord, 0.85::double as score, gl.x, gl.y, gl.z, pb.ooc, coalesce(pb.location,'Unknown') as location from gl left join pb using (frame_id)),
pass_vote as materialized (select * from pv union all select * from gp), """ + _PAIRS + """,
ab as (select * from (select *, row_number() over (partition by frame_id order by score desc, ord) as k from pass_vote) where k=1),
ov as (select ab.frame_id, coalesce(ab.x is not null and greatest(abs(ab.x-gp.x),abs(ab.y-gp.y),abs(ab.z-gp.z))>50, false) as o, ab.x, ab.y, ab.z, ab.ooc, ab.location, gp.x as gx, gp.y as gy, gp.z as gz, gp.ooc as go, gp.location as gl from ab left join gp using (frame_id))""")


@query("text_to_fix", V.duck("hud_line", body=_FIX + f""" select ov.frame_id, {dr('case when cs.frame_id is not null then cs.x when o then gx else ov.x end')} as x, {dr('case when cs.frame_id is not null then cs.z when o then gz else ov.z end')} as z,
 case when cs.frame_id is not null then cs.best.o when o then go else ov.ooc end as ooc, case when cs.frame_id is not null then cs.best.l when o then gl else ov.location end as location,
 case when cs.frame_id is not null then 'consensus' when o then 'glyph' else 'best' end as decided from ov left join cs on cs.frame_id=ov.frame_id"""))
def text_to_fix(spark, sf_dir):
    """Passes of one broken line each, some with a line that names the system before it."""
    text = F.when(F.col("variant") % 4 == 1, F.concat(F.lit("Zone: SolarSystem_Stan\n"), TX._split_text())).otherwise(TX._split_text())
    passes = V.hud_line(spark, sf_dir).select("frame_id", F.col("line_no").alias("ord"), F.lit("text").alias("pass"), text.alias("text"))
    out = T.text_to_fix(passes, KEY, _glyphs(spark, sf_dir))
    return out.select("frame_id", r(F.col("x")).alias("x"), r(F.col("z")).alias("z"), "ooc", "location", "decided")
