"""Pixel, box, template and manifest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.functions import text as X
from wayline.operators import pixels as P
from wayline.operators import quality as Q
from wayline.operators import snapshots as N
from wayline.operators import templates as M
from wayline.plans import views as V
from wayline.plans.registry import dr, query, r
from wayline.session import shares

KEY, ROW = ["frame_id"], ["frame_id", "row_idx"]

_OTSU = """lv as (select frame_id, v as t, count(*) as n from pixel group by 1,2),
cu as (select *, cast(sum(n) over w as double) as wb, cast(sum(t*n) over w as double) as sb, cast(sum(n) over (partition by frame_id) as double) as tw, cast(sum(t*n) over (partition by frame_id) as double) as ts from lv window w as (partition by frame_id order by t rows unbounded preceding)),
va as (select *, case when tw>wb then wb*(tw-wb)*power(sb/wb-(ts-sb)/(tw-wb),2) end as var from cu),
ot as materialized (select frame_id, coalesce(arg_max(t, (var, -t)) filter (var > 0), 0) as threshold from va group by 1)"""
_DENS = _OTSU + ", dn as materialized (select p.frame_id, y, avg(case when v>=threshold then 1.0 else 0.0 end) as density from pixel p join ot on p.frame_id=ot.frame_id group by 1,2)"
_BAND = _DENS + """, rn as (select *, y - row_number() over (partition by frame_id order by y) as run from dn where density > 0.04),
b0 as (select frame_id, min(y) as y0, max(y)+1 as y1 from rn group by frame_id, run having count(*) >= 6),
bd as materialized (select *, cast(row_number() over (partition by frame_id order by y0) as int) as band from b0)"""


def _density(spark, sf_dir):
    return P.row_density(P.with_foreground(V.pixel(spark, sf_dir), KEY), KEY)


def _bands(spark, sf_dir):
    return P.text_bands(_density(spark, sf_dir), KEY, F.col("density") > P.BAND_DENSITY)


@query("a14_otsu_threshold", V.duck("pixel", body=_OTSU + " select frame_id, threshold from ot"))
def a14(spark, sf_dir):
    return P.otsu_thresholds(V.pixel(spark, sf_dir), KEY)


@query("a15_leading_channel", V.duck("pixel", body="pc as (select frame_id, y, x, v as r, (v*frame_id)%220 as g, v//2 as b from pixel), mn as (select frame_id, avg(r)-avg(g) as d from pc group by 1) select frame_id, case when d>15 then 'red' when -d>15 then 'green' else 'brightest' end as channel, cast((select sum(case when d>15 then r when -d>15 then g else greatest(r,g,b) end) from pc where pc.frame_id=mn.frame_id) as bigint) as total from mn"))
def a15(spark, sf_dir):
    px = V.pixel(spark, sf_dir)
    rgb = px.select("frame_id", "y", "x", F.col("v").alias("r"), ((F.col("v") * F.col("frame_id")) % 220).alias("g"), F.expr("v div 2").alias("b"))
    return P.channel_value(rgb, KEY).groupBy("frame_id", "channel").agg(F.sum("v").alias("total"))


@query("a16_row_density", V.duck("pixel", body=_DENS + f" select frame_id, y, {dr('density')} as density from dn"))
def a16(spark, sf_dir):
    return _density(spark, sf_dir).select("frame_id", "y", r(F.col("density")).alias("density"))


@query("w18_text_bands", V.duck("pixel", body=_BAND + " select frame_id, band, y0, y1 from bd"))
def w18(spark, sf_dir):
    return _bands(spark, sf_dir).select("frame_id", "band", "y0", "y1")


@query("w19_third_band", V.duck("pixel", body=_BAND + ", nb as (select *, lag(y1) over w as pa, coalesce(lead(y0) over w, 60) as nx from bd window w as (partition by frame_id order by band)) select frame_id, greatest(y0-4, (pa+y0)//2) as top, least(y1+4, (y1+nx)//2) as bottom from nb where band=3"))
def w19(spark, sf_dir):
    return P.nth_band(_bands(spark, sf_dir), KEY, 3, 60)


@query("p18_box_support", V.duck("box", body="select f2 as frame_id, row_idx, count(*) as glyphs, count(glyph) as confident from (select *, frame_id//20 as f2 from box) where w>=4 group by 1,2 having count(*)>=8 and count(glyph)>=6"))
def p18(spark, sf_dir):
    b = V.box(spark, sf_dir).withColumn("frame_id", F.expr("frame_id div 20"))
    return P.supported_rows(P.large_enough(b), ROW)


_MERGE = """sx as (select frame_id, row_idx, x, max(x+w) as x1, min(y) as y0, max(y+h) as y1 from box group by 1,2,3),
rc as (select *, max(x1) over (partition by frame_id, row_idx order by x rows between unbounded preceding and 1 preceding) as reach from sx),
ic as (select *, sum(case when x-reach>=2 then 1 else 0 end) over (partition by frame_id, row_idx order by x rows unbounded preceding) as i from rc)"""


@query("w20_merge_boxes", V.duck("box", body=_MERGE + " select frame_id, row_idx, min(x) as x, min(y0) as y, max(x1)-min(x) as w, max(y1)-min(y0) as h from ic group by frame_id, row_idx, i"))
def w20(spark, sf_dir):
    return P.merge_boxes(V.box(spark, sf_dir), ROW, tasks=shares(V.table(spark, sf_dir, "lineitem")))


@query("w21_row_text", V.duck("box", body="lg as (select *, lag(x+w) over (partition by frame_id, row_idx order by x, id) as pe from box) select frame_id, row_idx, string_agg(concat(case when x-pe>6 then ' ' else '' end, coalesce(glyph,'?')), '' order by x, id) as text from lg group by 1,2"))
def w21(spark, sf_dir):
    return P.row_text(V.box(spark, sf_dir), ROW)


@query("w21_row_text_readable", V.duck("box", body="lg as (select *, lag(x+w) over (partition by frame_id, row_idx order by x, id) as pe from box where glyph is not null) select frame_id, row_idx, string_agg(concat(case when x-pe>18 then ' ' else '' end, glyph), '' order by x, id) as text from lg group by 1,2"))
def w21b(spark, sf_dir):
    return P.row_text(V.box(spark, sf_dir), ROW, gap=P.DATASET_SPACE_GAP, unknown=None)


@query("a23_row_bounds", V.duck("box", body="select frame_id, row_idx, greatest(0,min(x)-2) as x1, greatest(0,min(y)-2) as y1, least(120,max(x+w)+2) as x2, least(45,max(y+h)+2) as y2, min(case when glyph is not null then x end) as first_x from box group by 1,2"))
def a23(spark, sf_dir):
    return P.row_bounds(V.box(spark, sf_dir), ROW, 120, 45, "glyph")


@query("j16_box_classes", V.duck("box", body="select frame_id, id, x, w, glyph, score from box where score>=0.5"))
def j16(spark, sf_dir):
    b = V.box(spark, sf_dir)
    found = b.filter("score >= 0.5").select("frame_id", "id", "glyph", "score")
    return P.with_classification(b.select("frame_id", "id", "x", "w"), found, ["frame_id", "id"])


# Templates --------------------------------------------------------------------
_TPL = """ev as materialized (select vec_id, label, list_transform(embedding, lambda e: cast(e as double)) as v from embeddings),
tm as (select label, pos, avg(v[pos]) as m from ev, unnest(range(1,65)) as u(pos) group by 1,2),
tl as (select label, list(m order by pos) as m from tm group by 1),
tc as (select label, list_transform(m, lambda e: e - list_avg(m)) as c from tl),
tp as materialized (select label, list_transform(c, lambda e: e / sqrt(list_sum(list_transform(c, lambda q: q*q)))) as t from tc),
ec as materialized (select vec_id, label, list_transform(v, lambda e: e - list_avg(v)) as c from ev)"""
_SCORED = _TPL + """, sr as materialized (select vec_id, ec.label, tp.label as cand, list_dot_product(c, t)/sqrt(list_dot_product(c,c)) as s from ec, tp),
bs as materialized (select vec_id, label, arg_max(cand, (s, -cand)) as best, max(s) as score from sr group by 1,2)"""


def _tpl(spark, sf_dir):
    return M.build_templates(V.embeddings(spark, sf_dir), "label", "embedding")


def _best(spark, sf_dir):
    e = V.embeddings(spark, sf_dir)
    return M.score_against(e, "embedding", _tpl(spark, sf_dir), "label")


@query("a10_class_templates", "with " + _TPL + f" select label, cast(pos-1 as int) as pos, {dr('t[pos]')} as v from tp, unnest(range(1,65)) as u(pos)")
def a10(spark, sf_dir):
    t = _tpl(spark, sf_dir).select("label", F.posexplode("template").alias("pos", "v"))
    return t.select("label", "pos", r(F.col("v")).alias("v"))


@query("j14_template_scores", "with " + _SCORED + f" select vec_id, best, {dr('score')} as score from bs")
def j14(spark, sf_dir):
    return _best(spark, sf_dir).select("vec_id", "best", r(F.col("score")).alias("score"))


@query("f29_correlation", "with " + _SCORED + f" select vec_id, {dr('s')} as score from sr where cand=label")
def f29(spark, sf_dir):
    e = V.embeddings(spark, sf_dir).join(_tpl(spark, sf_dir), "label")
    return e.select("vec_id", r(M.correlation(M.doubles(F.col("embedding")), F.col("template"))).alias("score"))


@query("f29_shifted_correlation", "with " + _TPL + f""", sh as (select dx, dy from unnest(range(-2,3)) as a(dx), unnest(range(-1,2)) as b(dy)),
ts as materialized (select label as cand, dx, dy, list_transform(range(0,64), lambda i: t[(((i//8)+dy+8)%8)*8 + ((i%8)+dx+8)%8 + 1]) as t from tp, sh),
sr as (select vec_id, cand, max(list_dot_product(c,t)/sqrt(list_dot_product(c,c))) as s from ec, ts group by 1,2)
select vec_id, arg_max(cand,(s,-cand)) as best, {dr('max(s)')} as score from sr group by 1""")
def f29s(spark, sf_dir):
    e = V.embeddings(spark, sf_dir)
    scored = M.score_against(e, "embedding", _tpl(spark, sf_dir), "label", (8, 8), M.SHIFT_X, M.SHIFT_Y)
    return scored.select("vec_id", "best", r(F.col("score")).alias("score"))


@query("t5_class_or_reject", "with " + _SCORED + f" select vec_id, case when score>=0.78 then cast(best as string) when vec_id%12<=8 and vec_id%9<=6 then '.' end as char, case when score<0.78 and vec_id%12<=8 and vec_id%9<=6 then 0.99::double else {dr('score')} end as score from bs")
def t5(spark, sf_dir):
    b = _best(spark, sf_dir)
    kept = M.accept_class(F.col("best"), r(F.col("score")), width=F.col("vec_id") % 9, height=F.col("vec_id") % 12, has_dot=False)
    return b.select("vec_id", kept.alias("k")).select("vec_id", "k.char", "k.score")


@query("a17_accuracy", "with " + _SCORED + f" select label, {dr('avg(case when best=label then 1.0 else 0 end)')} as accuracy from bs group by 1")
def a17(spark, sf_dir):
    a = Q.accuracy(_best(spark, sf_dir), ["label"], "best", "label")
    return a.select("label", r(F.col("accuracy")).alias("accuracy"))


@query("a21_candidate_ranking", "with " + _SCORED + f", cm as (select vec_id%7 as candidate, label, avg(s) as s from sr where cand=label group by 1,2) select candidate, {dr('avg(s)')} as mean, count(*) as members from cm group by 1")
def a21(spark, sf_dir):
    own = V.embeddings(spark, sf_dir).join(_tpl(spark, sf_dir), "label").select(
        (F.col("vec_id") % 7).alias("candidate"), "label", M.correlation(M.doubles(F.col("embedding")), F.col("template")).alias("s"))
    members = own.groupBy("candidate", "label").agg(F.avg("s").alias("s"))
    ranked = Q.rank_candidates(members, "candidate", "label", "s")
    return ranked.select("candidate", r(F.col("mean")).alias("mean"), F.size("scores").cast("bigint").alias("members"))


def _nearest_axis(batches):
    """Sample user classifier: the largest component names the class."""
    for pdf in batches:
        top = [max(range(len(v)), key=lambda i: v[i]) for v in pdf["embedding"]]
        yield pdf[["vec_id"]].assign(char=[str(i) for i in top], score=[float(v[i]) for v, i in zip(pdf["embedding"], top)])


@query("x1_user_classifier", f"with v as (select vec_id, embedding, list_position(embedding, list_max(embedding))-1 as i from embeddings) select vec_id, cast(i as string) as char, {dr('embedding[i+1]')} as score from v")
def x1(spark, sf_dir):
    e = V.embeddings(spark, sf_dir).select("vec_id", "embedding")
    return M.classify_with(e, _nearest_axis, ["vec_id"]).select("vec_id", "char", r(F.col("score")).alias("score"))


# Manifests --------------------------------------------------------------------

@query("j13_manifest_delta", V.duck("manifest_old", "manifest_new", body="select coalesce(n.path,o.path) as path, case when n.path is null then 'deleted' else 'changed' end as change from manifest_old o full outer join manifest_new n on lower(o.path)=lower(n.path) where n.path is null or o.digest is distinct from n.digest"))
def j13(spark, sf_dir):
    return N.manifest_delta(V.manifest_old(spark, sf_dir), V.manifest_new(spark, sf_dir)).select("path", "change")


_DEFECT = "case when p_partkey%13=0 then concat('../',path) when p_partkey%17=0 then concat('logs/',path) when p_partkey%19=0 then concat('con.txt/',path) when p_partkey%23=0 then concat('x/',p_name) when p_partkey%29=0 then concat('a',chr(58),path) else path end"


@query("p19_path_safety", V.duck("manifest_old", body=f"pd as (select {_DEFECT.replace('p_name', 'regexp_extract(path,{q}^[^/]*{q})'.format(q=chr(39)))} as path, digest from manifest_old), tw as (select lower(path) as l from pd group by 1 having count(*)>1) select path, case when path like '../%' or path like 'a:%' then 'unsafe' when path like 'con.txt/%' then 'reserved' when path like 'logs/%' then 'user_data' else 'duplicate' end as problem from pd where path like '../%' or path like 'a:%' or path like 'con.txt/%' or path like 'logs/%' or lower(path) in (select l from tw)"))
def p19(spark, sf_dir):
    m = V.manifest_old(spark, sf_dir).withColumn("p_name", F.regexp_extract("path", "^[^/]*", 0))
    path = F.expr(_DEFECT.replace("chr(58)", "':'"))
    return N.manifest_problems(m.select(path.alias("path"), "digest"), None).select("path", "problem")


_VER = "concat(case when p_partkey%2=0 then 'v' else '' end, cast(p_partkey%3 as string),'.',case when p_partkey%31=0 then '01' else cast(p_partkey%13 as string) end,'.',cast(p_partkey%101 as string))"


@query("f28_version_order", f"with vs as (select p_partkey, {_VER} as version from part) select p_partkey, case when p_partkey%31<>0 then ltrim(version,'v') end as normal, case when p_partkey%31<>0 then p_partkey%3 end as major, case when p_partkey%31<>0 then p_partkey%101 end as patch from vs")
def f28(spark, sf_dir):
    v = V.table(spark, sf_dir, "part").select("p_partkey", F.expr(_VER).alias("version"))
    k = X.version_key(F.col("version"))
    return v.select("p_partkey", X.normalize_version(F.col("version")).alias("normal"), k["major"].alias("major"), k["patch"].alias("patch"))


@query("t8_prune_versions", f"with vs as (select concat('pkg-',cast(p_partkey as string)) as name, p_partkey, {_VER} as version from part), kk as (select *, row_number() over (order by p_partkey%3 desc, p_partkey%13 desc, p_partkey%101 desc, name desc) as k from vs where p_partkey%31<>0) select name, version from kk where k>5 and p_partkey%500<>1")
def t8(spark, sf_dir):
    v = V.table(spark, sf_dir, "part").select(F.expr("concat('pkg-',cast(p_partkey as string))").alias("name"), "p_partkey", F.expr(_VER).alias("version"))
    return N.prunable(v, 5, v.filter("p_partkey % 500 = 1")).select("name", "version")
