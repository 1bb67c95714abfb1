"""Point-of-interest catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.operators import catalogue as C
from wayline.plans import views as V
from wayline.plans.registry import query, r


def _poi(spark, sf_dir):
    return V.poi(spark, sf_dir)


def _raw(spark, sf_dir):
    """Entries as text with every kind of defect."""
    p, k = _poi(spark, sf_dir), F.col("s_suppkey")
    blank = lambda c, n: F.when(k % n == 0, F.lit(None)).otherwise(c)
    return p.select(
        "s_suppkey",
        F.when(k % 17 == 0, "   ").when(k % 19 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), F.col("name"))).alias("name"),
        F.when(k % 23 == 0, "far").otherwise(F.col("x").cast("string")).alias("x"), F.col("y").cast("string").alias("y"),
        blank(F.col("z").cast("string"), 29).alias("z"), F.when(k % 7 == 0, "").otherwise(F.col("location")).alias("location"),
        F.when(k % 5 == 0, "").otherwise(F.col("ooc")).alias("ooc"),
        F.when(k % 13 == 0, "orbit").otherwise(F.upper("kind")).alias("kind"), "category")


_EXP = "cave, circuit, exploration, hidden, hostile_combat, industry, logistics, logistics_black_market, loot, racing, tactical"
_RAW = """raw as (select s_suppkey, case when s_suppkey%17=0 then '   ' when s_suppkey%19=0 then null else concat(' ',name) end as name, case when s_suppkey%23=0 then null else x end as x, s_suppkey%23=0 as badx,
 y, case when s_suppkey%29=0 then null else z end as z, case when s_suppkey%7=0 then '' else location end as location, case when s_suppkey%5=0 then '' else ooc end as ooc, case when s_suppkey%13=0 then 'orbit' else upper(kind) end as kind, category from poi)"""
_VALID = _RAW + f""", va as (select *, case when name is null then 'Missing required field: ''name''.' when z is null then 'Missing required field: ''z''.' when trim(name)='' then 'Field ''name'' must not be empty.'
 when badx then 'Fields x/y/z must be numeric.' when lower(kind) not in ('surface','space') then concat('Field ''kind'' must be ''surface'' or ''space'' (got ''',lower(kind),''').')
 when category='bogus' then 'Unknown category ''bogus''. Expected one of: {_EXP}.' end as error from raw)"""


@query("p1_wire_form", V.duck("poi", body="select name, x, y, z, case when location='NATION_3' or location='' then 'Unknown' else location end as location, ooc, kind, category, '' as description from poi"))
def p1(spark, sf_dir):
    gone = F.when(F.col("location") == "NATION_3", "").otherwise(F.col("location"))
    return C.wire_form(_poi(spark, sf_dir).withColumn("location", gone))


@query("p2_loaded_form", V.duck("poi", body="select name, x, y, z, case when s_suppkey%5=0 then 'Unknown' else location end as location, ooc, kind, category, '' as description from poi"))
def p2(spark, sf_dir):
    df = (_poi(spark, sf_dir).withColumn("description", F.lit(None).cast("string"))
          .withColumn("location", F.when(F.col("s_suppkey") % 5 != 0, F.col("location"))))
    return C.loaded_form(df)


@query("p3_validation", V.duck("poi", body=_VALID + " select s_suppkey, error, case when error is null then trim(name) end as name, case when error is null then x end as x, case when error is null then case when location='' then 'Unknown' else location end end as location, case when error is null and ooc<>'' then ooc end as ooc, case when error is null then lower(kind) end as kind from va"))
def p3(spark, sf_dir):
    return C.validate(_raw(spark, sf_dir)).select("s_suppkey", "error", "name", "x", "location", "ooc", "kind")


@query("p4_document_validation", V.duck("poi", body=_VALID + ", dn as (select s_suppkey//4 as doc, cast(s_suppkey%4 as int) as pos, error from va) select doc, count(*) as entries, arg_min(concat('Entry #',cast(pos+1 as string),': ',error), pos) filter (error is not null) as error, count(error)=0 as accepted from dn group by 1"))
def p4(spark, sf_dir):
    v = C.validate(_raw(spark, sf_dir)).select(
        F.expr("s_suppkey div 4").alias("doc"), (F.col("s_suppkey") % 4).cast("int").alias("pos"), "error")
    return C.validate_documents(v, ["doc"])


@query("p5_category_filter", V.duck("poi", body="select s_suppkey, name from poi where category='cave'"))
def p5(spark, sf_dir):
    return C.in_category(_poi(spark, sf_dir), "cave").select("s_suppkey", "name")


_LABELS = " ".join(f"when '{c}' then '{l}'" for c, l, _ in C.CATEGORIES)
_COLOURS = " ".join(f"when '{c}' then '{v}'" for c, _, v in C.CATEGORIES)
_CANON = "case category when 'exploration' then 'cave' when 'logistics_black_market' then 'logistics' when 'hostile_combat' then 'tactical' else category end"
_CAT = f"cp as (select *, case {_CANON} {_LABELS} else 'Uncategorized' end as label, case {_CANON} {_COLOURS} else '#7E8B97' end as colour from poi)"


@query("p6_catalogue_search", V.duck("poi", body=_CAT + ", pp as (select s_suppkey, name, label from cp) select s_suppkey, name from pp where lower(name) like '%tact%' or lower(label) like '%tact%'"))
def p6(spark, sf_dir):
    return C.search(_poi(spark, sf_dir), "TACT").select("s_suppkey", "name")


@query("j15_category_lookup", V.duck("poi", body=_CAT + " select s_suppkey, category, label, colour from cp"))
def j15(spark, sf_dir):
    return C.with_category(_poi(spark, sf_dir)).select("s_suppkey", "category", "label", "colour")


@query("t6_catalogue_listing", V.duck("poi", body=_CAT + " select name, coalesce(ooc,'(legacy)') as zone, upper(label) as category, colour, printf('%.2f',x) as x, printf('%.2f',y) as y, printf('%.2f',z) as z from cp"))
def t6(spark, sf_dir):
    return C.listing(_poi(spark, sf_dir))


def _parts(spark, sf_dir):
    """A catalogue with many repeated names."""
    return V.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), (F.col("p_partkey") % 5).cast("double").alias("x"),
        F.lit(1.0).alias("y"), F.lit(2.0).alias("z"), F.lit("surface").alias("kind"), F.col("p_brand").alias("ooc"))


_PT = "pt as (select p_partkey as pos, p_name as name, cast(p_partkey%5 as double) as x, cast(1 as double) as y, cast(2 as double) as z, 'surface' as kind, p_brand as ooc from part)"
_IMP = "im as (select distinct upper(p_name) as name, cast(9 as double) as x, cast(1 as double) as y, cast(2 as double) as z, cast(null as varchar) as kind, 'new' as ooc from part where p_partkey%3=0 union all select concat('only ',cast(p_partkey as string)), 9, 1, 2, null, 'new' from part where p_partkey%100=0)"


def _imported(spark, sf_dir):
    p = V.table(spark, sf_dir, "part")
    common = [F.lit(9.0).alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("z"), F.lit(None).cast("string").alias("kind"), F.lit("new").alias("ooc")]
    return (p.filter("p_partkey % 3 = 0").select(F.upper("p_name").alias("name")).distinct().select("name", *common)
            .unionByName(p.filter("p_partkey % 100 = 0").select(F.concat(F.lit("only "), F.col("p_partkey").cast("string")).alias("name"), *common)))


@query("j5_duplicate_names", "with " + _PT + ", " + _IMP + " select name from im where lower(name) in (select lower(name) from pt)")
def j5(spark, sf_dir):
    return C.duplicates(_imported(spark, sf_dir), _parts(spark, sf_dir)).select("name")


# Imports that repeat names, and a catalogue that has some numbered ones.
_REP = _PT + """, nb as (select pos+10000000 as pos, concat(name,' (',cast(pos%40+2 as string),')') as name, x, y, z, kind, ooc from pt where pos%3<>1),
ol as (select * from pt where pos%4<>0 union all select * from nb),
iw as (select p_partkey as a, case when p_partkey%7=0 then concat('only ', cast(p_partkey%13 as string)) when p_partkey%5=0 then upper(p_name) else p_name end as name, cast(9 as double) as x, cast(1 as double) as y, cast(2 as double) as z,
 cast(null as varchar) as kind, 'new' as ooc from part where p_partkey%2=0),
ik as (select *, row_number() over (partition by lower(name) order by a) as k, count(*) over (partition by lower(name)) as came, (select count(*) from ol where lower(ol.name)=lower(iw.name)) as m from iw)"""


def _old_catalogue(spark, sf_dir):
    pt = _parts(spark, sf_dir)
    numbered = pt.filter("pos % 3 <> 1").withColumn("name", F.expr("concat(name, ' (', cast(pos % 40 + 2 as string), ')')")).withColumn("pos", F.col("pos") + 10000000)
    return pt.filter("pos % 4 <> 0").unionByName(numbered)


def _repeating_import(spark, sf_dir):
    return V.table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").selectExpr(
        "p_partkey as a", "case when p_partkey%7=0 then concat('only ', cast(p_partkey%13 as string)) when p_partkey%5=0 then upper(p_name) else p_name end as name",
        "9.0D as x", "1.0D as y", "2.0D as z", "cast(null as string) as kind", "'new' as ooc")


def _import(spark, sf_dir, policy):
    return C.upsert(_old_catalogue(spark, sf_dir), _repeating_import(spark, sf_dir), policy, arrival="a")


@query("j6_import_replace", "with " + _REP + """, ok as (select *, row_number() over (partition by lower(name) order by pos) as r from ol)
select name, x, y, z, kind, ooc from ok where r > coalesce((select max(came) from ik where lower(ik.name)=lower(ok.name)), 0) union all select name, x, y, z, 'space', ooc from ik where k > came - greatest(m, 1)""")
def j6(spark, sf_dir):
    return _import(spark, sf_dir, "replace")


@query("j6_import_keep_both", "with " + _REP + """, nm as (select distinct lower(name) as n from ol union select distinct lower(name) from iw),
wt as (select lower(name) as base, max(k) as most from ik group by 1),
fr as (select base, i, row_number() over (partition by base order by i) as kk from wt, unnest(range(2, most + 45)) as u(i) where concat(base,' (',cast(i as string),')') not in (select n from nm))
select name, x, y, z, kind, ooc from ol union all
select case when kk is null then name else concat(name,' (',cast(fr.i as string),')') end, x, y, z, 'space', ooc from (select *, case when m > 0 then k else k-1 end as want from ik) w left join fr on fr.base=lower(w.name) and fr.kk=w.want""")
def j6b(spark, sf_dir):
    return _import(spark, sf_dir, "keep_both")


@query("j6_import_abort", "with " + _REP + " select name, x, y, z, kind, ooc from ol union all select name, x, y, z, 'space', ooc from ik where m=0 and k=1")
def j6c(spark, sf_dir):
    return _import(spark, sf_dir, "abort")


@query("j7_delete_matching", "with " + _PT + " select pos, name, x from pt where not ((name, x) in (select name, x from pt where pos%50=7))")
def j7(spark, sf_dir):
    df = _parts(spark, sf_dir)
    return C.delete_matching(df, df.filter("pos % 50 = 7")).select("pos", "name", "x")


@query("j8_update_first", "with " + _PT + ", ch as (select distinct name, x from pt where pos%50=7), fi as (select min(pt.pos) as pos from pt join ch on pt.name=ch.name and pt.x=ch.x group by pt.name, pt.x) select pos, name, x, case when pos in (select pos from fi) then 'space' else kind end as kind, ooc from pt")
def j8(spark, sf_dir):
    df = _parts(spark, sf_dir)
    changes = df.filter("pos % 50 = 7").select(*C.IDENTITY).distinct().withColumns(
        {"new_kind": F.lit("space"), "new_ooc": F.lit(None).cast("string")})
    return C.update_first(df, changes).select("pos", "name", "x", "kind", "ooc")


@query("w22_next_free_name", """with ex as (select concat(p_name,' (',cast(p_partkey%40 + 2 as string),')') as name from part where p_partkey%3<>1 union all select p_name from part),
us as (select distinct lower(p_name) as base, p_partkey%40+2 as i from part where p_partkey%3<>1), ba as (select distinct p_name as name from part),
tr as (select lower(name) as base, 2 as i from ba union all select base, i+1 from us), fr as (select base, min(i) as i from tr where (base,i) not in (select base, i from us) group by 1)
select ba.name, concat(ba.name,' (',cast(fr.i as string),')') as free_name from ba join fr on lower(ba.name)=fr.base""")
def w22(spark, sf_dir):
    p = V.table(spark, sf_dir, "part")
    numbered = p.filter("p_partkey % 3 <> 1").select(F.expr("concat(p_name, ' (', cast(p_partkey % 40 + 2 as string), ')')").alias("name"))
    return C.next_free_names(p.select(F.col("p_name").alias("name")), numbered.union(p.select("p_name")))


@query("u3_accepted_slugs", V.duck("poi", body="select s_suppkey, category from poi where category in ('','hidden','cave','circuit','tactical','industry','logistics','loot','racing') union select s_suppkey, category from poi where category in ('exploration','logistics_black_market','hostile_combat')"))
def u3(spark, sf_dir):
    slugs = F.broadcast(C.accepted_slugs(spark))
    return _poi(spark, sf_dir).join(slugs, "category", "left_semi").select("s_suppkey", "category")


_PAR = "k as (select o_orderkey, (['max_speed_km_s','sigma_a','sigma_z','gate_nis','coast_s','arrival_radius_m','min_confidence'])[o_orderkey%7+1] as name, case when o_custkey%11=0 then null else (o_totalprice-150000)/1000.0 end as v from orders)"
_LIM = {n: v for n, v in C.LIMITS.items()}


@query("p20_parameter_limits", "with " + _PAR + " select o_orderkey, name, round(case name " + " ".join(
    f"when '{n}' then " + (f"least({hi}::double, " if hi is not None else "(") + f"greatest({lo}::double, coalesce(v, {d}::double)))" for n, (d, lo, hi) in _LIM.items()) + " end, 6)+0::double as value from k")
def p20(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    names = F.array(*[F.lit(n) for n in C.LIMITS])
    text = F.when(F.col("o_custkey") % 11 == 0, "n/a").otherwise(((F.col("o_totalprice") - 150000) / 1000.0).cast("string"))
    k = o.select("o_orderkey", F.get(names, (F.col("o_orderkey") % 7).cast("int")).alias("name"), text.alias("v"))
    return k.select("o_orderkey", "name", r(C.clamp_parameter(F.col("name"), F.col("v"))).alias("value"))
