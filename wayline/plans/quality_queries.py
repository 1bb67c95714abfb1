"""Recognition-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.operators import quality as Q
from wayline.plans import text_queries as TQ
from wayline.plans import views as V
from wayline.plans.registry import dr, query, r

_PART = "case when regexp_matches(text,'[Pp9][0oOaA9qQ][sSa56][:\\s]\\s*-?\\d+\\.\\d|[Pp]os:?\\s*-?\\d+\\.\\d') then len(regexp_extract_all(text,'-?\\d+\\.\\d{2,4}')) else 0 end"
_SAMPLES = (TQ.parsed_ctes("hud_line", "text", "pl", "frame_id, line_no, score, text") +
            f""", sm as materialized (select frame_id, frame_id%10 as run, count(*) as detections, min(score) as min_score, arg_min(method, line_no) filter (x is not null) as method,
 arg_min(x, line_no) filter (x is not null) as x, arg_min(y, line_no) filter (x is not null) as y, arg_min(z, line_no) filter (x is not null) as z, max({_PART}) as part, sum(length(text)) as chars from pl group by 1,2),
so as materialized (select *, case when method is not null then 'complete' when part>0 then 'partial' else 'none' end as outcome, (frame_id%97)/cast(10 as double) as latency_ms from sm)""").lstrip()
_MIDS = """, md as (select run, list_sort(list(x) filter (x is not null)) as lx, list_sort(list(y) filter (x is not null)) as ly, list_sort(list(z) filter (x is not null)) as lz from so group by 1),
mm as (select run, lx[len(lx)//2+1] as mx, ly[len(ly)//2+1] as my, lz[len(lz)//2+1] as mz from md where len(lx)>=3)"""
_REASON = ("nullif(concat_ws('; '," + ",".join(f"case when abs({a}-m{a})>10 then concat('{a.upper()} drift ',printf('%+.1f',{a}-m{a}),' km') end" for a in "xyz")
           + "," + ",".join(f"case when {a}*m{a}<0 and abs(abs({a})-abs(m{a}))<5 then '{a.upper()} sign flipped vs median' end" for a in "xyz") + "),'')")
_FLAG = _SAMPLES + _MIDS + f", fl as materialized (select so.*, {_REASON} as suspect from so left join mm on mm.run=so.run)"


def _samples(spark, sf_dir):
    lines = Q.classify_lines(V.hud_line(spark, sf_dir), "text")
    return (Q.classify_samples(lines, ["frame_id"])
            .select("frame_id", (F.col("frame_id") % 10).alias("run"), "detections", "min_score", "outcome",
                    "pos.method", "pos.x", "pos.y", "pos.z", "text_chars",
                    ((F.col("frame_id") % 97) / 10.0).alias("latency_ms")))


def _flagged(spark, sf_dir):
    return Q.flag_outliers(_samples(spark, sf_dir), ["run"])


@query("f31_sample_outcome", V.duck("hud_line", body=_SAMPLES + f" select frame_id, outcome, method, {dr('x')} as x from so"))
def f31(spark, sf_dir):
    return _samples(spark, sf_dir).select("frame_id", "outcome", "method", r(F.col("x")).alias("x"))


@query("a1_outcome_counts", V.duck("hud_line", body=_FLAG + " select run, count(*) as samples, count(*) filter (outcome='complete') as complete, count(*) filter (outcome='partial') as partial, count(*) filter (outcome='none') as none, round(count(*) filter (outcome='complete')/cast(count(*) as double),3) as complete_rate, count(suspect) as suspects from fl group by 1"))
def a1(spark, sf_dir):
    return Q.outcome_summary(_flagged(spark, sf_dir), ["run"])


@query("a2_latency_summary", V.duck("hud_line", body=_SAMPLES + f" select run, {dr('avg(latency_ms)')} as mean_ms, max(latency_ms) as max_ms, {dr('avg(detections)')} as mean_detections, {dr('sum(chars)/cast(sum(detections) as double)')} as mean_text from so group by 1"))
def a2(spark, sf_dir):
    s = Q.latency_summary(_samples(spark, sf_dir), ["run"])
    return s.select("run", r(F.col("mean_ms")).alias("mean_ms"), "max_ms",
                    r(F.col("mean_detections")).alias("mean_detections"), r(F.col("mean_text")).alias("mean_text"))


@query("a3_score_histogram", V.duck("hud_line", body="select frame_id%10 as run, case when score>=0.95 then '0.95-1.00' when score>=0.85 then '0.85-0.95' when score>=0.70 then '0.70-0.85' when score>=0.50 then '0.50-0.70' else '<0.50' end as bucket, count(*) as n from hud_line group by 1,2"))
def a3(spark, sf_dir):
    df = V.hud_line(spark, sf_dir).withColumn("run", F.col("frame_id") % 10)
    return Q.histogram(df, ["run"], Q.score_bucket(F.col("score")))


@query("a4_method_histogram", V.duck("hud_line", body=_SAMPLES + " select run, method as bucket, count(*) as n from so where method is not null group by 1,2"))
def a4(spark, sf_dir):
    df = _samples(spark, sf_dir).filter(F.col("method").isNotNull())
    return Q.histogram(df, ["run"], F.col("method"))


@query("a5_outlier_flags", V.duck("hud_line", body=_FLAG + " select frame_id, suspect from fl"))
def a5(spark, sf_dir):
    return _flagged(spark, sf_dir).select("frame_id", "suspect")


@query("s8_sample_report", V.duck("hud_line", body=_FLAG + " select frame_id, outcome, coalesce(method,'') as method, detections, printf('%.2f',min_score) as min_score, case when x is null then '—' else concat('(',printf('%.3f',x),', ',printf('%.3f',y),', ',printf('%.3f',z),')') end as matched from fl"))
def s8(spark, sf_dir):
    return Q.sample_report(_flagged(spark, sf_dir)).select(
        "frame_id", "outcome", F.coalesce("method", F.lit("")).alias("method"), "detections", "min_score", "matched")


_H = "hl as (select sid, count(*) filter (line like '%Position extracted%') as reads, count(*) filter (line like '%Multi-pass consensus%') as consensus, count(*) filter (line like '%OCR rejection%') as rejections, count(*) filter (line like '%OCR rejection: sign-flip%') as sign_flips, count(*) filter (line like '%ONNX sanity gate:%') as overrides from log_line group by 1)"


@query("a18_session_health", V.duck("log_line", body=_H + f" select *, {dr('consensus/nullif(reads::double,0)')} as consensus_share, coalesce(consensus/nullif(reads::double,0) > 0.5, false) as consensus_ok, coalesce(rejections/nullif((reads+rejections)::double,0) < 0.1, true) as rejections_ok from hl"))
def a18(spark, sf_dir):
    h = Q.log_health(Q.split_log(V.log_line(spark, sf_dir)), ["sid"], "message")
    return h.select("sid", "reads", "consensus", "rejections", "sign_flips", "overrides",
                    r(F.col("consensus_share")).alias("consensus_share"), "consensus_ok", "rejections_ok")


@query("s9_log_lines", V.duck("log_line", body="select sid, event_id, 'ocr' as logger, 'INFO' as level, substr(line, 40) as message from log_line"))
def s9(spark, sf_dir):
    return Q.split_log(V.log_line(spark, sf_dir)).select("sid", "event_id", "logger", "level", "message")


_STAB = "select sid, cast(floor(t_capture/10) as bigint) as bucket, {0} as capture_rate, {1} as spread_y, {2} as std_x from track group by 1,2"


@query("a19_quality_kpis", V.duck("track", body=_STAB.format(dr("avg(case when x is not null then 1.0 else 0 end)"), dr("max(y)-min(y)"), dr("sqrt(var_samp(x))"))))
def a19(spark, sf_dir):
    from wayline.operators import tracks as K
    return K.window_stability(V.track(spark, sf_dir)).select(
        "sid", "bucket", r(F.col("capture_rate")).alias("capture_rate"), r(F.col("spread_y")).alias("spread_y"),
        r(F.sqrt("var_x")).alias("std_x"))
