"""URL filters: a sorted sweep of URL keys over nested rule intervals.

A URL has one canonical key for its host and each parent domain: the reversed
labels of that domain, `#`, the URL's path. A rule (host, path) then is the
interval of all keys that begin with its own key, and two rules' intervals are
nested or apart. Keys and rules are sorted together; the rule met last, with
the rules that enclose it, is the stack from which the innermost one that still
holds the key is taken. Intervals never cross a domain, so the sweep is cut
between domains, and a domain again by a salt with its rules repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.common import ascii_lower, pick


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first `://`, path after it up to `?`, `#` or the end; both empty without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring({}, {} + 3)".format("url", "locate('://', url)"))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def parent_domains(host: Column, most: Column) -> Column:
    """The reversed host cut after its first label, its second, and so on, up to so many or all of it."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    return F.transform(F.sequence(F.lit(1), F.least(labels, most)), lambda n: reversed_host(F.call_function("substring_index", host, F.lit("."), -n)))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", salts: int = 32, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Host, path, longest fitting rule and verdict of every page.

    rules: host, path, verdict. A rule fits its host and all subdomains if the
    path begins with the rule's; the longest rule text wins, then the longer
    host. Of rules with the same host and path the smallest verdict counts;
    rules with nulls are left out. Pages that no rule fits get the default.
    One row for each row of pages: equal rows are judged once and given back as
    often as they came. A null URL, or one without `://`, has an empty host and
    path, which no rule fits.
    """
    known = (pick(rules, host="host", path="path", verdict="verdict").dropna()
             .select(ascii_lower(F.col("host")).alias("host"), "path", "verdict")
             .groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
             .select(reversed_host(F.col("host")).alias("domain"), "path", F.concat("host", "path").alias("rule"), "verdict"))
    # Rules whose path begins with another's of the same host stand inside it.
    inner = known.select("domain", "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")),
                                                                 lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("outer"))
    outer = known.select("domain", F.col("path").alias("outer"), "rule", "verdict")
    stacks = (inner.join(outer, ["domain", "outer"])
              .groupBy("domain", "path").agg(F.array_sort(F.collect_list(F.struct(F.length("outer").alias("size"), F.col("outer").alias("path"), "rule", "verdict"))).alias("stack")))

    host, path = host_and_path(F.col("url"))
    urls = (pick(pages, page_id=id_col, url=url_col).withColumn("host", host).withColumn("path", path)
            .groupBy("page_id", "host", "path").agg(F.count(F.lit(1)).alias("copies")))
    ruled = known.select("domain").distinct()
    # Longer domains than the longest rule's fit none.
    most = known.agg(F.coalesce(F.max(F.size(F.split("domain", r"\.", -1))), F.lit(1)).alias("most"))
    keys = (urls.where("host <> ''").withColumn("most", most.scalar()).withColumn("domain", F.explode(parent_domains(F.col("host"), F.col("most"))))
            .join(ruled, "domain", "left_semi")
            .select("domain", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(salts)).alias("salt"), "path", F.lit(1).alias("kind"),
                    F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"), F.struct("page_id", "host").alias("page")))
    marks = (stacks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
             .select("domain", "salt", "path", F.lit(0).alias("kind"), "stack", F.lit(None).cast(keys.schema["page"].dataType).alias("page")))
    sweep = Window.partitionBy("domain", "salt").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.filter("open", lambda r: F.startswith(F.col("path"), r["path"]))
    fitting = (keys.unionByName(marks).withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
               .withColumn("best", F.try_element_at(held, F.lit(-1))).where("best is not null")
               .groupBy(F.col("page.page_id").alias("page_id"), F.col("page.host").alias("host"), "path")
               .agg(F.max(F.struct(F.length("best.rule").alias("size"), F.length("domain").alias("host_size"), F.col("best.rule").alias("rule"),
                                   F.col("best.verdict").alias("verdict"))).alias("best")))
    joined = urls.alias("u").join(fitting.alias("f"), F.col("u.page_id").eqNullSafe(F.col("f.page_id")) & (F.col("u.host") == F.col("f.host")) & (F.col("u.path") == F.col("f.path")), "left")
    return (joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(F.col("u.page_id").cast("long").alias("page_id"), F.col("u.host").alias("host"), F.col("u.path").alias("path"),
                    F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")))


# The rules of the registered query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def oracle() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
    with rules(rh, rp, rv) as (values {rules}),
    cut as (select row_number() over () as n, page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
    parsed as (select n, page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                      regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from cut),
    fitting as (select n, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(rv, length(rh || rp)) as verdict
                from parsed join rules on (host = rh or host like '%.' || rh) and starts_with(path, rp) group by n)
    select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parsed left join fitting using (n)"""
