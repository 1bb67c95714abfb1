from __future__ import annotations

import random

from wayline.llm import url_rules as U


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[:min([k for k in map(tail.find, "?#") if k >= 0], default=len(tail))]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


def test_against_brute_force(spark):
    random.seed(2)
    rules = [*U.RULES, ("com", "/en/x", "block"), ("b.com", "/en/x/", "allow"), ("b.com", "", "block"), ("net", "/e", "allow")]
    hosts = ["com", "a.com", "B.com", "x.b.com", "www.example.com", "example.com", "notexample.com", "net", "q.net", "", "a..com", "org"]
    paths = ["", "/", "/en/", "/en/x", "/en/x/y", "/es/", "/fr/1", "/e", "?q=/en/", "#/en/", "/En/"]
    urls = [None, "", "com/en/", "://", "http://", *[f"http://{random.choice(hosts)}{random.choice(paths)}{random.choice(['', '?a=b', '#z'])}" for _ in range(400)]]
    pages = spark.createDataFrame([(k % 300 if k % 7 else None, u, "h", "clash", "stack") for k, u in enumerate(urls)], "page_id long, url string, html string, host string, stack string")
    pages = pages.unionByName(pages.limit(50)).unionByName(pages.limit(50))
    given = spark.createDataFrame([*rules, (None, "/", "block"), ("com", "/", "allow")], "host string, path string, verdict string")
    want = sorted((r.page_id if r.page_id is not None else -1, *map(str, brute(r.url, rules))) for r in pages.collect())
    got = sorted((r.page_id if r.page_id is not None else -1, *map(str, (r.host, r.path, r.rule, r.verdict))) for r in U.judge(pages, given, salts=3).collect())
    assert got == want


def test_no_rules_and_no_pages(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [tuple(r) for r in U.judge(pages, rules, default="block").collect()] == [(1, "a.com", "/", None, "block")]
    assert U.judge(pages.limit(0), spark.createDataFrame(U.RULES, "host string, path string, verdict string")).count() == 0


def test_a_host_of_many_labels(spark):
    host = "a." * 100_000 + "www.example.com"
    rules = spark.createDataFrame(U.RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, f"http://{host}/en/x"), (2, "http://" + "." * 100_000), (3, "http://x.net/fr/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge(pages, rules).collect()}
    assert got == {1: ("www.example.com/en/", "allow"), 2: (None, "allow"), 3: ("net/fr/", "block")}
