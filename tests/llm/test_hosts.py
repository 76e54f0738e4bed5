from pyspark.sql import functions as F

from rulelens.llm.hosts import host_reputation, url_filter
from rulelens.llm.queries import URL_RULES

LABELS = "key bigint, bad boolean"


def run(spark, pages, labels=()):
    docs = spark.createDataFrame(pages, "page_id bigint, url string, host int")
    key = lambda url: F.regexp_extract(url, "#([0-9]+)", 1).try_cast("bigint")
    got = url_filter(docs, spark.createDataFrame(list(labels), LABELS), URL_RULES, key=key)
    return sorted((str(r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect())


def test_parts_rules_and_odd_urls(spark):
    pages = [
        (1, "http://A.Example.NET/en/x?q#f", 0), (2, "https://example.net/fr/", 0), (3, "https://example.com/de/a", 0),
        (4, "ftp://x.org/fr/b", 0), (5, "http://xnet/", 0), (6, "http://a.net", 0), (7, "http://example.net?x=/en/", 0),
        (8, None, 0), (9, "no scheme/net/", 0), (10, "", 0), (10, "", 0), (None, "http://É.net/p", 0), (11, "x://a://b/c", 0),
    ]
    assert run(spark, pages) == sorted([
        ("1", "a.example.net", "/en/x", "example.net/en/", "allow"), ("2", "example.net", "/fr/", "net/", "block"),
        ("3", "example.com", "/de/a", "example.com/de/", "block"), ("4", "x.org", "/fr/b", "org/fr/", "allow"),
        ("5", "xnet", "/", None, "allow"), ("6", "a.net", "", None, "allow"), ("7", "example.net", "", None, "allow"),
        ("8", "", "", None, "allow"), ("9", "", "", None, "allow"), ("10", "", "", None, "allow"), ("10", "", "", None, "allow"),
        ("None", "É.net", "/p", "net/", "block"), ("11", "a:", "//b/c", None, "allow"),
    ])
    assert run(spark, []) == []


def test_bad_hosts_are_blocked_and_unsure_ones_are_not(spark):
    pages = [(i, f"http://bad.one.com/p#{i}", 0) for i in range(40)] + [(100, "http://new.one.com/p", 0), (101, "http://few.two.com/#101", 0)]
    pages += [(i, f"http://good.two.com/p#{i}", 0) for i in range(200, 260)]
    labels = [(i, i < 200) for i in [*range(38), *range(200, 260), 101, 0]]
    verdicts = {(h, v) for _, h, _, _, v in run(spark, pages, labels)}
    assert ("bad.one.com", "block") in verdicts and ("good.two.com", "allow") in verdicts and ("few.two.com", "allow") in verdicts


def test_shares_are_shrunk_towards_the_domain(spark):
    rows = [("a.x.com", True)] * 9 + [("a.x.com", False)] + [("b.x.com", None), ("c.y.com", True)] + [("d.y.com", False)] * 10
    rated = {r["host"]: r for r in host_reputation(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    share = {h: r["alpha"] / (r["alpha"] + r["beta"]) for h, r in rated.items()}
    assert 0.5 < share["a.x.com"] < 0.9 and share["d.y.com"] < share["c.y.com"] < 1 and share["b.x.com"] > share["d.y.com"]
    assert all(r["bound"] < share[h] for h, r in rated.items())
