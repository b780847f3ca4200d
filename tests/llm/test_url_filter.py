from __future__ import annotations

import re

import pytest

from rasterloom.llm import url_filter as uf

PAGES, OUTCOMES = "page_id long, url string, html string", "doc_id long, quality int, toxic int"
URLS = [
    "http://a.example.net/en/1", "http://a.example.net/de/1", "https://A.Example.COM/de/x?q#f", "http://x.org/fr/1", "http://x.org/en", "no scheme", None, "", "http://", "ftp://b.co.uk/p#t",
    "http://example.net", "http://notexample.net/en/", "http://net/", "x://h?://z/y", "http://a.example.net?x=/en/", "http://q.r.b.co.uk/",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def rule(host, path):
    fits = [(h + p, v) for v, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(URLS)], PAGES).repartition(3)
    outcomes = spark.createDataFrame([(i, 1, 0) for i in range(len(URLS))], OUTCOMES)
    got = {r.page_id: r for r in uf.filter_urls(pages, outcomes).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = parts(u)
        name, verdict = rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, name), u
        assert got[i].verdict == (verdict or "allow")


def test_reputation_shrinks_from_host_to_suffix(spark):
    urls = ["http://bad.a.com/"] * 30 + ["http://good.a.com/"] * 30 + ["http://one.a.com/"] + ["http://new.good.org/"] + ["http://old.good.org/"] * 40 + ["http://p.x.info/"] * 20
    good = [0] * 30 + [1] * 30 + [0] + [None] + [1] * 40 + [0] * 20
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], PAGES)
    outcomes = spark.createDataFrame([(i, g, 0) for i, g in enumerate(good)] + [(0, None, 0), (None, 1, 0)], OUTCOMES)
    low = {r.host: (r.low, r.verdict) for r in uf.filter_urls(pages, outcomes, rules=()).collect()}
    assert low["good.a.com"][1] == "allow" and low["bad.a.com"][1] == "block" and low["p.x.info"][1] == "block"
    assert low["bad.a.com"][0] < low["good.a.com"][0] and low["one.a.com"][0] < low["good.a.com"][0]
    assert low["new.good.org"][0] > low["one.a.com"][0]  # an unseen host takes after its domain
    assert low["new.good.org"][0] < low["old.good.org"][0]


def test_domains(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("a.b.com",), ("com",), ("",)], "h string")
    got = [tuple(r) for r in df.select("h", uf.domain_of(F.col("h")), uf.suffix_of(F.col("h"))).collect()]
    assert got == [("a.b.co.uk", "b.co.uk", "co.uk"), ("b.co.uk", "b.co.uk", "co.uk"), ("a.b.com", "b.com", "com"), ("com", "com", "com"), ("", "", "")]


def test_users_and_ports_are_no_domain(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a.b.com:80",), ("me@a.b.com",), ("me:pw@b.co.uk:8080",)], "h string")
    assert [r[0] for r in df.select(uf.domain_of(uf.name_of(F.col("h")))).collect()] == ["b.com", "b.com", "b.co.uk"]
    assert [r[0] for r in df.select(uf.domain_of(uf.name_of(F.col("h")), ("b.com",))).collect()] == ["a.b.com", "a.b.com", "co.uk"]


def test_many_hosts_and_long_urls(spark, monkeypatch):
    """Hosts beyond what is broadcast: the hot ones are, the others are joined by a shuffle, with the same result."""
    urls = ["http://hot.a.com/"] * 50 + [f"http://h{i}.b.org/{'x' * i * 100}" for i in range(40)] + [None]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], PAGES).repartition(3)
    outcomes = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], OUTCOMES)
    want = sorted(map(str, uf.filter_urls(pages, outcomes).collect()))
    monkeypatch.setattr(uf, "BROADCAST_HOSTS", 5)
    monkeypatch.setattr(uf, "BROADCAST_LABELS", 5)
    assert sorted(map(str, uf.filter_urls(pages, outcomes).collect())) == want and len(want) == len(urls)


def test_odd_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", ""), (1, "http://a.com/", ""), (None, None, "")], PAGES)
    empty = spark.createDataFrame([], OUTCOMES)
    got = sorted(tuple(r)[:5] for r in uf.filter_urls(pages.toDF("page_id", "url", "low"), empty).collect() if r.page_id)
    assert got == [(1, "a.com", "/", None, "block")] * 2
    assert uf.filter_urls(pages, empty).count() == 3 and uf.filter_urls(pages.limit(0), empty).count() == 0
    with pytest.raises(ValueError):
        uf.rule_of(None, None, [("allow", "h", "/")] * (uf.MAX_RULES + 1))
