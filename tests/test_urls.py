from urllib.parse import parse_qs, urlencode, urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from sievework import rules
from sievework.functions import urls
from sievework.operators import linkgraph

CASES = [
    "http://Example.com:80/A/B/",
    "https://example.com:443/?b=2&a=1&utm_source=x",
    "https://example.com:8443/x#frag",
    "https://example.com/x?a=&b=1&c",
    "https://example.com/x?b=~*&a=%7E%2A+z&b=1",
    "https://example.com/Path;P=1?q=a%zz",
    "https://example.com",
    "https://example.com/",
    "HTTPS://WWW.Example.com/Über?k=ü",
    "/relative/Path/?ref=1&x=2",
    "mailto:someone",
    "https://example.com//double//",
    "https://example.com/x?fbclid=1&gclid=2",
]


def by_library(url):
    p = urlparse(url)
    host, path = p.netloc.lower(), p.path.lower()
    for scheme, port in (("http", ":80"), ("https", ":443")):
        if p.scheme == scheme and host.endswith(port):
            host = host[: -len(port)]
    if len(path) > 1 and path.endswith("/"):
        path = path[:-1]
    query = {k: v for k, v in parse_qs(p.query).items() if k not in rules.TRACKING_PARAMETERS}
    return urlunparse((p.scheme, host, path, p.params, urlencode(sorted(query.items()), doseq=True), ""))


def test_normalize_agrees_with_the_url_library(spark):
    df = spark.createDataFrame([(u,) for u in CASES], "url string")
    got = {r[0]: r[1] for r in df.select("url", urls.normalize_url(F.col("url"))).collect()}
    assert got == {u: by_library(u) for u in CASES}


def test_normalize_is_idempotent(spark):
    once = [u for u in CASES if not u.endswith("//")]  # only one trailing slash is dropped at a time
    df = spark.createDataFrame([(u,) for u in once], "url string").select(urls.normalize_url(F.col("url")).alias("u"))
    assert df.filter(urls.normalize_url(F.col("u")) != F.col("u")).count() == 0


def test_links_skip_hidden_and_resolve(spark):
    html = (
        '<!-- <a href="/no1">x</a> --><script>"<a href=\'/no2\'>"</script><a href="/A?b=1&amp;a=2">1</a>'
        "<A class=x HREF='rel'>2</A><a href=#>3</a><a href='javascript:x()'>4</a><a href=\"/a?a=2&b=1\">5</a><a name=q>6</a>"
    )
    df = spark.createDataFrame([(1, "https://H.org/p/q", html)], "page_id long, url string, html string")
    got = [(r["pos"], r["link"]) for r in linkgraph.extract_links(df, "page_id").orderBy("pos").collect()]
    assert got == [(0, "https://h.org/a?a=2&b=1"), (1, "https://h.org/rel")]


def test_bounded_crawl_matches_a_queue(spark):
    edges = {"http://h/0": ["http://h/1", "http://h/2", "http://o/9"], "http://h/1": ["http://h/3", "http://h/0"], "http://h/2": ["http://h/3", "http://h/4", "http://h/5"], "http://h/3": ["http://h/6"]}
    rows = [(s, i, d) for s, ds in edges.items() for i, d in enumerate(ds)]
    links = spark.createDataFrame(rows, "src string, pos int, link string")
    seeds = spark.createDataFrame([("http://h/0",)], "seed string")
    got = linkgraph.bounded_crawl(seeds, links, 2, 5).orderBy("place").collect()
    assert [(r["url"][-1], r["depth"]) for r in got] == [("0", 0), ("1", 1), ("2", 1), ("3", 2), ("4", 2)]


@pytest.mark.parametrize("path,allowed", [("/en/1", False), ("/en/2/x", True), ("/fr", True)])
def test_robots_longest_rule_wins(spark, path, allowed):
    pages = spark.createDataFrame([("https://h.org" + path,)], "url string")
    robots = spark.createDataFrame([("h.org", "*", "/en", False), ("h.org", "*", "/en/2", True)], "host string, agent string, path string, allow boolean")
    assert linkgraph.robots_filter(pages, robots, "url").first()["allowed"] is allowed


def test_official_site_prefers_the_named_host(spark):
    rows = [("Acme Co", "https://linkedin.com/acmeco", 0, 0), ("Acme Co", "https://other.org/", 0, 1), ("Acme Co", "https://www.acmeco.com/", 1, 0), ("Beta", "https://x.org", 0, 3)]
    df = spark.createDataFrame(rows, "name string, url string, query_no int, rank int")
    got = {r[0]: r[1] for r in linkgraph.match_official_site(df).collect()}
    assert got == {"Acme Co": "https://www.acmeco.com/", "Beta": "https://x.org"}
