import random
import urllib.robotparser
from collections import deque

import pytest
from pyspark.sql import functions as F

from titleforge.sources import fetching as fe

ROBOTS = [
    "User-agent: *\nAllow: /a/ok\nDisallow: /a/\nDisallow: /s?q=\nSitemap: https://x.ir/m.xml",
    "User-agent: mozilla\nDisallow: /\n\nUser-agent: *\nDisallow:",
    "User-agent: other\nDisallow: /\n",
    "User-agent: *\nDisallow: /%D8%B1%D9%85\nDisallow: /c+d\nDisallow: /%zz\nDisallow: *",
    "no robots at all\x00\nDisallow: /a",
    "",
]
PATHS = ["", "/", "/a/", "/a/ok", "/a/okay?x=1", "/b", "/s?q=1", "/s", "?q=1", "/رمان/1", "/%D8%B1%D9%85%D8%A7%D9%86", "/c+d", "/c d", "/%zz/1", "/*", "/a#f"]


@pytest.mark.parametrize("agent", [fe.AGENT, "other/1"])
def test_robots_as_the_standard_parser(spark, agent):
    files = spark.createDataFrame([(f"https://h{i}.ir", t) for i, t in enumerate(ROBOTS)] + [("https://h5.ir", None)], "origin string, text string")
    urls = spark.createDataFrame([(f"https://h{i}.ir{p}",) for i in range(len(ROBOTS) + 1) for p in PATHS], "url string")
    rules = fe.parsed_robots(files, agent)
    assert {r.origin: r.sitemaps for r in rules.collect()}["https://h0.ir"] == ["https://x.ir/m.xml"]
    got = {r.url: r.may for r in urls.withColumn("origin", fe.origin_of(F.col("url"))).join(rules, "origin", "left").select("url", fe.permitted(F.col("url"), F.col("rules")).alias("may")).collect()}
    for i, text in enumerate(ROBOTS):
        parser = urllib.robotparser.RobotFileParser()
        parser.parse(text.splitlines())
        for p in PATHS:
            url = f"https://h{i}.ir{p}"
            assert got[url] == parser.can_fetch(agent, url), (text, p)
    assert all(got[f"https://h{len(ROBOTS)}.ir{p}"] for p in PATHS)


def test_fetched(spark):
    long = "x" * 300
    http = [("https://a.ir/1", 200, long), ("https://a.ir/2", 200, " short "), ("https://a.ir/3", 403, ""), ("https://a.ir/4", 404, long), ("https://a.ir/no", 200, long), ("https://a.ir/6", 200, long), ("https://a.ir/7", 200, long), ("https://a.ir/8", 503, long)]
    browser = [("https://a.ir/2", 200, "b2"), ("https://a.ir/3", 0, None), ("https://a.ir/4", 200, "b4"), ("https://a.ir/6", 200, "b6"), ("https://a.ir/7", 500, "b7"), ("https://a.ir/no", 200, "b")]
    asked = spark.createDataFrame([(f"https://a.ir/{i}", i in (6, 7), "kept") for i in range(1, 9)] + [("https://a.ir/no", True, "kept"), (None, None, None)], "url string, force boolean, _note string")
    answers = lambda rows: spark.createDataFrame(rows, "url string, status int, html string")
    rules = fe.parsed_robots(spark.createDataFrame([("https://a.ir", "User-agent: *\nDisallow: /no")], "origin string, text string"))
    out = fe.fetched(asked, answers(http), rules, answers(browser))
    assert out.columns == ["url", "force", "_note", "status", "html", "via", "ok"]
    got = {r.url: (r.status, r.html, r.via, r.ok) for r in out.collect()}
    a = "https://a.ir/"
    assert got == {
        a + "1": (200, long, "http", True), a + "2": (200, "b2", "browser", True), a + "3": (0, "", "browser", False), a + "4": (404, long, "http", False), a + "5": (0, "", "http", False),
        a + "6": (200, "b6", "browser", True), a + "7": (200, long, "http", True), a + "8": (503, long, "http", False), a + "no": (999, "", "robots-disallow", False), None: (0, "", "http", False),
    }
    plain = {r.url: r.status for r in fe.fetched(asked.select("url"), answers(http)).collect()}
    assert plain[a + "no"] == 200 and plain[a + "2"] == 200 and fe.fetched(asked, answers([])).where("status <> 0").isEmpty()


def test_fetched_has_one_row_a_request(spark):
    asked = spark.createDataFrame([("https://a.ir/1",), ("https://a.ir/1",), ("https://a.ir/2",)], "url string")
    answers = spark.createDataFrame([("https://a.ir/1", 404, "z" * 300), ("https://a.ir/1", 200, "x" * 300), ("https://a.ir/1", 200, "y" * 300), ("https://a.ir/2", 0, None), ("https://a.ir/2", None, None)], "url string, status int, html string")
    got = sorted((r.url, r.status, r.html[:1]) for r in fe.fetched(asked, answers, None, answers).collect())
    assert got == [("https://a.ir/1", 200, "y")] * 2 + [("https://a.ir/2", 0, "")]


def walk(starts, maps, most):
    """The walk one sitemap at a time."""
    seen, queue, urls = set(), deque(starts), []
    while queue and len(urls) < most * 4:
        url = queue.popleft()
        if url in seen:
            continue
        seen.add(url)
        if url not in maps:
            continue
        found, nested = maps[url]
        urls += found
        queue.extend(c for c in nested if c not in seen and len(seen) < 60)
    return urls


@pytest.mark.parametrize(("n", "wide"), [(1, 0), (12, 3), (90, 4), (200, 80)])
def test_sitemap_walk(spark, n, wide):
    pick = random.Random(n)
    names = [f"https://s.ir/{i}.xml" for i in range(n)]
    maps = {}
    for i, name in enumerate(names):
        nested = [pick.choice(names) for _ in range(pick.randint(0, wide))] if i % 3 == 0 else []
        maps[name] = ([], nested) if nested else ([f"https://s.ir/p{pick.randint(0, 50)}" for _ in range(pick.randint(0, 3))], [])
    del maps[names[-1]]
    loc = lambda tag, urls: "".join(f"<{tag}><loc>{u}</loc></{tag}>" for u in urls)
    xml = [(k, 200, f"<sitemapindex>{loc('sitemap', b)}</sitemapindex>" if b else f"<urlset>{loc('url', a)}</urlset>") for k, (a, b) in maps.items()] + [(names[-1], 404, "<urlset/>"), ("https://s.ir/blank.xml", 200, " ")]
    landed = spark.createDataFrame(xml, "url string, status int, html string")
    first = [names[0], names[n // 2], names[0]]
    starts = spark.createDataFrame([(s, u, i) for s in (1, 2) for i, u in enumerate(first[s - 1 :])], "site int, url string, pos int")
    for most in (1, 1000):
        got = fe.sitemap_walk(starts, landed, most).collect()
        for s in (1, 2):
            assert [r.url for r in sorted((r for r in got if r.site == s), key=lambda r: r.place)] == walk(first[s - 1 :], maps, most)
    none = fe.sitemap_walk(starts, landed.limit(0), 5)
    assert none.isEmpty() and none.columns == ["site", "place", "url"]


def test_candidates(spark):
    sites = spark.createDataFrame([(1, "https://a.ir/list"), (2, "https://b.ir"), (3, "https://c.ir/"), (4, "https://d.ir")], "site int, base_url string")
    rules = fe.parsed_robots(spark.createDataFrame([("https://b.ir", "Sitemap: https://b.ir/own.xml")], "origin string, text string"))
    starts = {(r.site, r.pos): r.url for r in fe.sitemap_starts(sites, rules).collect()}
    assert starts[2, 0] == "https://b.ir/own.xml" and (2, 1) not in starts and starts[3, 3] == "https://c.ir/wp-sitemap.xml"
    found = lambda *sites: spark.createDataFrame([(s, i, u) for s in sites for i, u in enumerate((f"https://{'_abcd'[s]}.ir/p/2#x", f"https://{'_abcd'[s]}.ir/p/1", f"https://{'_abcd'[s]}.ir/p/2", "https://else.ir/p/1", f"https://{'_abcd'[s]}.ir/q"))], "site int, place int, url string")
    chosen = fe.dispatched(sites, found(1, 2), found(1, 2), found(2, 3))
    assert {(r.site, r.source) for r in chosen.select("site", "source").distinct().collect()} == {(1, "listing"), (2, "sitemap"), (3, "crawl")}
    table = spark.createDataFrame([(1, "a.ir", "/p/", "", 0), (2, "b.ir", "", "/1$", 0), (3, "c.ir", "", "", 1)], "site int, domain string, include string, exclude string, pool int")
    got = [(r.site, r.rank, r.url) for r in fe.candidates(chosen, table).orderBy("site", "rank").collect()]
    assert got == [(1, 1, "https://a.ir/p/2"), (1, 2, "https://a.ir/p/1"), (2, 1, "https://b.ir/p/2"), (2, 2, "https://b.ir/q"), (3, 1, "https://c.ir/p/2")]
    assert (fe.cap_of(None, 0, 7), fe.cap_of(3, 5), fe.cap_of(), fe.pool_of(500, 10), fe.pool_of(500, 0), fe.pool_of(20, 10)) == (7, 3, 0, 60, 500, 20)
