import xml.etree.ElementTree as ET
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from titleforge.functions import html as H
from titleforge.functions import vectors as V
from titleforge.operators import enrich, reports
from titleforge.operators import state as st
from titleforge.sources import landing, schemas

PAGES = [
    ('<html><head><title>رمان شب | فروشگاه</title><meta property="og:site_name" content="فروشگاه"></head></html>', "https://a.ir/p/1", "رمان شب"),
    ("<h1 class='x'> رمان  <b>شب</b> &amp; روز </h1>", "https://a.ir", "رمان شب & روز"),
    ("<h1></h1><meta property='og:title' content='عنوان &#8211; یک'>", "https://a.ir", "عنوان – یک"),
    ("<title>shop.ir - رمان شب</title>", "https://www.shop.ir/x", "رمان شب"),
    ("<title>رمان شب - جلد دوم</title>", "https://www.shop.ir/x", "رمان شب - جلد دوم"),
    ("<h1>caf&eacute; caf&eacute;</h1>", "https://a.ir", "café"),
    (None, None, ""),
]


def test_titles(spark):
    df = spark.createDataFrame([(i, h, u) for i, (h, u, _) in enumerate(PAGES)], "i int, h string, u string")
    for _ in range(3):  # the plan must hold more than once in a session
        got = {r.i: r.t for r in H.with_title(df, F.col("h"), H.domain_of(F.col("u")), into="t").collect()}
    assert [got[i] for i in range(len(PAGES))] == [w for *_, w in PAGES]


def test_product_pages(spark):
    rows = [
        ('<script type="application/ld+json">{"@type": "Product"}</script>', "https://a.ir/blog/x", True),
        ("<p>قیمت: ۱۲۰۰ تومان</p><a>افزودن به سبد</a>", "https://a.ir/x", True),
        ("<p>قیمت: ۱۲۰۰ تومان</p><a>افزودن به سبد</a>", "https://a.ir/blog/x", False),
        ("<p>قیمت: ۱۲۰۰ تومان</p><h1>درباره ما</h1>", "https://a.ir/x", False),
        ("<script>قیمت تومان افزودن به سبد</script>", "https://a.ir/x", False),
        ("", "https://a.ir/x", False),
    ]
    df = spark.createDataFrame([(i, h, u) for i, (h, u, _) in enumerate(rows)], "i int, h string, u string").coalesce(1)
    got = {r.i: r.s for r in df.select("i", H.product_signals(F.col("h"), F.col("u")).alias("s")).collect()}
    assert [got[i].is_product for i in range(len(rows))] == [w for *_, w in rows]
    assert got[5].blockers == ["صفحه خالی است"]


def test_links_encoding_content(spark):
    page = '<a href="/x/">1</a><a href="y#f">2</a><a href="mailto:z">3</a><a href="/x">4</a>'
    assert H.links_of(page, "https://a.ir/p/") == ["https://a.ir/x", "https://a.ir/p/y"]
    text = "سلام"
    assert H.decoded(text.encode("windows-1256"), None) == text
    assert H.decoded(text.encode(), "text/html; charset=bogus") == text
    assert H.decoded(b"\xef\xbb\xbf" + text.encode(), "text/html; charset=latin-1") == text
    assert H.decoded(b'<meta charset="windows-1256">' + text.encode("windows-1256"), None).endswith(text)
    assert H.decoded(b"", None) == "" == H.decoded(None, None)
    df = spark.createDataFrame([("<article>a b</article><article>a b c</article><h2 >x</h2><ul ><img src='q'>",)], "h string")
    m = df.select(H.content_metrics(F.col("h")).alias("m")).select("m.*", H.content_score(F.col("m")).alias("score")).first()
    assert (m.word_count, m.h2_count, m.has_list, m.has_table, m.image_count) == (3, 1, True, False, 1)
    assert m.score == round(3 / 1500 * 4 + 2.5 / 8 + 1 + 0.25, 2)


def test_sources(spark):
    assert landing.sitemap_of('<urlset xmlns="s"><url><loc> https://a/1 </loc></url><url><x/></url></urlset>') == (["https://a/1"], [])
    assert landing.sitemap_of("<sitemapindex><sitemap><loc>https://a/s</loc></sitemap></sitemapindex>") == ([], ["https://a/s"])
    assert landing.sitemap_of("https://a/1\nx\nhttp://b") == (["https://a/1", "http://b"], [])
    df = spark.createDataFrame([("a.ir/x/, #c\nhttps://A.ir/x\nbad\n b.com ",)], "raw string")
    assert [r.url for r in landing.clean_sites(df).collect()] == ["https://a.ir/x", "https://b.com"]
    assert landing.Site.of("https://A.ir/x").domain == "a.ir"
    assert landing.Config(landing.Config.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": None}})).get("a.b", 7) == 7
    answers = spark.createDataFrame([('["q",["a"," b ",""]]',), ("broken",), (None,)], "response string")
    assert [(r.position, r.keyword) for r in landing.suggestions(answers).collect()] == [(0, "a"), (1, "b")]
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {(r.url, r.depth) for r in landing.crawl(links, seeds, 3).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert landing.crawl(links, seeds, 9, max_pages=3).count() == 3
    chain = spark.createDataFrame([("a", "b"), ("b", "a")], "url string, next_url string")
    assert landing.listing_pages(chain, seeds).count() == 2


CANONICAL = "id long, run_id string, canonical_title string, entity_tokens array<string>, merge_confidence double, needs_review boolean, suggest_status string"


@pytest.fixture
def tables(spark):
    return {
        "runs": spark.createDataFrame([("r",), ("s",)], "run_id string"),
        "raw_products": spark.createDataFrame([(1, "r", "a.ir", "u1", "t1", "x", True), (2, "r", "b.ir", "u2", "t2", "y", True), (3, "r", "a.ir", "u3", "t3", "", None), (4, "s", "c", "u4", "t4", "", True)], "id long, run_id string, source_domain string, source_url string, raw_title string, category string, is_relevant boolean").withColumn("topic_score", F.lit(0.4)),
        "canonical_products": spark.createDataFrame([(10, "r", "t1", ["p"], 0.9, True, "has_suggest"), (11, "r", "t2", ["q", "p"], 0.5, False, None), (12, "s", "t4", [], 1.0, False, "no_suggest")], CANONICAL),
        "product_mapping": spark.createDataFrame([(1, 10), (2, 11), (4, 12)], "raw_id long, canonical_id long"),
        "lsi_keywords": spark.createDataFrame([(10, "k1", 1, "q"), (11, "k1", 1, "q"), (11, "k2", 2, "q")], "canonical_id long, keyword string, position int, source_query string"),
    }


def test_merge_detach_rename_delete(spark, tables):
    c, m, k, moved = st.merge_products(tables["canonical_products"], tables["product_mapping"], tables["lsi_keywords"], 10, 11)
    row = c.where("id = 10").first()
    assert moved == 1 and row.entity_tokens == ["p", "q"] and row.merge_confidence == 1.0 and not row.needs_review and row.suggest_status == "has_suggest"
    assert {(r.keyword, r.position, r.source_query) for r in k.collect()} == {("k1", 1, "q"), ("k2", 2, "")}
    c2, m2, new = st.detach(c, m, tables["raw_products"], 2)
    assert c2.where(F.col("id") == new).first().needs_review and m2.where(F.col("canonical_id") == new).count() == 1
    with pytest.raises(ValueError):
        st.detach(c2, m2, tables["raw_products"], 2)
    with pytest.raises(ValueError):
        st.rename(c2, 10, " ")
    assert st.rename(c2, 10, " neu ").where("id = 10").first().canonical_title == "neu"
    left = st.delete_run(tables, "r")
    assert {n: df.count() for n, df in left.items()} == {"runs": 1, "raw_products": 1, "canonical_products": 1, "product_mapping": 1, "lsi_keywords": 0}
    with pytest.raises(ValueError):
        st.merge_products(tables["canonical_products"], m, k, 10, 12)
    with pytest.raises(ValueError):
        st.set_columns(c, F.lit(True), {"id": F.lit(1)}, {"canonical_title"})


def test_sheets(spark, tables):
    s = reports.sheets(tables["canonical_products"], tables["product_mapping"], tables["raw_products"], tables["lsi_keywords"], "review,ready,archive,all", 2)
    assert {k: df.count() for k, df in s.items()} == {"ready": 1, "archive": 2, "all": 3, "review": 2}
    r = s["ready"].first()
    assert (r.lsi_keywords, r.category, r.source_domains, r.suggest_1, r.suggest_2) == ("k1", "x", "a.ir", "k1", "")
    assert list(reports.sheets(*(tables[n] for n in ("canonical_products", "product_mapping", "raw_products", "lsi_keywords")), "nothing")) == ["ready", "archive", "all", "review"]


def test_files(spark, tables, tmp_path):
    s = reports.sheets(tables["canonical_products"], tables["product_mapping"], tables["raw_products"], tables["lsi_keywords"], "review,ready", 2)
    ready, review = (Path(p) for p in reports.csv_bundle(s, str(tmp_path), "run"))
    assert review.name == "run__review.csv" and review.read_bytes().startswith(b"\xef\xbb\xbf")
    assert len(review.read_text("utf-8-sig").splitlines()) == 3 and len(ready.read_text("utf-8-sig").splitlines()) == 2
    assert {r.sheet: r.n for r in reports.sheet_counts(s).collect()} == {"ready": 1, "review": 2}
    raw = schemas.reconciled(tables["raw_products"], "raw_products")
    lines = Path(reports.borderline_csv(raw, str(tmp_path / "review"), "r")).read_text("utf-8-sig").splitlines()
    assert lines[0] == "id,topic_score,raw_title,normalized_title,source_url" and len(lines) == 1 + reports.borderline(raw).count()
    assert reports.borderline_csv(raw.limit(0), str(tmp_path / "none"), "r") is None


def workbook(path):
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as z:
        names = [e.get("name") for e in ET.fromstring(z.read("xl/workbook.xml")).iterfind(".//m:sheet", ns)]
        tabs = [ET.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")) for i in range(1, len(names) + 1)]
    return names, tabs, [[["".join(c.itertext()) for c in r] for r in t.iterfind(".//m:row", ns)] for t in tabs]


def test_workbook(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a<b & \"c\"\x01", 1, 0.5, ["x", "y"]), (None, None, float("nan"), None), (" رمان ", 2, 1.0, [])], "t string, n long, s double, l array<string>").coalesce(1)
    names, tabs, got = workbook(reports.to_xlsx({"a/b": rows, "A b": rows.limit(0), "x" * 40: rows}, str(tmp_path / "a.xlsx")))
    assert names == ["a b", "A b 2", "x" * 31]
    assert got[0] == [["t", "n", "s", "l"], ["a<b & \"c\"", "1", "0.5", "x | y"], ["", "", "NaN", ""], [" رمان ", "2", "1.0", ""]] and got[1] == got[0][:1]
    assert [e.get("rightToLeft") for e in tabs[0].iter() if e.tag.endswith("sheetView")] == ["1"] and any(e.get("state") == "frozen" for e in tabs[0].iter())
    monkeypatch.setattr(reports, "TAB_ROWS", 3)
    names, _, got = workbook(reports.to_xlsx({"s": rows}, str(tmp_path / "b.xlsx")))
    assert names == ["s", "s 2"] and [len(g) for g in got] == [3, 2]


def test_plan_and_keywords(spark):
    runs = schemas.reconciled(spark.createDataFrame([("r", "old"), ("s", "old")], "run_id string, target_topic string"), "runs")
    got = {r.run_id: r for r in st.set_run_plan(runs, "r", categories=["roman"], sites=[], options={"max_products_per_site": 5, "js": True}).collect()}
    assert (got["r"].categories, got["r"].sites, got["r"].target_topic, got["r"].options.max_products_per_site, got["s"].sites) == (["roman"], [], "old", 5, None)
    words = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "canonical_id long, keyword string")
    assert st.delete_keyword(words, 1, "a").collect() == [(1, "b"), (2, "a")]


def test_snapshots_and_schemas(spark, tables, tmp_path):
    st.save(spark, str(tmp_path / "db"), {"runs": tables["runs"]})
    st.save(spark, str(tmp_path / "db"), {"runs": st.set_run_status(schemas.reconciled(tables["runs"], "runs"), "r", "completed", 4)})
    got = {r.run_id: r.status for r in st.load(spark, str(tmp_path / "db"), ["runs"])["runs"].collect()}
    assert got == {"r": "completed", "s": None}
    assert schemas.empty(spark, "api_cache").count() == 0
    new = spark.createDataFrame([("r", 1), ("x", 2), ("x", 1)], "run_id string, created_at int")
    assert st.create_run(tables["runs"], new).count() == 3


def test_enrichment(spark):
    products = spark.createDataFrame([(1, "رمان شب سرد", None)], "id long, canonical_title string, suggest_status string")
    asked = enrich.queries_of(enrich.pending(products))
    assert [r["query"] for r in asked.orderBy("variant").collect()] == ["رمان شب سرد", "دانلود رمان شب سرد", "پی دی اف رمان شب سرد"]
    responses = spark.createDataFrame([("رمان شب سرد", '["q",["رمان شب سرد دو","رمان دیگر"]]'), ("دانلود رمان شب سرد", '["q",["رمان شب سرد دو","رمان شب سرد سه"]]')], "query string, response string")
    got = [(r.keyword, r.position) for r in enrich.keywords(asked, responses).orderBy("position").collect()]
    assert got == [("رمان شب سرد دو", 1), ("رمان شب سرد سه", 2)]
    assert enrich.keywords(asked, responses, enough=1).count() == 1
    claims = spark.createDataFrame([(1, "رمان شب سرد", 2, "q"), (2, "رمان شب سرد", 1, "q"), (2, "b", 2, "q")], "canonical_id long, keyword string, position int, source_query string")
    titles = spark.createDataFrame([(1, "رمان شب سرد"), (2, "رمان شب گرم")], "id long, canonical_title string")
    assert {(r.canonical_id, r.keyword) for r in enrich.owners(claims, titles).collect()} == {(1, "رمان شب سرد"), (2, "b")}
    log = spark.createDataFrame([("c", i, o) for i, o in enumerate(["ok", "error", "error", "ok", "error", "error", "error", "ok"])], "client string, seq int, outcome string")
    assert [r.tripped for r in enrich.breakers(log).orderBy("seq").collect()] == [False] * 6 + [True] * 2


def test_cache(spark):
    now = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    cache = spark.createDataFrame([("a", '["x"]', "2024-01-30 00:00:00"), ("b", '["x"]', "2023-01-01 00:00:00"), ("c", "{broken", "2024-01-30 00:00:00"), ("d", "null", "2024-01-30 00:00:00"), ("e", '["x"]', None)], "cache_key string, response string, t string").withColumn("created_at", F.try_to_timestamp("t"))
    asked = cache.select("cache_key")
    assert {r.cache_key for r in st.cached(asked, cache, now, 30).where("hit").collect()} == {"a", "e"}
    assert {r.cache_key for r in st.cached(asked, cache, now, 0).where("hit").collect()} == {"a", "b", "e"}


def test_vectors(spark):
    v = V.hashed_vector("رمان شب")
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and V.hashed_vector("") == [0.0] * V.DIM
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r.c, 4) for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.96, 0.0, 0.0]
    row = spark.createDataFrame([([0.8, 0.9, 0.7], [0.1, 0.2, 0.3], [])], "p array<double>, n array<double>, e array<double>")
    got = row.select(V.calibrated(F.col("p"), F.col("n")).alias("t"), V.calibrated(F.col("n"), F.col("p")).alias("u"), V.percentile(F.col("e"), 0.5).alias("z")).first()
    assert (got.t.relevant, got.t.review, got.u, got.z) == (0.5, 0.4, None, 0.0)
