from titleforge.__main__ import main
from titleforge.plans import run as R
from titleforge.sources.landing import Site

PAGES = [
    ("https://a.ir/p/1", "رمان شب سرد الناز"), ("https://a.ir/p/2", "دانلود رمان شب سرد الناز pdf"), ("https://a.ir/p/3", "رمان عاشقانه سحر"),
    ("https://a.ir/p/4", "کفش ورزشی مردانه نایک"), ("https://b.ir/p/1", "رمان شب سرد الناز کامل"), ("https://c.ir/p/1", "رمان دیگر"),
]


def test_whole_run(spark):
    pages = spark.createDataFrame([(u, f'<h1>{t}</h1><script>{{"@type": "Product"}}</script>') for u, t in PAGES] + [("https://a.ir/about", "<h1>رمان درباره ما</h1>")], "url string, html string")
    responses = spark.createDataFrame([("رمان شب سرد", '["q",["رمان شب سرد الناز دانلود"]]'), ("رمان شب سرد الناز", '["q",["رمان شب سرد الناز دو","رمان"]]')], "query string, response string")
    out = R.run(spark, pages, [Site.of("https://a.ir"), Site.of("b.ir")], responses, {"run": {"categories": ["roman"]}})
    raw = {r.source_url: r for r in out["raw_products"].collect()}
    assert len(raw) == 5 and raw["https://a.ir/p/1"].is_relevant and not raw["https://a.ir/p/4"].is_relevant
    assert out["canonical_products"].count() == 2 and out["product_mapping"].count() == 4
    status = {r.canonical_title: r.suggest_status for r in out["canonical_products"].collect()}
    assert sorted(status.values()) == ["has_suggest", "no_suggest"]
    assert out["sheet_ready"].first().merge_count == 3 and out["sheet_all"].count() == 2


def test_settings():
    assert R.clean_options({"max_products_per_site": "x", "js": 1}) == {"max_products_per_site": 0, "require_product_signals": True, "js": True}
    assert R.clean_options({"max_products_per_site": 10**9})["max_products_per_site"] == 100_000
    assert [label for label, _ in R.categories(["roman", "رمان", "خودم", ""])] == ["رمان", "خودم"]
    assert R.config({"run": {"target_topic": "x"}}).get("run.relevance_threshold") == 0.65
    assert all(low is None or low > review for _, _, low, review in R.topics(list(R.X.CATEGORIES)))


def test_normalize_command(capsys):
    assert main(["normalize", "دانلود رمان شب سرد الناز"]) == 0
    assert "رمان شب سرد الناز" in capsys.readouterr().out
