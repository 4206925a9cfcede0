import duckdb
import pytest

import __spark_entry__ as entry
from titleforge.plans.crawling import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())
    assert sorted(names) == columns
    assert got == want


# Pages of one URL, each with its own answer: from the browser, refused, never given, disallowed.
SAME = [(i, u, f"<p>{i}</p>" * 60) for u, ids in (("https://a.example/en/1", (2, 4, 12, 17, 30)), ("http://a.example/en/2", (6, 7)), ("http://b.example/en/1", (1, 3, 5, 14)), ("https://c.example/", (8,))) for i in ids]


def against_sql_over_pages(spark, folder, name, rows):
    """The query's and its SQL's rows over these pages."""
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    got, want = df.collect(), con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    return sorted(repr(tuple(r[c] for c in names)) for r in got), sorted(map(repr, want.fetchall()))


def test_crawl_counters_of_a_url_on_many_pages(spark, tmp_path):
    got, want = against_sql_over_pages(spark, tmp_path, "crawl_counters", SAME)
    assert len(want) == 3 and got == want


def test_fetch_outcomes_of_a_url_on_many_pages(spark, tmp_path):
    got, want = against_sql_over_pages(spark, tmp_path, "fetch_outcomes", SAME + SAME[:3])
    assert len(want) == 15 and got == want
