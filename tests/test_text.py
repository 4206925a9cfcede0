import pytest
from pyspark.sql import functions as F

from titleforge.functions import text as T
from titleforge.functions.entities import Scanner
from titleforge.functions.text import Rules

GOLDEN = [
    ("دانلود رمان تاوان خیانت آوا PDF کامل ۱۴۰۴", "رمان تاوان خیانت آوا"),
    ("خرید جزوه‌ی فیزیک ۱ دانشگاهی رایگان", "جزوه فیزیک ۱ دانشگاهی"),
    ("سوالات آيين نامه راهنمايي و رانندگي جديد", "سوالات آیین نامه راهنمایی رانندگی"),
    ("رمان استاد مغرور جلد ۲ کامل", "رمان مغرور ۲"),
    ("سوالات آیین‌نامه اصلی ۱۴۰۴ با جواب", "سوالات آییننامه اصلی جواب"),
    ("كتاب رياضي 12", "کتاب ریاضی ۱۲"),
    ("پی دی اف رمان دانلود رایگان", "رمان"),
    ("  ", ""),
    (None, ""),
    ("a  b‌‌ c", "a b c"),
]


def test_golden(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(GOLDEN)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", T.normalize(F.col("t")).alias("n")).collect()}
    assert [got[i] for i in range(len(GOLDEN))] == [w for _, w in GOLDEN]


def test_idempotent_and_scanner_agrees(spark):
    df = spark.createDataFrame([(r,) for r, _ in GOLDEN], "t string").withColumn("n", T.normalize(F.col("t")))
    scanner = Scanner(Rules())
    for r in df.select("t", "n", T.normalize(F.col("n")).alias("again"), T.display(F.col("t")).alias("d"), T.tokenize(F.col("t")).alias("w")).collect():
        assert r.again == r.n
        assert r.d == T.plain(r.t, Rules())
        assert list(r.w) == scanner.words(r.t)
        assert r.n.split() == scanner.meaningful(scanner.words(r.t))


def test_decomposed_letters_are_composed(spark):
    df = spark.createDataFrame([("آب",), ("آب",)], "t string")
    assert len({r.n for r in df.select(T.normalize(F.col("t")).alias("n")).collect()}) == 1


@pytest.mark.parametrize("target,digits", [("fa", "۱۲۳۴"), ("en", "1234")])
def test_digits(spark, target, digits):
    df = spark.createDataFrame([("1۲٣4",)], "t string")
    assert df.select(T.map_digits(F.col("t"), target).alias("d")).first().d == digits


def test_options(spark):
    rules = Rules.of({"digit_target": "en", "strip_years": False, "zwnj": "space", "custom_stopwords": ["رمان"], "min_token_len": 2})
    df = spark.createDataFrame([("رمان نیم‌فاصله ۱۴۰۴ ۱",)], "t string")
    assert df.select(T.normalize(F.col("t"), rules).alias("n")).first().n == "نیم فاصله 1404"
    assert "جلد" not in Rules(extra_stopwords=False).stopwords


def test_collapse_and_search(spark):
    rows = [("دانلود رمان دانلود رمان شب سرد",), ("رمان ماه طوفان از زینب ایلخانی pdf pdf",), ("a a a a",), ("رمان شب سرد سرد نسخه کامل و اصلی pdf",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r.c for r in df.select(T.collapse_repeats(F.col("t")).alias("c")).collect()]
    assert got[:3] == ["دانلود رمان شب سرد", "رمان ماه طوفان از زینب ایلخانی pdf", "a"]
    found = [r.q for r in df.select(T.search_query(F.col("t")).alias("q")).collect()]
    assert found[0] == "رمان شب سرد" and found[3] == "رمان شب سرد"


def test_variants(spark):
    df = spark.createDataFrame([("یک دو سه چهار پنج",), ("",), ("تک",)], "q string")
    got = [list(r.v) for r in df.select(T.variants_of(F.col("q")).alias("v")).collect()]
    assert got[0] == ["یک دو سه چهار پنج", "یک دو سه چهار", "دانلود یک دو سه چهار", "یک دو سه", "پی دی اف یک دو سه چهار"]
    assert got[1] == [] and got[2] == ["تک", "دانلود تک", "پی دی اف تک"]


def test_covers(spark):
    df = spark.createDataFrame([("رمان ارباب تعصبی من", "رمان ارباب تعصبی"), ("رمان غرور و تعصب", "رمان ارباب تعصبی"), ("x", "دانلود")], "s string, q string")
    assert [r.c for r in df.select(T.covers(F.col("s"), F.col("q")).alias("c")).collect()] == [True, False, True]
