import random
import re

import numpy as np
import pytest

import corpus_pipeline
from titleforge.llm import decontaminate, near_dup, surrogates


def _five(text):
    ws = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ")
    ws = [w for w in ws if w]
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def _kept(rows):
    """Ids left by brute force: all pairs of five-word sets at 0.8, components, the smallest id of each."""
    sets = {i: _five(t) for i, t in rows}
    of = {}
    for i, s in sets.items():
        for g in s:
            of.setdefault(g, []).append(i)
    common = {}
    for ids in of.values():
        for x, a in enumerate(ids):
            for b in ids[x + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), k in common.items():
        if 5 * k >= 4 * (len(sets[a]) + len(sets[b]) - k):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i for i in sets if find(i) == i}


def test_near_duplicate_stage_by_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"])
    # one changed word of 24 parts the five-word sets of a pair, not their two-word sets
    base = [f"w{i}" for i in range(24)]
    planted = [(10**9 + i, " ".join(ws), "xx", "test", 0) for i, ws in enumerate((base, [*base[:12], "other", *base[13:]], base))]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema)).checkpoint()
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect()}
    assert got == _kept([(r.doc_id, r.text) for r in docs.collect()])


def test_five_word_sets_of_few_words():
    sets = list(near_dup.shingle_sets(np.frombuffer(b"a b c", np.uint8), np.array([0, 5]), 5))
    assert [len(s) for s in sets] == [1]


def recall_of_deletions(n, trials=100):
    """The share of items of ``n`` words that are found with a fifth of their words deleted."""
    rng = random.Random(n)
    items = [[f"w{rng.randrange(5000)}" for _ in range(n)] for _ in range(trials)]
    texts = []
    for item in items:
        gone = set(rng.sample(range(n), n // 5))
        around = [[f"x{rng.randrange(5000)}" for _ in range(30)] for _ in "ab"]
        texts.append(" ".join([*around[0], *(w for i, w in enumerate(item) if i not in gone), *around[1]]).encode())
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    found = {(d, i) for d, i, *_ in decontaminate.matches(decontaminate.Items(list(range(trials)), [" ".join(x) for x in items], 20), data, offsets)}
    return len({(i, i) for i in range(trials)} & found) / trials


@pytest.mark.parametrize("n", [5, 14, 20, 60, 100, 200])
def test_leaks_with_all_allowed_deletions_are_found(n):
    assert recall_of_deletions(n) == 1


def test_twins_in_a_family_below_the_bound(spark):
    rng = random.Random(11)
    template = [f"t{i}" for i in range(120)]
    ids, rows = rng.sample(range(100_000), 400), []
    for i in range(0, 400, 2):
        # of five changed words twins share two (similarity 0.82); others share none (0.71 to 0.79)
        places = rng.sample(range(2, 118, 3), 8)
        for own, at in ((0, places[2:5]), (1, places[5:])):
            text = list(template)
            for k in (*places[:2], *at):
                text[k] = f"u{i}" if k in places[:2] else f"u{i + own}x{k}"
            rows.append((ids[i + own], text))
    rows = [(i, " ".join(t)) for i, t in rows]
    sets = {i: frozenset(zip(t.split(), t.split()[1:])) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {i: find(i) for i in sets}
    assert 100 < len(set(want.values())) < 300
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize(
    "kind, spellings",
    [("card", ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"]), ("phone", ["+49 30 1234 5678", "+493012345678", "+49-30-1234-5678"]), ("iban", ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"])],
)
def test_one_surrogate_for_all_spellings_of_a_number(kind, spellings):
    bare = lambda t: "".join(c for c in t if c.isalnum())
    found = [surrogates.entities(f"see {t} here") for t in spellings]
    assert all([f[0] for f in x] == [kind] for x in found)
    new = [surrogates.surrogate(kind, t, x[0][3], 0) for t, x in zip(spellings, found, strict=True)]
    assert len(set(map(bare, new))) == 1 and bare(new[0]) != bare(spellings[0])
    assert [[c for c in t if not c.isalnum()] for t in new] == [[c for c in t if not c.isalnum()] for t in spellings]


def exact_components(sets):
    """Components of all pairs at 0.8, by inverted lists."""
    of, common, root = {}, {}, {i: i for i in sets}
    for i, s in sorted(sets.items()):
        for g in s:
            for j in of.setdefault(g, []):
                common[j, i] = common.get((j, i), 0) + 1
            of[g].append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [p for p, k in common.items() if 5 * k >= 4 * (len(sets[p[0]]) + len(sets[p[1]]) - k)]
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in sets}, len(links)


def test_pages_of_one_template(spark):
    """Most pairs of a template's pages lie just below the bound; those above it must all be linked."""
    rng = random.Random(3)
    template, rows = [f"t{i}" for i in range(200)], []
    for i in range(700):
        text = list(template)
        for k in rng.sample(range(200), rng.randrange(7, 9)):
            text[k] = f"u{rng.randrange(3000)}"
        rows.append((i, " ".join(text)))
    want, links = exact_components({i: frozenset(zip(t.split(), t.split()[1:])) for i, t in rows})
    assert links > 300 and 50 < len(set(want.values())) < 690
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, size=2).collect()} == want


def test_common_shingles_by_matrices():
    rng = np.random.default_rng(0)
    left, right = ([np.unique(rng.integers(0, 9000, rng.integers(1, 6000)).astype(np.uint64)) for _ in range(n)] for n in (9, 5))
    assert near_dup._common(left, right).tolist() == [[len(np.intersect1d(x, y)) for y in right] for x in left]


def test_keys_find_what_all_windows_hold(spark):
    """Leaks by brute force over all stretches of all documents against those that the keys find."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    items = [[rng.choice(words) for _ in range(rng.randrange(4, 26))] for _ in range(25)]
    texts = []
    for _ in range(60):
        text = [rng.choice(words) for _ in range(25)]
        for _ in range(rng.randrange(3)):
            leak = list(rng.choice(items))
            for _ in range(rng.randrange(len(leak) // 4 + 1)):
                at = rng.randrange(len(leak))
                leak[at : at + 1] = rng.choice([[], [rng.choice(words)], [leak[at], "zz"]])
            at = rng.randrange(len(text))
            text[at:at] = leak
        texts.append(text)
    want = set()
    for d, text in enumerate(texts):
        number = {w: k for k, w in enumerate(words)}
        codes = np.array([number.get(w, -1) for w in text])
        for i, item in enumerate(items):
            if decontaminate.best_stretch(np.array([number[w] for w in item]), codes)[0] <= len(item) // 5:
                want.add((d, i))
    docs = spark.createDataFrame([(d, " ".join(x)) for d, x in enumerate(texts)], "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] * 2, "doc_id long, text string")
    got = decontaminate.find_leaks(docs, benchmark, item_key="doc_id").collect()
    assert len(want) > 25 and {(r.doc_id, r.item_doc_id) for r in got} == want


def test_long_items():
    rng = random.Random(2)
    item = [f"w{rng.randrange(4000)}" for _ in range(3000)]
    leak = [w for w in item if rng.random() > 0.15]
    data = " ".join(["x"] * 50 + leak + ["y"] * 50).encode()
    found = list(decontaminate.matches(decontaminate.Items([7], [" ".join(item)], 20), np.frombuffer(data, np.uint8), np.array([0, len(data)])))
    assert [(d, i) for d, i, *_ in found] == [(0, 0)]


def test_one_person_has_one_surrogate(spark):
    rows = [
        (1, "Mrs. Anna Meyer came. Dr. Anna Meyer spoke, then Anna Meyer left; Meyer was late, and so was Ms. Meyer. Annameyer stays."),
        (2, "Prof. Anna Meyer wrote ANNA MEYER, not anna meyer."),
        (3, "Anna Meyer has no title here."),
        (4, "Mr. John Doe and Mr. Jack Doe met Mr. Doe."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.pseudonymise(docs, key=b"one").collect()}
    first, last = re.match(r"Mrs\. (\w+) ([\w-]+) came", got[1].text).groups()
    assert first in surrogates.GIVEN["latin", "f"]
    assert got[1].text == f"Mrs. {first} {last} came. Dr. {first} {last} spoke, then {first} {last} left; {last} was late, and so was Ms. {last}. Annameyer stays."
    assert got[2].text == f"Prof. {first} {last} wrote {first.upper()} {last.upper()}, not anna meyer."
    assert got[3].text == rows[2][1] and got[1].n_entities == 5
    # two persons of one family name: the name alone is neither of them
    names = re.match(r"Mr\. ([\w-]+ [\w-]+) and Mr\. ([\w-]+ [\w-]+) met Mr\. ([\w-]+)\.", got[4].text).groups()
    assert len(set(names)) == 3
    other = {r.doc_id: r.text for r in surrogates.pseudonymise(docs, key=b"two").collect()}
    assert other[1] != got[1].text and surrogates.session_key(spark) == surrogates.session_key(spark)


def test_formats_that_run_out(spark):
    """More values than the format has: all stay distinct, later ones get longer."""
    rows = [(i, f"token={i:08d}") for i in range(30)] + [(100 + i, f"Mr. {chr(65 + i // 26)}{chr(97 + i % 26)}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = [r.text for r in surrogates.pseudonymise(docs, key=b"k").collect()]
    assert len(set(texts)) == len(rows) and not {t for _, t in rows} & set(texts)
    assert len(surrogates.surrogate("ssn", "123-45-6789", "123456789", surrogates.LONGER_FROM)) == 19


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "Mr. John Doe", "x", 5, "y")], "doc_id long, text string, n_entities string, _past0 int, _hash0 string")
    row = surrogates.pseudonymise(docs, key=b"k").first()
    assert row.n_entities == 1 and row._past0 == 5 and row._hash0 == "y" and row.entity_kinds == "name"


def test_rows_without_id_are_judged(spark):
    text = " ".join(f"w{i}" for i in range(60))
    own = " ".join(f"v{i}" for i in range(60))
    rows = [(5, text), (None, text), (None, own), (None, own), (9, None), (None, None), (7, "leak " + " ".join(f"x{i}" for i in range(30)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted((r.doc_id or 0, r.text or "") for r in near_dup.mark(docs).collect())
    assert left == sorted([(5, text), (0, own), (9, ""), (0, ""), (7, rows[-1][1])])
    items = spark.createDataFrame([(1, own), (2, " ".join(f"x{i}" for i in range(30)))], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in decontaminate.clean(docs, items).collect()) == sorted([(5, text), (0, text), (9, ""), (0, "")])
