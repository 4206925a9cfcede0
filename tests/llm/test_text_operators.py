import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from titleforge.llm import byte_bpe, decontaminate, line_rules, near_dup, preferences, repeats, surrogates, token_files
from titleforge.llm.common import Scratch
from titleforge.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "a b " * 3000), (6, "x y z. " * 40), (6, "x y z. " * 40), (None, "no id, but a text of some words here."), (7, "é ñ ß — 漢字 😀"), (8, "#$%&|<> ### !!")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in ODD], "doc_id long, text string, score string")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())


def _base(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_line_rules(spark, odd, empty):
    got = line_rules.clean_lines(odd).collect()
    assert len(got) == len(ODD) and {r.score for r in got} == {"clash"}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _base(r.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert line_rules.clean_lines(empty).count() == 0
    prose = "This is a line of clean prose, which ends well.\nIt goes on for a while, as such lines do."
    junk = "home | about | contact | help\nLOUD!! WORDS!! ARE!! HERE!!\nAll rights reserved.\nThis one stays, being prose."
    rows = line_rules.clean_lines(spark.createDataFrame([(1, prose), (2, junk)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert rows[0].kept and rows[0].clean_text == prose
    assert not rows[1].kept and rows[1].clean_text == "This one stays, being prose."
    assert (rows[1].n_navigation, rows[1].n_punctuation, rows[1].n_boilerplate) == (1, 1, 1)


def test_preferences(spark):
    turn = "array<struct<role:string,text:string>>"
    a = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "yes")]
    rows = [(1, a, [*a[:3], ("assistant", "no!")]), (2, a, a), (3, None, a), (4, [("user", None)], []), (5, a, [("system", "s"), *a])]
    got = {r.id: r for r in preferences.format_preferences(spark.createDataFrame(rows, f"id int, chosen {turn}, rejected {turn}")).collect()}
    assert [got[i].n_prefix for i in range(1, 6)] == [3, 4, 0, 0, 0]
    assert [got[i].usable for i in range(1, 6)] == [True, False, False, False, True]
    for r in got.values():
        for text, mask in ((r.chosen_text, r.chosen_mask), (r.rejected_text, r.rejected_mask)):
            assert all(f"<|assistant|>\n{text[s.start : s.end]}\n<|end|>" in text for s in mask)
    assert got[1].rejected_text[got[1].rejected_mask[0].start : got[1].rejected_mask[0].end] == "no!"
    assert got[1].prompt.count("<|end|>") == 3
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert preferences.format_preferences(preferences.pairs_of(empty)).count() == 0


def _sets(rows):
    out = {}
    for i, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
        out[i] = {tuple(w[k : k + 2]) for k in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()
    return out


def test_near_duplicates(spark, odd, empty):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randrange(2, 90))] for _ in range(30)]
    rows = []
    for i in range(400):
        b = list(rng.choice(base))
        for _ in range(rng.randrange(0, max(1, len(b) // 12) + 1)):
            b[rng.randrange(len(b))] = rng.choice(words)
        rows.append((i, " ".join(b)))
    sets = _sets(rows)
    label = {i: i for i, _ in rows}
    for i in label:
        for j in label:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert {r.doc_id: r.component_id for r in got} == label
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    some = near_dup.near_duplicates(odd, size=2).collect()
    assert len(some) == len(ODD) and all(r.component_id == r.doc_id for r in some if r.doc_id not in (None, 6))
    assert near_dup.mark(odd).count() == len(ODD)
    assert near_dup.near_duplicates(empty).count() == 0


def test_crowded_region(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    hub = [rng.choice(words) for _ in range(120)]
    rows = [(0, " ".join(hub))]
    for i in range(1, 300):
        b = list(hub)
        for k in rng.sample(range(120), 6):
            b[k] = rng.choice(words)
        rows.append((i, " ".join(b)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert {r.component_id for r in got} == {0}


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_decontamination(spark, odd, empty):
    import numpy as np

    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [text(rng.randrange(15, 50)) for _ in range(30)]
    rows, planted = [], set()
    for i in range(200):
        body = text(60)
        if i % 2:
            k = rng.randrange(30)
            leak = list(items[k])
            for _ in range(len(leak) // 5):
                at = rng.randrange(len(leak))
                leak[at : at + 1] = rng.choice([[], ["zz"], [leak[at], "zz"]])
            if _distance(items[k], leak) <= len(items[k]) // 5:
                planted.add((i, k))
            body[20:20] = leak
        rows.append((i, " ".join(body).upper() if i % 3 else " ".join(body) + "!!"))
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(98, None), (99, "")], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.find_leaks(docs, benchmark).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert len(planted - found) <= 0.01 * len(planted)
    assert all(i % 2 for i, _ in found)
    left = {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()}
    assert left == {i for i, _ in rows} - {i for i, _ in found}
    assert decontaminate.find_leaks(odd, benchmark).count() == 0 == decontaminate.find_leaks(empty, benchmark).count()
    assert decontaminate.clean(odd, benchmark.limit(0)).count() == len(ODD)
    for _ in range(200):
        a, b = (np.array([rng.randrange(4) for _ in range(rng.randrange(1, 9))]) for _ in "ab")
        edits, s, e = decontaminate.best_stretch(a, b)
        assert edits == _distance(a, b[s:e]) == min(_distance(a, b[x:y]) for x in range(len(b) + 1) for y in range(x, len(b) + 1))


def test_surrogates(spark, odd, empty):
    text = "Mrs. Anna Meyer (anna.meyer@mail.example.com, +1 (212) 555-0199, 10.1.2.3) met Mr. JOHN DOE; card 4111111111111111, token = \"abcdef0123456789abcdef0123456789abcdef01\", г-жа Иванова."
    again = "Write to anna.meyer@mail.example.com or ask Mrs. Anna Meyer."
    got = surrogates.pseudonymise(spark.createDataFrame([(1, text), (2, again)], "doc_id long, text string")).orderBy("doc_id").collect()
    for private in ("Anna", "Meyer", "anna.meyer", "555-0199", "10.1.2.3", "JOHN", "4111111111111111", "abcdef0123", "Иванова"):
        assert private not in got[0].text and private not in got[1].text
    new = {k: got[0].text[a:b] for k, a, b, _ in surrogates.entities(got[0].text) if k != "name"}
    assert new["email"] in got[1].text and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", new["phone"]) and re.fullmatch(r"\d{16}", new["card"]) and re.fullmatch("[0-9a-f]{40}", new["secret"])
    first, last = re.search(r"Mrs\. (\w+) (\w+)", got[0].text).groups()
    assert first in surrogates.GIVEN["latin", "f"] and last in surrogates.FAMILY["latin"] and f"Mrs. {first} {last}" in got[1].text
    assert re.search(r"Mr\. [A-Z]+ [A-Z]+;", got[0].text) and re.search("г-жа [А-ЯЁ][а-яё]+а\\.", got[0].text)
    # far more names than the lists have pairs for one word: all stay distinct
    many = [(i, f"Mr. X{chr(97 + i // 26)}{chr(97 + i % 26)}o") for i in range(400)]
    texts = [r.text for r in surrogates.pseudonymise(spark.createDataFrame(many, "doc_id long, text string")).collect()]
    assert len(set(texts)) == 400
    same = surrogates.pseudonymise(odd).collect()
    assert len(same) == len(ODD) and sorted((r.doc_id or 0, r.text or "") for r in same) == sorted((i or 0, t or "") for i, t in ODD)
    assert surrogates.pseudonymise(empty).count() == 0


def test_surrogates_without_broadcast(spark, monkeypatch):
    many = spark.createDataFrame([(i, f"Mr. X{chr(97 + i // 26)}{chr(97 + i % 26)}o") for i in range(200)], "doc_id long, text string")
    want = {(r.doc_id, r.text) for r in surrogates.pseudonymise(many).collect()}
    monkeypatch.setattr(surrogates, "BROADCAST_ROWS", -1)
    assert {(r.doc_id, r.text) for r in surrogates.pseudonymise(many).collect()} == want


def test_byte_bpe(spark, odd, empty):
    import public_tokenizers
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(byte_bpe.default_ranks()), special_tokens={})
    odd_texts = [None, "", " ", "  a", "a \xa0 b", "\n\n x", "’s it's 'S", "　x　 x", "\x1c a", "a\x85 b", "...  !!\t\tq ", "١٢٣ 4５", " " * 3000]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(odd_texts, 100)), "doc_id long, text string"))
    with Scratch(spark) as scratch:
        rows = byte_bpe.decode(byte_bpe.encode(docs, scratch)).collect()
    want = sorted((i or 0, enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in (*ODD, *enumerate(odd_texts, 100)))
    assert sorted((r.doc_id or 0, list(r.ids), bytes(r.decoded)) for r in rows) == want
    assert byte_bpe.digests(empty).count() == 0


def test_digests_of_ids_and_bytes_in_one_worker(spark, odd, monkeypatch):
    """Neither ids nor decoded bytes go through the executor's heap to a second worker."""
    plans, keep = [], byte_bpe.held
    monkeypatch.setattr(byte_bpe, "held", lambda df: plans.append((df.schema, df._jdf.queryExecution().executedPlan().toString())) or keep(df))
    monkeypatch.setattr(byte_bpe, "STEP_WORDS", 50)
    rows = byte_bpe.digests(odd, block=9000).collect()
    with Scratch(spark) as scratch:
        whole = byte_bpe.decode(byte_bpe.encode(odd, scratch)).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(r.doc_id or 0, len(r.ids), sha(" ".join(map(str, r.ids)).encode()), sha(bytes(r.decoded))) for r in whole]
    assert sorted((r[0] or 0, *r[1:]) for r in rows) == sorted(want)
    ((schema, plan),) = plans
    assert {f.dataType.simpleString() for f in schema} == {"bigint", "string"}
    # one run of words to ids, one of blocks to digests
    assert plan.count("MapInArrow") == 2


def test_token_files(spark, odd, empty, tmp_path):
    import numpy as np
    import public_tokenizers
    import tokenizers

    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50, 3000):
        lengths = token_files.code_lengths(rng.zipf(1.3, n))
        assert lengths.max() <= token_files.LIMIT and (n == 1 or abs((2.0**-lengths).sum() - 1) < 1e-9)
        ids, ends = rng.integers(0, n, 5000), np.array([0, 0, 10, 700, 5000])
        bits, at = token_files.pack_bits(ids, ends, token_files.canonical(lengths), lengths)
        assert (token_files.Decoder(lengths).stretches(bits.tobytes(), at[[0, 10, 700]], np.array([10, 690, 4300])) == ids).all()
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = [(20, "a <|endoftext|> b"), (21, "x\n\n <|endoftext|><|endoftext|>y"), (22, "w<|endoftext|>")]
    with Scratch(spark) as scratch:
        path = str(tmp_path / "files")
        token_files.write_files(odd.select("doc_id", "text").unionByName(spark.createDataFrame(special, "doc_id long, text string")), path, scratch)
        before = {r.file: r.before for r in token_files.starts(spark, path).collect()}
        got = sorted(((before[r.file] + r.start_in_file, r.doc_id, list(r.ids)) for r in token_files.read_files(spark, path).collect()), key=lambda r: r[0])
        token_files.write_files(empty, str(tmp_path / "none"), scratch)
        assert token_files.read_files(spark, str(tmp_path / "none")).count() == 0
    assert [i for _, i, _ in got] == sorted((i for i, _ in (*ODD, *special)), key=lambda i: -1 if i is None else i)
    assert tok.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    start = 0
    for s, _, ids in got:
        assert s == start
        start += len(ids)
    want = sorted([*tok.encode(t or "", add_special_tokens=False).ids, 0] for _, t in (*ODD, *special))
    assert sorted(ids for *_, ids in got) == want


def _without_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone)))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("block", [3000, 2 << 20])
def test_repeats(spark, odd, empty, monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    monkeypatch.setattr(repeats, "MOST_LETTERS", block)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    base, rows = [text(400) for _ in range(12)], []
    for i in range(200):
        b, a = rng.choice(base), rng.randrange(200)
        piece = text(rng.randrange(1, 130))
        changed = b[:a] + "Z" + b[a + 1 :]
        rows.append((i, rng.choice([text(300), b, text(50) + b[a : a + rng.randrange(90, 200)] + text(50), "a" * rng.randrange(50, 700), piece * rng.randrange(2, 8), changed, None, "", text(100)])))
    rng.shuffle(rows)
    with Scratch(spark) as scratch:
        got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), scratch).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got} == _without_repeats(rows)
        assert repeats.remove_repeats(empty, scratch).count() == 0
        assert repeats.remove_repeats(odd.select("doc_id", "text"), scratch).count() == len(ODD)




def test_suffix_ranks_follow_the_letters():
    import numpy as np

    rng = random.Random(8)
    phrases = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 240))) for _ in range(12)] + [b"a" * 300, b"a" * 250]
    letters, ends = np.frombuffer(b"".join(phrases), np.uint8), np.cumsum([len(p) for p in phrases])
    rank = repeats.suffix_ranks(letters, ends)
    windows = {}
    for p, end in zip(phrases, ends, strict=True):
        for k in range(len(p)):
            at = end - len(p) + k
            assert (rank[at] >= 0) == (k + repeats.LENGTH <= len(p))
            if rank[at] >= 0:
                windows[int(rank[at])] = {*windows.get(int(rank[at]), ()), p[k : k + repeats.LENGTH]}
    assert all(len(w) == 1 for w in windows.values())
    assert [min(windows[r]) for r in sorted(windows)] == sorted({x for w in windows.values() for x in w})


def test_triggers_of_long_texts(monkeypatch):
    import numpy as np

    gram = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    want = repeats._triggers(gram)
    monkeypatch.setattr(repeats, "_STRETCH", 700)
    assert (repeats._triggers(gram) == want).all()


@pytest.mark.parametrize("most", [40, 100_000])
def test_pieces_are_the_librarys(monkeypatch, most):
    """Ids of whole texts, put together from pieces that were met before, spelled here or given to the library."""
    monkeypatch.setattr(token_files, "MOST_KNOWN", most)
    library = token_files.Pieces(token_files.default_tokenizer())
    pick = random.Random(most)
    stems = ["a", "don't", "Ünïon", "straße", "ĄćęŁ", "ɏȘ", "×", "÷a", "ñ", "日本", "рус", "x1", "12", "e.g.", "<|endoftext|>", "a\x00", "a\u0301", "ª", "\u00ad", "'s", "u" * 40, "é" * 16, "z" * 31]
    ends, gaps = ["", "", ".", "!!", ",%%%", "?'", "#$&*;:", ")", "\u00a0"], [" ", " ", "\n", "\t", "  ", " \n", "\r\n", "\u00a0 ", "\n "]
    for _ in range(12):
        texts = ["".join(pick.choice(gaps) * pick.randint(0, 1) + pick.choice(stems) * pick.randint(1, 2) + pick.choice(ends) for _ in range(pick.randint(0, 60))) + pick.choice(["", "\n", " "]) for _ in range(20)]
        distinct, codes, first = token_files.units(*token_files.utf8(pa.array(texts)))
        sizes, flat = library.told(distinct)
        pieces = np.split(flat, np.cumsum(sizes)[:-1])
        for text, a, b in zip(texts, first[:-1], first[1:], strict=True):
            assert [i for c in codes[a:b] for i in pieces[c].tolist()] == library.tok.encode(text, add_special_tokens=False).ids, repr(text)
        assert library.known.count <= most
    asked = []
    monkeypatch.setattr(library, "ids", lambda pieces: asked.extend(pieces) or type(library).ids(library, pieces))
    many = pa.array([f" {a}{b}{c}".encode() for a in "abcdefgh" for b in "éñßü" for c in (".", ",", "")], pa.large_binary())
    library.told(many)
    assert not asked  # plain pieces need no pattern
    library.told(pa.array([b" 1234"], pa.large_binary()))
    library.told(pa.array([b" 1234"], pa.large_binary()))
    assert asked == [b" 1234"]


def test_token_files_of_two_tokenizers(spark, tmp_path):
    """A worker that has met a word under one tokenizer still asks the other for it."""
    import tokenizers

    letters = sorted(tokenizers.pre_tokenizers.ByteLevel.alphabet())
    single = tokenizers.Tokenizer(tokenizers.models.BPE({c: i for i, c in enumerate(letters)}, []))
    single.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)
    single.save(str(tmp_path / "single.json"))
    text = "the same words again, and 12 again"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)
    for name, path in (("public", token_files.default_tokenizer()), ("single", str(tmp_path / "single.json"))):
        with Scratch(spark) as scratch:
            token_files.write_files(docs, str(tmp_path / name), scratch, tokenizer=path)
            [row] = token_files.read_files(spark, str(tmp_path / name)).collect()
        assert list(row.ids) == [*tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 0]
