"""Surrogates for personal data.

Detected entities get keyed replacements of their own kind: names keep gender, script, case and number of
parts, everything else keeps its format character by character. A replacement is a function of (key, kind,
normal value, attempt), so one person or address has one surrogate in the whole corpus (coreference), however it is
spaced, and whatever title a person has: the gender of a name is told from all its titles in the corpus.
Distinct entities are then compared globally: where two share a surrogate, or a surrogate is itself an entity
of the corpus, all but the first move on to their next attempt, until none collide (distinctness). Where the values
of a format run out, later attempts are longer.

A name is found after a title. Further mentions of a found name in its text are replaced too, without a title: the
whole name, and its last word alone. A last word that ends exactly one longer name of the text means that person.
A name that has no title anywhere in a text stays.

The key comes from ``spark.titleforge.surrogates.key``; without that setting it is random and lasts for the session.

Texts are not shuffled: only distinct entities are, and what a text needs beyond its own words is the list of
entities past attempt 0 or of unlike titles, which is broadcast up to BROADCAST_ROWS rows and joined by row beyond.

Defined results: a null text stays null with 0 entities, as an empty one stays empty. Repeated rows get the same
replacements. Of overlapping candidates the earlier wins, then the longer kind listed first. Very long texts are read
whole. Other columns pass through; result columns (n_entities, entity_kinds) win over input columns of their name.
An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import secrets
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleforge.llm.common import Scratch, held, lean, table, tidy

BROADCAST_ROWS = 200_000
#: Attempts after which names get a part of letters, and after which every surrogate gets longer.
LETTERS_FROM, LONGER_FROM = 10, 20
SETTING = "spark.titleforge.surrogates.key"
_session_keys: dict[str, bytes] = {}

#: Titles that show a gender, and those that don't.
MALE = ("Mr", "Mister", "Sir", "Herr", "Monsieur", "M", "Señor", "Sr", "Don", "Signor", "господин", "г-н", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra", "Srta", "Doña", "Signora", "госпожа", "г-жа", "κυρία")
NEUTRAL = ("Dr", "Prof", "Professor", "Doctor", "доктор")
#: Given names by script and gender, and family names by script.
GIVEN = {
    ("latin", "m"): "Adam Albert Andrew Anton Bruno Carl Daniel David Edgar Emil Felix Frank Georg Gustav Henry Hugo Ivan Jacob James Jonas Karl Leo Louis Lucas Marco Martin Max Milo Noah Oscar Otto Paul Peter Philip Robert Rolf Samuel Simon Theo Thomas Victor Walter".split(),
    ("latin", "f"): "Ada Agnes Alice Amelia Anna Bella Carla Celia Clara Daria Diana Edith Elena Ella Emma Erika Eva Flora Frida Greta Hanna Helen Ida Irene Iris Jana Julia Karin Laura Lena Lily Lucia Maria Marta Mia Nina Nora Olga Paula Petra Rosa Sara Sonia Vera".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Степан Тимур Фёдор Юрий".split(),
    ("cyrillic", "f"): "Алла Белла Вера Галина Дарья Елена Жанна Зоя Ирина Кира Лидия Мария Нина Ольга Полина Рита Софья Юлия".split(),
    ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Ηλίας Κώστας Λουκάς Μάρκος Νίκος Πέτρος Σταύρος".split(),
    ("greek", "f"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία".split(),
}
FAMILY = {
    "latin": "Abbott Adler Bauer Becker Bell Berger Blanc Brandt Brook Carter Costa Dorn Duval Ellis Faber Fischer Fontaine Frost Garcia Gray Haas Hart Hill Hofer Jansen Keller Klein Lambert Lang Lopez Marsh Mercer Meyer Moreau Nolan Novak Ortega Page Pratt Quinn Ramos Reed Renard Roth Santos Shaw Stein Stone Torres Vance Vogel Wagner Ward Weber Winter Wolf York Ziegler".split(),
    "cyrillic": "Белов Волков Громов Дроздов Ершов Жуков Зимин Ильин Котов Лавров Морозов Носов Орлов Попов Рыбин Соколов".split(),
    "greek": "Αλεξίου Βασιλείου Γεωργίου Δήμου Ιωάννου Κωστή Λάμπρου Νικολάου Παύλου Σταύρου".split(),
}
_TITLE = "|".join(re.escape(t) for t in sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True))
_CAP = r"[A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆΈ-Ώ][\w'’\-]+"
#: Kinds and their patterns, the first winning where two begin at one place.
KINDS = {
    "secret": r"""(?i:\b(?:token|api[_-]?key|secret|password|passwd|access[_-]?key)\b\s*[=:]\s*["']?)(?P<secret>[A-Za-z0-9_\-+/=.]{8,})""",
    "email": r"(?P<email>[\w.+%\-]+@[\w\-]+(?:\.[\w\-]+)+)",
    "iban": r"\b(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b",
    "ip": r"(?<![\d.])(?P<ip>(?:\d{1,3}\.){3}\d{1,3})(?![\d.]*\d)",
    "card": r"(?<![\d\-])(?P<card>\d{13,19}|\d{4}(?:[ \-]\d{4}){3})(?![\d\-]*\d)",
    "ssn": r"(?<![\d\-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\d\-]*\d)",
    "phone": r"(?<![\w.])(?P<phone>\+?\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .\-]?\d{4})(?![\w]*\d)",
    "hex": r"\b(?P<hex>(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{32,128})\b",
    "name": rf"\b(?P<title>{_TITLE})\.?[ \u00A0](?P<name>{_CAP}(?:[ \u00A0]{_CAP}){{0,2}})",
}
#: Calling codes: none is the beginning of another.
_CALLING = re.compile(r"\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})")
PATTERN = re.compile("|".join(KINDS.values()))
#: Texts without a match of this have no entity (RE2).
SIGN = rf"[0-9@]|(?:{_TITLE})\.?[ \x{{A0}}]\p{{Lu}}|(?i:token|api.?key|secret|passw|access.?key)"


def session_key(spark: SparkSession) -> bytes:
    """The key in SETTING, else a random one of this session."""
    key = spark.conf.get(SETTING, None)
    return key.encode() if key else _session_keys.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def _mentions(text: str, out: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Names without their title where the text has them with one; one person by one value and gender."""
    names = {n[2:] for k, _, _, n in out if k == "name"}
    if not names:
        return out
    last: dict[str, list[str]] = {}
    for name in sorted(names):
        if " " in name:
            last.setdefault(name.rpartition(" ")[2], []).append(name)
    person = lambda name: last[name][0] if len(last.get(name, ())) == 1 else name
    out = [(k, a, b, f"{n[:2]}{person(n[2:])}" if k == "name" else n) for k, a, b, n in out]
    wanted = sorted({*names, *last}, key=lambda x: (-len(x), x))
    again = re.compile(r"(?<![\w@.\-])(?:" + "|".join(r"[ \u00A0]".join(map(re.escape, w.split())) for w in wanted) + r")(?![\w@])", re.I)
    starts, ends = [a for _, a, _, _ in out], [b for _, _, b, _ in out]
    for m in again.finditer(text):
        near = bisect.bisect_right(starts, m.start())
        free = (near == 0 or ends[near - 1] <= m.start()) and (near == len(starts) or starts[near] >= m.end())
        if free and all(w[0].isupper() for w in m[0].split()):
            out.append(("name", *m.span(), f"n:{person(' '.join(m[0].split()).lower())}"))
    genders: dict[str, str] = {}
    for k, _, _, n in out:
        if k == "name":
            genders[n[2:]] = min(genders.get(n[2:], "n"), n[0])
    return [(k, a, b, f"{genders[n[2:]]}:{n[2:]}" if k == "name" else n) for k, a, b, n in out]


def entities(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, normal value) of a text's entities, in order; a name's value opens with its gender there."""
    out = []
    for m in PATTERN.finditer(text):
        kind = m.lastgroup
        if kind == "name":
            title = m["title"]
            gender = "m" if title in MALE else "f" if title in FEMALE else "n"
            out.append(("name", *m.span("name"), f"{gender}:{' '.join(m['name'].split()).lower()}"))
            continue
        raw = m[kind]
        if kind == "phone" and not 7 <= sum(c.isdigit() for c in raw) <= 15:
            continue
        if kind == "email":
            raw = raw.rstrip(".-_")
        a = m.start(kind)
        out.append((kind, a, a + len(raw), _normal(kind, raw)))
    return sorted(_mentions(text, out), key=lambda x: x[1:3])


def _normal(kind: str, raw: str) -> str:
    """Emails in lower case; numbers by their digits and letters, and a phone's plus, however they are spaced."""
    if kind in ("phone", "card", "iban", "ssn"):
        return ("+" if kind == "phone" and raw.startswith("+") else "") + "".join(c for c in raw if c.isalnum())
    return raw.lower() if kind == "email" else raw


def _stream(kind: str, value: str, attempt: int, key: bytes) -> Iterator[int]:
    block = 0
    while True:
        yield from hashlib.blake2b(f"{kind}\0{value}\0{attempt}\0{block}".encode(), key=key[:64]).digest()
        block += 1


def _reshaped(value: str, stream: Iterator[int]) -> str:
    """Digits to digits and letters to letters of the same case and script; the rest stays."""
    out = []
    for c in value:
        if not c.isalnum():  # spacing takes nothing of the stream, so all spellings get the same digits
            out.append(c)
            continue
        b = next(stream) | next(stream) << 8
        if c.isdigit():
            out.append(chr(ord(c) - int(c) + b % 10) if c.isdecimal() else str(b % 10))
        elif "а" <= c.lower() <= "я":
            out.append(chr(ord("а") + b % 32) if c.islower() else chr(ord("А") + b % 32))
        elif "α" <= c.lower() <= "ω":
            out.append("αβγδεζηθικλμνξοπρστυφχψω"[b % 24] if c.islower() else "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"[b % 24])
        elif c.isalpha():
            letter = chr(ord("a") + b % 26)
            out.append(letter.upper() if c.isupper() else letter)
        else:
            out.append(c)
    return "".join(out)


def _cased(new: str, old: str) -> str:
    return new.upper() if old.isupper() and len(old) > 1 else new.lower() if old.islower() else new


def surrogate(kind: str, raw: str, normal: str, attempt: int, key: bytes = b"") -> str:
    """The replacement of one mention; mentions with one normal value differ in case and spacing only.

    A name's normal value is its gender, a colon and the whole name; a mention of fewer words gets the last parts.
    """
    if kind == "name":
        gender, words = normal[0], normal[2:].split()
        stream = _stream(kind, normal[2:], attempt, key)
        script = "cyrillic" if re.search(r"[а-яё]", normal[2:]) else "greek" if re.search(r"[α-ωά-ώ]", normal[2:]) else "latin"
        pick = lambda names: names[(next(stream) | next(stream) << 8 | next(stream) << 16) % len(names)]
        given = GIVEN[script, gender] if gender in "mf" else GIVEN[script, "m"] + GIVEN[script, "f"]
        family = pick(FAMILY[script])
        parts = [*(pick(given) for _ in words[1:]), family]
        if attempt >= LETTERS_FROM:  # the lists are used up: a further part of letters
            longer = words[-1] if attempt < LONGER_FROM else (words[-1] * 8)[:8]
            parts[-1] += "-" + _reshaped(longer, stream).capitalize()
        if script == "cyrillic" and gender == "f" and parts[-1].endswith(("в", "н")):
            parts[-1] += "а"
        old = raw.split()
        return " ".join(_cased(p, w) for p, w in zip(parts[-len(old) :], old, strict=True))
    stream = _stream(kind, normal, attempt, key)
    out = _formatted(kind, raw, normal, stream, key)
    return out if attempt < LONGER_FROM else out + _reshaped("00000000", stream)


def _formatted(kind: str, raw: str, normal: str, stream: Iterator[int], key: bytes) -> str:
    """A value of the format of ``raw``."""
    if kind == "email":
        local, _, domain = raw.partition("@")
        labels = domain.lower().split(".")
        # one domain has one surrogate, whoever writes from it; its last label stays
        renamed = _reshaped(".".join(labels[:-1]), _stream("domain", ".".join(labels), 0, key))
        return f"{_reshaped(local, stream)}@{renamed}.{labels[-1]}"
    if kind == "ip":
        return ".".join(str(1 + (next(stream) | next(stream) << 8) % 254) for _ in range(4))
    if kind in ("secret", "hex") and re.fullmatch(r"[0-9a-fA-F]+", raw):
        digits = "0123456789ABCDEF" if raw.isupper() else "0123456789abcdef"
        return "".join(digits[next(stream) % 16] for _ in raw)
    if kind == "iban":
        return raw[:2] + _reshaped(raw[2:], stream)
    if kind == "phone" and raw.startswith("+"):
        # the calling code stays; it is told by its digits, as not all spellings part it off
        code = len(_CALLING.match(normal)[1])
        at = [i for i, c in enumerate(raw) if c.isdigit()][code - 1] + 1
        return raw[:at] + _reshaped(raw[at:], stream)
    return _reshaped(raw, stream)


def _flags(column: pa.Array) -> list[bool]:
    return pc.fill_null(pc.match_substring_regex(column, SIGN), False).to_pylist()


def _found(docs: DataFrame, text: str) -> DataFrame:
    """(kind, normal, gender, raw) of all mentions; the gender is that of all the text's mentions, empty but for names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, rows = batch.column(0), set()
            for i, flag in enumerate(_flags(column)):
                if flag:
                    t = column[i].as_py()
                    rows.update((k, *_entity(k, n), t[a:b]) for k, a, b, n in entities(t))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*sorted(rows), strict=True)], ["kind", "normal", "gender", "raw"])

    return docs.select(F.col(text).cast("string").alias("t")).mapInArrow(tidy(run), "kind string, normal string, gender string, raw string")


def _entity(kind: str, normal: str) -> tuple[str, str]:
    """What all mentions of an entity have in common, and a name's gender."""
    return (normal[2:], normal[0]) if kind == "name" else (normal, "")


def _valued(kind: str, entity: str, gender: str) -> str:
    return f"{gender}:{entity}" if kind == "name" else entity


def _assigned(distinct: DataFrame, key: bytes) -> DataFrame:
    """Adds ``new``: the whole surrogate of each entity in normal form, as entities are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "normal", "gender", "raw", "attempt")), strict=True)
            out = [_normal(k, surrogate(k, n if k == "name" else r, _valued(k, n, g), a, key)).lower() for k, n, g, r, a in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "new"])

    return distinct.mapInArrow(tidy(run), distinct.select("*").schema.add("new", "string"))


def exceptions(docs: DataFrame, text: str, scratch: Scratch, key: bytes) -> DataFrame:
    """(kind, normal, gender, attempt) of entities whose first surrogate collides or whose titles are unlike."""
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    now = _found(docs, text).groupBy("kind", "normal").agg(F.min("raw").alias("raw"), F.min("gender").alias("gender"), (F.min("gender") != F.max("gender")).alias("unlike"))
    now = scratch.save(now.withColumn("attempt", F.lit(0)))
    originals = scratch.save(now.select("kind", F.lower("normal").alias("new")).distinct())
    while True:
        made = scratch.save(_assigned(now, key))
        # the first of those that share a surrogate keeps it: the least attempt, then the least value
        shared = made.groupBy("kind", "new").agg(F.count("*").alias("c"), F.min(F.struct("attempt", "normal"))["normal"].alias("owner"))
        shared = scratch.save(shared.join(originals.withColumn("taken", F.lit(True)), ["kind", "new"], "left").where("c > 1 or taken").select("kind", "new", "owner", F.coalesce("taken", F.lit(False)).alias("taken")))
        if shared.isEmpty():
            break
        bump = F.col("owner").isNotNull() & (F.col("taken") | (F.col("owner") != F.col("normal")))
        bumped = made.join(few(shared), ["kind", "new"], "left").withColumn("attempt", F.col("attempt") + F.coalesce(bump.cast("int"), F.lit(0)))
        now = scratch.save(bumped.select(*now.columns))
    return now.where("attempt > 0 or unlike").select("kind", "normal", "gender", "attempt")


def replaced(text: str, past: dict[tuple[str, str], tuple[str, int]], key: bytes) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds of its mentions; ``past`` has gender and attempt of exceptions."""
    out, at, kinds = [], 0, []
    for kind, a, b, normal in entities(text):
        entity, gender = _entity(kind, normal)
        gender, attempt = past.get((kind, entity), (gender, 0))
        out += [text[at:a], surrogate(kind, text[a:b], _valued(kind, entity, gender), attempt, key)]
        at = b
        kinds.append(kind)
    return "".join([*out, text[at:]]), kinds


def pseudonymise(docs: DataFrame, text: str = "text", key: bytes | None = None) -> DataFrame:
    """The documents with surrogates in ``text``; adds n_entities and entity_kinds (one word a mention)."""
    key = session_key(docs.sparkSession) if key is None else key
    keep = [c for c in docs.columns if c not in ("n_entities", "entity_kinds")]
    with Scratch(docs.sparkSession) as scratch:
        past = held(exceptions(docs, text, scratch, key))
    few = past.count() <= BROADCAST_ROWS
    told = lambda rows: {(r["kind"], r["normal"]): (r["gender"], r["attempt"]) for r in rows}
    shared = told(past.collect()) if few else {}
    source = docs.select(*keep) if few else _with_past(docs.select(*keep), text, past)
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, 512) for whole in batches for a in range(0, len(whole), 512)):
            column = batch.column(at)
            own = None if few else batch.column(len(keep))
            texts, n, kinds = column.to_pylist(), [0] * len(column), [""] * len(column)
            for i, flag in enumerate(_flags(column)):
                if flag:
                    texts[i], found = replaced(texts[i], shared if own is None else told(own[i].as_py() or ()), key)
                    n[i], kinds[i] = len(found), " ".join(found)
            columns = [pa.array(texts, pa.string()) if j == at else c for j, c in enumerate(batch.columns[: len(keep)])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(kinds, pa.string())], [*keep, "n_entities", "entity_kinds"])

    return source.mapInArrow(tidy(run), docs.select(*keep).schema.add("n_entities", "long").add("entity_kinds", "string"))


def _with_past(docs: DataFrame, text: str, past: DataFrame) -> DataFrame:
    """Adds to each row, last, the exceptions among the entities of its text, by the text's hash."""
    taken = set(docs.columns)
    name = next(f"_past{i}" for i in range(len(taken) + 1) if f"_past{i}" not in taken)
    mark = next(f"_hash{i}" for i in range(len(taken) + 1) if f"_hash{i}" not in taken)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for i, flag in enumerate(_flags(batch.column(1))):
                if flag:
                    rows.update((batch.column(0)[i].as_py(), k, _entity(k, n)[0]) for k, _, _, n in entities(batch.column(1)[i].as_py()))
            if rows:
                h, k, n = zip(*sorted(rows), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.string()), pa.array(k, pa.string()), pa.array(n, pa.string())], [mark, "kind", "normal"])

    whole = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    mentions = docs.select(whole.alias(mark), F.col(text).cast("string").alias("t")).mapInArrow(tidy(run), f"{mark} string, kind string, normal string").distinct()
    own = mentions.join(past, ["kind", "normal"]).groupBy(mark).agg(F.collect_list(F.struct("kind", "normal", "gender", "attempt")).alias(name))
    return docs.withColumn(mark, whole).join(own, mark, "left").select(*docs.columns, name)


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean(spark)
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
