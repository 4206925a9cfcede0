"""Entity resolution: blocking by rare words, verdicts by rule, clusters that never break a red line."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleforge.functions import entities as E
from titleforge.functions import similarity as S
from titleforge.functions import text as T
from titleforge.functions.text import Rules
from titleforge.operators.graph import components, cut

THRESHOLD, STRONG, NO_ENTITY, INFERRED = 0.80, 0.88, 0.95, 0.85


def candidates(raw: DataFrame, rules: Rules = Rules(), key: str = "raw_id", title: str = "raw_title", compose: bool = True) -> DataFrame:
    """Features of titles: (idx, title, display, normalized, tokens, entity, person, other, keys). idx is ``key``."""
    out = raw.select(F.col(key).alias("idx"), F.coalesce(title, F.lit("")).alias("title")).withColumn("display", T.display(F.col("title"), rules, compose))
    out = out.withColumn("meaningful", T.meaningful(T.tokens_of(F.col("display"), rules), rules)).withColumn("normalized", F.array_join("meaningful", " "))
    out = out.withColumn("entity", E.entities(F.col("title"), rules))
    e = F.col("entity")
    return out.withColumn("tokens", F.when(F.size(e["base"]) > 0, e["base"]).otherwise(F.col("meaningful"))).withColumns({"person": E.person_key(e), "other": E.other_key(e), "keys": E.key(e)})


def document_frequency(features: DataFrame, tokens: str = "tokens") -> DataFrame:
    return features.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def rare_tokens(features: DataFrame, top: int = 3, key: str = "idx", tokens: str = "tokens") -> DataFrame:
    """(key, token): each row's rarest words; of equally rare ones the greatest first."""
    spread = features.select(key, F.explode(F.array_distinct(tokens)).alias("token"))
    ranked = spread.join(document_frequency(features, tokens), "token")
    first = Window.partitionBy(key).orderBy(F.col("df").asc(), F.col("token").desc())
    return ranked.withColumn("r", F.row_number().over(first)).where(F.col("r") <= max(1, top)).select(key, "token")


def candidate_pairs(features: DataFrame, top: int = 3, most: int = 400, key: str = "idx", tokens: str = "tokens") -> DataFrame:
    """(a, b) with a < b that share a block of 2 to ``most`` rows; larger blocks compare nothing, by definition."""
    blocks = rare_tokens(features, top, key, tokens)
    sizes = blocks.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).select("token")
    kept = blocks.join(sizes, "token")
    # a block is at most ``most`` rows, so its pairs come from one bounded array, without a self-join
    rows = kept.groupBy("token").agg(F.array_sort(F.collect_list(key)).alias("ids"))
    left = rows.select("ids", F.posexplode("ids").alias("i", "a"))
    return left.select("a", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("b")).distinct()


def with_features(pairs: DataFrame, features: DataFrame, columns: list[str], key: str = "idx") -> DataFrame:
    out = pairs
    for side in ("a", "b"):
        out = out.join(features.select(F.col(key).alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
    return out


def verdict(score: Column, threshold: float = THRESHOLD, strong: float = STRONG, no_entity: float = NO_ENTITY) -> Column:
    """struct(verdict, confidence, reason, forbids) from columns person_*, other_*, keys_* of both sides.

    Red lines forbid a merge for good: different persons, or different other words (also at an uneven pair
    above the threshold). A low score alone only fails to merge.
    """
    pa, pb, oa, ob, ka, kb = (F.col(c) for c in ("person_a", "person_b", "other_a", "other_b", "keys_a", "keys_b"))
    some = lambda c: F.size(c) > 0
    share, uneven = F.size(F.array_intersect(pa, pb)) > 0, oa != ob
    out = lambda v, c, why, no=False: F.struct(F.lit(v).alias("verdict"), F.lit(c).alias("confidence"), F.lit(why).alias("reason"), F.lit(no).alias("forbids"))
    return (
        F.when(some(pa) & some(pb) & ~share, out("no_merge", 0.0, "red line: person", True))
        .when(some(oa) & some(ob) & uneven, out("no_merge", 0.0, "red line: token", True))
        .when(score < threshold, out("no_merge", 0.0, "low score"))
        .when(uneven & some(ka) & some(kb), out("no_merge", 0.0, "red line: token", True))
        .when(uneven & (score >= strong), out("candidate", 0.0, "token on one side"))
        .when(uneven, out("review", 0.0, "token on one side"))
        .when(share & (score >= strong), out("merge", 0.95, "same person"))
        .when(share, out("review", 0.0, "same person, lower score"))
        .when((some(pa) != some(pb)) & (score >= strong), out("candidate", 0.0, "person on one side"))
        .when(some(pa) != some(pb), out("review", 0.0, "person on one side, lower score"))
        .when(score >= no_entity, out("merge", 0.95, "same title"))
        .otherwise(out("review", 0.0, "similar, nothing to tell them apart"))
    )


def decisions(features: DataFrame, pairs: DataFrame, score: Column | None = None, **limits: float) -> DataFrame:
    """(a, b, score, verdict, confidence, reason, forbids, persons) of each pair."""
    both = with_features(pairs, features, ["normalized", "tokens", "person", "other", "keys"])
    both = both.withColumn("score", S.title_similarity(F.col("normalized_a"), F.col("normalized_b")) if score is None else score)
    return both.withColumn("v", verdict(F.col("score"), **limits)).select("a", "b", "score", "v.*", "person_a", "person_b")


def inferred(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (u, v, confidence, kind, seq_a, seq_b) of titles whose candidates agree on one person; and rows to review.

    The unnamed side is the one without person (the first, if both lack one).
    """
    flip = (F.size("person_a") > 0) & (F.size("person_b") == 0)
    sided = decided.where("verdict = 'candidate'").select(
        F.when(flip, F.col("b")).otherwise(F.col("a")).alias("unnamed"), F.when(flip, F.col("a")).otherwise(F.col("b")).alias("named"),
        F.when(flip, F.col("person_a")).otherwise(F.col("person_b")).alias("person"), "score", "a", "b",
    )
    seq = F.min(F.struct("a", "b"))
    best = F.max_by("named", F.struct(F.col("score"), -F.col("a"), -F.col("b")))
    grouped = sided.groupBy("unnamed").agg(F.count_distinct("person").alias("n"), F.max(F.size("person")).alias("some"), best.alias("named"), seq.alias("s"))
    sure = (F.col("n") == 1) & (F.col("some") > 0)
    links = grouped.where(sure).select(F.col("unnamed").alias("u"), F.col("named").alias("v"), F.lit(INFERRED).alias("confidence"), F.lit(1).alias("kind"), F.col("s.a").alias("seq_a"), F.col("s.b").alias("seq_b"))
    return links, grouped.where(~sure).select(F.col("unnamed").alias("idx"))


def uncertain(decided: DataFrame) -> DataFrame:
    """Rows of review pairs: only the side without person if just one has a person, else both."""
    a, b = F.size("person_a") > 0, F.size("person_b") > 0
    sides = F.when(a & ~b, F.array("b")).when(b & ~a, F.array("a")).otherwise(F.array("a", "b"))
    return decided.where("verdict = 'review'").select(F.explode(sides).alias("idx"))


def merged_in_order(links: list[tuple], forbidden: set[tuple]) -> tuple[dict, dict, set]:
    """Unions in order, skipping those that would join a forbidden pair: (root, confidence) by node, refused nodes."""
    root: dict = {}
    group: dict = {}
    confidence: dict = {}
    refused: set = set()
    for u, v, c in links:
        for x in (u, v):
            if x not in root:
                root[x], group[x] = x, {x}
        p, q = root[u], root[v]
        if p != q:
            small, large = sorted((group[p], group[q]), key=len)
            if any((min(x, y), max(x, y)) in forbidden for x in small for y in large):
                refused |= {u, v}
                continue
            for x in group.pop(q):
                root[x] = p
                group[p].add(x)
        for x in (u, v):
            confidence[x] = min(confidence.get(x, 1.0), c)
    return root, confidence, refused


def clusters(features: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(idx, root, confidence, review) of every row, and the links that were tried.

    Links of one component of accepted pairs meet in one task, in order of confidence, kind and pair; a pair
    across components can never be joined, so this equals the order over the whole table.
    """
    decided = cut(decided)
    direct = decided.where("verdict = 'merge'").select(F.col("a").alias("u"), F.col("b").alias("v"), "confidence", F.lit(0).alias("kind"), F.col("a").alias("seq_a"), F.col("b").alias("seq_b"))
    guessed, unsure = inferred(decided)
    links = cut(direct.unionByName(guessed))
    part = components(links)
    tagged = links.join(part.select(F.col("node").alias("u"), "component"), "u")
    red = decided.where("forbids").select(F.col("a").alias("u"), F.col("b").alias("v"))
    inside = red.join(part.select(F.col("node").alias("u"), "component"), "u").join(part.select(F.col("node").alias("v"), F.col("component").alias("c2")), "v").where("component = c2")
    rows = tagged.select("component", "u", "v", "confidence", "kind", "seq_a", "seq_b").unionByName(
        inside.select("component", "u", "v", F.lit(0.0).alias("confidence"), F.lit(-1).alias("kind"), F.col("u").alias("seq_a"), F.col("v").alias("seq_b"))
    )
    kind = dict(features.dtypes)["idx"]

    def greedy(frame: pd.DataFrame) -> pd.DataFrame:
        forbidden = {(min(u, v), max(u, v)) for u, v in frame.loc[frame.kind < 0, ["u", "v"]].itertuples(index=False)}
        tried = frame[frame.kind >= 0].sort_values(["confidence", "kind", "seq_a", "seq_b"], ascending=[False, True, True, True])
        root, confidence, refused = merged_in_order(list(tried[["u", "v", "confidence"]].itertuples(index=False, name=None)), forbidden)
        return pd.DataFrame([(x, r, confidence.get(x, 1.0), x in refused) for x, r in root.items()], columns=["idx", "root", "node_confidence", "refused"])

    solved = rows.groupBy("component").applyInPandas(greedy, f"idx {kind}, root {kind}, node_confidence double, refused boolean")
    flagged = uncertain(decided).unionByName(unsure).distinct().withColumn("flag", F.lit(True))
    all_rows = features.select("idx").join(solved, "idx", "left").join(flagged, "idx", "left").withColumn("root", F.coalesce("root", "idx"))
    over = Window.partitionBy("root")
    out = all_rows.withColumn("size", F.count("*").over(over)).withColumn("low", F.min("node_confidence").over(over))
    review = (F.coalesce("flag", F.lit(False)) | F.coalesce("refused", F.lit(False))) & (F.col("size") == 1)
    confidence = F.when(F.col("size") > 1, F.round(F.coalesce("low", F.lit(0.95)), 4)).when(review, 0.5).otherwise(1.0)
    return out.select("idx", "root", confidence.alias("confidence"), review.alias("review")), links


def canonical(features: DataFrame, clustered: DataFrame) -> DataFrame:
    """(root, title, tokens, confidence, needs_review, members): the records of the clusters.

    The title is the majority's, then that with most meaningful words, then the shortest, then the greatest.
    Equal titles of two clusters get their sorted words added, then a number.
    """
    rows = clustered.join(features.select("idx", "title", "display", "normalized", F.size("meaningful").alias("n"), F.col("entity.tokens").alias("tokens")), "idx")
    votes = rows.withColumn("votes", F.count("*").over(Window.partitionBy("root", "normalized")))
    shown = F.coalesce(F.when(F.col("display") != "", F.col("display")), F.col("title"))
    best = F.max_by(shown, F.struct("votes", "n", -F.length("display"), "display", -F.col("idx")))
    members = F.array_sort(F.collect_list(F.struct("idx", "tokens")))
    out = votes.groupBy("root").agg(best.alias("title"), members.alias("m"), F.first("confidence").alias("confidence"), F.max("review").alias("needs_review"))
    out = out.withColumn("tokens", F.array_distinct(F.flatten(F.transform("m", lambda x: x["tokens"])))).withColumn("members", F.transform("m", lambda x: x["idx"]))
    return unique_titles(out.drop("m"))


def unique_titles(records: DataFrame) -> DataFrame:
    """Distinct titles, as if given out in the order of the roots: the title, else with its words added, else the first free number.

    Each round the least root keeps a wanted title and the others ask for a later choice; a row that has others of its
    own title before it skips as many numbers, which those will take, so rounds are few.
    """
    words = F.array_join(F.array_sort(F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>")))), " ")
    now = cut(records.select("root", F.col("title").alias("plain"), words.alias("words"), F.lit(0).alias("k")))
    wanted = F.when(F.col("k") == 0, F.col("plain")).when(F.col("k") == 1, F.concat_ws(" ", "plain", "words")).otherwise(F.concat(F.col("plain"), F.lit(" #"), F.col("k").cast("string")))
    while True:
        asked = now.withColumn("wanted", wanted)
        order = lambda *by: Window.partitionBy(*by).orderBy("root")
        ranked = asked.withColumns({"r": F.row_number().over(order("wanted")), "own": F.row_number().over(order("plain", "k"))})
        ranked = ranked.withColumn("kept", F.min(F.when(F.col("own") == 1, F.col("r") == 1)).over(Window.partitionBy("plain", "k")))
        later = F.when(F.col("k") == 0, F.when(F.col("words") != "", 1).otherwise(2)).when(F.col("k") == 1, 2).otherwise(F.col("k") + F.col("own") - F.when(F.col("kept"), 1).otherwise(0))
        now = cut(ranked.select("root", "plain", "words", F.when(F.col("r") == 1, F.col("k")).otherwise(later).cast("int").alias("k"), (F.col("r") > 1).alias("moved")))
        if now.where("moved").isEmpty():
            break
        now = now.drop("moved")
    return records.drop("title").join(now.select("root", wanted.alias("title")), "root").select(*records.columns)


def resolve(raw: DataFrame, rules: Rules = Rules(), top: int = 3, most: int = 400, **limits: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, clusters, decisions) of rows (raw_id, raw_title)."""
    # titles are often made in Python; reading them from a checkpoint keeps the readers below apart
    features = cut(candidates(cut(raw), rules))
    decided = cut(decisions(features, candidate_pairs(features, top, most), **limits))
    clustered, _ = clusters(features, decided)
    clustered = cut(clustered)
    return canonical(features, clustered), clustered, decided


def stats(decided: DataFrame, clustered: DataFrame) -> DataFrame:
    """One row of counts: pairs, merged, red lines, reviewed pairs, clusters, clusters to review."""
    pairs = decided.agg(F.count("*").alias("pairs"), F.count_if(F.col("verdict") == "merge").alias("merged_pairs"), F.count_if("forbids").alias("red_lines"), F.count_if(F.col("verdict") == "review").alias("review_pairs"))
    rows = clustered.agg(F.count_distinct("root").alias("clusters"), F.count_if("review").alias("needs_review"))
    return pairs.join(rows)


def audit_rows(decided: DataFrame, features: DataFrame) -> Iterator[str]:
    """The decisions as JSON lines, streamed."""
    names = features.select("idx", "title")
    named = decided.join(names.select(F.col("idx").alias("a"), F.col("title").alias("title_a")), "a").join(names.select(F.col("idx").alias("b"), F.col("title").alias("title_b")), "b")
    yield from (r[0] for r in named.select(F.to_json(F.struct("a", "b", "title_a", "title_b", "score", "verdict", "confidence", "reason"))).toLocalIterator())
