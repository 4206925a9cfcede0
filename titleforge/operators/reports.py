"""Report sheets, browsing, counters and file sinks."""

from __future__ import annotations

import csv
import os
import re
import zipfile
from functools import reduce
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleforge.functions import fixed as X

# The limits of a workbook's tabs and the names its format asks for.
TAB_NAME, TAB_ROWS = 31, 1_048_576
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_MIME = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_SHEET_HEAD = f'{_XML}<worksheet xmlns="{_MAIN}"><sheetViews><sheetView rightToLeft="1" workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>'
_UNPRINTABLE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def category_of(mapping: DataFrame, raw: DataFrame) -> DataFrame:
    """(id, category): the most frequent non-empty category of members; of equal ones the least."""
    rows = mapping.join(raw.select(F.col("id").alias("raw_id"), "category"), "raw_id").where("category <> ''")
    return rows.groupBy(F.col("canonical_id").alias("id")).agg(F.mode("category", True).alias("category"))


def wide(canonical: DataFrame, mapping: DataFrame, raw: DataFrame, keywords: DataFrame) -> DataFrame:
    """One row a product, with what its members and keywords give, each aggregated before it is joined."""
    members = mapping.join(raw.select(F.col("id").alias("raw_id"), "source_domain", "source_url"), "raw_id")
    ordered = F.array_sort(F.collect_list(F.struct("raw_id", "source_domain", "source_url")))
    per = members.groupBy(F.col("canonical_id").alias("id")).agg(ordered.alias("m")).select(
        "id", F.array_distinct(F.filter(F.transform("m", lambda x: x["source_domain"]), lambda d: d.isNotNull() & (d != ""))).alias("domains"), F.transform("m", lambda x: x["source_url"]).alias("urls"),
    )
    words = keywords.groupBy(F.col("canonical_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "keyword"))), lambda x: x["keyword"]).alias("keywords"))
    none = F.array().cast("array<string>")
    out = canonical.join(per, "id", "left").join(words, "id", "left").join(category_of(mapping, raw), "id", "left")
    return out.withColumns({c: F.coalesce(c, none) for c in ("domains", "urls", "keywords")}).withColumn("category", F.coalesce("category", F.lit("")))


def _columns(cells: int, label: bool, words: bool) -> list[Column]:
    status = F.coalesce("suggest_status", F.lit(""))
    named = F.coalesce(F.create_map(*(F.lit(x) for kv in X.SUGGEST_LABELS.items() for x in kv))[status], F.lit(X.SUGGEST_LABELS[""]))
    return [
        F.col("canonical_title"),
        *([named.alias("suggest")] if label else []),
        *([F.array_join("keywords", " | ").alias("lsi_keywords")] if words else []),
        F.size("keywords").cast("long").alias("lsi_count"),
        F.col("category"),
        F.array_join("domains", " | ").alias("source_domains"),
        F.array_join("urls", " | ").alias("source_urls"),
        F.size("urls").cast("long").alias("merge_count"),
        F.round(F.coalesce("merge_confidence", F.lit(0.0)), 3).alias("confidence"),
        *(F.coalesce(F.get("keywords", F.lit(i)), F.lit("")).alias(f"suggest_{i + 1}") for i in range(max(0, min(50, cells)) if words else 0)),
    ]


def ready(products: DataFrame, cells: int = 10) -> DataFrame:
    return products.where("suggest_status = 'has_suggest'").select(*_columns(cells, False, True)).orderBy(F.col("lsi_count").desc(), "canonical_title")


def archive(products: DataFrame) -> DataFrame:
    """All that is not ready, pending products too."""
    return products.where("coalesce(suggest_status, '') <> 'has_suggest'").select(*_columns(0, False, False)).orderBy("canonical_title")


def everything(products: DataFrame, cells: int = 10) -> DataFrame:
    return products.select(*_columns(cells, True, True)).orderBy(F.col("suggest") != X.SUGGEST_LABELS["has_suggest"], F.col("lsi_count").desc(), "canonical_title")


def review(products: DataFrame, raw: DataFrame) -> DataFrame:
    """Ambiguous products and borderline rows, one under the other."""
    row = lambda kind, title, score, urls: (F.lit(kind[0]).alias("type"), title.alias("title"), F.lit(kind[1]).alias("reason"), F.round(F.coalesce(score, F.lit(0.0)), 3).alias("score"), urls.alias("source_urls"))
    unsure = products.where("needs_review").select(*row(X.REVIEW_MERGE, F.col("canonical_title"), F.col("merge_confidence"), F.array_join("urls", " | ")))
    border = borderline(raw).select(*row(X.REVIEW_TOPIC, F.col("raw_title"), F.col("topic_score"), F.col("source_url")))
    return unsure.unionByName(border).orderBy("type", "score")


def sheets(canonical: DataFrame, mapping: DataFrame, raw: DataFrame, keywords: DataFrame, wanted: str | list[str] | None = None, cells: int = 10) -> dict[str, DataFrame]:
    """The wanted sheets by key, in a fixed order; none or only unknown keys mean all."""
    asked = [w.strip() for w in wanted.split(",")] if isinstance(wanted, str) else list(wanted or [])
    keys = [k for k in X.SHEETS if k in asked] or list(X.SHEETS)
    products = wide(canonical, mapping, raw, keywords)
    made = {"ready": lambda: ready(products, cells), "archive": lambda: archive(products), "all": lambda: everything(products, cells), "review": lambda: review(products, raw)}
    return {k: made[k]() for k in keys}


def borderline(raw: DataFrame) -> DataFrame:
    return raw.where("is_relevant is null")


def relevant(raw: DataFrame) -> DataFrame:
    return raw.where("is_relevant")


def counters(raw: DataFrame, canonical: DataFrame, keywords: DataFrame) -> DataFrame:
    """One row: nine counts of a run, one aggregate a table."""
    r = raw.agg(F.count("*").alias("raw"), F.count_if("is_relevant").alias("relevant"), F.count_if(F.col("is_relevant").isNull()).alias("borderline"))
    s = F.col("suggest_status")
    c = canonical.agg(F.count("*").alias("canonical"), F.count_if("needs_review").alias("needs_review"), F.count_if(s == "has_suggest").alias("has_suggest"), F.count_if(s == "no_suggest").alias("no_suggest"), F.count_if(s.isNull()).alias("pending"))
    k = keywords.join(canonical.select(F.col("id").alias("canonical_id")), "canonical_id", "left_semi").agg(F.count("*").alias("keywords"))
    return r.join(c).join(k)


def browse(canonical: DataFrame, mapping: DataFrame, mode: str = "all", text: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of products: by status, review or merging, and by a title pattern (% and _ are wildcards, ASCII case is not)."""
    status = F.col("suggest_status")
    modes = {"all": F.lit(True), "has": status == "has_suggest", "no": status == "no_suggest", "pending": status.isNull(), "needs_review": F.col("needs_review"), "merged": F.lit(True)}
    rows = canonical.where(modes.get(mode, modes["all"]))
    if mode == "merged":
        rows = rows.join(merged_products(mapping), "id", "left_semi")
    if text:
        ascii_lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        rows = rows.where(F.like(ascii_lower(F.col("canonical_title")), ascii_lower(F.lit(f"%{text}%"))))
    page = rows.orderBy(F.col("needs_review").desc(), "id").offset(max(0, offset)).limit(max(1, min(500, limit)))
    return page


def merged_products(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy(F.col("canonical_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id")


def product_details(canonical: DataFrame, mapping: DataFrame, raw: DataFrame, keywords: DataFrame) -> DataFrame:
    return wide(canonical, mapping, raw, keywords).select("id", "canonical_title", "domains", F.size("urls").alias("members"), F.size("keywords").alias("keyword_count"), "keywords", "urls")


def latest_runs(runs: DataFrame, topic: str | None = None, limit: int = 20) -> DataFrame:
    rows = runs if topic is None else runs.where(F.col("target_topic") == topic)
    return rows.orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(limit)


def cells(df: DataFrame) -> DataFrame:
    """All columns as text: null is empty, lists are joined, truth has its words."""
    def one(name: str, kind: str) -> Column:
        if kind.startswith("array"):
            return F.coalesce(F.array_join(F.col(name).cast("array<string>"), " | "), F.lit(""))
        if kind == "boolean":
            return F.when(F.col(name), X.YES).when(~F.col(name), X.NO).otherwise("")
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    return df.select(*(one(n, k).alias(n) for n, k in df.dtypes))


def to_csv(df: DataFrame, path: str) -> str:
    """Writes a sheet as CSV with a byte order mark; rows stream through the driver, as a download must."""
    with open(path, "w", encoding="utf-8-sig", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(df.columns)
        writer.writerows(cells(df).toLocalIterator())
    return path


def csv_bundle(named: dict[str, DataFrame], folder: str, stem: str) -> list[str]:
    """One file a sheet, named by the stem and the sheet."""
    return [to_csv(df, os.path.join(folder, f"{stem}__{slug(name)}.csv")) for name, df in named.items()]


def borderline_csv(raw: DataFrame, folder: str, run_id: str) -> str | None:
    """Rows between the thresholds for manual review, the best first; None where there are none."""
    rows = borderline_sheet(raw)
    if rows.isEmpty():
        return None
    os.makedirs(folder, exist_ok=True)
    return to_csv(rows, os.path.join(folder, f"{run_id}_borderline.csv"))


def borderline_sheet(raw: DataFrame) -> DataFrame:
    score = F.round(F.coalesce("topic_score", F.lit(0.0)), 4).alias("topic_score")
    return borderline(raw).orderBy(F.col("topic_score").desc()).select("id", score, "raw_title", "normalized_title", "source_url")


def to_xlsx(named: dict[str, DataFrame], path: str) -> str:
    """Writes a workbook, one right-to-left tab a sheet with a frozen header; rows stream through the driver.

    Numbers stay numbers and all else is text. Rows beyond what a tab can hold go on in a further one.
    """
    taken: list[str] = []

    def tab(name: str) -> str:
        base = re.sub(r"[\[\]:*?/\\]", " ", name)[:TAB_NAME] or "sheet"
        title, n = base, 2
        while title.lower() in (t.lower() for t in taken):
            title, n = f"{base[: TAB_NAME - len(str(n)) - 1]} {n}", n + 1
        taken.append(title)
        return title

    def cell(value: str, number: bool) -> str:
        if number and value not in ("", "NaN", "Infinity", "-Infinity"):
            return f"<c><v>{value}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_UNPRINTABLE.sub("", value))}</t></is></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, df in named.items():
            numbers = [k in ("int", "bigint", "double", "float", "smallint", "tinyint") for _, k in df.dtypes]
            rows, done, more = cells(df).toLocalIterator(), False, None
            while not done:
                tab(name)
                with book.open(f"xl/worksheets/sheet{len(taken)}.xml", "w", force_zip64=True) as out:
                    out.write(_SHEET_HEAD.encode())
                    out.write(f"<row>{''.join(cell(c, False) for c in df.columns)}</row>".encode())
                    for n in range(TAB_ROWS - 1):
                        row = more or next(rows, None)
                        more = None
                        if row is None:
                            break
                        out.write(f"<row>{''.join(map(cell, row, numbers))}</row>".encode())
                    more = next(rows, None)
                    done = more is None
                    out.write(b"</sheetData></worksheet>")
        ids = range(1, len(taken) + 1)
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_MIME}.worksheet+xml"/>' for i in ids)
        book.writestr("[Content_Types].xml", f'{_XML}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_MIME}.sheet.main+xml"/>{types}</Types>')
        book.writestr("_rels/.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r0" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/_rels/workbook.xml.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids) + "</Relationships>")
        book.writestr("xl/workbook.xml", f'{_XML}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>' + "".join(f'<sheet name={quoteattr(t)} sheetId="{i}" r:id="r{i}"/>' for i, t in zip(ids, taken, strict=True)) + "</sheets></workbook>")
    return path


def sheet_counts(made: dict[str, DataFrame]) -> DataFrame:
    """(sheet, n) of the sheets that were made."""
    return reduce(DataFrame.unionByName, [df.agg(F.lit(k).alias("sheet"), F.count("*").alias("n")) for k, df in made.items()])


def crawl_counters(opened: DataFrame) -> DataFrame:
    """(site, pages_fetched, failures, not_product, titles_found) of opened pages (site, ok, is_product, title)."""
    title = F.trim(F.coalesce("title", F.lit(""))) != ""
    return opened.groupBy("site").agg(
        F.count("*").alias("pages_fetched"), F.count_if(~F.col("ok")).alias("failures"), F.count_if(F.col("ok") & ~F.col("is_product")).alias("not_product"),
        F.count_if(F.col("ok") & F.col("is_product") & title).alias("titles_found"),
    )


def slug(name: str) -> str:
    return "".join(c if c.isalnum() else "-" for c in name)


def ranked_members(mapping: DataFrame) -> DataFrame:
    return mapping.withColumn("position", F.row_number().over(Window.partitionBy("canonical_id").orderBy("raw_id")))
