"""Links of web pages and reports: extraction, canonical forms, seeds and document references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.lake import LANGUAGES, SOURCES, first_of

# Addresses of reports.
TSB_REPORT, TTSB_MEDIA = "https://www.bst-tsb.gc.ca/sites/default/files/rapports-reports/aviation/", "https://www.ttsb.gov.tw/media/"
REPORT_ID = r"(?U)\b([Aa]\d{2}[A-Za-z]\d{4})\b"


def links(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """Absolute targets of a page's anchors: (url, href, target), each target once a page. Null pages have none."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    rows = pages.select(F.col(url).alias("url"), F.explode(hrefs).alias("href")).withColumn("href", F.trim(F.replace(F.col("href"), F.lit("&amp;"), F.lit("&"))))
    return rows.withColumn("target", T.joined_url(F.col("url"), F.col("href"))).dropDuplicates(["url", "target"])


def detail_links(found: DataFrame, *, host_suffix: str, base_path: str) -> DataFrame:
    """Targets under a path of a host that are no PDF, without query and fragment, each once, in order."""
    t = F.col("target")
    rows = found.where(T.host(t).endswith(host_suffix) & T.path(t).startswith(base_path) & ~F.lower(T.path(t)).endswith(".pdf"))
    return rows.select(F.regexp_replace(t, r"[?#].*$", "").alias("target")).distinct()


def pdf_links(found: DataFrame, *, host_suffix: str) -> DataFrame:
    """Distinct PDF targets of a host."""
    t = F.col("target")
    return found.where(T.host(t).endswith(host_suffix) & F.lower(T.path(t)).endswith(".pdf")).select("target").distinct()


def report_ids(text: Column) -> Column:
    """Report ids of a text in capitals, each once, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(REPORT_ID), F.lit(1)), F.upper)))


def seeds(lines: DataFrame, *, host_suffix: str, line: str = "value", number: str = "line_no") -> DataFrame:
    """Seed urls: blank lines and comments skipped, PDFs of the host only, of one file name the first line."""
    rows = lines.select(F.col(number).alias("line_no"), F.trim(line).alias("url")).where("url <> '' and not startswith(url, '#')")
    rows = rows.where(T.host(F.col("url")).endswith(host_suffix) & F.lower(T.path(F.col("url"))).endswith(".pdf"))
    return first_of(rows.withColumn("name", T.file_name(F.col("url"))), ["name"], [F.col("line_no")])


def document_reference(path: Column) -> Column:
    """struct(source, lang, stem, doc_id) of a file's path: the first source and the first language in their fixed order among
    its parts; a path without one of them raises an error."""
    parts = F.split(path, "/")
    pick = lambda values: F.coalesce(*[F.when(F.array_contains(parts, v), v) for v in values])
    source = F.coalesce(pick(SOURCES), F.raise_error(F.concat(F.lit("no source in path: "), path)))
    lang = F.coalesce(pick(LANGUAGES), F.raise_error(F.concat(F.lit("no language in path: "), path)))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return F.struct(source.alias("source"), lang.alias("lang"), stem.alias("stem"), F.concat_ws("/", source, stem).alias("doc_id"))


def rebuilt_urls(documents: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """``documents`` (source, stem, lang, ...) with ``source_url`` as far as name and seeds (name, url) tell it: tsb by the report's
    id, ttsb by the media number before the first ``_`` of the stem, caac by the seed of its file name; tc has none."""
    stem, source = F.col("stem"), F.col("source")
    rid = F.lower(stem)
    tsb = F.concat(F.lit(TSB_REPORT), rid, F.when(F.col("lang") == "en", "/eng/").otherwise("/fra/"), rid, F.lit(".pdf"))
    media = F.when(stem.rlike(r"(?s)^\d+_.+$"), F.concat(F.lit(TTSB_MEDIA), F.substring_index(stem, "_", 1), F.lit("/"), F.expr("substring(stem, instr(stem, '_') + 1)"), F.lit(".pdf")))
    if seeds is None:
        return documents.withColumn("source_url", F.when(source == "tsb", tsb).when(source == "ttsb", media))
    known = by_name(seeds).select(F.col("name").alias("__name"), F.col("url").alias("__url"))
    out = documents.join(known, F.concat(stem, F.lit(".pdf")) == F.col("__name"), "left")
    return out.withColumn("source_url", F.when(source == "tsb", tsb).when(source == "ttsb", media).when(source == "caac", F.col("__url"))).drop("__name", "__url")


def by_name(urls: DataFrame) -> DataFrame:
    """One url for each file name: (name, url), of several the first by name."""
    return urls.where("url is not null").select(F.coalesce("name", T.file_name(F.col("url"))).alias("name") if "name" in urls.columns else T.file_name(F.col("url")).alias("name"), "url").groupBy("name").agg(F.min("url").alias("url"))


def detail_reports(found: DataFrame) -> DataFrame:
    """Report ids in the targets and texts of an index page's links (target, text), each once."""
    text = F.concat_ws(" ", "target", "text") if "text" in found.columns else F.col("target")
    return found.select(F.explode(report_ids(text)).alias("report_id")).distinct()
