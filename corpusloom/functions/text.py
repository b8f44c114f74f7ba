"""Scalar text functions as Spark expressions.

Every function keeps null as null unless its docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that carry no meaning for a search (English and French).
STOP_WORDS = sorted(
    set(
        "a an the and or of in to for on at by is was were are with from as its it this that these those been be have has had will "
        "would could should may also such more than while after before during between when where which who what how not no can all "
        "any some but if so les des du la le un une et ou de en au aux est sont".split()
    )
)
# Function words dropped before terms are marked on a page.
TERM_STOP_WORDS = sorted(
    set("the and for with from into after before that this was were are has had not but its les des une dans pour par sur avec que qui aux est ont lors apres avant".split())
)
# Patterns of tokens, date and page lines, headings and citations.
TOKEN = r"[A-Za-zÀ-ɏ一-鿿㐀-䶿0-9][A-Za-zÀ-ɏ一-鿿㐀-䶿0-9\-./]*"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE_LINE = rf"(?i)^\s*(?:\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}|(?:{MONTHS})\s+\d{{4}})\s*$"
PAGE_LINE = r"^\s*[-–]\s*\d+\s*[-–]?\s*$"
HEADING = r"(?iu)findings\s+as\s+to\s+causes?(?:\s+and\s+contributing\s+factors)?|findings\s+as\s+to\s+risk|safety\s+action\b|faits\s+établis\s+quant\s+aux\s+causes?|faits\s+établis\s+quant\s+aux\s+risques?|mesures\s+de\s+sécurité\b"
NUMBERED = r"^\d{1,2}(?:\.\d{1,2}){0,2}\.?\s{1,4}[A-Z][A-Za-zÀ-ÿ]"
CITATION = r"\[([^\]\s]+)\s+p\.\s*(\d+)[^\]]*\]"
QUOTED = CITATION + r'[^"\[\]]{0,160}?["“]([^"”]+)["”]'


def squeezed(text: Column) -> Column:
    """Each run of white space (Unicode) as one space, ends stripped."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def chunk_hash(text: Column) -> Column:
    """SHA-256 (hex) of the squeezed text in lower case."""
    return F.sha2(F.lower(squeezed(text)), 256)


def point_id(chunk_hash: Column) -> Column:
    """UUID of the first 128 bits of a hash; a shorter hash raises an error."""
    part = lambda a, n: F.substring(chunk_hash, a, n)
    uuid = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    return F.when(F.length(chunk_hash) < 32, F.raise_error(F.concat(F.lit("hash too short: "), chunk_hash))).when(chunk_hash.isNotNull(), uuid)


def figure_id(doc: Column, page: Column, bbox: Column) -> Column:
    """``{doc}:fig:{page}:{hash}``, the hash over document, page and coordinates with two decimals."""
    box = F.concat_ws(",", *[F.format_string("%.2f", bbox[i]) for i in range(4)])
    return F.concat(doc, F.lit(":fig:"), page.cast("string"), F.lit(":"), F.substring(F.sha2(F.concat_ws(":", doc, page.cast("string"), box), 256), 1, 12))


def fact_id(occurrence: Column, kind: str, text: Column, own: Column | None = None) -> Column:
    """Id of a finding (``f``) or recommendation (``r``); an own id that is not empty wins."""
    made = F.concat(occurrence, F.lit(f":{kind}:"), F.substring(F.sha2(F.concat_ws(":", occurrence, text), 256), 1, 12))
    return made if own is None else F.coalesce(F.nullif(own, F.lit("")), made)


def tokens(text: Column) -> Column:
    """Search tokens in lower case, in order, repeated ones kept; null gives an empty list."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def search_terms(text: Column) -> Column:
    """Tokens that are no stop words."""
    return F.filter(tokens(text), lambda x: ~x.isin(STOP_WORDS))


def page_terms(query: Column, most: int = 8) -> Column:
    """Words of three letters or more to mark on a page: no stop words, each once, ``most`` at most."""
    words = F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit(r"[A-Za-zÀ-ÿ]+"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(words, lambda x: (F.length(x) >= 3) & ~x.isin(TERM_STOP_WORDS))), 1, most)


def is_boilerplate(text: Column) -> Column:
    """Shorter than 80 characters, a page number, or a date and nothing else."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return (F.length(bare) < 80) | bare.rlike(PAGE_LINE) | bare.rlike(DATE_LINE)


def cjk_characters(text: Column) -> Column:
    """Number of characters from U+4E00 to U+9FFF."""
    return F.length(F.regexp_replace(text, "[^一-鿿]", ""))


def solid_characters(text: Column) -> Column:
    """Number of characters that are no white space."""
    return F.length(F.regexp_replace(text, r"(?U)\s", ""))


def is_heading(line: Column) -> Column:
    """At most 120 characters, and a section's heading or a numbered title."""
    bare = F.trim(line)
    return (F.length(bare) > 0) & (F.length(bare) <= 120) & (bare.rlike(HEADING) | bare.rlike(NUMBERED))


def snippet(text: Column, most: int) -> Column:
    """One line of at most ``most`` characters; a longer one ends in three dots."""
    flat = F.trim(F.regexp_replace(text, "\n", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("..."))).otherwise(flat)


def without_reasoning(answer: Column) -> Column:
    """The answer without a leading block of reasoning."""
    return F.regexp_replace(answer, r"^\s*<think>[\s\S]*?</think>\s*", "")


def without_sources(answer: Column) -> Column:
    """The answer without its source list and inline tags."""
    out = F.regexp_replace(answer, r"(?s)\n*-{3,}\s*\*\*Sources:\*\*.*$", "")
    out = F.regexp_replace(out, r"(?s)\n*(?:\*\*)?Sources:(?:\*\*)?\s*\[.*$", "")
    return F.rtrim(F.regexp_replace(out, r"\s*" + CITATION, ""))


def cited_pages(answer: Column) -> Column:
    """The pages an answer cites, each once, in order: array of ``doc p.page`` strings."""
    docs, pages = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)), F.regexp_extract_all(answer, F.lit(CITATION), F.lit(2))
    return F.array_distinct(F.zip_with(docs, pages, lambda d, p: F.concat(d, F.lit(" p."), p.cast("int").cast("string"))))


def quoted_citations(answer: Column) -> Column:
    """Array of (doc, page, quote) of the citations that a quotation follows; the first of a page wins."""
    part = lambda i: F.regexp_extract_all(answer, F.lit(QUOTED), F.lit(i))
    rows = F.filter(F.arrays_zip(part(1).alias("doc"), part(2).alias("page"), part(3).alias("quote")), lambda x: F.trim(x["quote"]) != "")
    keys = F.transform(rows, lambda x: F.concat_ws(" ", x["doc"], x["page"].cast("int")))
    return F.filter(rows, lambda x, i: F.array_position(keys, F.concat_ws(" ", x["doc"], x["page"].cast("int"))) == i + 1)


def parsed_caption(answer: Column) -> Column:
    """struct(caption, ocr_text) of a captioner's answer with the labels ``Caption:`` and ``Transcribed:``."""
    caption = F.regexp_extract(answer, r"(?is)caption\s*:\s*(.*?)\s*(?:transcribed[^:]*:|$)", 1)
    text = F.regexp_extract(answer, r"(?is)transcribed[^:]*:\s*(.*?)\s*$", 1)
    return F.struct(F.when(answer.rlike(r"(?i)caption\s*:"), caption).otherwise(F.trim(answer)).alias("caption"), text.alias("ocr_text"))


def rescued_json(answer: Column) -> Column:
    """The first ``{...}`` of a model's answer, code fences dropped; ``{}`` where there is none."""
    bare = F.regexp_replace(answer, r"```(?:json)?", "")
    found = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(F.coalesce(found, F.lit("")) == "", F.lit("{}")).otherwise(found)


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def file_name(url: Column) -> Column:
    """Last part of the path, percent signs decoded, a plus sign kept."""
    last = F.substring_index(path(url), "/", -1)
    return F.coalesce(F.try_url_decode(F.regexp_replace(last, r"\+", "%2B")), last)


def joined_url(base: Column, href: Column) -> Column:
    """``href`` seen from ``base``: absolute, ``//host``, ``/root``, ``?query``, ``#part`` or relative to its folder, with
    leading ``./`` and ``../`` resolved."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    root = F.concat(scheme, F.lit("://"), host(base))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    relative = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), F.regexp_replace(href, r"^(\./)+", ""))
    for _ in range(6):  # a link climbs few folders
        relative = F.regexp_replace(relative, r"/[^/]+/\.\./", "/")
    relative = F.regexp_replace(relative, r"^/(\.\./)+", "/")
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(root, path(base), href))
        .when((href == "") | href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .otherwise(F.concat(root, relative))
    )


def ocr_language(lang: Column, source: Column) -> Column:
    """Model of the reader of scanned pages for a language and source."""
    return F.when((lang == "zh") & (source == "ttsb"), "chinese_cht").when(lang == "zh", "ch").when(lang == "fr", "fr").otherwise("en")
