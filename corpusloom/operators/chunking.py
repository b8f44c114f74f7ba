"""Pages to overlapping token windows with section, page and region.

A token is a run of characters without white space (the tokenizer is a slot: any function from text to pieces that
concatenate to the text works). Windows never gather a document in one task: tokens get their place in the document by a
running sum over pages in buckets, each page gives its part of every window it touches, and a window's parts are
put together by (document, window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import running
from corpusloom.functions import text as T
from corpusloom.session import materialize


def pieces(text: Column) -> Column:
    """Tokens of a text, each with the white space after it."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+\s*"), F.lit(0))


def window_starts(n: Column, window: int, overlap: int) -> Column:
    """Starts of the windows over ``n`` tokens: none for 0, and the first window that reaches the end is the last."""
    step = max(1, window - overlap)
    count = F.when(n <= 0, 0).when(n <= window, 1).otherwise(F.ceil((n - window) / step) + 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def text_windows(df: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 512, overlap: int = 128) -> DataFrame:
    """Windows of texts that stand in one row: key, chunk_no from 0, first and last token, text. Null and blank texts
    have none."""
    rows = df.select(F.col(key).alias(key), pieces(F.col(text)).alias("p"))
    rows = rows.select(key, "p", F.posexplode(window_starts(F.size("p"), window, overlap)).alias("chunk_no", "start_tok"))
    end = F.least(F.col("start_tok") + window, F.size("p"))
    body = F.regexp_replace(F.array_join(F.slice("p", F.col("start_tok") + 1, end - F.col("start_tok")), ""), r"(?U)\s+$", "")
    return rows.select(key, "chunk_no", "start_tok", end.alias("end_tok"), body.alias("text"))


def page_windows(pages: DataFrame, *, keys: list[str], page: str = "page", text: str = "text", chars: str = "chars", window: int = 512, overlap: int = 128) -> DataFrame:
    """Windows over the pages of a document, joined by a blank line: keys, chunk_no, n_tokens, text, page (of most
    characters, of equals the first), pages touched, section_title in force at the first token, chunk_hash. Where ``pages`` has
    glyphs (``chars``), lines in larger type are headings too, and windows have ``page_bboxes`` (page and box for each page
    that has any, see ``span_boxes``) and ``bbox`` (the box on ``page``, zeros without one).

    Each (keys, page) should stand once; pages are read in order. A window of nothing but white space does not arise,
    as windows are made of tokens.
    """
    step = max(1, window - overlap)
    drawn = chars in pages.columns
    texts = pages.select(*keys, F.col(page).alias("page"), F.coalesce(F.col(text), F.lit("")).alias("text"), *([F.col(chars).alias("chars")] if drawn else []))
    sizes = running.before_sum(texts.select(*keys, "page", F.size(pieces(F.col("text"))).cast("long").alias("n")), keys, "page", "n", "base")
    sizes = materialize(sizes.join(sizes.groupBy(*keys).agg(F.sum("n").alias("total")), keys), "page-sizes")
    rows = texts.select(*keys, "page", "text").join(sizes.where("n > 0"), [*keys, "page"]).withColumn("p", pieces(F.col("text")))
    last = F.when(F.col("total") <= window, F.lit(0)).otherwise(F.ceil((F.col("total") - window) / step)).cast("long")
    first_w = F.greatest(F.lit(0), F.ceil((F.col("base") - window + 1) / step)).cast("long")
    last_w = F.least(last, F.floor((F.col("base") + F.col("n") - 1) / step)).cast("long")
    parts = rows.where(first_w <= last_w).select(*keys, "page", "text", "p", "n", "base", "total", F.explode(F.sequence(first_w, last_w)).alias("chunk_no"))
    lo = F.greatest(F.lit(0), F.col("chunk_no") * step - F.col("base")).cast("int")
    hi = F.least(F.col("n"), F.col("chunk_no") * step + window - F.col("base")).cast("int")
    tail = F.when(hi == F.col("n"), F.lit("\n\n")).otherwise(F.lit(""))
    slice_ = F.slice("p", lo + 1, hi - lo)
    # the part's range in its page's text: from the window's first token to its last, else from and to the page's ends
    before = lambda k: F.length(F.regexp_extract("text", r"(?U)^\s*", 0)) + F.aggregate(F.slice("p", 1, k), F.lit(0), lambda a, x: a + F.length(x))
    opens = F.col("base") + lo == F.col("chunk_no") * step
    closes = F.col("base") + hi == F.least(F.col("total"), F.col("chunk_no") * step + window)
    begin = F.when(opens, before(lo)).otherwise(F.lit(0))
    end = F.when(closes, before(hi - 1) + F.length(F.regexp_replace(F.element_at("p", hi), r"(?U)\s+$", ""))).otherwise(F.length("text"))
    parts = parts.select(*keys, "chunk_no", "page", (hi - lo).alias("tokens"), F.array_join(slice_, "").alias("body"), tail.alias("tail"), *([begin.alias("lo"), end.alias("hi")] if drawn else []))
    per_window = parts.groupBy(*keys, "chunk_no").agg(
        F.sum("tokens").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("page", "body", "tail"))).alias("parts"),
        F.max_by("page", F.struct(F.length("body"), -F.col("page"))).alias("page"),
    )
    body = F.regexp_replace(F.array_join(F.transform("parts", lambda x: F.concat(x["body"], x["tail"])), ""), r"(?U)\s+$", "")
    per_window = per_window.withColumn("text", body).withColumn("pages", F.transform("parts", lambda x: x["page"])).drop("parts")

    headed = texts if drawn else texts.where(F.exists(F.split("text", "\n"), T.is_heading))
    if drawn:
        headed = headed.join(glyph_sizes(texts, keys).select(*keys, "heading_size"), keys, "left").where(F.exists(F.split("text", "\n"), T.is_heading) | (F.size("chars") > 0))
    heads = headings(headed.join(sizes.select(*keys, "page", "base"), [*keys, "page"]), keys)
    starts = per_window.select(*keys, (F.col("chunk_no") * step).alias("token"), "chunk_no", F.lit(None).cast("string").alias("title"), F.lit(1 << 30).alias("nth"))
    both = starts.unionByName(heads.select(*keys, "token", F.lit(None).cast("long").alias("chunk_no"), "title", "nth"))
    both = running.last_known(both, keys, F.struct("token", "nth"), "title", "section_title", position="token", width=1 << 16)
    sections = both.where("chunk_no is not null").select(*keys, "chunk_no", F.coalesce("section_title", F.lit("")).alias("section_title"))
    out = per_window.join(sections, [*keys, "chunk_no"]).withColumn("chunk_hash", T.chunk_hash(F.col("text")))
    if not drawn:
        return out
    glyphs = aligned_glyphs(texts, keys)
    extents = glyphs.groupBy(*keys, "page").agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))
    spans = parts.select(*keys, "page", F.col("chunk_no").alias("span"), "lo", "hi").join(extents.select(*keys, "page"), [*keys, "page"], "left_semi")
    boxes = span_boxes(spans, glyphs, extents, keys).where("x0 is not null")
    box = F.array(*[F.col(c) for c in ("x0", "top", "x1", "bottom")])
    boxes = boxes.groupBy(*keys, F.col("span").alias("chunk_no")).agg(F.array_sort(F.collect_list(F.concat(F.array(F.col("page").cast("double")), box))).alias("page_bboxes"))
    out = out.join(boxes, [*keys, "chunk_no"], "left").withColumn("page_bboxes", F.coalesce("page_bboxes", F.array().cast("array<array<double>>")))
    own = F.get(F.filter("page_bboxes", lambda x: x[0] == F.col("page")), F.lit(0))
    return out.withColumn("bbox", F.coalesce(F.slice(own, 2, 4), F.array(*[F.lit(0.0)] * 4)))


def headings(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Section headings with the place of their first token in the document (``base`` is the page's): keys, token, nth
    (order among headings of one place), title. Where pages have ``chars`` and ``heading_size``, a short line is one as well if the
    page's glyphs that stand in it are at least so large in the mean."""
    drawn = "chars" in pages.columns
    more = ["chars", "heading_size"] if drawn else []
    lines = pages.select(*keys, "page", "base", F.posexplode(F.split("text", "\n")).alias("line_no", "line"), F.split("text", "\n").alias("lines"), *more)
    head = T.is_heading(F.col("line"))
    if drawn:
        bare = F.trim("line")
        mine = F.transform(F.filter("chars", lambda c: (c["size"] > 0) & (c["text"] != "") & F.contains(bare, c["text"])), lambda c: c["size"])
        mean = F.aggregate(mine, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(mine), F.lit(0))
        head = head | ((F.length(bare) > 0) & (F.length(bare) <= 120) & F.coalesce(mean >= F.col("heading_size"), F.lit(False)))
    lines = lines.where(head)
    before = F.aggregate(F.slice("lines", 1, F.col("line_no")), F.lit(0), lambda a, x: a + F.size(pieces(x)))
    return lines.select(*keys, (F.col("base") + before).alias("token"), F.col("line_no").alias("nth"), F.trim("line").alias("title"))


def glyph_sizes(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Median glyph size of a document and the size from which a line is a heading (1.2 times as much). Exact for few
    distinct sizes: the percentile runs over a map of sizes and counts."""
    chars = pages.select(*keys, F.explode("chars").alias("c")).where("c.size > 0")
    return chars.groupBy(*keys).agg(F.percentile("c.size", F.lit(0.5)).alias("median_size"), F.count("*").alias("glyphs")).withColumn("heading_size", F.col("median_size") * 1.2)


def page_extents(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest box around all glyphs of a page; pages without glyphs are left out."""
    chars = pages.select(*keys, "page", F.explode("chars").alias("c"))
    return chars.groupBy(*keys, "page").agg(F.min("c.x0").alias("x0"), F.min("c.top").alias("top"), F.max("c.x1").alias("x1"), F.max("c.bottom").alias("bottom"), F.count("*").alias("glyphs"))


def aligned_glyphs(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Place of each glyph in its page's text. The text is walked once and a glyph is used up where it equals the
    character; characters without their glyph get none. keys, page, place, x0, top, x1, bottom."""
    fields = "place int, x0 double, top double, x1 double, bottom double"

    @F.udf(f"array<struct<{fields}>>", useArrow=True)
    def walk(text, chars):
        out, at = [], 0
        for i, c in enumerate(text or ""):
            if chars is None or at >= len(chars):
                break
            if chars[at]["text"] == c:
                g = chars[at]
                out.append((i, g["x0"], g["top"], g["x1"], g["bottom"]))
                at += 1
        return out

    return pages.where(F.size("chars") > 0).select(*keys, "page", F.explode(walk("text", "chars")).alias("g")).select(*keys, "page", "g.*")


def span_boxes(spans: DataFrame, glyphs: DataFrame, extents: DataFrame, keys: list[str], *, least_area: float = 5000.0) -> DataFrame:
    """Box of each span (keys, page, span, lo, hi: places in the page's text) on its page: around its glyphs, or the whole
    page's box where it has none or covers less than ``least_area``."""
    inside = spans.join(glyphs, [*keys, "page"], "left").where(F.col("place").isNull() | F.col("place").between(F.col("lo"), F.col("hi") - 1))
    own = inside.groupBy(*keys, "page", "span").agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))
    page = extents.select(*keys, "page", *[F.col(c).alias(f"p_{c}") for c in ("x0", "top", "x1", "bottom")])
    rows = spans.join(own, [*keys, "page", "span"], "left").join(page, [*keys, "page"], "left")
    good = F.coalesce((F.col("x1") - F.col("x0")) * (F.col("bottom") - F.col("top")) >= least_area, F.lit(False))
    pick = [F.when(good, F.col(c)).otherwise(F.coalesce(f"p_{c}", c)).alias(c) for c in ("x0", "top", "x1", "bottom")]
    return rows.select(*keys, "page", "span", *pick)


def line_glyph_boxes(lines: DataFrame, *, dpi: int = 200) -> DataFrame:
    """Glyph boxes of recognised lines (key, line_no, text, x0, top, x1, bottom in pixels): the line's box is shared out
    evenly, pixels become points, the size is the box's height. One row for each character, in order."""
    scale = F.lit(72.0 / dpi)
    rows = lines.where(F.length("text") > 0).select("*", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("nth"))
    width = (F.col("x1") - F.col("x0")) / F.length("text")
    return rows.select("key", "line_no", "nth", F.substring("text", F.col("nth"), F.lit(1)).alias("glyph"), ((F.col("x0") + width * (F.col("nth") - 1)) * scale).alias("x0"), (F.col("top") * scale).alias("top"), ((F.col("x0") + width * F.col("nth")) * scale).alias("x1"), (F.col("bottom") * scale).alias("bottom"), ((F.col("bottom") - F.col("top")) * scale).alias("size"))
