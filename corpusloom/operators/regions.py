"""Regions on pages: hits of terms and quotes, line boxes, touching boxes, best matching sentences."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.chunking import aligned_glyphs
from corpusloom.operators.evaluation import sequence_ratio


def term_hits(pages: DataFrame, terms: DataFrame, keys: list[str], *, terms_per_block: int = 1000) -> DataFrame:
    """Every hit of every term (column ``term``) in the pages' texts, case and white space apart: keys, page, term, hit, lo,
    hi. Blank terms have none. Terms go to the tasks in blocks of about ``terms_per_block``, each a pass over the pages."""

    @F.udf("array<struct<term: string, hit: int, lo: int, hi: int>>", useArrow=True)
    def find(text, wanted):
        out, low = [], text.lower()
        for term, first, pattern in _patterns(tuple(wanted)):
            if first in low:
                out += [(term, n, m.start(), m.end()) for n, m in enumerate(pattern.finditer(text))]
        return out

    terms = terms.where("trim(term) <> ''").select("term").distinct()
    blocks = max(1, -(-terms.count() // terms_per_block))
    some = pages.where(F.length("text") > 0).select(*keys, "page", "text")
    block = F.pmod(F.xxhash64("term"), F.lit(blocks))
    wanted = terms.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list("term")).alias("wanted"))  # of bounded size
    found = None
    for b in range(blocks):
        hits = some.crossJoin(F.broadcast(wanted.where(F.col("block") == b))).select(*keys, "page", F.explode(find("text", "wanted")).alias("h")).select(*keys, "page", "h.*")
        found = hits if found is None else found.unionByName(hits)
    return found


@functools.lru_cache(maxsize=4)
def _patterns(terms: tuple[str, ...]) -> list[tuple[str, str, re.Pattern]]:
    """Each term with its first word in lower case and its pattern."""
    return [(t, t.split()[0].lower(), re.compile(r"\s+".join(map(re.escape, t.split())), re.IGNORECASE)) for t in terms]


def quote_hit(text: Column, quote: Column, *, probe: int = 8) -> Column:
    """struct(lo, hi) of the first place of a quote: its words with any other signs between, else its first ``probe`` words,
    else its last; null without a place."""

    @F.udf("struct<lo: int, hi: int>", useArrow=True)
    def find(t, q):
        words = re.findall(r"[\w'’-]+", q or "")
        if not words or not t:
            return None
        for some in [words] + ([words[:probe], words[-probe:]] if len(words) > probe else []):
            m = re.search(r"\W+".join(map(re.escape, some)), t, re.IGNORECASE)
            if m:
                return m.start(), m.end()
        return None

    return find(text, quote)


def line_boxes(hits: DataFrame, pages: DataFrame, keys: list[str], *, most: int = 25) -> DataFrame:
    """Boxes of hits (keys, page, term, hit, lo, hi) by line: glyphs whose tops agree within two points are a line. Boxes of equal
    rounded corners come once, at most ``most`` a page, in order of term and hit."""
    glyphs = aligned_glyphs(pages, keys)
    inside = hits.join(glyphs, [*keys, "page"]).where("place >= lo and place < hi")
    line = F.bround(F.col("top") / 2) * 2
    boxes = inside.groupBy(*keys, "page", "term", "hit", line.alias("line")).agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))
    corner = [F.bround(c).cast("long").alias(f"r_{c}") for c in ("x0", "top", "x1", "bottom")]
    boxes = boxes.select("*", *corner)
    first = F.row_number().over(W.partitionBy(*keys, "page", "r_x0", "r_top", "r_x1", "r_bottom").orderBy("term", "hit", "line"))
    boxes = boxes.withColumn("n", first).where("n = 1")
    place = F.row_number().over(W.partitionBy(*keys, "page").orderBy("term", "hit", "line"))
    return boxes.withColumn("n", place).where(F.col("n") <= most).select(*keys, "page", "term", "hit", "x0", "top", "x1", "bottom")


def merge_touching(boxes: DataFrame, keys: list[str], *, tolerance: float = 2.0) -> DataFrame:
    """Boxes (keys, x0, top, x1, bottom) of one page that overlap or touch become one, until none do. A page has few boxes, so a
    page is one group."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        left, done = [tuple(r) for r in pdf[["x0", "top", "x1", "bottom"]].itertuples(index=False)], []
        while left:
            x0, t, x1, b = left.pop()
            near = [o for o in done if x0 <= o[2] + tolerance and x1 >= o[0] - tolerance and t <= o[3] + tolerance and b >= o[1] - tolerance]
            if not near:
                done.append((x0, t, x1, b))
                continue
            done = [o for o in done if o not in near]
            near.append((x0, t, x1, b))
            left.append((min(o[0] for o in near), min(o[1] for o in near), max(o[2] for o in near), max(o[3] for o in near)))
        out = pd.DataFrame(sorted(done), columns=["x0", "top", "x1", "bottom"])
        for k in keys:
            out.insert(keys.index(k), k, pdf[k].iloc[0])
        return out

    rows = boxes.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("x0", "top", "x1", "bottom")]).distinct().na.drop(subset=["x0", "top", "x1", "bottom"])
    return rows.groupBy(*keys).applyInPandas(merge, rows.schema)


def big_enough(box: Column, *, least: float = 20.0) -> Column:
    """Whether a box of four coordinates is at least ``least`` points wide and high."""
    return (box[2] - box[0] >= least) & (box[3] - box[1] >= least)


def pixels(box: Column, *, dpi: int, width: int, height: int) -> Column:
    """A box in points as pixels of a page image, rounded half to even and kept inside it."""
    scaled = F.transform(box, lambda x: F.bround(x * (dpi / 72.0)).cast("int"))
    return F.transform(scaled, lambda x, i: F.greatest(F.lit(0), F.least(x, F.when(i % 2 == 0, F.lit(width)).otherwise(F.lit(height)))))


def best_sentence(pairs: DataFrame, *, key: str, passage: str, draft: str, least: float = 0.35) -> DataFrame:
    """Of each pair of texts the passage's sentence that is most like one of the draft's: (key, sentence, ratio), pairs without a
    ratio above ``least`` are left out. Sentences of 20 characters or fewer don't count; a draft without longer ones counts
    whole."""
    long = lambda c: F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), F.trim), lambda x: F.length(x) > 20)
    rows = pairs.select(F.col(key).alias(key), long(F.col(passage)).alias("a"), long(F.col(draft)).alias("b"), F.col(draft).alias("whole"))
    rows = rows.withColumn("b", F.when(F.size("b") > 0, F.col("b")).otherwise(F.array("whole")))
    rows = rows.select(key, F.explode("a").alias("sentence"), "b").select(key, "sentence", F.explode("b").alias("other"))
    rows = rows.withColumn("ratio", sequence_ratio("sentence", "other")).where(F.col("ratio") > least)
    best = rows.groupBy(key).agg(F.max_by(F.struct("sentence", "ratio"), F.struct("ratio", "sentence")).alias("m"))
    return best.select(key, "m.sentence", "m.ratio")
