"""Queries of page regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import lake, regions
from corpusloom.plans.registry import query
from corpusloom.session import read


def _terms(spark, d):
    return read(spark, d, "glossary").select(F.explode(F.array("term_en", "term_fr", "term_zh")).alias("term")).where("term is not null")


@query("""
WITH p AS (SELECT DISTINCT doc_id, edition, page, text FROM page_extracts WHERE text <> ''),
t AS (SELECT DISTINCT term FROM (SELECT unnest([term_en, term_fr, term_zh]) AS term FROM glossary) WHERE trim(term) <> '')
SELECT doc_id, edition, page, term, len(regexp_extract_all(text, '(?i)' || regexp_replace(regexp_escape(term), '\\\\ ', '[\\\\s\\\\x1c-\\\\x1f\\\\x85\\\\p{Z}]+', 'g'))) AS hits FROM p, t
WHERE contains(lower(text), lower(split_part(term, ' ', 1))) AND len(regexp_extract_all(text, '(?i)' || regexp_replace(regexp_escape(term), '\\\\ ', '[\\\\s\\\\x1c-\\\\x1f\\\\x85\\\\p{Z}]+', 'g'))) > 0
""")
def term_hits(spark, d):
    """Hits of the glossary's terms in all languages on every page."""
    pages = read(spark, d, "page_extracts").where("text <> ''").select("doc_id", "edition", "page", "text").distinct()
    hits = regions.term_hits(pages, _terms(spark, d), ["doc_id", "edition"])
    return hits.groupBy("doc_id", "edition", "page", "term").agg(F.count("*").alias("hits"))


@query()
def term_boxes(spark, d):
    """Line boxes of these hits on pages with glyphs; the glyphs are aligned by a walk that SQL can't express."""
    pages = read(spark, d, "page_extracts").where(F.size("chars") > 0).select("doc_id", "edition", "page", "text", "chars").distinct()
    hits = regions.term_hits(pages, _terms(spark, d), ["doc_id", "edition"])
    return regions.line_boxes(hits, pages, ["doc_id", "edition"])


@query()
def figure_regions(spark, d):
    """Boxes of figures that touch, merged to a fixpoint (no SQL)."""
    f = read(spark, d, "figures").where(regions.big_enough(F.col("bbox")))
    return regions.merge_touching(f.select("doc_id", "page", *[F.col("bbox")[i].alias(c) for i, c in enumerate(("x0", "top", "x1", "bottom"))]), ["doc_id", "page"])


@query()
def cited_sentences(spark, d):
    """Of each rejected answer and chunk that it used, the chunk's sentence most like the answer (difflib; no SQL)."""
    qa = read(spark, d, "unaccepted_qa").where("answer is not null").select("id", "answer", F.explode("chunk_hashes").alias("chunk_hash")).distinct()
    text = lake.new_chunks(lake.records(read(spark, d, "chunks"))).select("chunk_hash", "text")
    pairs = qa.join(text, "chunk_hash").select(F.struct("id", "chunk_hash").alias("key"), "answer", "text")
    return regions.best_sentence(pairs, key="key", passage="text", draft="answer", least=0.35).select("key.id", "key.chunk_hash", "sentence", F.round("ratio", 6).alias("ratio"))


@query("""
SELECT DISTINCT doc_id, page, array_to_string(list_transform(bbox, lambda x, i: greatest(0, least(round_even(x * 150 / 72, 0)::INT, CASE WHEN i % 2 = 1 THEN 1275 ELSE 1650 END))), ',') AS px FROM figures WHERE bbox[3] - bbox[1] >= 20 AND bbox[4] - bbox[2] >= 20
""")
def figure_pixels(spark, d):
    """Boxes of figures that are large enough, as pixels of their page's image."""
    f = read(spark, d, "figures").where(regions.big_enough(F.col("bbox")))
    px = regions.pixels(F.col("bbox"), dpi=150, width=1275, height=1650)
    return f.select("doc_id", "page", F.array_join(F.transform(px, lambda x: x.cast("string")), ",").alias("px")).distinct()
