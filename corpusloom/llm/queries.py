"""The pN queries of this package; each runs over its whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F  # noqa: F401

from corpusloom.llm import alignment, boilerplate, encoding, language, leakage, normalize, scans, spans
from corpusloom.session import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return alignment.align(read(spark, d, "chunks"), language_model(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.repeated_lines(read(spark, d, "chunks"))


def p2_text(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.without_repeated_lines(read(spark, d, "chunks").select("chunk_id", "doc_id", "text")).select("chunk_id", "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return normalize.changed_fields(read(spark, d, "chunks"), "chunk_id", ["text", "section_title"])


def language_model(spark: SparkSession, d: str) -> language.LanguageModel:
    """Fitted on labelled chunks and documents (a bounded sample, see ``language.fit``)."""
    return language.fit(read(spark, d, "chunks").select("text", "lang").unionByName(read(spark, d, "documents").select("text", "lang")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return language.mislabelled(read(spark, d, "chunks"), language_model(spark, d)).select("chunk_id", "seg_no", "lang")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise(read(spark, d, "chunks"), read(spark, d, "page_extracts"))


def p5_text(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(read(spark, d, "chunks"), read(spark, d, "page_extracts")).select("chunk_id", "text")


TOKENIZERS = os.environ.get("CORPUSLOOM_TOKENIZERS", "/opt/tokenizers")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(read(spark, d, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_characters(read(spark, d, "documents"))


def p8_text(spark: SparkSession, d: str) -> DataFrame:
    return spans.without_repeats(read(spark, d, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_text": p2_text, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p5_text": p5_text, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found, "p8_text": p8_text}


P2 = r"""
WITH l AS (SELECT chunk_id, doc_id, split_part(doc_id, '/', 1) AS source, generate_subscripts(p, 1) AS line_no, unnest(p) AS line
           FROM (SELECT chunk_id, doc_id, string_split(text, chr(10)) AS p FROM chunks)),
k AS (SELECT chunk_id, doc_id, source, line_no, lower(regexp_replace(line, '[^\pL]', '', 'g')) AS letters FROM l),
d AS (SELECT split_part(doc_id, '/', 1) AS source, count(DISTINCT doc_id) AS docs FROM chunks GROUP BY 1),
e AS (SELECT source, letters FROM k JOIN d USING (source) WHERE length(letters) >= 12 GROUP BY source, letters, docs HAVING count(DISTINCT doc_id) >= greatest(4, 0.04 * docs))
SELECT DISTINCT chunk_id, line_no::INT AS line_no FROM k JOIN e USING (source, letters)
"""
P7 = r"""
WITH w AS (SELECT 'd' AS side, doc_id::VARCHAR AS id, text FROM documents UNION ALL SELECT 'i', item_id, passage FROM eval_items),
t AS (SELECT side, id, regexp_extract_all(regexp_replace(lower(text), '([\x{4E00}-\x{9FFF}])', ' \1 ', 'g'), '[\pL\pN]+') AS a FROM w WHERE text IS NOT NULL),
g AS (SELECT side, id, array_to_string(a[s:s + 11], ' ') AS gram FROM (SELECT side, id, a, unnest(generate_series(1, len(a) - 11)) AS s FROM t WHERE len(a) >= 12))
SELECT DISTINCT d.id::BIGINT AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.side = 'd' AND i.side = 'i' AND d.gram = i.gram
"""
P8 = """
WITH s AS (SELECT doc_id, i, md5(substr(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 299)) AS i FROM documents WHERE length(text) >= 300)),
h AS (SELECT h FROM s GROUP BY h HAVING count(DISTINCT doc_id) > 1),
p AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM s JOIN h USING (h))
SELECT doc_id, sum(coalesce(least(300, i - before), 300))::BIGINT AS shared_chars FROM p GROUP BY doc_id
"""
P2_TEXT = (
    "WITH gone AS (" + P2 + r"""),
l AS (SELECT chunk_id, generate_subscripts(p, 1) AS line_no, unnest(p) AS line FROM (SELECT chunk_id, string_split(text, chr(10)) AS p FROM chunks)),
k AS (SELECT chunk_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM l ANTI JOIN gone USING (chunk_id, line_no) GROUP BY chunk_id)
SELECT c.chunk_id, CASE WHEN c.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text FROM chunks c LEFT JOIN k USING (chunk_id)
"""
)
P8_TEXT = r"""
WITH l AS (SELECT doc_id, generate_subscripts(p, 1) AS line_no, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
f AS (SELECT doc_id, line_no, line, lower(regexp_replace(line, '[\s\x0b\x1c-\x1f\x85\p{Z}]+', '', 'g')) AS form FROM l),
r AS (SELECT doc_id, line_no, line, length(form) < 40 OR row_number() OVER (PARTITION BY form ORDER BY doc_id, line_no) = 1 AS kept FROM f),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM r WHERE kept GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text FROM documents d LEFT JOIN k USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express at this size; the others are tested against brute force."""
    return {"p2_found": P2, "p2_text": P2_TEXT, "p7_found": P7, "p8_found": P8, "p8_text": P8_TEXT}
