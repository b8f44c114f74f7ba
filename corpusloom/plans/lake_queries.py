"""Queries over the chunk lake: tolerant reading, hashes, deduplication, admission, windows, figures, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking, lake, links
from corpusloom.plans.registry import query
from corpusloom.session import read

RECORDS = """
SELECT chunk_id, doc_id, coalesce(section_title, '') AS section_title, coalesce(page, 0) AS page,
       coalesce(nullif(corpus, ''), split_part(doc_id, '/', 1)) AS corpus, coalesce(nullif(kind, ''), 'text') AS kind,
       CASE WHEN len(page_bboxes) > 0 THEN page_bboxes
            WHEN len(list_filter(coalesce(bbox, [0.0, 0.0, 0.0, 0.0]), lambda x: x <> 0)) > 0 THEN [list_concat([coalesce(page, 0)::DOUBLE], bbox)]
            ELSE []::DOUBLE[][] END AS page_bboxes,
       chunk_hash, lang, source_url, text
FROM chunks
"""
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
BOILER = """(length({t}) < 80
  OR regexp_matches({t}, '^\\s*[-–]\\s*\\d+\\s*[-–]?\\s*$')
  OR regexp_matches({t}, '(?i)^\\s*(?:\\d{{1,2}}\\s+(?:MONTHS)\\s+\\d{{4}}|\\d{{4}}-\\d{{2}}-\\d{{2}}|(?:MONTHS)\\s+\\d{{4}})\\s*$'))""".replace("MONTHS", T.MONTHS)
BARE = f"regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')"


@query(f"""
WITH r AS ({RECORDS})
SELECT chunk_id, section_title, page, corpus, kind, len(page_bboxes) AS n_boxes,
       coalesce(round(list_sum(list_transform(page_bboxes, lambda x: list_sum(x))), 4), 0) AS box_sum FROM r
""")
def lake_records(spark, d):
    r = lake.records(read(spark, d, "chunks"))
    total = F.aggregate(F.flatten("page_bboxes"), F.lit(0.0), lambda a, x: a + x)
    return r.select("chunk_id", "section_title", "page", "corpus", "kind", F.size("page_bboxes").cast("long").alias("n_boxes"), F.round(total, 4).alias("box_sum"))


@query(f"""
SELECT chunk_id, sha256(lower(trim(regexp_replace(text, '{SPACE}+', ' ', 'g')))) AS made,
       sha256(lower(trim(regexp_replace(text, '{SPACE}+', ' ', 'g')))) = chunk_hash AS same FROM chunks
""")
def chunk_hashes(spark, d):
    made = T.chunk_hash(F.col("text"))
    return read(spark, d, "chunks").select("chunk_id", made.alias("made"), (made == F.col("chunk_hash")).alias("same"))


@query("""
SELECT chunk_id, substr(chunk_hash, 1, 8) || '-' || substr(chunk_hash, 9, 4) || '-' || substr(chunk_hash, 13, 4) || '-' || substr(chunk_hash, 17, 4) || '-' || substr(chunk_hash, 21, 12) AS point_id
FROM chunks
""")
def point_ids(spark, d):
    return read(spark, d, "chunks").select("chunk_id", T.point_id(F.col("chunk_hash")).alias("point_id"))


@query(f"""
WITH r AS ({RECORDS}),
o AS (SELECT *, row_number() OVER (PARTITION BY chunk_hash ORDER BY
        CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'zh' THEN 3 ELSE 4 END,
        CASE corpus WHEN 'tsb' THEN 1 WHEN 'tc' THEN 2 WHEN 'ttsb' THEN 3 WHEN 'caac' THEN 4 ELSE 5 END, doc_id, chunk_id) AS n FROM r)
SELECT chunk_hash, chunk_id, doc_id FROM o WHERE n = 1
""")
def chunk_dedup(spark, d):
    return lake.new_chunks(lake.records(read(spark, d, "chunks"))).select("chunk_hash", "chunk_id", "doc_id")


@query("""
WITH later AS (SELECT chunk_hash, max(chunk_id) AS chunk_id FROM chunks GROUP BY chunk_hash)
SELECT c.chunk_hash, c.chunk_id, c.page, c.lang FROM chunks c JOIN later l USING (chunk_hash, chunk_id)
""")
def point_upsert(spark, d):
    c = read(spark, d, "chunks").select("chunk_hash", "chunk_id", "page", "lang")
    return lake.upsert(c.where("chunk_id % 2 = 0"), c.where("chunk_id % 2 = 1"), ["chunk_hash"], "chunk_id")


@query(f"SELECT chunk_id, length({BARE}) AS n, {BOILER.format(t=BARE)} AS boilerplate FROM chunks")
def boilerplate_chunks(spark, d):
    bare = F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).cast("long")
    return read(spark, d, "chunks").select("chunk_id", bare.alias("n"), T.is_boilerplate(F.col("text")).alias("boilerplate"))


TOTALS = f"""
SELECT lang, doc_id, count(*) AS n_chunks, sum(length(text))::BIGINT AS total_chars, bool_and({BOILER.format(t=BARE)}) AS all_boilerplate,
       round(sum(length(regexp_replace(text, '[^一-鿿]', '', 'g'))) / nullif(sum(length(regexp_replace(text, '{SPACE}', '', 'g'))), 0), 6) AS cjk_share
FROM chunks GROUP BY lang, doc_id
"""


@query(TOTALS)
def document_totals(spark, d):
    return lake.document_totals(read(spark, d, "chunks")).withColumn("cjk_share", F.round("cjk_share", 6))


ADMITTED = f"""
SELECT lang, doc_id, CASE WHEN total_chars < 200 THEN 'sub_threshold' WHEN all_boilerplate THEN 'cover_only'
       WHEN lang = 'zh' AND cjk_share < 0.1 THEN 'lang_misdetect' END AS reason FROM ({TOTALS})
"""


def _admitted(spark, d):
    chunks = read(spark, d, "chunks")
    return lake.admissions(chunks.select("lang", "doc_id").distinct(), chunks)


@query(ADMITTED)
def admissions(spark, d):
    return _admitted(spark, d).select("lang", "doc_id", "reason")


@query(f"""
WITH a AS (SELECT coalesce(lang, '') AS lang, split_part(doc_id, '/', 1) AS corpus, coalesce(reason, 'admitted') AS reason FROM ({ADMITTED}))
SELECT CASE WHEN grouping(reason) = 0 THEN 'reason' WHEN grouping(corpus) = 0 THEN 'corpus' WHEN grouping(lang) = 0 THEN 'lang' ELSE 'all' END AS slice,
       coalesce(reason, corpus, lang, '') AS value, count(*) FILTER (reason = 'admitted') AS admitted, count(*) FILTER (reason <> 'admitted') AS rejected
FROM a GROUP BY GROUPING SETS ((), (reason), (corpus), (lang))
""")
def manifest(spark, d):
    return lake.manifest(_admitted(spark, d))


@query(f"""
WITH t AS (SELECT count(*) FILTER (reason IS NULL AND lang = 'zh') AS zh, count(*) FILTER (reason IS NULL AND lang IN ('en', 'fr')) AS other FROM ({ADMITTED}))
SELECT zh, other, CASE WHEN zh > 0 AND other > 0 THEN round(zh / other, 6) END AS ratio,
       coalesce(CASE WHEN zh > 0 AND other > 0 THEN zh / other END < 0.5 OR CASE WHEN zh > 0 AND other > 0 THEN zh / other END > 2.0, false) AS out_of_band FROM t
""")
def balance_ratio(spark, d):
    return lake.balance(_admitted(spark, d))


@query(f"""
WITH p AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+{SPACE}*') AS p FROM documents),
w AS (SELECT doc_id, p, unnest(CASE WHEN len(p) = 0 THEN []::BIGINT[] WHEN len(p) <= 64 THEN [0] ELSE generate_series(0, ((len(p) - 64 + 47) // 48) * 48, 48) END) AS start_tok FROM p)
SELECT doc_id, (start_tok // 48)::BIGINT AS chunk_no, start_tok::BIGINT AS start_tok, least(start_tok + 64, len(p))::BIGINT AS end_tok,
       sha256(regexp_replace(array_to_string(p[start_tok + 1:least(start_tok + 64, len(p))], ''), '{SPACE}+$', '')) AS hash FROM w
""")
def text_windows(spark, d):
    w = chunking.text_windows(read(spark, d, "documents"), window=64, overlap=16)
    long = lambda c: F.col(c).cast("long").alias(c)
    return w.select("doc_id", long("chunk_no"), long("start_tok"), long("end_tok"), F.sha2("text", 256).alias("hash"))


PAGES = "SELECT doc_id, edition, page, max(text) AS text FROM page_extracts GROUP BY doc_id, edition, page"
PIECE = f"[^\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+{SPACE}*"


DRAWN = f"SELECT p.doc_id, p.edition, p.page, coalesce(p.text, '') AS text, c.chars FROM ({PAGES}) p LEFT JOIN (SELECT doc_id, edition, page, max(chars) AS chars FROM page_extracts GROUP BY ALL) c ON c.doc_id = p.doc_id AND c.edition = p.edition AND c.page = p.page"


def _drawn(spark, d):
    return read(spark, d, "page_extracts").groupBy("doc_id", "edition", "page").agg(F.max("text").alias("text"), F.max("chars").alias("chars"))


HEADED = "(regexp_matches({t}, '(?i)findings\\s+as\\s+to\\s+causes?|findings\\s+as\\s+to\\s+risk|safety\\s+action\\b|faits\\s+établis\\s+quant\\s+aux\\s+causes?|faits\\s+établis\\s+quant\\s+aux\\s+risques?|mesures\\s+de\\s+sécurité') OR regexp_matches({t}, '^\\d{{1,2}}(?:\\.\\d{{1,2}}){{0,2}}\\.?\\s{{1,4}}[A-Z][A-Za-zÀ-ÿ]'))"


@query(f"""
WITH pages AS ({PAGES}),
tok AS (SELECT doc_id, edition, page, regexp_extract_all(coalesce(text, ''), '{PIECE}') AS p FROM pages),
one AS (SELECT doc_id, edition, page, generate_subscripts(p, 1) AS i, unnest(p) AS piece, len(p) AS n FROM tok),
seq AS (SELECT *, row_number() OVER (PARTITION BY doc_id, edition ORDER BY page, i) - 1 AS t, count(*) OVER (PARTITION BY doc_id, edition) AS total FROM one),
win AS (SELECT *, unnest(generate_series(greatest(0, (t - 128 + 96) // 96)::BIGINT, least(t // 96, CASE WHEN total <= 128 THEN 0 ELSE (total - 128 + 95) // 96 END)::BIGINT)) AS chunk_no FROM seq),
part AS (SELECT doc_id, edition, chunk_no, page, count(*) AS tokens, string_agg(piece, '' ORDER BY i) AS body, max(i) = max(n) AS whole FROM win GROUP BY ALL HAVING true),
chunk AS (SELECT doc_id, edition, chunk_no, sum(tokens)::BIGINT AS n_tokens, arg_max(page, struct_pack(a := length(body), b := -page)) AS page,
                 regexp_replace(string_agg(body || CASE WHEN whole THEN chr(10) || chr(10) ELSE '' END, '' ORDER BY page), '{SPACE}+$', '') AS text FROM part GROUP BY doc_id, edition, chunk_no),
median AS (SELECT doc_id, edition, quantile_cont(c.size, 0.5) AS median FROM (SELECT doc_id, edition, unnest(chars) AS c FROM ({DRAWN})) WHERE c.size > 0 GROUP BY ALL),
line AS (SELECT doc_id, edition, page, text, chars, generate_subscripts(l, 1) AS nth, unnest(l) AS raw FROM (SELECT *, string_split(text, chr(10)) AS l FROM ({DRAWN}))),
place AS (SELECT *, trim(raw) AS title, (sum(length(raw) + 1) OVER (PARTITION BY doc_id, edition, page ORDER BY nth) - length(raw) - 1)::BIGINT AS off FROM line),
head AS (SELECT p.*, list_avg(list_transform(list_filter(chars, lambda c: c.size > 0 AND c.text <> '' AND contains(title, c.text)), lambda c: c.size)) >= 1.2 * median AS large FROM place p LEFT JOIN median USING (doc_id, edition) WHERE length(title) BETWEEN 1 AND 120),
base AS (SELECT doc_id, edition, page, min(t) AS base FROM seq GROUP BY ALL),
section AS (SELECT h.doc_id, h.edition, base + len(regexp_extract_all(substr(h.text, 1, off), '[^\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+')) AS token, nth, title FROM head h JOIN base USING (doc_id, edition, page) WHERE large OR {HEADED.format(t='title')}),
inforce AS (SELECT c.doc_id, c.edition, c.chunk_no, arg_max(title, struct_pack(a := token, b := nth)) AS title FROM chunk c JOIN section s ON s.doc_id = c.doc_id AND s.edition = c.edition AND token <= c.chunk_no * 96 GROUP BY ALL)
SELECT c.doc_id, c.edition, c.chunk_no, n_tokens, page, text, coalesce(title, '') AS section_title, sha256(lower(trim(regexp_replace(text, '{SPACE}+', ' ', 'g')))) AS chunk_hash
FROM chunk c LEFT JOIN inforce i ON i.doc_id = c.doc_id AND i.edition = c.edition AND i.chunk_no = c.chunk_no
""")
def page_windows(spark, d):
    """Windows of all pages; their boxes come from a walk over glyphs and are tested on a fixture (query ``window_boxes``)."""
    w = chunking.page_windows(_drawn(spark, d), keys=["doc_id", "edition"], window=128, overlap=32)
    return w.select("doc_id", "edition", "chunk_no", "n_tokens", "page", "text", "section_title", "chunk_hash")


@query()
def window_boxes(spark, d):
    """Boxes of windows that have glyphs (the walk that finds their places is not for SQL)."""
    w = chunking.page_windows(_drawn(spark, d), keys=["doc_id", "edition"], window=128, overlap=32)
    return w.where(F.size("page_bboxes") > 0).select("doc_id", "edition", "chunk_no", "page", "bbox", "page_bboxes")


@query(f"""
WITH lines AS (SELECT chunk_id, trim(unnest(string_split(text, chr(10)))) AS line FROM chunks),
h AS (SELECT * FROM lines WHERE length(line) BETWEEN 1 AND 120 AND (regexp_matches(line, '(?i)findings\\s+as\\s+to\\s+causes?|findings\\s+as\\s+to\\s+risk|safety\\s+action\\b|faits\\s+établis\\s+quant\\s+aux\\s+causes?|faits\\s+établis\\s+quant\\s+aux\\s+risques?|mesures\\s+de\\s+sécurité')
   OR regexp_matches(line, '^\\d{{1,2}}(?:\\.\\d{{1,2}}){{0,2}}\\.?\\s{{1,4}}[A-Z][A-Za-zÀ-ÿ]')))
SELECT line, count(*) AS n, count(DISTINCT chunk_id) AS chunks FROM h GROUP BY line
""")
def heading_lines(spark, d):
    lines = read(spark, d, "chunks").select("chunk_id", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.where(T.is_heading(F.col("line"))).withColumn("line", F.trim("line"))
    return lines.groupBy("line").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("chunks"))


@query("""
WITH known AS (SELECT doc_id, page, chunk_id, section_title FROM chunks WHERE section_title <> ''),
one AS (SELECT doc_id, page, chunk_id FROM chunks)
SELECT o.chunk_id, coalesce((SELECT arg_max(section_title, struct_pack(p := k.page, c := k.chunk_id)) FROM known k WHERE k.doc_id = o.doc_id AND (k.page < o.page OR k.page = o.page AND k.chunk_id <= o.chunk_id)), '') AS section FROM one o
""")
def section_asof(spark, d):
    from corpusloom.functions.running import last_known

    c = read(spark, d, "chunks").select("chunk_id", "doc_id", "page", F.nullif(F.col("section_title"), F.lit("")).alias("section_title"))
    out = last_known(c, ["doc_id"], F.struct("page", "chunk_id"), "section_title", "section", position="page", width=64)
    return out.select("chunk_id", F.coalesce("section", F.lit("")).alias("section"))


@query("""
WITH g AS (SELECT doc_id, edition, page, unnest(chars) AS c FROM (SELECT DISTINCT doc_id, edition, page, chars FROM page_extracts))
SELECT doc_id, edition, page, round(min(c.x0), 4) AS x0, round(min(c.top), 4) AS top, round(max(c.x1), 4) AS x1, round(max(c.bottom), 4) AS bottom, count(*) AS glyphs FROM g GROUP BY doc_id, edition, page
""")
def page_extents(spark, d):
    pages = read(spark, d, "page_extracts").select("doc_id", "edition", "page", "chars").distinct()
    out = chunking.page_extents(pages, ["doc_id", "edition"])
    return out.select("doc_id", "edition", "page", *[F.round(c, 4).alias(c) for c in ("x0", "top", "x1", "bottom")], "glyphs")


@query("""
WITH g AS (SELECT doc_id, unnest(chars) AS c FROM (SELECT DISTINCT doc_id, edition, page, chars FROM page_extracts))
SELECT doc_id, round(quantile_cont(c.size, 0.5), 6) AS median_size, count(*) AS glyphs FROM g WHERE c.size > 0 GROUP BY doc_id
""")
def glyph_sizes(spark, d):
    pages = read(spark, d, "page_extracts").select("doc_id", "edition", "page", "chars").distinct()
    return chunking.glyph_sizes(pages, ["doc_id"]).select("doc_id", F.round("median_size", 6).alias("median_size"), "glyphs")


@query()
def glyph_alignment(spark, d):
    """Places of glyphs in their page's text, by a walk that SQL can't express."""
    pages = read(spark, d, "page_extracts").select("doc_id", "edition", "page", "text", "chars").distinct()
    return chunking.aligned_glyphs(pages, ["doc_id", "edition"])


FIGURE_TEXT = "'[Figure p.' || page || '] ' || coalesce(caption, '') || CASE WHEN coalesce(ocr_text, '') <> '' THEN chr(10) || chr(10) || ocr_text ELSE '' END"


@query(f"""
SELECT doc_id, page, {FIGURE_TEXT} AS text,
       doc_id || ':fig:' || page || ':' || substr(sha256(doc_id || ':' || page || ':' || array_to_string(list_transform(bbox, lambda x: printf('%.2f', x)), ',')), 1, 12) AS figure_id FROM figures
""")
def figure_chunks(spark, d):
    return lake.figures_as_chunks(read(spark, d, "figures")).select("doc_id", "page", "text", "figure_id")


@query("""
WITH f AS (SELECT chunk_id, doc_id, regexp_extract(text, '(?s)^\\[Figure p\\.(\\d+)\\] (.*)$', 1)::INT AS page, regexp_extract(text, '(?s)^\\[Figure p\\.(\\d+)\\] (.*)$', 2) AS rest FROM chunks
           WHERE regexp_matches(text, '(?s)^\\[Figure p\\.(\\d+)\\] (.*)$'))
SELECT doc_id, page, split_part(rest, chr(10) || chr(10), 1) AS caption, regexp_extract(rest, '(?s)^.*?\\n\\n(.*)$', 1) AS ocr_text FROM f
""")
def figure_rehydration(spark, d):
    return lake.chunks_as_figures(read(spark, d, "chunks"))


@query("""
SELECT source_url, regexp_extract(source_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS host, regexp_extract(source_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
       list_extract(string_split(regexp_extract(source_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), -1) AS file_name, count(*) AS n
FROM chunks WHERE source_url IS NOT NULL GROUP BY source_url
""")
def source_urls(spark, d):
    u = F.col("source_url")
    rows = read(spark, d, "chunks").where(u.isNotNull()).groupBy("source_url").agg(F.count("*").alias("n"))
    return rows.select("source_url", T.host(u).alias("host"), T.path(u).alias("path"), T.file_name(u).alias("file_name"), "n")


@query("""
WITH r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(report_id, '') || ' ' || coalesce(text, ''), '\\b([Aa]\\d{2}[A-Za-z]\\d{4})\\b', 1)) AS id FROM documents)
SELECT DISTINCT doc_id, upper(id) AS report_id FROM r
""")
def report_ids(spark, d):
    text = F.concat_ws(" ", F.coalesce("report_id", F.lit("")), F.coalesce("text", F.lit("")))
    return read(spark, d, "documents").select("doc_id", F.explode(links.report_ids(text)).alias("report_id")).distinct()


@query("""
SELECT chunk_id, CASE WHEN lang = 'zh' AND corpus = 'ttsb' THEN 'chinese_cht' WHEN lang = 'zh' THEN 'ch' WHEN lang = 'fr' THEN 'fr' ELSE 'en' END AS reader FROM chunks
""")
def ocr_routing(spark, d):
    return read(spark, d, "chunks").select("chunk_id", T.ocr_language(F.col("lang"), F.col("corpus")).alias("reader"))


@query("""
SELECT DISTINCT doc_id, page, [x for x in page_bboxes if x[1] = page] AS boxes FROM (SELECT doc_id, page, page_bboxes FROM chunks WHERE len(page_bboxes) > 0 AND page IS NOT NULL)
""".replace("[x for x in page_bboxes if x[1] = page] AS boxes", "len(list_filter(page_bboxes, lambda x: x[1] = page)) AS regions, bool_or(len(list_filter(page_bboxes, lambda x: x[4] - x[2] > 0 AND x[5] - x[3] > 0 AND (x[2] > 1 OR x[3] > 1))) > 0) OVER (PARTITION BY doc_id, page) AS drawable"))
def page_regions(spark, d):
    """Regions of chunks on their own page, and whether any region of the page can be drawn."""
    from pyspark.sql import Window as W

    rows = read(spark, d, "chunks").where((F.size("page_bboxes") > 0) & F.col("page").isNotNull())
    good = F.exists("page_bboxes", lambda x: (x[3] - x[1] > 0) & (x[4] - x[2] > 0) & ((x[1] > 1) | (x[2] > 1)))
    rows = rows.select("doc_id", "page", F.size(F.filter("page_bboxes", lambda x: x[0] == F.col("page"))).cast("long").alias("regions"), good.alias("good"))
    return rows.select("doc_id", "page", "regions", F.bool_or("good").over(W.partitionBy("doc_id", "page")).alias("drawable")).distinct()


SCAN = "CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'zh' THEN 3 ELSE 4 END, CASE corpus WHEN 'tsb' THEN 1 WHEN 'tc' THEN 2 WHEN 'ttsb' THEN 3 WHEN 'caac' THEN 4 ELSE 5 END, doc_id, chunk_id"


@query(f"""
WITH r AS ({RECORDS}), good AS (SELECT lang, doc_id FROM ({ADMITTED}) WHERE reason IS NULL)
SELECT chunk_hash, chunk_id, r.doc_id, r.lang FROM r JOIN good g ON g.doc_id = r.doc_id AND g.lang IS NOT DISTINCT FROM r.lang QUALIFY row_number() OVER (PARTITION BY chunk_hash ORDER BY {SCAN.replace('lang', 'r.lang', 1).replace('doc_id', 'r.doc_id')}) = 1
""")
def processed_chunks(spark, d):
    """Admission, then deduplication: chunks of rejected documents claim no hash."""
    c = lake.records(read(spark, d, "chunks"))
    new, _ = lake.processed(c.select("lang", "doc_id").distinct(), c)
    return new.select("chunk_hash", "chunk_id", "doc_id", "lang")


@query("""
WITH s AS (SELECT regexp_extract(source_url, '([^/?#]*)$', 1) AS name, min(source_url) AS url FROM chunks WHERE doc_id LIKE 'caac/%' AND source_url IS NOT NULL GROUP BY 1),
r AS (SELECT DISTINCT split_part(doc_id, '/', 1) AS source, substr(doc_id, instr(doc_id, '/') + 1) AS stem, lang FROM chunks WHERE lang IN ('en', 'fr', 'zh'))
SELECT source, stem, lang, CASE WHEN source = 'tsb' THEN 'https://www.bst-tsb.gc.ca/sites/default/files/rapports-reports/aviation/' || lower(stem) || CASE WHEN lang = 'en' THEN '/eng/' ELSE '/fra/' END || lower(stem) || '.pdf'
  WHEN source = 'ttsb' AND regexp_matches(stem, '^\\d+_.+$') THEN 'https://www.ttsb.gov.tw/media/' || split_part(stem, '_', 1) || '/' || substr(stem, instr(stem, '_') + 1) || '.pdf'
  WHEN source = 'caac' THEN s.url END AS source_url
FROM r LEFT JOIN s ON s.name = r.stem || '.pdf'
""")
def rebuilt_urls(spark, d):
    """Addresses of documents out of their names; seeds are the addresses that caac's chunks have."""
    c = read(spark, d, "chunks")
    refs = c.where("lang in ('en', 'fr', 'zh')").select(F.substring_index("doc_id", "/", 1).alias("source"), F.expr("substring(doc_id, instr(doc_id, '/') + 1)").alias("stem"), "lang").distinct()
    return links.rebuilt_urls(refs, c.where("startswith(doc_id, 'caac/')").select(F.col("source_url").alias("url")))


@query("""
SELECT chunk_id, doc_id, page FROM chunks WHERE len(bbox) = 4 AND length(text) >= 30 AND page >= 1 AND greatest(0, bbox[3] - bbox[1]) * greatest(0, bbox[4] - bbox[2]) >= 100
""")
def region_candidates(spark, d):
    from corpusloom.operators import evaluation

    return evaluation.region_candidates(read(spark, d, "chunks")).select("chunk_id", "doc_id", "page")


@query("""
SELECT chunk_id FROM (SELECT * FROM chunks WHERE len(bbox) = 4 AND length(text) >= 30 AND page >= 1 AND greatest(0, bbox[3] - bbox[1]) * greatest(0, bbox[4] - bbox[2]) >= 100) ORDER BY md5('7:' || chunk_hash), chunk_id LIMIT 50
""")
def region_sample(spark, d):
    """Fifty of them by hash (the sampling is the operator)."""
    from corpusloom.operators import evaluation

    return evaluation.region_sample(read(spark, d, "chunks"), n=50, seed=7).select("chunk_id")


@query(f"SELECT chunk_id, lang, corpus FROM (SELECT chunk_id, doc_id, lang, coalesce(nullif(corpus, ''), split_part(doc_id, '/', 1)) AS corpus FROM chunks) WHERE lang IN ('en', 'fr') AND corpus = 'tsb'")
def payload_filter(spark, d):
    from corpusloom.operators import search

    return search.payload_filter(lake.records(read(spark, d, "chunks")), lang=["en", "fr"], source="tsb").select("chunk_id", "lang", "corpus")


@query("""
WITH f AS (SELECT DISTINCT doc_id, page, caption, bbox FROM figures WHERE caption <> ''),
g AS (SELECT doc_id, page, caption, bbox, unnest(generate_series(1, length(caption))) AS nth FROM f)
SELECT doc_id, page, caption, nth, substr(caption, nth, 1) AS glyph, round((bbox[1] + (bbox[3] - bbox[1]) / length(caption) * (nth - 1)) * 72 / 200, 4) AS x0, round(bbox[2] * 72 / 200, 4) AS top,
       round((bbox[1] + (bbox[3] - bbox[1]) / length(caption) * nth) * 72 / 200, 4) AS x1, round(bbox[4] * 72 / 200, 4) AS bottom, round((bbox[4] - bbox[2]) * 72 / 200, 4) AS size FROM g
""")
def line_glyphs(spark, d):
    """Glyph boxes of recognised lines: captions in their figures' boxes, taken as pixels."""
    f = read(spark, d, "figures").where("caption <> ''").select("doc_id", "page", "caption", "bbox").distinct()
    lines = f.select(F.struct("doc_id", "page").alias("key"), F.lit(1).alias("line_no"), F.col("caption").alias("text"), *[F.col("bbox")[i].alias(c) for i, c in enumerate(("x0", "top", "x1", "bottom"))])
    out = chunking.line_glyph_boxes(lines).join(lines.select("key", "text", F.col("x0").alias("px"), F.col("top").alias("py")), "key")
    out = out.where((F.round(F.col("top"), 6) == F.round(F.col("py") * 72 / 200, 6)) & (F.col("nth") <= F.length("text")) & (F.substring("text", F.col("nth"), F.lit(1)) == F.col("glyph")))
    return out.select("key.doc_id", "key.page", F.col("text").alias("caption"), F.col("nth").cast("long").alias("nth"), "glyph", *[F.round(c, 4).alias(c) for c in ("x0", "top", "x1", "bottom", "size")]).distinct()
