"""Queries of the graph: entities, nodes, edges, contexts, recurrence."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import graph, lake, links
from corpusloom.plans.registry import query
from corpusloom.session import read

REGS = "list_distinct(list_concat(regexp_extract_all(text, '(?i)\\bCARs?\\s*(\\d{3}(?:\\.\\d+)+)', 1), regexp_extract_all(text, '(?i)\\bsection\\s+(\\d{3}\\.\\d+)(?:\\s+of\\s+the\\s+CARs?)?', 1)))"
ACS = "list_distinct(regexp_extract_all(text, '(?i)\\bAC\\s*(\\d{3}-\\d{3})\\b', 1))"
CORPUS = "coalesce(nullif(corpus, ''), split_part(doc_id, '/', 1))"
OWN = f"SELECT chunk_id, doc_id, {CORPUS} AS corpus, source_url, lang, section_title, text FROM chunks WHERE {CORPUS} IN ('tsb', 'tc')"
OCC = "substr(doc_id, instr(doc_id, '/') + 1)"
ORDER = "CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'zh' THEN 3 ELSE 4 END, CASE corpus WHEN 'tsb' THEN 1 WHEN 'tc' THEN 2 WHEN 'ttsb' THEN 3 WHEN 'caac' THEN 4 ELSE 5 END, doc_id, chunk_id"


def _chunks(spark, d):
    return lake.records(read(spark, d, "chunks"))


@query(f"""
WITH own AS ({OWN}),
e AS (SELECT chunk_id, 'regulation' AS kind, unnest({REGS}) AS value FROM own UNION ALL SELECT chunk_id, 'circular', unnest({ACS}) FROM own)
SELECT kind, value, count(*) AS chunks FROM e GROUP BY ALL
""")
def entity_citations(spark, d):
    e = graph.entities(_chunks(spark, d)).select("chunk_id", F.explode(F.map_from_arrays(F.array(F.lit("regulation"), F.lit("circular")), F.array("regulations", "circulars"))).alias("kind", "values"))
    return e.select("kind", F.explode("values").alias("value")).groupBy("kind", "value").agg(F.count("*").alias("chunks"))


WORD, BLANK = "[^\\pL\\pM\\pN_]", "\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}"


def _aircraft_sql() -> str:
    """All patterns as one list: no look-around in DuckDB, so boundaries are the signs beside a match."""
    parts = []
    for pattern, form, special in graph.AIRCRAFT:
        flags, body = ("(?i)", pattern.removeprefix("(?iU)")) if pattern.startswith("(?iU)") else ("", pattern.removeprefix("(?U)"))
        body = body.replace("[-\\s]", f"[-{BLANK}]").replace("\\s", f"[{BLANK}]").replace("\\d", "\\p{Nd}")
        body = f"{flags}(?:^|{WORD})" + body.removeprefix("\\b").removesuffix("\\b") + f"(?:$|{WORD})"
        fixed, group, _ = form.partition("{1")
        to = f"'{form}'" if not group else f"'{fixed}' || " + ("upper(x[1]) || lower(x[2:])" if form.endswith(":title}") else "upper(x)")
        for value, name in special.items():
            to = f"CASE WHEN x = '{value}' THEN '{name}' ELSE {to} END"
        parts.append(f"list_transform(regexp_extract_all(text, '{body}', 1), lambda x: {to})")
    return "list_distinct(flatten([" + ", ".join(parts) + "]))"


AIR = _aircraft_sql()
RECS = "list_distinct(regexp_extract_all(text, '\\b(A\\d{2}-\\d{2})\\b', 1))"
CIRCULAR = "upper(replace(regexp_extract(doc_id, '(?i)AC[_\\s]?(\\d{3}[-_]\\d{3})', 1), '_', '-'))"
SECTION_SQL = " UNION ALL ".join(
    f"SELECT chunk_id, doc_id, corpus, '{category}' AS category, regexp_extract(text, '(?is)({pattern.replace('(?iu)', '').replace(chr(92) + 'b', '')}.*)$', 1) AS section FROM own" for pattern, category in graph.SECTIONS
)
FINDINGS = f"""
parts AS (SELECT chunk_id, doc_id, corpus, category, unnest(string_split(regexp_replace(section, '\\n\\s*(?:\\d+\\.|•|-|\\*)', chr(1), 'g'), chr(1))[2:]) AS part FROM ({SECTION_SQL}) WHERE section <> ''),
findings AS (SELECT chunk_id, doc_id, corpus, category, trim(regexp_replace(part, '^\\s+|\\s+$', '', 'g')) AS text FROM parts WHERE regexp_matches(part, '^\\s+\\S') AND length(regexp_replace(part, '^\\s+|\\s+$', '', 'g')) > 20)
"""


@query(f"""
WITH e AS (SELECT chunk_id, unnest({AIR}) AS aircraft FROM ({OWN}))
SELECT aircraft, count(*) AS chunks FROM e GROUP BY 1
""")
def entity_aircraft(spark, d):
    e = graph.entities(_chunks(spark, d)).select(F.explode("aircraft").alias("aircraft"))
    return e.groupBy("aircraft").agg(F.count("*").alias("chunks"))


@query(f"""
WITH own AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {ORDER}) AS n FROM ({OWN}) WHERE corpus = 'tsb')
SELECT {OCC} AS id, doc_id, source_url, lang FROM own WHERE n = 1
""")
def occurrence_nodes(spark, d):
    return graph.occurrences(_chunks(spark, d))


@query(f"""
WITH own AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {ORDER}) AS n FROM ({OWN}) WHERE corpus = 'tc')
SELECT upper(replace(regexp_extract(doc_id, '(?i)AC[_\\s]?(\\d{{3}}[-_]\\d{{3}})', 1), '_', '-')) AS id, doc_id, coalesce(section_title, '') AS title FROM own
WHERE n = 1 AND regexp_matches(doc_id, '(?i)AC[_\\s]?(\\d{{3}}[-_]\\d{{3}})')
""")
def circular_nodes(spark, d):
    return graph.circular_nodes(_chunks(spark, d))


EDGES = f"""
own AS ({OWN}),
e AS (SELECT {OCC} AS occ, {CIRCULAR} AS circular, corpus, {REGS} AS regs, {ACS} AS acs, {AIR} AS air, {RECS} AS recs FROM own),
edges AS (SELECT DISTINCT * FROM (
  SELECT occ AS src, 'CITES' AS rel, unnest(regs) AS dst FROM e WHERE corpus = 'tsb'
  UNION ALL SELECT occ, 'REFERENCES_AC', unnest(acs) FROM e WHERE corpus = 'tsb'
  UNION ALL SELECT occ, 'INVOLVES', unnest(air) FROM e WHERE corpus = 'tsb'
  UNION ALL SELECT occ, 'HAS_RECOMMENDATION', unnest(recs) FROM e WHERE corpus = 'tsb'
  UNION ALL SELECT rec, 'IMPLEMENTS', unnest(regs) FROM (SELECT unnest(recs) AS rec, regs FROM e WHERE corpus = 'tsb')
  UNION ALL SELECT unnest(regs), 'GUIDED_BY', circular FROM e WHERE corpus = 'tc' AND circular <> ''))
"""


@query(f"""
WITH {EDGES}, {FINDINGS},
f AS (SELECT {OCC} || ':f:' || substr(sha256({OCC} || ':' || f.text), 1, 12) AS id, {OCC} AS occ, chunk_id FROM findings f WHERE corpus = 'tsb')
SELECT * FROM edges UNION SELECT occ, 'HAS_FINDING', id FROM f UNION SELECT id, 'FINDING_CITES', unnest(regs) FROM f JOIN (SELECT chunk_id, {REGS} AS regs FROM own) USING (chunk_id)
""")
def graph_edges(spark, d):
    return graph.edges_of(_chunks(spark, d))


@query(f"""
WITH {EDGES}, {FINDINGS}
SELECT 'aircraft' AS label, id, split_part(id, '-', 1) AS detail FROM (SELECT DISTINCT unnest(air) AS id FROM e)
UNION ALL SELECT 'regulation', id, '' FROM (SELECT DISTINCT unnest(regs) AS id FROM e)
UNION ALL SELECT 'circular', id, '' FROM (SELECT unnest(acs) AS id FROM e UNION SELECT circular FROM e WHERE corpus = 'tc' AND circular <> '')
UNION ALL SELECT 'occurrence', id, '' FROM (SELECT DISTINCT occ AS id FROM e WHERE corpus = 'tsb')
UNION ALL SELECT 'recommendation', rec, arg_max(doc_id || ' ' || page, struct_pack(o := n)) FROM (
  SELECT unnest({RECS}) AS rec, doc_id, page, n FROM (SELECT text, doc_id, coalesce(page, 0) AS page, row_number() OVER (ORDER BY {ORDER}) AS n FROM (SELECT chunk_id, doc_id, page, lang, text, {CORPUS} AS corpus FROM chunks WHERE {CORPUS} = 'tsb'))) GROUP BY rec
UNION ALL SELECT 'finding', id, arg_max(category, struct_pack(n := n, c := category)) FROM (
  SELECT {OCC} || ':f:' || substr(sha256({OCC} || ':' || f.text), 1, 12) AS id, category, n FROM findings f JOIN (SELECT chunk_id, row_number() OVER (ORDER BY {ORDER}) AS n FROM own) USING (chunk_id) WHERE corpus = 'tsb') GROUP BY id
""")
def graph_nodes(spark, d):
    """All nodes: label, id, and the family of aircraft, the place of recommendations, the category of findings."""
    t = graph.tables_of(_chunks(spark, d))
    row = lambda name, label, detail: t[name].select(F.lit(label).alias("label"), "id", detail.alias("detail"))
    out = row("aircraft", "aircraft", F.col("type_family"))
    for name, label in (("regulations", "regulation"), ("circulars", "circular"), ("occurrences", "occurrence")):
        out = out.unionByName(row(name, label, F.lit("")))
    out = out.unionByName(row("recommendations", "recommendation", F.concat_ws(" ", "source_doc_id", F.col("page").cast("string"))))
    return out.unionByName(row("findings", "finding", F.col("category")))


@query(f"""
WITH {EDGES}
SELECT DISTINCT lower(occ_id) AS src, reg AS dst FROM cites WHERE reg IS NOT NULL AND lower(occ_id) IN (SELECT {OCC} FROM own WHERE corpus = 'tsb') AND reg IN (SELECT dst FROM edges WHERE rel = 'CITES')
""")
def edges_dangling_dropped(spark, d):
    c = _chunks(spark, d)
    cites = read(spark, d, "cites").where("reg is not null").select(F.lower("occ_id").alias("src"), F.col("reg").alias("dst"))
    known = c.where("corpus = 'tsb'").select(F.explode(graph.regulations(F.col("text"))).alias("id"))
    return graph.existing_edges(cites, graph.occurrences(c), known)


@query("""
SELECT reg, count(DISTINCT lower(occ_id)) AS n, string_agg(DISTINCT lower(occ_id), ',' ORDER BY lower(occ_id)) AS occs FROM cites WHERE occ_id IS NOT NULL AND reg IS NOT NULL GROUP BY reg
""")
def citing_fold(spark, d):
    rows = graph.citing(read(spark, d, "cites"))
    return rows.select("reg", F.explode("occs").alias("occ")).groupBy("reg").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("occ")), ",").alias("occs"))


@query("""
SELECT lower(occ_id) AS occ_id, coalesce(array_to_string(list_sort(list_distinct(list(reg))), ','), '') AS regs, min(occ_url) AS occ_url FROM cites WHERE occ_id IS NOT NULL GROUP BY 1
""")
def adjacency_fold(spark, d):
    return graph.adjacency(read(spark, d, "cites")).select("occ_id", F.array_join("regs", ",").alias("regs"), "occ_url")


CITES = "SELECT DISTINCT lower(occ_id) AS src, reg AS dst FROM cites WHERE occ_id IS NOT NULL AND reg IS NOT NULL"
RECURRING = """
WITH e AS ({cites}), seeds AS (SELECT DISTINCT item_id AS query_id, substr(unnest(expected), instr(unnest(expected), '/') + 1) AS id FROM eval_items),
deg AS (SELECT dst, count(*) AS occ_count FROM e GROUP BY 1 HAVING count(*) <= 15),
own AS (SELECT query_id, id, dst AS reg FROM seeds JOIN e ON src = id),
n AS (SELECT query_id, count(DISTINCT id) AS n FROM {counted} GROUP BY 1),
r AS (SELECT DISTINCT query_id, reg, occ_count FROM own JOIN deg ON reg = dst JOIN n USING (query_id) WHERE occ_count > n),
o AS (SELECT query_id, reg, occ_count, src FROM r JOIN e ON reg = dst WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = r.query_id AND s.id = src)),
g AS (SELECT query_id, reg, occ_count, array_to_string(list_slice(list_sort(list(src)), 1, 3), ',') AS siblings FROM o GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY occ_count DESC, reg) AS rank FROM g QUALIFY rank <= 5
"""


def _recurring(spark, d, **options):
    cites = graph_cites(spark, d)
    seeds = read(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.explode("expected").alias("doc")).select("query_id", F.expr("substring(doc, instr(doc, '/') + 1)").alias("id"))
    return graph.recurring(seeds, cites, **options).withColumn("siblings", F.array_join("siblings", ","))


def graph_cites(spark, d):
    return read(spark, d, "cites").where("occ_id is not null and reg is not null").select(F.lower("occ_id").alias("src"), F.col("reg").alias("dst")).distinct()


@query(RECURRING.format(cites=CITES, counted="own"))
def recurring_context(spark, d):
    return _recurring(spark, d)


@query(RECURRING.format(cites=CITES, counted="seeds"))
def recurring_context_all_seeds(spark, d):
    return _recurring(spark, d, count_all_seeds=True)


@query(f"""
WITH {EDGES}, {FINDINGS},
nodes AS (SELECT {OCC} AS id, source_url AS occ_url FROM (SELECT doc_id, source_url, row_number() OVER (PARTITION BY doc_id ORDER BY {ORDER}) AS n FROM own WHERE corpus = 'tsb') WHERE n = 1),
ids AS (SELECT DISTINCT substr(x, instr(x, '/') + 1) AS id FROM (SELECT unnest(expected) AS x FROM eval_items)),
f AS (SELECT src AS id, rel, string_agg(dst, ',' ORDER BY dst) AS facts FROM edges GROUP BY ALL),
i AS (SELECT e.src AS id, g.dst AS reg FROM edges e JOIN edges g ON g.src = e.dst AND g.rel = 'IMPLEMENTS' WHERE e.rel = 'HAS_RECOMMENDATION'),
r AS (SELECT id, string_agg(DISTINCT reg, ',' ORDER BY reg) AS facts FROM i GROUP BY 1),
g AS (SELECT id, string_agg(DISTINCT dst, ',' ORDER BY dst) AS facts FROM i JOIN edges ON src = reg AND rel = 'GUIDED_BY' GROUP BY 1),
n AS (SELECT {OCC} AS id, count(DISTINCT (f.text, coalesce(reg, ''))) AS n FROM findings f LEFT JOIN (SELECT chunk_id, unnest({REGS}) AS reg FROM own) USING (chunk_id) WHERE corpus = 'tsb' GROUP BY 1)
SELECT o.id AS occ_id, occ_url, coalesce(c.facts, '') AS direct_regs, coalesce(a.facts, '') AS acs, coalesce(h.facts, '') AS recommendations, coalesce(r.facts, '') AS rec_regs, coalesce(g.facts, '') AS reg_guided_acs, coalesce(n.n, 0) AS n_findings
FROM nodes o JOIN ids USING (id) LEFT JOIN f c ON c.id = o.id AND c.rel = 'CITES' LEFT JOIN f a ON a.id = o.id AND a.rel = 'REFERENCES_AC' LEFT JOIN f h ON h.id = o.id AND h.rel = 'HAS_RECOMMENDATION'
LEFT JOIN r ON r.id = o.id LEFT JOIN g ON g.id = o.id LEFT JOIN n ON n.id = o.id
""")
def graph_context(spark, d):
    ids = read(spark, d, "eval_items").select(F.explode("expected").alias("doc")).select(F.expr("substring(doc, instr(doc, '/') + 1)").alias("id"))
    out = graph.hop_one(ids, graph.tables_of(_chunks(spark, d)))
    out = out.withColumn("recommendations", F.transform("recommendations", lambda r: r["id"]))
    return out.select("occ_id", "occ_url", *[F.array_join(n, ",").alias(n) for n in ("direct_regs", "acs", "recommendations", "rec_regs", "reg_guided_acs")], F.size("findings").cast("long").alias("n_findings"))


@query(f"""
WITH f AS (SELECT doc_id, page, doc_id || ':fig:' || page || ':' || substr(sha256(doc_id || ':' || page || ':' || array_to_string(list_transform(bbox, lambda x: printf('%.2f', x)), ',')), 1, 12) AS dst FROM figures WHERE doc_id LIKE 'tsb/%')
SELECT DISTINCT {OCC} AS src, dst FROM f
""")
def figure_edges(spark, d):
    f = lake.figures_as_chunks(read(spark, d, "figures")).where("startswith(doc_id, 'tsb/')")
    return f.select(F.expr("substring(doc_id, instr(doc_id, '/') + 1)").alias("src"), F.col("figure_id").alias("dst")).distinct()


@query(f"""
WITH {EDGES}, {FINDINGS}
SELECT (SELECT count(*) FROM chunks) AS chunks, (SELECT count(DISTINCT x) FROM (SELECT unnest(regs) AS x FROM e)) AS regulations,
       (SELECT count(DISTINCT x) FROM (SELECT unnest(acs) AS x FROM e)) AS circulars, (SELECT count(DISTINCT x) FROM (SELECT unnest(air) AS x FROM e)) AS aircraft,
       (SELECT count(*) FROM findings WHERE corpus = 'tsb') AS findings, (SELECT coalesce(sum(len(recs)), 0)::BIGINT FROM e WHERE corpus = 'tsb') AS recommendations,
       (SELECT coalesce(sum(len(recs) * len(regs)), 0)::BIGINT FROM e WHERE corpus = 'tsb') AS rec_reg_links, (SELECT coalesce(sum(len(regs)), 0)::BIGINT FROM e WHERE corpus = 'tc' AND circular <> '') AS reg_ac_links
""")
def entity_counts(spark, d):
    return graph.entity_counts(_chunks(spark, d))


@query(f"""
WITH own AS ({OWN}), {FINDINGS}
SELECT chunk_id, category, text FROM findings
""")
def entity_findings(spark, d):
    """List items under headings of findings."""
    return graph.entities(_chunks(spark, d)).select("chunk_id", F.explode("findings").alias("f")).select("chunk_id", "f.category", "f.text")


@query("""
WITH l AS (SELECT id, created_at, resolved_at, answer, row_number() OVER (PARTITION BY id ORDER BY created_at DESC, resolved_at DESC NULLS LAST, answer DESC NULLS LAST) AS n FROM unaccepted_qa)
SELECT id, created_at, resolved_at, answer FROM l WHERE n = 1
""")
def nodes_last_wins(spark, d):
    rows = read(spark, d, "unaccepted_qa").select("id", "created_at", "resolved_at", "answer")
    return graph.last_of(rows, ["id"], [F.col("created_at"), F.col("resolved_at"), F.col("answer")])


@query("""
SELECT p_source AS source, p_stem AS stem, p_source || '/' || p_stem AS doc_id, count(*) AS n FROM (SELECT split_part(doc_id, '/', 1) AS p_source, split_part(doc_id, '/', 2) AS p_stem FROM chunks) GROUP BY ALL
""")
def document_references(spark, d):
    path = F.concat(F.lit("corpus/"), F.substring_index("doc_id", "/", 1), F.lit("/en/"), F.substring_index("doc_id", "/", -1), F.lit(".pdf"))
    ref = read(spark, d, "chunks").select(links.document_reference(path).alias("r"))
    return ref.groupBy("r.source", "r.stem", "r.doc_id").agg(F.count("*").alias("n"))
