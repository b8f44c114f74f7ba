"""Queries of evaluation: ranking metrics, slices, lift, graph hits, similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import evaluation, feedback, graph, lake, search
from corpusloom.plans.graph_queries import EDGES, FINDINGS, OCC, REGS
from corpusloom.plans.registry import query
from corpusloom.plans.retrieval_queries import EXPAND, PAIRS, SEEDS, TERMS, TOP, _queries, _seed_hits, _terms, _vectors
from corpusloom.session import materialize, read

METRICS = """
a AS (SELECT query_id, list(doc_id ORDER BY rank) AS actual FROM {seeds} GROUP BY 1),
i AS (SELECT item_id AS query_id, lang, expected, coalesce(actual, []::VARCHAR[]) AS actual FROM eval_items LEFT JOIN a ON a.query_id = item_id),
u AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS place FROM {seeds} GROUP BY query_id, doc_id),
g AS (SELECT query_id, sum(CASE WHEN place <= 5 THEN 1 / log2(place + 1) ELSE 0 END) AS d5, sum(CASE WHEN place <= 10 THEN 1 / log2(place + 1) ELSE 0 END) AS d10 FROM u JOIN i USING (query_id) WHERE list_contains(expected, doc_id) GROUP BY 1),
m AS (SELECT query_id, lang,
  CASE WHEN len(expected) = 0 THEN 0.0 ELSE len(list_intersect(actual[1:5], expected)) / len(expected) END AS recall_5,
  CASE WHEN len(expected) = 0 THEN 0.0 ELSE len(list_intersect(actual[1:10], expected)) / len(expected) END AS recall_10,
  coalesce(1 / list_min(list_filter(list_transform(expected, lambda x: list_position(actual, x)), lambda x: x > 0)), 0.0) AS rr,
  CASE WHEN len(expected) = 0 THEN 0.0 ELSE coalesce(d5, 0) / list_sum(list_transform(generate_series(1, least(5, len(expected))), lambda x: 1 / log2(x + 1))) END AS ndcg_5,
  CASE WHEN len(expected) = 0 THEN 0.0 ELSE coalesce(d10, 0) / list_sum(list_transform(generate_series(1, least(10, len(expected))), lambda x: 1 / log2(x + 1))) END AS ndcg_10
FROM i LEFT JOIN g USING (query_id))
"""
NAMES = ["recall_5", "recall_10", "rr", "ndcg_5", "ndcg_10"]
ROUND = ", ".join(f"round({n}, 6) AS {n}" for n in NAMES)
MEANS = ", ".join(f"round(avg({n}), 6) AS {n}" for n in NAMES)


def _items(spark, d):
    return read(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "query", "expected", "lang")


def _metrics(spark, d):
    return evaluation.evaluate(_items(spark, d), _seed_hits(spark, d))


@query(SEEDS + METRICS.format(seeds="seeds") + f"SELECT query_id, lang, {ROUND} FROM m")
def ranking_metrics(spark, d):
    m = _metrics(spark, d)
    return m.select("query_id", "lang", *[F.round(n, 6).alias(n) for n in NAMES])


@query(SEEDS + METRICS.format(seeds="seeds") + f"SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS slice, count(*) AS items, {MEANS} FROM m GROUP BY GROUPING SETS ((), (lang)) HAVING grouping(lang) = 1 OR lang IS NOT NULL")
def evaluation_report(spark, d):
    return evaluation.report(_metrics(spark, d))


SECOND = EXPAND + f""",
mt AS (SELECT query_id, string_agg(term, ' ' ORDER BY rank) AS more FROM terms GROUP BY 1),
q2 AS (SELECT item_id AS query_id, unnest({TERMS.format(t="concat_ws(' ', query, more)")}) AS term FROM eval_items LEFT JOIN mt ON mt.query_id = item_id),
qc2 AS (SELECT query_id, term, count(*) AS wq FROM q2 GROUP BY ALL),
s2 AS (SELECT query_id, point_id, sum(wq * wp)::DOUBLE AS score FROM qc2 JOIN pc USING (term) GROUP BY ALL),
seeds2 AS (SELECT t.query_id, t.rank, c.doc_id FROM ({TOP.format(rows="FROM s2 SELECT *", k=10)}) t JOIN chunks c ON c.chunk_id = t.point_id),
"""


@query(SECOND + METRICS.format(seeds="seeds").replace("\na AS", "\na1 AS").replace("JOIN a ON a.query_id", "JOIN a1 a ON a.query_id").replace("\ni AS", "\ni1 AS").replace("\nu AS", "\nu1 AS").replace("\ng AS", "\ng1 AS").replace("\nm AS", "\nm1 AS").replace("FROM u JOIN i", "FROM u1 JOIN i1").replace("FROM i LEFT JOIN g", "FROM i1 LEFT JOIN g1")
       + "," + METRICS.format(seeds="seeds2") + "SELECT round((SELECT avg(recall_10) FROM m) - (SELECT avg(recall_10) FROM m1), 6) AS recall10_lift, round((SELECT avg(rr) FROM m) - (SELECT avg(rr) FROM m1), 6) AS mrr_lift")
def reformulation_lift(spark, d):
    """Gain of the expanded queries over the first ones."""
    items, terms = _terms(spark, d)
    second = feedback.reformulated(items, terms)
    chunks = read(spark, d, "chunks")
    hits = search.sparse_topk(second.select("query_id", F.col("query").alias("text")), chunks.select(F.col("chunk_id").alias("point_id"), "text"), k=10)
    hits = hits.join(chunks.select(F.col("chunk_id").alias("point_id"), "doc_id"), "point_id")
    return evaluation.lift(_metrics(spark, d), evaluation.evaluate(_items(spark, d), hits))


@query(f"""
WITH {EDGES}, {FINDINGS},
x AS (SELECT DISTINCT item_id, substr(unnest(expected), instr(unnest(expected), '/') + 1) AS occ_id, note FROM eval_items),
f AS (SELECT {OCC} AS occ_id, text, chunk_id FROM findings WHERE corpus = 'tsb'),
n AS (SELECT occ_id, count(DISTINCT (f.text, coalesce(reg, ''))) AS n FROM f LEFT JOIN (SELECT chunk_id, unnest({REGS}) AS reg FROM own) USING (chunk_id) GROUP BY 1),
k AS (SELECT x.item_id, x.occ_id, bool_or(contains(lower(f.text), lower(note))) AS hit FROM x JOIN f USING (occ_id) GROUP BY ALL),
c AS (SELECT src AS occ_id, rel, count(*) AS n FROM edges GROUP BY ALL)
SELECT x.item_id, x.occ_id, coalesce(n.n, 0) AS n_findings, coalesce(r.n, 0) AS n_recs, coalesce(d.n, 0) AS n_regs, note IS NULL OR coalesce(k.hit, false) AS keyword_hit,
       CASE WHEN coalesce(n.n, 0) > 0 AND (note IS NULL OR coalesce(k.hit, false)) THEN 1.0 ELSE 0.0 END AS score
FROM x LEFT JOIN n ON n.occ_id = x.occ_id LEFT JOIN c r ON r.occ_id = x.occ_id AND r.rel = 'HAS_RECOMMENDATION' LEFT JOIN c d ON d.occ_id = x.occ_id AND d.rel = 'CITES'
LEFT JOIN k ON k.item_id = x.item_id AND k.occ_id = x.occ_id
""")
def traversal_hit(spark, d):
    """Whether the graph gives findings for an item's occurrences, with the item's note as keyword."""
    items = read(spark, d, "eval_items").select("item_id", F.explode("expected").alias("doc"), "note")
    items = items.select("item_id", F.expr("substring(doc, instr(doc, '/') + 1)").alias("occ_id"), F.when(F.col("note").isNotNull(), F.array("note")).otherwise(F.array().cast("array<string>")).alias("keywords")).distinct()
    context = graph.hop_one(items.select(F.col("occ_id").alias("id")), graph.tables_of(lake.records(read(spark, d, "chunks"))))
    return evaluation.traversal_scores(items, context).select("item_id", "occ_id", *[F.col(c).cast("long").alias(c) for c in ("n_findings", "n_recs", "n_regs")], "keyword_hit", "score")


@query(SEEDS + METRICS.format(seeds="seeds") + """,
r AS (SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS slice, count(*) AS items, round(avg(recall_5), 6) AS a, round(avg(recall_10), 6) AS b, round(avg(rr), 6) AS c, round(avg(ndcg_5), 6) AS d, round(avg(ndcg_10), 6) AS e FROM m GROUP BY GROUPING SETS ((), (lang)) HAVING grouping(lang) = 1 OR lang IS NOT NULL)
SELECT slice, CASE WHEN slice = 'all' THEN 'Eval over ' || items || ' queries' ELSE '  -- ' || slice || ' (n=' || items || ')' END || printf(': R@5=%.4f R@10=%.4f MRR=%.4f nDCG@5=%.4f nDCG@10=%.4f', a, b, c, d, e) AS line FROM r
""")
def report_lines(spark, d):
    return evaluation.report_lines(evaluation.report(_metrics(spark, d)))


@query("""
WITH r AS (SELECT id, lower(coalesce(query, '') || ' ' || coalesce(answer, '')) AS txt, terms FROM unaccepted_qa)
SELECT id, coalesce(len(terms), 0) = 0 OR len(list_filter(terms, lambda k: contains(txt, lower(k)))) > 0 AS hit, count(*) AS n FROM r GROUP BY ALL
""")
def keyword_hits(spark, d):
    rows = read(spark, d, "unaccepted_qa")
    hit = evaluation.keyword_hit(F.array(F.coalesce("query", F.lit("")), F.coalesce("answer", F.lit(""))), F.col("terms"))
    return rows.select("id", hit.alias("hit")).groupBy("id", "hit").agg(F.count("*").alias("n"))


@query(f"""
WITH s AS (SELECT score AS similarity FROM ({TOP.format(rows=PAIRS, k=10)}))
SELECT count(similarity) AS n_ok, count(*) FILTER (similarity >= 0.4) AS n_hit, round_even(avg(similarity), 4) AS mean, round_even((list_sort(list(similarity) FILTER (similarity IS NOT NULL)))[(count(similarity) // 2) + 1], 4) AS median FROM s
""")
def similarity_report(spark, d):
    """Report over the similarities of the ten nearest vectors of each query."""
    p = _vectors(spark, d)
    hits = search.dense_topk(_queries(p), p, k=10)
    return evaluation.similarity_report(materialize(hits.select(F.col("score").alias("similarity")), "similarities"))


@query()
def figure_text_similarity(spark, d):
    """Similarity of each figure's caption and the text of its chunk by matching blocks (Python's difflib; no SQL)."""
    from corpusloom.operators import lake

    a = lake.chunks_as_figures(read(spark, d, "chunks")).select("doc_id", "page", F.col("caption").alias("chunk_caption")).distinct()
    b = read(spark, d, "figures").select("doc_id", "page", "caption").distinct()
    return a.join(b, ["doc_id", "page"]).select("doc_id", "page", F.round(evaluation.sequence_ratio("chunk_caption", "caption"), 6).alias("similarity"))


