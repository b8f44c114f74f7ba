"""Queries of retrieval: nearest neighbours, sparse scores, fusion, reranking, anchored expansion, feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import feedback, lake, search
from corpusloom.plans.registry import query
from corpusloom.session import materialize, read

PAIRS = """
SELECT q.vec_id AS query_id, p.vec_id AS point_id, q.label AS ql, p.label AS pl,
       round(list_dot_product(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(p.embedding::DOUBLE[], p.embedding::DOUBLE[]))), 6) AS score
FROM embeddings q, embeddings p WHERE q.vec_id % 20 = 0
"""
TOP = "SELECT query_id, point_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM ({rows}) QUALIFY rank <= {k}"
STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
TOKENS = "regexp_extract_all(lower(coalesce({t}, '')), '[A-Za-zÀ-ɏ一-鿿㐀-䶿0-9][A-Za-zÀ-ɏ一-鿿㐀-䶿0-9\\-./]*')"
TERMS = f"list_filter({TOKENS}, lambda x: x NOT IN ({STOP}))"


def _vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"), "label")


def _queries(points):
    return points.where("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), "vector", "label")


@query(TOP.format(rows=PAIRS, k=10))
def dense_topk(spark, d):
    p = _vectors(spark, d)
    return search.dense_topk(_queries(p), p, k=10)


@query(TOP.format(rows=PAIRS + " AND q.label = p.label", k=10))
def dense_topk_filtered(spark, d):
    p = _vectors(spark, d)
    return search.dense_topk(_queries(p), p, k=10, within="label")


@query(TOP.format(rows=PAIRS + " AND p.vec_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')", k=10))
def dense_topk_excluded(spark, d):
    p = _vectors(spark, d)
    gone = read(spark, d, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("point_id"))
    return search.dense_topk(_queries(p), p.join(gone, "point_id", "left_anti"), k=10)


SPARSE = f"""
WITH q AS (SELECT item_id AS query_id, unnest({TERMS.format(t='query')}) AS term FROM eval_items),
qc AS (SELECT query_id, term, count(*) AS wq FROM q GROUP BY ALL),
p AS (SELECT chunk_id AS point_id, unnest({TERMS.format(t='text')}) AS term FROM chunks),
pc AS (SELECT point_id, term, count(*) AS wp FROM p GROUP BY ALL),
s AS (SELECT query_id, point_id, sum(wq * wp)::DOUBLE AS score FROM qc JOIN pc USING (term) GROUP BY ALL),
"""


def _sparse(spark, d, k):
    items = read(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("query").alias("text"))
    return search.sparse_topk(items, read(spark, d, "chunks").select(F.col("chunk_id").alias("point_id"), "text"), k=k)


@query(SPARSE + f"top AS ({TOP.format(rows='FROM s SELECT *', k=10)}) SELECT * FROM top")
def sparse_topk(spark, d):
    return _sparse(spark, d, 10)


@query(SPARSE + f"""
top AS ({TOP.format(rows='FROM s SELECT *', k=20)}),
r AS (SELECT query_id, point_id, t.rank AS ann_rank, list_distinct({TERMS.format(t='query')}) AS qt, {TERMS.format(t='c.text')} AS pt
      FROM top t JOIN eval_items i ON i.item_id = t.query_id JOIN chunks c ON c.chunk_id = t.point_id),
x AS (SELECT query_id, point_id, ann_rank, CASE WHEN len(qt) = 0 THEN 0.0 ELSE round(len(list_intersect(qt, pt)) / len(qt), 9) END AS rerank_score FROM r)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, ann_rank) AS rank FROM x QUALIFY rank <= 10
""")
def sparse_rerank(spark, d):
    items = read(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "query")
    hits = _sparse(spark, d, 20).join(items, "query_id").join(read(spark, d, "chunks").select(F.col("chunk_id").alias("point_id"), "text"), "point_id")
    return search.rerank(hits, top_k=10).select("query_id", "point_id", "ann_rank", "rerank_score", "rank")


HYBRID = f"""
WITH d AS ({TOP.format(rows=PAIRS, k=50)}),
v AS (SELECT vec_id AS id, text FROM embeddings JOIN documents ON doc_id = vec_id),
q AS (SELECT id AS query_id, unnest({TERMS.format(t='text')}) AS term FROM v WHERE id % 20 = 0),
qc AS (SELECT query_id, term, count(*) AS wq FROM q GROUP BY ALL),
p AS (SELECT doc_id AS point_id, unnest({TERMS.format(t='text')}) AS term FROM documents),
pc AS (SELECT point_id, term, count(*) AS wp FROM p GROUP BY ALL),
s0 AS (SELECT query_id, point_id, sum(wq * wp)::DOUBLE AS score FROM qc JOIN pc USING (term) GROUP BY ALL),
s AS ({TOP.format(rows='FROM s0 SELECT *', k=50)}),
nd AS (SELECT query_id, count(*) AS nd FROM d GROUP BY 1), ns AS (SELECT query_id, count(*) AS ns FROM s GROUP BY 1),
f AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.point_id, s.point_id) AS point_id, d.rank AS rd, s.rank AS rs FROM d FULL JOIN s ON d.query_id = s.query_id AND d.point_id = s.point_id),
g AS (SELECT f.query_id, point_id, rd, rs, round(1 / (60 + coalesce(rd, coalesce(nd, 0) + 1)) + 1 / (60 + coalesce(rs, coalesce(ns, 0) + 1)), 9) AS score FROM f LEFT JOIN nd USING (query_id) LEFT JOIN ns USING (query_id))
SELECT query_id, point_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rd NULLS LAST, rs NULLS FIRST, point_id) AS rank FROM g
"""


@query(HYBRID)
def rrf_fusion(spark, d):
    """The dense ranking of all vectors and the sparse one of all documents, fused; queries are the vectors with an id divisible
    by 20 and their documents."""
    p = _vectors(spark, d)
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("point_id"), "text")
    asked = texts.join(p.select("point_id"), "point_id", "left_semi").where("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), "text")
    return search.rrf_fuse(search.dense_topk(_queries(p), p, k=50), search.sparse_topk(asked, texts, k=50))


def _texted(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("point_id"), "text", "lang", F.col("source").alias("corpus"))
    p = _vectors(spark, d).drop("label").join(docs, "point_id")
    return p.where("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), F.col("text").alias("query"), "vector"), p


TEXTED = f"""
pt AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, text, lang FROM embeddings JOIN documents ON doc_id = vec_id WHERE {{keep}}),
qt AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, text FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 20 = 0 AND trim(text) <> ''),
dp AS (SELECT q.id AS query_id, p.id AS point_id, round(list_dot_product(q.e, p.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(p.e, p.e))), 6) AS score FROM qt q, pt p),
dh AS ({TOP.format(rows='FROM dp SELECT *', k=20)}),
"""
RERANKED = f"""
rr AS (SELECT query_id, point_id, score, c.rank AS ann_rank, list_distinct({TERMS.format(t='q.text')}) AS a, {TERMS.format(t='p.text')} AS b FROM cand c JOIN qt q ON q.id = query_id JOIN pt p ON p.id = point_id),
sc AS (SELECT query_id, point_id, score, ann_rank, CASE WHEN len(a) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(a), 9) END AS rerank_score FROM rr)
SELECT query_id, point_id, score, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, ann_rank) AS rank FROM sc QUALIFY rank <= 10
"""


@query("WITH " + TEXTED.format(keep="lang IN ('en', 'fr')") + "cand AS (SELECT * FROM dh)," + RERANKED)
def retrieve_dense(spark, d):
    """Nearest vectors in two languages, reranked; queries are the vectors with an id divisible by 20 and their documents."""
    q, p = _texted(spark, d)
    return search.retrieve(q, p, ann_k=20, top_k=10, lang=["en", "fr"]).select("query_id", "point_id", "score", "rerank_score", "rank")


@query("WITH " + TEXTED.format(keep="true") + f"""
tq AS (SELECT query_id, term, count(*) AS wq FROM (SELECT id AS query_id, unnest({TERMS.format(t='text')}) AS term FROM qt) GROUP BY ALL),
tp AS (SELECT point_id, term, count(*) AS wp FROM (SELECT id AS point_id, unnest({TERMS.format(t='text')}) AS term FROM pt) GROUP BY ALL),
sp AS (SELECT query_id, point_id, sum(wq * wp)::DOUBLE AS score FROM tq JOIN tp USING (term) GROUP BY ALL),
sh AS ({TOP.format(rows='FROM sp SELECT *', k=20)}),
nd AS (SELECT query_id, count(*) AS nd FROM dh GROUP BY 1), ns AS (SELECT query_id, count(*) AS ns FROM sh GROUP BY 1),
fu AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.point_id, s.point_id) AS point_id, d.rank AS rd, s.rank AS rs FROM (SELECT * FROM dh WHERE query_id IN (SELECT query_id FROM ns)) d FULL JOIN sh s ON d.query_id = s.query_id AND d.point_id = s.point_id),
fs AS (SELECT query_id, point_id, rd, rs, round(1 / (60 + coalesce(rd, coalesce(nd, 0) + 1)) + 1 / (60 + coalesce(rs, coalesce(ns, 0) + 1)), 9) AS score FROM fu LEFT JOIN nd USING (query_id) LEFT JOIN ns USING (query_id)),
cand AS (SELECT query_id, point_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rd NULLS LAST, rs NULLS FIRST, point_id) AS rank FROM fs
         UNION ALL SELECT query_id, point_id, score, rank FROM dh WHERE query_id NOT IN (SELECT query_id FROM ns)),""" + RERANKED)
def retrieve_hybrid(spark, d):
    """Dense and sparse hits fused, then reranked."""
    q, p = _texted(spark, d)
    return search.retrieve(q, p, ann_k=20, top_k=10, hybrid=True).select("query_id", "point_id", "score", "rerank_score", "rank")


def _seed_hits(spark, d):
    c = lake.records(read(spark, d, "chunks"))
    return _sparse(spark, d, 10).join(c.select(F.col("chunk_id").alias("point_id"), "doc_id", "lang", "page", "section_title", "text", "chunk_hash"), "point_id")


SEEDS = SPARSE + f"""
top AS ({TOP.format(rows='FROM s SELECT *', k=10)}),
seeds AS (SELECT t.query_id, t.rank, t.point_id, c.doc_id, c.lang, coalesce(c.page, 0) AS page, coalesce(c.section_title, '') AS section_title, c.text, c.chunk_hash FROM top t JOIN chunks c ON c.chunk_id = t.point_id),
"""
DOCS = """b AS (SELECT query_id, doc_id, min(rank) AS best FROM seeds GROUP BY ALL),
docs AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY best, doc_id) AS rank FROM b QUALIFY rank <= 3)"""


@query(SPARSE + f"""
top AS ({TOP.format(rows='FROM s SELECT *', k=20)}),
r AS (SELECT query_id, t.rank AS ann_rank, c.doc_id, list_distinct({TERMS.format(t='query')}) AS qt, {TERMS.format(t='c.text')} AS pt FROM top t JOIN eval_items i ON i.item_id = t.query_id JOIN chunks c ON c.chunk_id = t.point_id),
x AS (SELECT query_id, doc_id, ann_rank, CASE WHEN len(qt) = 0 THEN 0.0 ELSE round(len(list_intersect(qt, pt)) / len(qt), 9) END AS score FROM r),
b AS (SELECT query_id, doc_id FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ann_rank) <= 10),
ca AS (SELECT query_id, doc_id, count(*) AS ca FROM r WHERE ann_rank <= 10 GROUP BY ALL), cb AS (SELECT query_id, doc_id, count(*) AS cb FROM b GROUP BY ALL)
SELECT coalesce(ca.query_id, cb.query_id) AS query_id, sum(coalesce(ca, 0))::BIGINT AS n_a, sum(coalesce(cb, 0))::BIGINT AS n_b, sum(least(coalesce(ca, 0), coalesce(cb, 0)))::BIGINT AS common
FROM ca FULL JOIN cb ON ca.query_id = cb.query_id AND ca.doc_id = cb.doc_id GROUP BY 1
""")
def index_parity(spark, d):
    """Documents that the ranking by terms and the reranked one have in common among their first ten."""
    items = read(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "query")
    hits = materialize(_sparse(spark, d, 20), "hits").join(read(spark, d, "chunks").select(F.col("chunk_id").alias("point_id"), "doc_id", "text"), "point_id")
    return search.parity(hits.where("rank <= 10"), search.rerank(hits.join(items, "query_id"), top_k=10))


@query(SEEDS + DOCS + " SELECT * FROM docs")
def top_documents(spark, d):
    return search.top_documents(_seed_hits(spark, d), n=3)


@query(SEEDS + DOCS + f""",
pool AS (SELECT i.item_id AS query_id, c.chunk_id, c.doc_id, coalesce(c.page, 0) AS page, c.text, list_distinct({TERMS.format(t='i.query')}) AS qt, {TERMS.format(t='c.text')} AS pt
         FROM docs JOIN chunks c USING (doc_id) JOIN eval_items i ON i.item_id = docs.query_id JOIN seeds s ON s.query_id = docs.query_id AND s.rank = 1 WHERE s.lang IS NULL OR c.lang = s.lang),
sc AS (SELECT *, CASE WHEN len(qt) = 0 THEN 0.0 ELSE round(len(list_intersect(qt, pt)) / len(qt), 9) END AS rerank_score FROM pool),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rank FROM sc),
bu AS (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS total FROM rk)
SELECT query_id, chunk_id, rerank_score, rank, row_number() OVER (PARTITION BY query_id ORDER BY doc_id, page, rank) AS reading_no FROM bu WHERE total <= 4000 OR rank = 1
UNION ALL SELECT query_id, point_id, NULL, rank, rank FROM seeds WHERE query_id NOT IN (SELECT query_id FROM pool)
""")
def anchored_budget(spark, d):
    items = read(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "query")
    out = search.anchored(_seed_hits(spark, d), lake.records(read(spark, d, "chunks")), items, top_docs=3, budget=4000)
    return out.select("query_id", "chunk_id", "rerank_score", "rank", "reading_no")


@query(f"""
WITH a AS (SELECT *, NULL::DOUBLE AS rerank_score FROM ({TOP.format(rows=PAIRS + ' AND q.label = p.label', k=10)})),
b AS (SELECT *, CASE WHEN point_id % 3 = 0 THEN score END AS rerank_score FROM ({TOP.format(rows=PAIRS, k=10)})),
u AS (SELECT *, 0 AS hop FROM a UNION ALL SELECT *, 1 AS hop FROM b),
o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, point_id ORDER BY hop, rank) = 1)
SELECT * FROM (SELECT query_id, point_id, score, rerank_score, hop, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(rerank_score, 1.0) DESC, score DESC, hop, point_id) AS rank FROM o) WHERE rank <= 12
""")
def candidate_merge(spark, d):
    p = _vectors(spark, d)
    q = _queries(p)
    a = search.dense_topk(q, p, k=10, within="label").withColumn("rerank_score", F.lit(None).cast("double"))
    b = search.dense_topk(q, p, k=10).withColumn("rerank_score", F.when(F.col("point_id") % 3 == 0, F.col("score")))
    return search.merge_candidates(a, b, top_k=12)


@query("""
WITH n AS (SELECT label, count(*) AS n, (SELECT count(*) FROM embeddings) AS total FROM embeddings GROUP BY label),
t AS (SELECT label, CASE WHEN total <= 100 THEN n ELSE greatest(1, round_even(100 * n / total, 0))::BIGINT END AS take FROM n)
SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('0:' || vec_id), vec_id) AS n FROM embeddings) e JOIN t USING (label) WHERE n <= take
""")
def stratified_sample(spark, d):
    return search.stratified_sample(read(spark, d, "embeddings"), most=100, stratum="label", key="vec_id").select("label", "vec_id")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def point_groups(spark, d):
    """Points by the field that colours them."""
    return read(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


@query()
def pca3(spark, d):
    """Centred projection on three components, scaled to the largest coordinate; signs are the solver's."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    df = read(spark, d, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    out = PCA(k=3, inputCol="v", outputCol="c").fit(df).transform(df).select("vec_id", "label", vector_to_array("c").alias("c"))
    mean = out.agg(*[F.avg(F.col("c")[i]).alias(f"m{i}") for i in range(3)])
    out = out.crossJoin(F.broadcast(mean)).select("vec_id", "label", *[(F.col("c")[i] - F.col(f"m{i}")).alias(x) for i, x in enumerate("xyz")])  # one row of means
    top = out.agg(F.max(F.greatest(*[F.abs(x) for x in "xyz"])).alias("top"))
    return out.crossJoin(F.broadcast(top)).select("vec_id", "label", *[F.round(F.col(x) / F.nullif(F.col("top"), F.lit(0.0)), 4).alias(x) for x in "xyz"])


LATEST = "SELECT * FROM unaccepted_qa QUALIFY row_number() OVER (PARTITION BY id ORDER BY resolved_at DESC NULLS LAST, created_at DESC) = 1"


@query(f"SELECT id, resolved_at IS NOT NULL AS resolved, created_at FROM ({LATEST})")
def feedback_state(spark, d):
    return feedback.latest(read(spark, d, "unaccepted_qa")).select("id", F.col("resolved_at").isNotNull().alias("resolved"), "created_at")


SIMILAR = f"""
o AS (SELECT id, query_emb::DOUBLE[] AS e FROM ({LATEST}) WHERE resolved_at IS NULL),
q AS (SELECT id AS query_id, query_emb::DOUBLE[] AS e FROM ({LATEST}) WHERE id % 20 = 0),
s AS (SELECT query_id, id, round(list_dot_product(q.e, o.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(o.e, o.e))), 6) AS score FROM q, o),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.8)
"""


def _similar(spark, d, k=None):
    log = read(spark, d, "unaccepted_qa")
    asked = feedback.latest(log).where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("query_emb").alias("vector"))
    return log, feedback.similar_rejections(asked, log, k=k)


@query(f"WITH {SIMILAR} SELECT * FROM near")
def feedback_similar(spark, d):
    return _similar(spark, d)[1]


@query(f"WITH {SIMILAR}, b AS (SELECT query_id, id FROM near WHERE rank = 1) SELECT DISTINCT query_id, unnest(chunk_hashes) AS chunk_hash FROM b JOIN ({LATEST}) USING (id)")
def feedback_exclusions(spark, d):
    log, near = _similar(spark, d, k=1)
    return feedback.exclusions(near, log)


EXPAND = SEEDS + f"""
own AS (SELECT item_id AS query_id, {TOKENS.format(t='query')} AS own FROM eval_items),
tok AS (SELECT query_id, rank AS place, generate_subscripts(t, 1) AS pos, unnest(t) AS term FROM (SELECT query_id, rank, {TERMS.format(t='text')} AS t FROM seeds)),
w AS (SELECT query_id, term, sum(length(term))::BIGINT AS weight, min(place * 1000000 + pos) AS first FROM tok JOIN own USING (query_id) WHERE length(term) >= 3 AND NOT list_contains(own, term) GROUP BY ALL),
terms AS (SELECT query_id, term, weight, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, first) AS rank FROM w QUALIFY rank <= 6)
"""


def _terms(spark, d):
    items = read(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "query")
    return items, feedback.novel_terms(_seed_hits(spark, d), items)


@query(EXPAND + " SELECT * FROM terms")
def reformulate_terms(spark, d):
    return _terms(spark, d)[1].withColumn("rank", F.col("rank").cast("long"))


@query(EXPAND + ", m AS (SELECT query_id, string_agg(term, ' ' ORDER BY rank) AS more FROM terms GROUP BY 1) SELECT item_id AS query_id, concat_ws(' ', query, more) AS query FROM eval_items LEFT JOIN m ON m.query_id = item_id")
def reformulated_queries(spark, d):
    items, terms = _terms(spark, d)
    return feedback.reformulated(items, terms)


@query(SEEDS + """
t AS (SELECT query_id, doc_id, page, min(rank) AS rank FROM seeds GROUP BY ALL)
SELECT query_id, '**Sources:** ' || string_agg('[' || doc_id || ' p.' || page || ']', ', ' ORDER BY rank) AS block FROM t GROUP BY 1
""")
def sources_block(spark, d):
    return feedback.sources_block(_seed_hits(spark, d))


@query(SEEDS + """
t AS (SELECT query_id, rank, trim(replace(text, chr(10), ' ')) AS flat, doc_id, page, section_title FROM seeds)
SELECT query_id, string_agg('[' || rank || '] ' || doc_id || ' p.' || page || CASE WHEN section_title <> '' THEN ' §' || section_title ELSE '' END || chr(10) || '    ' ||
       CASE WHEN length(flat) > 240 THEN rtrim(substr(flat, 1, 240)) || '...' ELSE flat END, chr(10) || chr(10) ORDER BY rank) AS citations FROM t GROUP BY 1
""")
def prompt_citations(spark, d):
    return feedback.citations(_seed_hits(spark, d), most=240)


@query("""
WITH w AS (SELECT item_id, generate_subscripts(a, 1) AS pos, unnest(a) AS term FROM (SELECT item_id, regexp_extract_all(lower(query), '[A-Za-zÀ-ÿ]+') AS a FROM eval_items)),
o AS (SELECT item_id, term, min(pos) AS pos FROM w WHERE length(term) >= 3 AND term NOT IN (""" + ", ".join(f"'{w}'" for w in T.TERM_STOP_WORDS) + """) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS n FROM o QUALIFY n <= 8)
SELECT item_id, string_agg(term, ' ' ORDER BY n) AS terms FROM r GROUP BY 1
""")
def page_terms(spark, d):
    rows = read(spark, d, "eval_items").select("item_id", T.page_terms(F.col("query")).alias("t"))
    return rows.where(F.size("t") > 0).select("item_id", F.array_join("t", " ").alias("terms"))


@query("""
WITH e AS (SELECT user_id, event_type AS query, max(ts) AS ts FROM events GROUP BY ALL)
SELECT user_id, query, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, query) AS place FROM e QUALIFY place <= 12
""")
def recent_queries(spark, d):
    log = read(spark, d, "events").select("user_id", F.col("event_type").alias("query"), "ts")
    return feedback.recent_queries(log)


@query("""
WITH b AS (SELECT user_id AS thread, event_id, value FROM events)
SELECT thread, event_id, row_number() OVER (PARTITION BY thread ORDER BY event_id) - 1 AS step, CASE WHEN (row_number() OVER (PARTITION BY thread ORDER BY event_id) - 1) % 3 < 2 AND coalesce(value / 100, 0) < 0.65 THEN 'loop' ELSE 'continue' END AS decision FROM b
""")
def trace_steps(spark, d):
    rows = feedback.steps(read(spark, d, "events").select(F.col("user_id").alias("thread"), "event_id", "value"), thread="thread", order="event_id")
    return rows.select("thread", "event_id", F.col("step").cast("long").alias("step"), feedback.decision(F.col("value") / 100, F.col("step") % 3).alias("decision"))


GROUPED = SEEDS.replace("c.chunk_hash FROM top", "c.chunk_hash, coalesce(nullif(c.kind, ''), 'text') AS kind FROM top")


@query(GROUPED + """
g AS (SELECT query_id, doc_id, page, array_to_string(list_sort(list_distinct(list(rank))), ',') AS ranks, bool_or(kind = 'figure') AS figure FROM seeds GROUP BY ALL) SELECT * FROM g
""")
def grouped_hits(spark, d):
    """Hits of a page together, as they are shown."""
    c = lake.records(read(spark, d, "chunks")).select(F.col("chunk_id").alias("point_id"), "doc_id", "page", "kind")
    hits = _sparse(spark, d, 10).join(c, "point_id").withColumn("rerank_score", F.lit(None).cast("double"))
    return search.grouped(hits, by=["doc_id", "page"]).select("query_id", "doc_id", "page", F.array_join(F.transform("ranks", lambda r: r.cast("string")), ",").alias("ranks"), "figure")


@query(SEEDS + """
n AS (SELECT query_id, count(DISTINCT doc_id) AS docs FROM seeds GROUP BY 1 HAVING count(DISTINCT doc_id) <= 9),
e AS (SELECT DISTINCT lower(occ_id) AS src, reg AS dst FROM cites WHERE occ_id IS NOT NULL AND reg IS NOT NULL),
ids AS (SELECT DISTINCT query_id, substr(doc_id, 5) AS id FROM seeds JOIN n USING (query_id) WHERE doc_id LIKE 'tsb/%'),
deg AS (SELECT dst, count(*) AS occ_count FROM e GROUP BY 1 HAVING count(*) <= 15),
own AS (SELECT query_id, id, dst AS reg FROM ids JOIN e ON src = id),
m AS (SELECT query_id, count(DISTINCT id) AS n FROM own GROUP BY 1),
r AS (SELECT DISTINCT query_id, reg, occ_count FROM own JOIN deg ON reg = dst JOIN m USING (query_id) WHERE occ_count > n),
o AS (SELECT query_id, reg, occ_count, src FROM r JOIN e ON reg = dst WHERE NOT EXISTS (SELECT 1 FROM ids s WHERE s.query_id = r.query_id AND s.id = src)),
g AS (SELECT query_id, reg, occ_count, array_to_string(list_slice(list_sort(list(src)), 1, 3), ',') AS siblings FROM o GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY occ_count DESC, reg) AS rank FROM g QUALIFY rank <= 5
""")
def broadened_context(spark, d):
    """Recurring regulations of the questions whose hits come from nine documents or fewer."""
    from corpusloom.operators import agent
    from corpusloom.plans.graph_queries import graph_cites

    return agent.broadened(_seed_hits(spark, d), graph_cites(spark, d), most_docs=9).withColumn("siblings", F.array_join("siblings", ","))


@query(EXPAND + """,
more AS (SELECT query_id, list(term ORDER BY rank) AS terms FROM terms GROUP BY 1),
h AS (SELECT query_id, list(chunk_hash ORDER BY rank) AS hashes FROM seeds WHERE rank <= 3 GROUP BY 1)
SELECT item_id AS query_id, query, coalesce(array_to_string(hashes, ','), '') AS chunk_hashes, array_to_string(list_filter(more.terms, lambda t: NOT list_contains(string_split_regex(lower(trim(query)), '\\s+'), t)), ' ') AS terms
FROM eval_items LEFT JOIN h ON h.query_id = item_id LEFT JOIN more ON more.query_id = item_id WHERE query IS NOT NULL
""")
def rejection_rows(spark, d):
    """What the log of rejected answers would get of each item: hashes of its first three hits, terms of its second hop."""
    from corpusloom.operators import agent

    items, terms = _terms(spark, d)
    again = feedback.reformulated(items, terms).withColumnRenamed("query", "reformulated")
    hits = _seed_hits(spark, d).withColumn("rerank_score", F.lit(None).cast("double"))
    answers = items.select("query_id", F.array().cast("array<double>").alias("query_emb"), F.lit("").alias("answer"))
    out = agent.rejections(items.where("query is not null").join(again, "query_id"), hits, answers)
    return out.select("query_id", "query", F.array_join("chunk_hashes", ",").alias("chunk_hashes"), F.array_join("terms", " ").alias("terms"))


@query()
def question_hops(spark, d):
    """The loop of two hops over all items; its parts have SQL (sparse_rerank, reformulate_terms, candidate_merge)."""
    from corpusloom.operators import agent

    items = read(spark, d, "eval_items").where("query is not null").select(F.col("item_id").alias("query_id"), "query")
    c = read(spark, d, "chunks").select(F.col("chunk_id").alias("point_id"), "doc_id", "text")

    def ask(q):
        hits = search.sparse_topk(q.select("query_id", F.col("query").alias("text")), c, k=20)
        return search.rerank(hits.join(q, "query_id").join(c, "point_id"), top_k=10).select("query_id", "point_id", "doc_id", "text", "score", "rerank_score", "rank")

    found, state = agent.hops(items, ask, max_hops=2, replace=False)
    return found.join(state.select("query_id", F.col("hop").alias("hops")), "query_id").select("query_id", "point_id", "rank", "rerank_score", "hops")
