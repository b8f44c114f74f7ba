"""Retrieval: exact nearest neighbours, sparse scores, rank fusion, reranking, anchored expansion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.session import materialize


def chosen(selected: list[str] | None, values: list[str]) -> list[str]:
    """A choice of several values as a filter: none or all of them are no filter (an empty list)."""
    some = [x for x in selected or [] if x in values]
    return [] if len(set(some)) == len(values) else some


def payload_filter(df: DataFrame, *, lang=None, source: str | None = None, loose_source: bool = False) -> DataFrame:
    """Filters below a search: language in a list (a single value is a list of one, an empty list no filter), corpus equal
    to ``source``; ``loose_source`` matches the source anywhere in the document's name instead."""
    langs = [lang] if isinstance(lang, str) else list(lang or [])
    if langs:
        df = df.where(F.col("lang").isin(langs))
    if source:
        df = df.where(F.instr("doc_id", f"{source}/") > 0) if loose_source else df.where(F.col("corpus") == source)
    return df


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / F.nullif(norm, F.lit(0.0)))


class _Best:
    """The ``k`` best points of each query over the batches of one task, ties by point; ``k`` None keeps all that count."""

    def __init__(self, queries: int, k: int | None):
        self.k, self.parts = k, [[] for _ in range(queries)]
        self.full = np.zeros(queries, np.int64)

    def add(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray, least: float) -> None:
        """Scores (queries ``which`` x points ``ids``); those not above ``least`` don't count."""
        order = np.argsort(ids, kind="stable")
        scores, ids = scores[:, order], ids[order]
        for row, q in enumerate(which):
            some = np.flatnonzero(scores[row] > least)
            if self.k is not None and len(some) > self.k:
                bound = np.partition(scores[row][some], -self.k)[-self.k]
                above, equal = some[scores[row][some] > bound], some[scores[row][some] == bound]
                some = np.concatenate((above, equal[: self.k - len(above)]))
            if len(some):
                self.parts[q].append((scores[row][some], ids[some]))
                self.full[q] += len(some)
                if self.k is not None and self.full[q] > 8 * self.k:
                    self._cut(q)

    def _cut(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        scores, ids = (np.concatenate(x) for x in zip(*self.parts[q]))
        best = np.lexsort((ids, -scores))[: self.k]
        self.parts[q], self.full[q] = [(scores[best], ids[best])], len(best)
        return self.parts[q][0]

    def rows(self):
        """(queries, points, scores) of what is left, in pieces."""
        for q in range(len(self.parts)):
            if self.parts[q]:
                scores, ids = self._cut(q)
                yield np.full(len(ids), q), ids, scores


def _scan(queries: DataFrame, points: DataFrame, task, schema: str, block_rows: int, columns: list[str]) -> DataFrame:
    """Points stay where they are; the queries go to all tasks in blocks of about ``block_rows`` rows, one block at a time.
    ``task(block)`` makes the function of a task from a block's Arrow table (first column id)."""
    n = queries.count()
    blocks, out = max(1, -(-n // block_rows)), None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select(*columns).orderBy("id").toArrow()
        sent = queries.sparkSession.sparkContext.broadcast(block)
        found = points.mapInArrow(task(sent), schema)
        if blocks > 1:
            found = materialize(found, "block-hits")
            sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def dense_topk(queries: DataFrame, points: DataFrame, *, k: int | None = 10, query: str = "query_id", point: str = "point_id", vector: str = "vector", decimals: int = 6, block_rows: int = 8192, within: str | None = None, least: float | None = None) -> DataFrame:
    """The ``k`` points of greatest cosine for each query, exact: (query, point, score, rank), ties by point.

    One pass over the points for each block of about ``block_rows`` queries: a batch of points times the block is a matrix
    product, a task keeps k rows a query, and the best of all tasks are ranked, which is all that is shuffled. ``within`` names a
    column that query and point must share: only such are multiplied. ``least`` is a score below which points don't count; ``k``
    None ranks all of them. Rows whose vector is null are in no result, and a vector of zeros has the score 0.
    """
    cols = lambda df, key: df.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.col(within).cast("string") if within else F.lit("")).alias("w"))
    queries, points = cols(queries, query), cols(points, point)
    kinds = queries.schema["id"].dataType.simpleString(), points.schema["id"].dataType.simpleString()
    floor = -np.inf if least is None else np.nextafter(least, -np.inf)

    def task(sent):
        def run(batches):
            block = sent.value
            if not block.num_rows:
                return
            qv, qw = _matrix(block["v"]), np.array(block["w"].to_pylist(), object)
            best = _Best(len(qv), k)
            for batch in batches:
                for start in range(0, len(batch), max(1, 4_000_000 // len(qv))):
                    some = batch.slice(start, max(1, 4_000_000 // len(qv)))
                    pv, ids, pw = _matrix(some.column("v")), some.column("id").to_numpy(zero_copy_only=False), np.array(some.column("w").to_pylist(), object)
                    for w in set(pw.tolist()) - ({None} if within else set()):
                        which, here = np.flatnonzero(qw == w), np.flatnonzero(pw == w)
                        if len(which):
                            best.add(which, np.round(qv[which] @ pv[here].T, decimals) + 0.0, ids[here], floor)
            names = block["id"].combine_chunks()
            for q, ids, scores in best.rows():
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), pa.array(ids), pa.array(scores)], [query, point, "score"])

        return run

    found = _scan(queries, points, task, f"{query} {kinds[0]}, {point} {kinds[1]}, score double", block_rows, ["id", "v", "w"])
    return ranked(found, query, [F.desc("score"), F.col(point)], k)


def ranked(df: DataFrame, key: str, order: list, k: int | None = None) -> DataFrame:
    """Rank from 1 within the key, cut at ``k``: Spark keeps k rows a key in each task before the shuffle."""
    df = df.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    df = df if k is None else df.where(F.col("rank") <= k)
    return df.withColumn("rank", F.col("rank").cast("long"))


def term_counts(text: Column) -> tuple[Column, Column]:
    """Default weights of a text: its search terms, each time it comes up with the weight 1."""
    terms = T.search_terms(text)
    return terms, F.transform(terms, lambda _: F.lit(1.0))


def map_weights(weights: Column) -> tuple[Column, Column]:
    """Weights out of a map of terms (learned ones, by a model outside)."""
    return F.map_keys(weights).cast("array<string>"), F.map_values(weights).cast("array<double>")


def sparse_topk(queries: DataFrame, passages: DataFrame, *, k: int = 10, query: str = "query_id", point: str = "point_id", text: str = "text", weigh=term_counts, block_rows: int = 2048) -> DataFrame:
    """Top ``k`` passages by the sum of products of term weights: (query, point, score, rank), ties by point; passages without a
    common term and queries without terms have no rows. ``weigh`` gives terms and weights of the column ``text``: counts of
    terms without stop words by default, ``map_weights`` for a column of maps.

    One pass over the passages for each block of about ``block_rows`` queries: a passage is scored where it is read, by the
    queries that hold its terms, a task keeps k rows a query, and only these are shuffled.
    """
    cols = lambda df, key: df.select(F.col(key).alias("id"), *[c.alias(n) for c, n in zip(weigh(F.col(text)), ("terms", "weights"))]).where(F.size("terms") > 0)
    queries, passages = cols(queries, query), cols(passages, point)
    kinds = queries.schema["id"].dataType.simpleString(), passages.schema["id"].dataType.simpleString()

    def postings(terms, weights):
        per = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
        return np.repeat(np.arange(len(terms)), per), terms.flatten(), weights.flatten().to_numpy(zero_copy_only=False).astype(np.float64)

    def task(sent):
        def run(batches):
            block = sent.value
            if not block.num_rows:
                return
            n = block.num_rows
            owner, terms, weight = postings(block["terms"].combine_chunks(), block["weights"].combine_chunks())
            known = terms.unique()
            code = pc.index_in(terms, known).to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            owner, weight, first = owner[order], weight[order], np.searchsorted(code[order], np.arange(len(known) + 1))
            best, names = _Best(n, k), block["id"].combine_chunks()
            step = max(1, 2_000_000 // n)
            for batch in batches:
                for start in range(0, len(batch), step):
                    some = batch.slice(start, step)
                    row, words, w = postings(some.column("terms"), some.column("weights"))
                    c = pc.index_in(words, known)
                    hit = c.is_valid().to_numpy(zero_copy_only=False)
                    c, row, w = c.drop_null().to_numpy(zero_copy_only=False), row[hit], w[hit]
                    size = first[c + 1] - first[c]
                    at = np.repeat(first[c] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    scores = np.bincount(owner[at] * len(some) + np.repeat(row, size), weights=weight[at] * np.repeat(w, size), minlength=n * len(some)).reshape(n, len(some))
                    best.add(np.arange(n), scores, some.column("id").to_numpy(zero_copy_only=False), 0.0)
            for q, ids, scores in best.rows():
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), pa.array(ids), pa.array(scores)], [query, point, "score"])

        return run

    found = _scan(queries, passages, task, f"{query} {kinds[0]}, {point} {kinds[1]}, score double", block_rows, ["id", "terms", "weights"])
    return ranked(found, query, [F.desc("score"), F.col(point)], k)


def rrf_fuse(dense: DataFrame, sparse: DataFrame, *, query: str = "query_id", point: str = "point_id", k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two rankings; a point that a list lacks stands one place behind its end there.
    (query, point, score, rank); of equal scores those of the dense list come first, in its order."""
    size = lambda df, name: df.groupBy(query).agg(F.count("*").alias(name))
    both = dense.select(query, point, F.col("rank").alias("rd")).join(sparse.select(query, point, F.col("rank").alias("rs")), [query, point], "full_outer")
    both = both.join(size(dense, "nd"), query, "left").join(size(sparse, "ns"), query, "left")
    rd = F.coalesce("rd", F.coalesce("nd", F.lit(0)) + 1)
    rs = F.coalesce("rs", F.coalesce("ns", F.lit(0)) + 1)
    both = both.withColumn("score", F.round(1 / (k + rd) + 1 / (k + rs), 9))
    return ranked(both, query, [F.desc("score"), F.col("rd").asc_nulls_last(), F.col("rs"), F.col(point)]).select(query, point, "score", "rank")


def overlap_score(query_text: Column, passage: Column) -> Column:
    """Default reranker: share of the query's distinct terms that the passage has; 0 without terms."""
    terms = F.array_distinct(T.search_terms(query_text))
    hit = F.size(F.array_intersect(terms, T.search_terms(passage)))
    return F.when(F.size(terms) == 0, 0.0).otherwise(hit / F.nullif(F.size(terms), F.lit(0)))


def rerank(candidates: DataFrame, *, top_k: int | None = 10, query: str = "query_id", query_text: str = "query", text: str = "text", scorer=overlap_score) -> DataFrame:
    """Candidates (query, rank, ...) by ``scorer``; equal scores keep their order. Adds rerank_score, renews rank."""
    out = candidates.withColumnRenamed("rank", "ann_rank").withColumn("rerank_score", F.round(scorer(F.col(query_text), F.col(text)), 9))
    return ranked(out, query, [F.desc("rerank_score"), F.col("ann_rank")], top_k)


def top_documents(hits: DataFrame, *, n: int = 3, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """The first ``n`` distinct documents of each ranking: (query, doc, rank) by their best hit."""
    best = hits.groupBy(query, doc).agg(F.min("rank").alias("best"))
    return ranked(best, query, [F.col("best"), F.col(doc)], n).select(query, doc, "rank")


def within_budget(df: DataFrame, *, budget: int, key: str = "query_id", text: str = "text") -> DataFrame:
    """The first row of each ranking, then rows as long as their texts fit into ``budget`` characters together."""
    total = F.sum(F.length(text)).over(W.partitionBy(key).orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow))
    return df.withColumn("__total", total).where((F.col("__total") <= budget) | (F.col("rank") == 1)).drop("__total")


def retrieve(queries: DataFrame, points: DataFrame, *, ann_k: int = 50, top_k: int = 10, lang=None, source: str | None = None, excluded: DataFrame | None = None, hybrid: bool = False, rrf_k: int = 60, weigh=term_counts, sparse_text: str = "text", scorer=overlap_score) -> DataFrame:
    """Nearest points (point_id, vector, text, ... other columns stay) of each query (query_id, query, vector), reranked by
    ``scorer`` and cut at ``top_k``: adds query_id, score, rerank_score and rank.

    ``ann_k`` candidates a query go to the reranker. Language, source and ``excluded`` (chunk_hash) filter below the search. With
    ``hybrid`` a sparse ranking over ``sparse_text`` is fused in; a query without sparse hits keeps its dense ones, and the fused
    candidates (up to twice ``ann_k``) are not cut again. Blank queries have no rows; ``ann_k`` below ``top_k`` is an error.
    """
    if ann_k < top_k:
        raise ValueError(f"ann_k ({ann_k}) must not be less than top_k ({top_k})")
    asked = queries.where(F.trim("query") != "")
    points = payload_filter(points, lang=lang, source=source)
    if excluded is not None:
        points = points.join(excluded.select("chunk_hash").distinct(), "chunk_hash", "left_anti")
    hits = dense_topk(asked, points, k=ann_k)
    if hybrid:
        sparse = sparse_topk(asked.withColumn(sparse_text, F.col("query")) if weigh is term_counts else asked, points, k=ann_k, text=sparse_text, weigh=weigh)
        hits, sparse = materialize(hits, "dense-hits"), materialize(sparse, "sparse-hits")
        both = sparse.select("query_id").distinct()
        fused = rrf_fuse(hits.join(both, "query_id", "left_semi"), sparse, k=rrf_k)
        hits = hits.join(both, "query_id", "left_anti").unionByName(fused)
    hits = hits.join(points.drop("vector"), "point_id").join(asked.select("query_id", "query"), "query_id")
    return rerank(hits, top_k=top_k, scorer=scorer).drop("ann_rank")


def anchored(seeds: DataFrame, chunks: DataFrame, queries: DataFrame, *, top_docs: int = 3, budget: int = 24000, excluded: DataFrame | None = None, lang: str | list[str] | None = None, scorer=overlap_score) -> DataFrame:
    """All chunks of the first documents of each seed ranking (query_id, doc_id, lang, rank), reranked by ``scorer`` against the
    query (query_id, query), cut by the character budget, in reading order. ``excluded`` holds (query_id, chunk_hash) that are
    left out. Chunks stay whose language is one of ``lang``, or, where that is None, the best seed's; a seed without language
    and an empty list filter nothing. A query whose documents have no such chunk keeps its seeds in their order. Empty texts
    are left out."""
    docs = top_documents(seeds, n=top_docs)
    pool = chunks.join(docs.select("query_id", "doc_id"), "doc_id").join(queries.select("query_id", "query"), "query_id")
    if excluded is not None:
        pool = pool.join(excluded, ["query_id", "chunk_hash"], "left_anti")
    langs = [lang] if isinstance(lang, str) else lang
    if langs:
        pool = pool.where(F.col("lang").isin(langs))
    elif langs is None:
        first = seeds.where("rank = 1").select("query_id", F.col("lang").alias("seed_lang"))
        pool = pool.join(first, "query_id").where("seed_lang is null or lang = seed_lang").drop("seed_lang")
    scored = pool.withColumn("rerank_score", F.round(scorer(F.col("query"), F.col("text")), 9))
    # a text has a character at least, so no more than ``budget`` rows can fit: tasks keep no more before the shuffle
    scored = ranked(scored.where(F.length("text") > 0), "query_id", [F.desc("rerank_score"), F.col("chunk_id")], budget + 1)
    kept = within_budget(scored, budget=budget)
    order = W.partitionBy("query_id").orderBy("doc_id", F.coalesce("page", F.lit(0)), "rank")
    kept = kept.withColumn("reading_no", F.row_number().over(order).cast("long"))
    alone = seeds.join(kept.select("query_id").distinct(), "query_id", "left_anti")
    if "chunk_id" not in alone.columns:
        alone = alone.withColumn("chunk_id", F.col("point_id").cast(chunks.schema["chunk_id"].dataType))
    alone = alone.withColumn("rank", F.col("rank").cast("long")).withColumn("reading_no", F.col("rank"))
    return kept.unionByName(alone.select(*[c for c in alone.columns if c in kept.columns]), allowMissingColumns=True)


def displayed(hits: DataFrame, *, query: str = "query_id") -> DataFrame:
    """Hits in the order of display: greatest rerank_score first, those without one last, ``place`` from 1."""
    order = W.partitionBy(query).orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return hits.withColumn("place", F.row_number().over(order).cast("long"))


def grouped(hits: DataFrame, *, by: list[str], query: str = "query_id") -> DataFrame:
    """Hits of one document (or document and page) together: greatest rerank_score, ranks in order, whether any is a figure."""
    return hits.groupBy(query, *by).agg(F.max("rerank_score").alias("best"), F.array_sort(F.collect_set("rank")).alias("ranks"), F.coalesce(F.bool_or(F.col("kind") == "figure"), F.lit(False)).alias("figure"))


def merge_candidates(old: DataFrame, new: DataFrame, *, top_k: int, key: str = "query_id", point: str = "point_id") -> DataFrame:
    """Candidates of two hops, each point once (the first hop's row), by rerank_score then score. A missing rerank_score
    counts as 1.0, so rows that were never reranked come first."""
    both = old.withColumn("hop", F.lit(0)).unionByName(new.withColumn("hop", F.lit(1)))
    row = F.struct(*[c for c in both.columns])
    one = both.groupBy(F.col(key).alias("__k"), F.col(point).alias("__p")).agg(F.min_by(row, F.struct("hop", "rank")).alias("r")).select("r.*").drop("rank")
    return ranked(one, key, [F.desc(F.coalesce("rerank_score", F.lit(1.0))), F.desc("score"), F.col("hop"), F.col(point)], top_k)


def parity(a: DataFrame, b: DataFrame, *, key: str = "query_id", item: str = "doc_id") -> DataFrame:
    """Overlap of two result lists as bags: (key, n_a, n_b, common), one row for each key of either."""
    count = lambda df, name: df.groupBy(key, item).agg(F.count("*").alias(name))
    both = count(a, "ca").join(count(b, "cb"), [key, item], "full_outer")
    return both.groupBy(key).agg(F.sum(F.coalesce("ca", F.lit(0))).alias("n_a"), F.sum(F.coalesce("cb", F.lit(0))).alias("n_b"), F.sum(F.least(F.coalesce("ca", F.lit(0)), F.coalesce("cb", F.lit(0)))).alias("common"))


def stratified_sample(df: DataFrame, *, most: int, stratum: str, key: str, seed: int = 0) -> DataFrame:
    """About ``most`` rows, of each stratum its share but one at least, those of least MD5 of seed and key."""
    size = df.groupBy(stratum).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    size = size.crossJoin(total).select(F.col(stratum).alias("__s"), F.when(F.col("total") <= most, F.col("n")).otherwise(F.greatest(F.lit(1), F.bround(F.lit(most) * F.col("n") / F.col("total")).cast("long"))).alias("take"))
    order = W.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    # at most ``most`` rows of a stratum are needed, so tasks keep no more of it before the shuffle
    first = df.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most)
    return first.join(size, F.col(stratum).eqNullSafe(F.col("__s"))).where(F.col("__n") <= F.col("take")).drop("__n", "__s", "take")
