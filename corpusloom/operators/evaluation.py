"""Ranking metrics, slices, graph hits and similarity reports."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def recall_at(actual: Column, expected: Column, k: int) -> Column:
    """Share of the expected documents among the first ``k`` results; 0 where nothing is expected."""
    hit = F.size(F.array_intersect(F.slice(F.coalesce(actual, F.array().cast("array<string>")), 1, k), expected))
    return F.when(F.coalesce(F.size(expected), F.lit(0)) <= 0, 0.0).otherwise(hit / F.nullif(F.size(expected), F.lit(0)))


def reciprocal_rank(actual: Column, expected: Column) -> Column:
    """1 by the place of the first expected result, else 0."""
    places = F.filter(F.transform(F.coalesce(actual, F.array().cast("array<string>")), lambda x, i: F.when(F.array_contains(expected, x), i + 1)), lambda x: x.isNotNull())
    return F.coalesce(1 / F.get(places, F.lit(0)), F.lit(0.0))


def ndcg_at(actual: Column, expected: Column, k: int) -> Column:
    """Binary nDCG over distinct documents in order; the ideal has min(k, number expected) hits."""
    one = F.slice(F.array_distinct(F.coalesce(actual, F.array().cast("array<string>"))), 1, k)
    gain = lambda i: 1 / F.log2(i + 2)
    dcg = F.aggregate(F.transform(one, lambda x, i: F.when(F.array_contains(expected, x), gain(i)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    size = F.least(F.lit(k), F.size(expected))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1), gain), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.coalesce(F.size(expected), F.lit(0)) <= 0, 0.0).otherwise(dcg / ideal)


def result_lists(hits: DataFrame, *, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Ranked hits as one list a query."""
    return hits.groupBy(query).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", doc))), lambda x: x[doc]).alias("actual"))


def evaluate(items: DataFrame, hits: DataFrame, *, k: int = 10) -> DataFrame:
    """Metrics of each item (query_id, expected, lang); items without hits have zeros."""
    rows = items.join(result_lists(hits), "query_id", "left")
    a, e = F.col("actual"), F.col("expected")
    return rows.select("query_id", "lang", recall_at(a, e, 5).alias("recall_5"), recall_at(a, e, k).alias("recall_10"), reciprocal_rank(a, e).alias("rr"), ndcg_at(a, e, 5).alias("ndcg_5"), ndcg_at(a, e, k).alias("ndcg_10"))


def report(metrics: DataFrame) -> DataFrame:
    """Means over all items and by language, in one pass; items without a language count in the whole only."""
    names = ["recall_5", "recall_10", "rr", "ndcg_5", "ndcg_10"]
    out = metrics.groupingSets([[], ["lang"]], "lang").agg(F.grouping("lang").alias("g"), F.count("*").alias("items"), *[F.round(F.avg(n), 6).alias(n) for n in names])
    return out.where("g = 1 or lang is not null").select(F.when(F.col("g") == 1, "all").otherwise(F.col("lang")).alias("slice"), "items", *names)


def lift(first: DataFrame, second: DataFrame) -> DataFrame:
    """Gain of a second hop over the first: differences of the mean recall and reciprocal rank."""
    mean = lambda df, s: df.agg(F.avg("recall_10").alias(f"r{s}"), F.avg("rr").alias(f"m{s}"))
    return mean(first, 1).crossJoin(mean(second, 2)).select(F.round(F.col("r2") - F.col("r1"), 6).alias("recall10_lift"), F.round(F.col("m2") - F.col("m1"), 6).alias("mrr_lift"))


def keyword_hit(texts: Column, keywords: Column) -> Column:
    """Whether any keyword stands in the joined texts, case apart; no keywords count as a hit."""
    joined = F.lower(F.array_join(texts, " "))
    return F.when(F.coalesce(F.size(keywords), F.lit(0)) <= 0, True).otherwise(F.exists(keywords, lambda k: F.contains(joined, F.lower(k))))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts, stripped and in lower case; 1 for two empty ones, 0 for one empty one."""

    def one(x, y):
        x, y = (x or "").strip().lower(), (y or "").strip().lower()
        if not x and not y:
            return 1.0
        return difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def similarity_report(pairs: DataFrame, *, threshold: float = 0.4, score: str = "similarity") -> DataFrame:
    """Number, hits, mean and upper median of similarities, rounded to four places (halves to even). The median comes
    from counts by value, not from a collected list."""
    from pyspark.sql import Window as W

    total = pairs.agg(F.count(score).alias("n_ok"), F.count_if(F.col(score) >= threshold).alias("n_hit"), F.bround(F.avg(score), 4).alias("mean"))
    counts = pairs.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("c"))
    # values in ranges first, so that no task sorts all of them
    counts = counts.withColumn("bin", F.floor(F.col(score) * 1000))
    bins = counts.groupBy("bin").agg(F.sum("c").alias("t")).withColumn("base", F.coalesce(F.sum("t").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    run = F.sum("c").over(W.partitionBy("bin").orderBy(score)) + F.col("base")
    placed = counts.join(bins, "bin").withColumn("upto", run).crossJoin(total.select("n_ok"))
    median = placed.where(F.col("upto") > F.floor(F.col("n_ok") / 2)).agg(F.bround(F.min(score), 4).alias("median"))
    return total.crossJoin(median)


def region_candidates(chunks: DataFrame, *, least_area: float = 100.0, least_chars: int = 30) -> DataFrame:
    """Chunks whose region can be compared with their text: four coordinates, an area of at least ``least_area``, at least
    ``least_chars`` characters, a page from 1."""
    box = F.col("bbox")
    area = F.greatest(F.lit(0.0), box[2] - box[0]) * F.greatest(F.lit(0.0), box[3] - box[1])
    return chunks.where((F.size(box) == 4) & (F.length("text") >= least_chars) & (F.col("page") >= 1)).where(area >= least_area)


def region_sample(chunks: DataFrame, *, n: int = 50, seed: int = 0, **options) -> DataFrame:
    """``n`` of these candidates (the sampling is the feature), those of least MD5 of seed and chunk_hash."""
    return region_candidates(chunks, **options).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "chunk_hash")), "chunk_id").limit(n)


def worst(pairs: DataFrame, *, n: int = 5, score: str = "similarity", key: str = "chunk_id") -> DataFrame:
    """The ``n`` least similar pairs."""
    return pairs.where(F.col(score).isNotNull()).orderBy(score, key).limit(n)


def traversal_scores(items: DataFrame, context: DataFrame) -> DataFrame:
    """Graph items (item_id, occ_id, keywords) against the facts of their occurrences (see ``graph.hop_one``): numbers of findings,
    recommendations and distinct regulations, keyword_hit, and score 1 where there are findings and a keyword stands in them."""
    rows = items.join(context.select("occ_id", "findings", "recommendations", "direct_regs"), "occ_id", "left")
    none = lambda c, like: F.coalesce(c, F.array().cast(context.schema[like].dataType))
    found = none("findings", "findings")
    regs = F.array_union(none("direct_regs", "direct_regs"), F.filter(F.transform(found, lambda f: f["cites_reg"]), lambda x: x.isNotNull()))
    hit = keyword_hit(F.transform(found, lambda f: F.coalesce(f["text"], F.lit(""))), F.col("keywords"))
    return rows.select("item_id", "occ_id", F.size(found).alias("n_findings"), F.size(none("recommendations", "recommendations")).alias("n_recs"), F.size(regs).alias("n_regs"), hit.alias("keyword_hit"), F.when((F.size(found) > 0) & hit, 1.0).otherwise(0.0).alias("score"))


def replayed(queries: DataFrame, log: DataFrame, points: DataFrame, *, k: int = 10, threshold: float = 0.8) -> DataFrame:
    """Retrieval with the feedback of the log: of each query (query_id, vector) the nearest open rejection as near as
    ``threshold``, the hashes that it excludes, and of the ``k`` best points (point_id, chunk_hash, vector) without it how many
    those exclude. Resolved rejections exclude nothing."""
    from corpusloom.operators import feedback, search

    near = feedback.similar_rejections(queries, log, threshold=threshold, k=1)
    gone = feedback.exclusions(near, log)
    hits = search.dense_topk(queries, points, k=k).join(points.select("point_id", "chunk_hash"), "point_id")
    hit = hits.join(gone.withColumn("gone", F.lit(1)), ["query_id", "chunk_hash"], "left").groupBy("query_id").agg(F.count("gone").alias("hits_excluded"))
    size = gone.groupBy("query_id").agg(F.count("*").alias("excluded"))
    out = queries.select("query_id").distinct().join(near.select("query_id", "id"), "query_id", "left").join(size, "query_id", "left").join(hit, "query_id", "left")
    return out.select("query_id", "id", F.coalesce("excluded", F.lit(0)).alias("excluded"), F.coalesce("hits_excluded", F.lit(0)).alias("hits_excluded"))


def report_lines(report: DataFrame) -> DataFrame:
    """A report by slice (see ``report``) as lines of text: (slice, line)."""
    number = lambda c: F.format_string("%.4f", c)
    head = F.when(F.col("slice") == "all", F.concat(F.lit("Eval over "), F.col("items").cast("string"), F.lit(" queries"))).otherwise(F.concat(F.lit("  -- "), "slice", F.lit(" (n="), F.col("items").cast("string"), F.lit(")")))
    return report.select("slice", F.concat(head, F.lit(": R@5="), number("recall_5"), F.lit(" R@10="), number("recall_10"), F.lit(" MRR="), number("rr"), F.lit(" nDCG@5="), number("ndcg_5"), F.lit(" nDCG@10="), number("ndcg_10")).alias("line"))


def result_json(hits: DataFrame, *, query: str = "query_id") -> DataFrame:
    """Ranked hits of each query as one JSON array."""
    fields = [c for c in ("rank", "doc_id", "page", "section_title", "lang", "source_url", "bbox", "score", "rerank_score", "text") if c in hits.columns]
    return hits.groupBy(query).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias("json"))
