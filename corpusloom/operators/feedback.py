"""Rejected answers, query reformulation, prompt parts and chat history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.running import before_sum
from corpusloom.operators.search import dense_topk, ranked
from corpusloom.session import materialize


def latest(log: DataFrame) -> DataFrame:
    """The state of each rejection: of rows with one id a resolved one wins, then the later one."""
    row = F.struct(*[F.col(c) for c in log.columns])
    order = F.struct(F.col("resolved_at").isNotNull(), F.col("resolved_at"), F.col("created_at"), F.xxhash64("answer", "query"))
    return log.groupBy(F.col("id").alias("__id")).agg(F.max_by(row, order).alias("r")).select("r.*")


def similar_rejections(queries: DataFrame, log: DataFrame, *, threshold: float = 0.8, k: int | None = None) -> DataFrame:
    """Open rejections as near as ``threshold`` to each query (query_id, vector): (query_id, id, score, rank). ``k`` None
    gives all of them."""
    open_ = latest(log).where("resolved_at is null").select(F.col("id").alias("point_id"), F.col("query_emb").alias("vector"))
    return dense_topk(queries, open_, k=k, least=threshold).withColumnRenamed("point_id", "id")


def written(rows: DataFrame, path: str) -> None:
    """Appends rejections (id, query, query_emb, answer, chunk_hashes, terms) to the log at ``path``, open and with the time of
    writing."""
    stamped = rows.withColumn("created_at", F.current_timestamp()).withColumn("resolved_at", F.lit(None).cast("timestamp"))
    stamped.write.mode("append").parquet(path)


def resolved(ids: DataFrame, path: str) -> None:
    """Marks rejections (id) of the log at ``path`` as resolved now: their last state is appended with the time; ids that the log
    does not have change nothing."""
    log = ids.sparkSession.read.parquet(path)
    rows = latest(log).join(ids.select("id").distinct(), "id", "left_semi").select(*log.columns)
    materialize(rows.withColumn("resolved_at", F.current_timestamp()), "resolved").write.mode("append").parquet(path)


def exclusions(nearest: DataFrame, log: DataFrame) -> DataFrame:
    """Chunk hashes that a query's nearest rejection excludes: (query_id, chunk_hash)."""
    best = nearest.where("rank = 1").select("query_id", "id")
    return best.join(latest(log).select("id", F.explode("chunk_hashes").alias("chunk_hash")), "id").select("query_id", "chunk_hash").distinct()


def novel_terms(candidates: DataFrame, queries: DataFrame, *, n: int = 6, least: int = 3) -> DataFrame:
    """Terms that expand a query: tokens of its candidates' texts (query_id, rank, text), no stop words, ``least`` letters or
    more, not in the query, weighted by length and number; of equal weights the first seen. (query_id, term, weight, rank)."""
    own = queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("term")).distinct()
    seen = candidates.select("query_id", F.col("rank").alias("place"), F.posexplode(T.search_terms(F.col("text"))).alias("pos", "term")).where(F.length("term") >= least)
    weight = seen.groupBy("query_id", "term").agg(F.sum(F.length("term")).alias("weight"), F.min(F.struct("place", "pos")).alias("first"))
    weight = weight.join(own, ["query_id", "term"], "left_anti")
    return ranked(weight, "query_id", [F.desc("weight"), F.col("first")], n).select("query_id", "term", "weight", "rank")


def reformulated(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """Queries with their terms appended in order; without terms they stay."""
    more = terms.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ").alias("more"))
    out = queries.join(more, "query_id", "left")
    return out.select("query_id", F.concat_ws(" ", "query", "more").alias("query"))


def decision(best_score: Column, hop: Column, *, max_hops: int = 2, threshold: float = 0.65) -> Column:
    """Whether another hop follows."""
    return F.when((hop < max_hops) & (F.coalesce(best_score, F.lit(0.0)) < threshold), "loop").otherwise("continue")


def sources_block(hits: DataFrame) -> DataFrame:
    """The line of sources of each ranking: tags of document and page, each once, in order; empty without any."""
    rows = hits.where("doc_id is not null and doc_id <> '' and page is not null").groupBy("query_id", "doc_id", "page").agg(F.min("rank").alias("rank"))
    tag = F.concat(F.lit("["), F.col("doc_id"), F.lit(" p."), F.col("page").cast("string"), F.lit("]"))
    tags = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", tag.alias("tag")))).alias("t"))
    return tags.select("query_id", F.concat(F.lit("**Sources:** "), F.array_join(F.transform("t", lambda x: x["tag"]), ", ")).alias("block"))


def citations(hits: DataFrame, *, most: int = 2000) -> DataFrame:
    """The numbered citations of each ranking for a prompt."""
    section = F.when(F.coalesce("section_title", F.lit("")) != "", F.concat(F.lit(" §"), F.col("section_title"))).otherwise("")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("doc_id"), F.lit(" p."), F.coalesce("page", F.lit(0)).cast("string"), section, F.lit("\n    "), T.snippet(F.col("text"), most))
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return rows.select("query_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("citations"))


def recurring_block(rows: DataFrame) -> DataFrame:
    """Recurring regulations of a query (query_id, reg, occ_count, siblings, rank) as lines."""
    sib = F.array_join(F.transform("siblings", lambda s: F.concat(F.lit("    [tsb/"), s, F.lit("]"))), "\n")
    line = F.concat(F.lit("- CAR "), F.col("reg"), F.lit(" — cited by "), F.col("occ_count").cast("string"), F.lit(" reports; e.g.:\n"), sib)
    out = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return out.select("query_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("block"))


def recent_queries(log: DataFrame, *, user: str = "user_id", query: str = "query", time: str = "ts", keep: int = 12) -> DataFrame:
    """History of a user: each query at its last use, the newest ``keep``."""
    last = log.groupBy(user, query).agg(F.max(time).alias(time))
    return last.withColumn("place", F.row_number().over(W.partitionBy(user).orderBy(F.desc(time), query))).where(F.col("place") <= keep).withColumn("place", F.col("place").cast("long"))


def steps(trace: DataFrame, *, thread: str, order: str) -> DataFrame:
    """Checkpoints of a thread oldest first, numbered from 0; ``order`` is a whole number. A long thread is numbered in
    buckets, not in one task."""
    return before_sum(trace.withColumn("__one", F.lit(1)), [thread], order, "__one", "step").drop("__one")


def context_block(context: DataFrame) -> DataFrame:
    """Graph facts of occurrences (see ``graph.hop_one``; ``id`` or ``occ_id``, columns that are missing count as empty) as lines of
    a prompt; an occurrence without facts is named only."""
    key = "occ_id" if "occ_id" in context.columns else "id"
    empty = F.lit("")

    def listed(name: str, label: str) -> Column:
        if name not in context.columns:
            return empty
        return F.when(F.size(name) > 0, F.concat(F.lit(f"\n  {label}: "), F.array_join(name, ", "))).otherwise("")

    def each(name: str, line) -> Column:
        return F.array_join(F.transform(name, line), "") if name in context.columns else empty

    place = lambda x: F.concat(F.lit("\n  ["), F.coalesce(x["source_doc_id"], F.col(key)), F.lit(" p."), F.coalesce(x["page"].cast("string"), F.lit("?")), F.lit("] "))
    flat = lambda x: F.trim(F.regexp_replace(F.coalesce(x["text"], empty), "\n", " "))
    facts = F.concat(
        each("findings", lambda x: F.concat(place(x), F.coalesce(x["category"], F.lit("finding")), F.lit(": "), flat(x), F.when(F.coalesce(x["cites_reg"], empty) != "", F.concat(F.lit(" [cites CAR "), x["cites_reg"], F.lit("]"))).otherwise(""))),
        each("recommendations", lambda x: F.concat(place(x), F.lit("recommendation"), F.when(F.coalesce(x["id"], empty) != "", F.concat(F.lit(" ("), x["id"], F.lit(")"))).otherwise(""), F.lit(": "), flat(x))),
        listed("direct_regs", "cited regulations"),
        listed("rec_regs", "recommendations implement"),
        listed("reg_guided_acs", "implementing regs guided by ACs"),
        listed("acs", "referenced ACs"),
    )
    url = F.coalesce("occ_url", empty) if "occ_url" in context.columns else empty
    bare = F.rtrim(F.concat(F.lit("- Occurrence "), F.col(key), F.lit("  "), url))
    return context.select(key, F.when(facts == "", bare).otherwise(F.concat(F.lit("Occurrence "), F.col(key), F.lit(":"), facts)).alias("block"))
