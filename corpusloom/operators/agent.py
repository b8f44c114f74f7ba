"""The question loop over many questions at once: retrieval in hops, graph context, prompts, rejections.

The number of hops is small and fixed by the caller; each hop is one run of DataFrame operators over all questions that go on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import feedback, graph, search
from corpusloom.session import materialize


def hops(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], *, max_hops: int = 2, threshold: float = 0.65, top_k: int = 10, replace: bool = True) -> tuple[DataFrame, DataFrame]:
    """Candidates of each query (query_id, query) after as many hops as it takes, and its state (query_id, hop, query,
    reformulated, best).

    ``retrieve`` gives ranked candidates (query_id, point_id, text, score, rerank_score, rank, ...) of queries. A query goes on
    while its best rerank_score is below ``threshold`` and hops are left; from the second hop on it is asked with the terms that
    its candidates add. ``replace`` takes the candidates of the last hop (whole documents), else the hops are merged and cut at
    ``top_k``. A single hop is ``max_hops=1``.
    """
    if max_hops < 1:
        raise ValueError("max_hops must be 1 at least")
    active = queries.select("query_id", "query", F.col("query").alias("asked"))
    done = state = kept = None
    for hop in range(1, max_hops + 1):
        if hop > 1:
            before = queries.select("query_id", "query").join(active.select("query_id"), "query_id", "left_semi")
            again = feedback.reformulated(before, feedback.novel_terms(kept, before)).withColumnRenamed("query", "asked")
            active = before.join(again, "query_id")
        found = retrieve(active.select("query_id", F.col("asked").alias("query")))
        if hop > 1 and not replace:
            found = search.merge_candidates(kept, found, top_k=top_k)
        found = materialize(found, f"hop-{hop}")
        best = found.groupBy("query_id").agg(F.max(F.coalesce("rerank_score", F.lit(0.0))).alias("best"))
        now = active.join(best, "query_id", "left").withColumn("best", F.greatest(F.coalesce("best", F.lit(0.0)), F.lit(0.0)))
        now = materialize(now.withColumn("next", feedback.decision(F.col("best"), F.lit(hop), max_hops=max_hops, threshold=threshold)), f"state-{hop}")
        over = now.where("next = 'continue'")
        row = over.select("query_id", F.lit(hop).alias("hop"), "query", F.when(F.col("asked") != F.col("query"), F.col("asked")).alias("reformulated"), "best")
        part = found.join(over.select("query_id"), "query_id", "left_semi")
        done = part if done is None else done.unionByName(part, allowMissingColumns=True)
        state = row if state is None else state.unionByName(row)
        active = now.where("next = 'loop'").select("query_id", "query", "asked")
        kept = found.join(active.select("query_id"), "query_id", "left_semi")
        if hop == max_hops or not active.limit(1).count():
            break
    return done, state


def occurrence_ids(candidates: DataFrame) -> DataFrame:
    """(query_id, id) of the occurrences that candidates come from, each once."""
    return candidates.where("startswith(doc_id, 'tsb/')").select("query_id", F.expr("substring(doc_id, instr(doc_id, '/') + 1)").alias("id")).distinct()


def broadened(candidates: DataFrame, cites: DataFrame, *, most_docs: int = 3, **options) -> DataFrame:
    """Recurring regulations (see ``graph.recurring``) of those queries whose candidates come from few documents: at most
    ``most_docs``, an occurrence among them. Others have no rows, as breadth needs no help there."""
    narrow = candidates.groupBy("query_id").agg(F.count_distinct(F.coalesce("doc_id", F.lit(""))).alias("docs")).where(F.col("docs") <= most_docs)
    return graph.recurring(occurrence_ids(candidates).join(narrow.select("query_id"), "query_id", "left_semi"), cites, **options)


def rejections(state: DataFrame, candidates: DataFrame, answers: DataFrame, *, top_reject: int = 3, order_by: str = "score") -> DataFrame:
    """Rows for the log of rejected answers (without id and time): query_id, query, query_emb, answer, chunk_hashes of the first
    ``top_reject`` candidates, terms that the reformulated query adds (null without any). ``answers`` has (query_id, query_emb,
    answer). Candidates count by rerank_score (``score``) or in the order that they are shown in (``reading``)."""
    if order_by not in ("score", "reading"):
        raise ValueError(f"unknown order: {order_by}")
    order = [F.desc_nulls_last("rerank_score"), F.col("rank")] if order_by == "score" else [F.col("reading_no" if "reading_no" in candidates.columns else "rank")]
    first = candidates.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("n") <= top_reject)
    hashes = first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "chunk_hash"))), lambda x: x["chunk_hash"]).alias("chunk_hashes"))
    words = lambda c: F.filter(F.split(F.lower(F.trim(c)), r"(?U)\s+"), lambda x: x != "")
    own = words(F.col("query"))
    terms = F.filter(words(F.col("reformulated")), lambda x: ~F.array_contains(own, x))
    out = state.join(answers, "query_id").join(hashes, "query_id", "left")
    return out.select("query_id", "query", "query_emb", "answer", F.coalesce("chunk_hashes", F.array().cast("array<string>")).alias("chunk_hashes"), F.when(F.size(terms) > 0, terms).alias("terms"))


def system_prompt(base: str, queries: DataFrame) -> DataFrame:
    """The system prompt of each query (query_id, rejected_prior): the base, with a note about an answer rejected before."""
    # The note's words.
    note = "NOTE: A previous answer to a similar question was explicitly rejected by the user. Avoid the same framing and cite different evidence than: "
    prior = F.coalesce("rejected_prior", F.lit(""))
    return queries.select("query_id", F.when(prior == "", F.lit(base)).otherwise(F.concat(F.lit(f"{base}\n\n{note}"), F.substring(prior, 1, 400))).alias("system"))


def finished(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Answers (query_id, draft) with their block of sources (query_id, block), as the final text."""
    out = answers.join(sources, "query_id", "left")
    draft = F.coalesce("draft", F.lit(""))
    return out.select("query_id", F.when(F.coalesce("block", F.lit("")) == "", draft).otherwise(F.concat(F.regexp_replace(draft, r"(?U)\s+$", ""), F.lit("\n\n---\n"), "block")).alias("final"))


def messages(turns: DataFrame, *, chat: str = "chat_id", order: str = "turn") -> DataFrame:
    """The messages that a model is given of each chat: (chat_id, messages) with role and content in order; turns without
    content and those that carry metadata (shown only) are left out."""
    rows = turns.where("content <> '' and metadata is null")
    listed = F.array_sort(F.collect_list(F.struct(order, "role", "content")))
    return rows.groupBy(chat).agg(F.transform(listed, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def turn_links(turns: DataFrame, sources: DataFrame, *, keep: int = 8) -> DataFrame:
    """Links of the latest ``keep`` turns of each chat: (chat_id, turn, doc_id, source_url). Of a turn's sources (chat_id, turn,
    rank, doc_id, source_url) those that its answer cites, all where it cites none of them; a document's first url counts."""
    one = sources.where("doc_id <> '' and source_url <> ''").groupBy("chat_id", "turn", "doc_id").agg(F.min_by("source_url", "rank").alias("source_url"))
    cited = turns.select("chat_id", "turn", F.transform(T.cited_pages(F.coalesce("answer", F.lit(""))), lambda x: F.substring_index(x, " p.", 1)).alias("docs"))
    rows = one.join(cited, ["chat_id", "turn"]).withColumn("own", F.array_contains("docs", F.col("doc_id")))
    rows = rows.withColumn("any", F.bool_or("own").over(W.partitionBy("chat_id", "turn"))).where("own or not any")
    rows = rows.withColumn("n", F.dense_rank().over(W.partitionBy("chat_id").orderBy(F.desc("turn"))))
    return rows.where(F.col("n") <= keep).select("chat_id", "turn", "doc_id", "source_url")


def bullets(trace: DataFrame, *, thread: str = "thread", order: str = "step") -> DataFrame:
    """The steps of a trace (node, n_new, n_merged, best_rerank, n_rows) as lines: (thread, block, steps)."""
    n = F.coalesce(F.nullif(F.col("n_new"), F.lit(0)).cast("string"), F.nullif(F.col("n_merged"), F.lit(0)).cast("string"), F.lit("?"))
    best = F.when(F.col("best_rerank").isNotNull(), F.concat(F.lit(" · best score "), F.format_string("%.2f", "best_rerank"))).otherwise("")
    line = (
        F.when(F.col("node") == "retrieve", F.concat(F.lit("Retrieved "), n, F.lit(" chunks"), best))
        .when(F.col("node") == "graph_expand", F.concat(F.lit("Graph context · "), F.coalesce(F.col("n_rows").cast("string"), F.lit("?")), F.lit(" edges")))
        .when(F.col("node") == "synthesize", F.lit("Synthesised the answer"))
    )
    lines = F.transform(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct(F.col(order).alias("o"), line.alias("l"))))), lambda x: x["l"])
    out = trace.groupBy(thread).agg(lines.alias("lines"))
    out = out.withColumn("lines", F.when(F.size("lines") == 0, F.array(F.lit("Loaded cached answer"))).otherwise(F.col("lines")))
    return out.select(thread, F.array_join(F.transform("lines", lambda x: F.concat(F.lit("- "), x)), "\n").alias("block"), F.size("lines").alias("steps"))
