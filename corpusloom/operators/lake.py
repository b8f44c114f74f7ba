"""The keyed lake of chunk records: tolerant reading, deduplication, ids, upserts and admission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# Scan order of languages and sources.
LANGUAGES, SOURCES = ["en", "fr", "zh"], ["tsb", "tc", "ttsb", "caac"]


def _rank(column: str, values: list[str]):
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, values)), F.coalesce(F.col(column), F.lit(""))), F.lit(0)), F.lit(len(values) + 1))


def records(chunks: DataFrame) -> DataFrame:
    """Chunk records with what an older writer left out: page 0, a bbox of zeros, an empty title, kind text, the corpus
    from the document's name, and page_bboxes from page and bbox where any coordinate is not 0, else empty."""
    zeros = F.array(*[F.lit(0.0)] * 4)
    box, page = F.coalesce("bbox", zeros), F.coalesce("page", F.lit(0))
    made = F.when(F.exists(box, lambda x: x != 0), F.array(F.concat(F.array(page.cast("double")), box))).otherwise(F.array().cast("array<array<double>>"))
    return chunks.withColumns(
        {
            "page_bboxes": F.when(F.size("page_bboxes") > 0, F.col("page_bboxes")).otherwise(made),
            "corpus": F.coalesce(F.nullif(F.col("corpus"), F.lit("")), F.substring_index("doc_id", "/", 1)),
            "kind": F.coalesce(F.nullif(F.col("kind"), F.lit("")), F.lit("text")),
            "section_title": F.coalesce("section_title", F.lit("")),
            "page": page,
            "bbox": box,
        }
    )


def scan_order(chunks: DataFrame) -> list:
    """Order in which the corpus is read: language, source, document, chunk."""
    return [_rank("lang", LANGUAGES), _rank("corpus", SOURCES), F.col("doc_id"), F.col("chunk_id")]


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key. A grouped minimum with partial aggregation, so a hot key costs no sort in one task;
    rows with equal order give one of them."""
    names = [f"__o{i}" for i in range(len(order))]
    df = df.select(*df.columns, *[o.alias(n) for o, n in zip(order, names)])
    row = F.struct(*names, F.struct(*[c for c in df.columns if c not in names]).alias("__row"))
    return df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row["__row"], F.struct(*names)).alias("__row")).select("__row.*")


def new_chunks(chunks: DataFrame, lake: DataFrame | None = None) -> DataFrame:
    """Each text once: of chunks with one chunk_hash the first in scan order, none that ``lake`` holds already."""
    out = first_of(chunks, ["chunk_hash"], scan_order(chunks))
    return out if lake is None else out.join(lake.select("chunk_hash").distinct(), "chunk_hash", "left_anti")


def upsert(points: DataFrame, batch: DataFrame, keys: list[str], version: str) -> DataFrame:
    """``points`` with the rows of ``batch``; of one key the row of the greatest ``version`` stays."""
    both = points.unionByName(batch)
    row = F.struct(*[F.col(c) for c in both.columns])
    return both.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(row, F.struct(F.col(version), F.xxhash64(*both.columns))).alias("r")).select("r.*")


def document_totals(chunks: DataFrame) -> DataFrame:
    """Per language and document: chunks, characters, whether all chunks are boilerplate, and the share of Chinese
    characters among those that are no white space (null without any)."""
    return chunks.groupBy("lang", "doc_id").agg(
        F.count("*").alias("n_chunks"),
        F.sum(F.length("text")).alias("total_chars"),
        F.every(T.is_boilerplate(F.col("text"))).alias("all_boilerplate"),
        (F.sum(T.cjk_characters(F.col("text"))) / F.nullif(F.sum(T.solid_characters(F.col("text"))), F.lit(0))).alias("cjk_share"),
    )


def admissions(documents: DataFrame, chunks: DataFrame, *, least_chars: int = 200, least_cjk: float = 0.1) -> DataFrame:
    """The first rule that a document (lang, doc_id) fails: empty, sub_threshold, cover_only, lang_misdetect, else null."""
    rows = documents.join(document_totals(chunks), (documents["doc_id"].eqNullSafe(chunks["doc_id"])) & documents["lang"].eqNullSafe(chunks["lang"]), "left")
    reason = (
        F.when(F.coalesce("n_chunks", F.lit(0)) == 0, "empty")
        .when(F.coalesce("total_chars", F.lit(0)) < least_chars, "sub_threshold")
        .when(F.col("all_boilerplate"), "cover_only")
        .when((documents["lang"] == "zh") & (F.col("cjk_share") < least_cjk), "lang_misdetect")
    )
    return rows.select(documents["lang"], documents["doc_id"], F.coalesce("total_chars", F.lit(0)).alias("total_chars"), reason.alias("reason"))


def manifest(admitted: DataFrame) -> DataFrame:
    """Tallies in one pass: total, by reason, by corpus and by language (``slice`` names the tally)."""
    rows = admitted.withColumn("corpus", F.substring_index("doc_id", "/", 1)).withColumn("reason", F.coalesce("reason", F.lit("admitted")))
    rows = rows.withColumn("lang", F.coalesce("lang", F.lit("")))
    rows = rows.withColumn("ok", F.col("reason") == "admitted")
    sets = rows.groupingSets([[], ["reason"], ["corpus"], ["lang"]], "reason", "corpus", "lang")
    out = sets.agg(F.count_if("ok").alias("admitted"), F.count_if(~F.col("ok")).alias("rejected"), F.grouping("reason").alias("gr"), F.grouping("corpus").alias("gc"), F.grouping("lang").alias("gl"))
    name = F.when(F.col("gr") == 0, "reason").when(F.col("gc") == 0, "corpus").when(F.col("gl") == 0, "lang").otherwise("all")
    return out.select(name.alias("slice"), F.coalesce("reason", "corpus", "lang", F.lit("")).alias("value"), "admitted", "rejected")


def balance(admitted: DataFrame, *, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Ratio of admitted Chinese to English and French documents, null where either side has none, and whether it lies
    outside the band."""
    ok = F.col("reason").isNull()
    zh, other = F.count_if(ok & (F.col("lang") == "zh")), F.count_if(ok & F.col("lang").isin("en", "fr"))
    out = admitted.agg(zh.alias("zh"), other.alias("other"))
    ratio = F.when((F.col("zh") > 0) & (F.col("other") > 0), F.col("zh") / F.col("other"))
    return out.select("zh", "other", F.round(ratio, 6).alias("ratio"), F.coalesce((ratio < low) | (ratio > high), F.lit(False)).alias("out_of_band"))


def figures_as_chunks(figures: DataFrame) -> DataFrame:
    """Chunk records of figures: text, title, boxes, figure id and hash. Repeated figures stay."""
    text = F.concat(F.format_string("[Figure p.%d] ", "page"), F.coalesce("caption", F.lit("")), F.when(F.coalesce("ocr_text", F.lit("")) != "", F.concat(F.lit("\n\n"), F.col("ocr_text"))).otherwise(F.lit("")))
    return figures.select("doc_id", F.lit("[figure]").alias("section_title"), "page", "bbox", F.array(F.concat(F.array(F.col("page").cast("double")), F.col("bbox"))).alias("page_bboxes"), F.lit("figure").alias("kind"), T.figure_id(F.col("doc_id"), F.col("page"), F.col("bbox")).alias("figure_id"), text.alias("text"))


def chunks_as_figures(chunks: DataFrame) -> DataFrame:
    """Caption and read text back from the chunks of figures; others are left out."""
    tag = r"(?s)^\[Figure p\.(\d+)\] (.*)$"
    rows = chunks.where(F.col("text").rlike(tag))
    rest = F.regexp_extract("text", tag, 2)
    return rows.select("doc_id", F.regexp_extract("text", tag, 1).cast("int").alias("page"), F.split_part(rest, F.lit("\n\n"), F.lit(1)).alias("caption"), F.regexp_extract(rest, r"(?s)^.*?\n\n(.*)$", 1).alias("ocr_text"))


def processed(documents: DataFrame, chunks: DataFrame, *, done: DataFrame | None = None, lake: DataFrame | None = None, curate: bool = True) -> tuple[DataFrame, DataFrame]:
    """New chunks for the lake and the admissions of all documents (lang, doc_id): documents that are ``done`` (fresh outputs)
    count as admitted and give no chunks; of the others the admitted ones' chunks stay, each text once, none that ``lake``
    has. Texts of rejected documents claim no hash."""
    todo = documents if done is None else documents.join(done.select("lang", "doc_id").distinct(), ["lang", "doc_id"], "left_anti")
    verdict = admissions(todo, chunks)
    if not curate:
        verdict = verdict.withColumn("reason", F.lit(None).cast("string"))
    good = verdict.where("reason is null").select(F.col("lang").alias("__lang"), F.col("doc_id").alias("__doc")).distinct()
    kept = chunks.join(good, chunks["doc_id"].eqNullSafe(F.col("__doc")) & chunks["lang"].eqNullSafe(F.col("__lang")), "left_semi")
    if done is not None:
        fresh = documents.join(done.select("lang", "doc_id").distinct(), ["lang", "doc_id"], "left_semi")
        verdict = verdict.unionByName(fresh.select("lang", "doc_id", F.lit(None).cast("long").alias("total_chars"), F.lit(None).cast("string").alias("reason")))
    return new_chunks(kept, lake), verdict


def embedded(chunks: DataFrame, embedder, *, key: str = "chunk_hash", text: str = "text") -> DataFrame:
    """Points of chunks: point_id, ``vector`` and the chunk's columns. ``embedder`` is a function of an iterator of Arrow batches
    (key, text) that gives (key, vector array<double>); a text comes to it once, in batches of Spark's size, and a chunk that
    it gives no vector for is left out."""
    once = chunks.where(F.col(text).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(text).alias("text"))
    made = once.mapInArrow(embedder, "key string, vector array<double>").where("vector is not null")
    return chunks.join(made.withColumnRenamed("key", "__key"), F.col(key) == F.col("__key")).drop("__key").withColumn("point_id", T.point_id(F.col(key)))
