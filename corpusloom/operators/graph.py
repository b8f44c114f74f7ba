"""Entities, a property graph of node and edge tables, and fixed-hop traversals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import lake
from corpusloom.session import materialize

# Citation patterns and section headings with their category.
REGULATION = r"(?iU)\bCARs?\s*(\d{3}(?:\.\d+)+)"
REGULATION_SECTION = r"(?iU)\bsection\s+(\d{3}\.\d+)(?:\s+of\s+the\s+CARs?)?"
CIRCULAR = r"(?iU)\bAC\s*(\d{3}-\d{3})\b"
RECOMMENDATION = r"(?U)\b(A\d{2}-\d{2})\b"
SECTIONS = [
    (r"(?iu)findings as to causes?(?:\s+and contributing factors)?", "cause"),
    (r"(?iu)findings as to risk", "risk"),
    (r"(?iu)safety action\b", "safety_action"),
    (r"(?iu)faits\s+établis\s+quant\s+aux\s+causes?", "cause"),
    (r"(?iu)faits\s+établis\s+quant\s+aux\s+risques?", "risk"),
    (r"(?iu)mesures\s+de\s+sécurité\b", "safety_action"),
]
LIST_ITEM = r"(?s)(?:^|\n)\s*(?:\d+\.|•|-|\*)\s+(.+?)(?=\n\s*(?:\d+\.|•|-|\*|\z)|\z)"
# Aircraft patterns, the form of their ids ({1} is the group, in capitals; "{1:title}" in title case) and forms that
# single values of the group have instead.
AIRCRAFT = [
    (r"(?iU)\bDHC[-\s]?8[-\s][-\s]?(\d{3})[A-Z]?\b", "DHC-8-{1}", {}),
    (r"(?iU)\bQ\s*(400|300|200|100)\b", "DHC-8-{1}", {"400": "DHC-8-402", "300": "DHC-8-311", "200": "DHC-8-202", "100": "DHC-8-102"}),
    (r"(?iU)\b(Dash[-\s]?8|DHC[-\s]?8)\b", "DHC-8", {}),
    (r"(?iU)\bCRJ[-\s]?(1000|900|705|700|200|100)\b", "CRJ-{1}", {}),
    (r"(?iU)\bCanadair\s+Regional\s+Jet\s*(\d{3})?\b", "CRJ-{1}", {"": "CRJ"}),
    (r"(?iU)\b(CRJ)\b", "CRJ", {}),
    (r"(?iU)\bLearjet\s*(\d{2}[A-Z]?)\b", "Learjet-{1}", {}),
    (r"(?iU)\bChallenger\s*(\d{3})\b", "Challenger-{1}", {}),
    (r"(?iU)\bCL[-\s]?(6\d{2})\b", "CL-{1}", {}),
    (r"(?iU)\bGlobal\s*(Express|XRS|8000|7500|6500|6000|5500|5000)\b", "Global-{1:title}", {}),
    (r"(?iU)\b(BD[-\s]?700)\b", "BD-700", {}),
    (r"(?iU)\b(Twin\s+Otter|DHC[-\s]?6)\b", "DHC-6", {}),
    (r"(?iU)\b(DHC[-\s]?2|Beaver)\b", "DHC-2", {}),
    (r"(?iU)\b(DHC[-\s]?3|Single\s+Otter)\b", "DHC-3", {}),
    (r"(?iU)\bDHC[-\s]?([2-9])\b", "DHC-{1}", {}),
    (r"(?iU)\bATR[-\s]?(72|42)(?:[-\s]\d{3})?\b", "ATR-{1}", {}),
    (r"(?iU)\bERJ[-\s]?(\d{3})\b", "ERJ-{1}", {}),
    (r"(?iU)\bE[-\s]?(170|175|190|195)(?:[-\s]E2)?\b", "E{1}", {}),
    (r"(?iU)\bKing\s+Air\s+([A-Z]?\d{2,3}[A-Z]*)\b", "King-Air-{1}", {}),
    (r"(?iU)\b(Beech(?:craft)?\s+1900[A-Z]?|1900[CD])\b", "Beechcraft-1900", {}),
    (r"(?iU)\bPA[-\s](\d{2}[A-Z]?)\b", "PA-{1}", {}),
    (r"(?iU)\bCessna\s+(\d{3}[A-Z]?)\b", "Cessna-{1}", {}),
    (r"(?iU)\bPC[-\s]?(12|24)\b", "PC-{1}", {}),
    (r"(?iU)\bGulfstream\s+G(\d{3,4})\b", "G{1}", {}),
    (r"(?iU)\bFalcon\s*(\d{3,4}[A-Z]?)\b", "Falcon-{1}", {}),
    (r"(?U)\bC-([A-Z]{4})\b", "C-{1}", {}),
]
# Beginnings of all patterns but the last, the registration.
AIRCRAFT_BEGINNING = r"(?iU)\b(?:DHC|Q\s*[1-4]00|Dash|CRJ|Canadair|Learjet|Challenger|CL[-\s]?6|Global|BD|Twin|Beaver|Single|ATR|ERJ|E[-\s]?1[79]|King\s|Beech|1900|PA[-\s]|Cessna|PC[-\s]?[12]|Gulfstream|Falcon)"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def regulations(text: Column) -> Column:
    """Regulation numbers cited in a text, each once."""
    return F.array_distinct(F.concat(_all(text, REGULATION), _all(text, REGULATION_SECTION)))


def circulars(text: Column) -> Column:
    return F.array_distinct(_all(text, CIRCULAR))


def recommendation_ids(text: Column) -> Column:
    return F.array_distinct(_all(text, RECOMMENDATION))


def aircraft(text: Column) -> Column:
    """Aircraft ids, each once, in the order of the patterns, those of one pattern in the order of the text."""

    def ids(pattern: str, form: str, special: dict[str, str]) -> Column:
        def one(x: Column) -> Column:
            fixed, group, _ = form.partition("{1")
            out = F.lit(form) if not group else F.concat(F.lit(fixed), F.initcap(F.lower(x)) if form.endswith(":title}") else F.upper(x))
            for value, to in special.items():
                out = F.when(x == value, F.lit(to)).otherwise(out)
            return out

        return F.transform(_all(text, pattern), one)

    types = F.concat(*[ids(*row) for row in AIRCRAFT[:-1]])
    # one pass over word beginnings spares most texts the passes of all patterns
    types = F.when(text.rlike(AIRCRAFT_BEGINNING), types).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(types, ids(*AIRCRAFT[-1])))


def findings(text: Column) -> Column:
    """List items after a section's heading, longer than 20 characters: array of (category, text). A text under several
    headings stands under each."""


    def under(pattern: str, category: str) -> Column:
        at = F.regexp_instr(text, F.lit(pattern))
        section = F.when(at > 0, F.substring(text, at, F.length(text)))
        items = F.filter(F.transform(_all(F.coalesce(section, F.lit("")), LIST_ITEM), lambda x: F.trim(x)), lambda x: F.length(x) > 20)
        return F.transform(items, lambda x: F.struct(F.lit(category).alias("category"), x.alias("text")))

    return F.concat(*[under(pattern, category) for pattern, category in SECTIONS])


def has_sections(text: Column) -> Column:
    """Whether a text has a heading of findings."""
    out = F.lit(False)
    for pattern, _ in SECTIONS:
        out = out | text.rlike(pattern)
    return out


def entities(chunks: DataFrame) -> DataFrame:
    """Chunks with regulations, circulars, recommendation_ids, findings and aircraft; of corpora other than tsb and tc the
    lists are empty."""
    own = F.coalesce(F.col("corpus").isin("tsb", "tc"), F.lit(False))
    text = F.when(own, F.col("text")).otherwise(F.lit(""))
    return chunks.withColumns({"regulations": regulations(text), "circulars": circulars(text), "recommendation_ids": recommendation_ids(text), "findings": findings(text), "aircraft": aircraft(text)})


def occurrences(chunks: DataFrame) -> DataFrame:
    """One node for each document of tsb: id, source_url and lang of its first chunk in scan order."""
    rows = chunks.where("corpus = 'tsb'")
    first = lake.first_of(rows, ["doc_id"], lake.scan_order(rows))
    return first.select(F.expr("substring(doc_id, instr(doc_id, '/') + 1)").alias("id"), "doc_id", "source_url", "lang")


def circular_number(doc: Column) -> Column:
    """Number of a circular out of a document's name, null without one."""
    found = F.regexp_extract(doc, r"(?i)AC[_\s]?(\d{3}[-_]\d{3})", 1)
    return F.upper(F.translate(F.nullif(found, F.lit("")), "_", "-"))


def circular_nodes(chunks: DataFrame) -> DataFrame:
    """One node for each document of tc with a number: id, doc_id and the title of its first chunk."""
    rows = chunks.where("corpus = 'tc'")
    first = lake.first_of(rows, ["doc_id"], lake.scan_order(rows))
    return first.select(circular_number(F.col("doc_id")).alias("id"), "doc_id", F.col("section_title").alias("title")).where("id is not null")


def _facts(chunks: DataFrame) -> DataFrame:
    """Chunks with their entities, their occurrence (``occ``, tsb) or circular (``circular``, tc) and ``findings`` and
    ``recommendations`` as arrays of (id, text, ...)."""
    rows = entities(chunks).withColumn("occ", F.when(F.col("corpus") == "tsb", F.expr("substring(doc_id, instr(doc_id, '/') + 1)"))).withColumn("circular", F.when(F.col("corpus") == "tc", circular_number(F.col("doc_id"))))
    none = lambda t: F.array().cast(t)
    found = F.transform("findings", lambda f: F.struct(T.fact_id(F.col("occ"), "f", f["text"]).alias("id"), f["text"].alias("text"), f["category"].alias("category")))
    recommended = F.transform("recommendation_ids", lambda r: F.struct(T.fact_id(F.col("occ"), "r", F.lit(""), r).alias("id"), F.lit("").alias("text")))
    return rows.withColumn("findings", F.when(F.col("occ").isNotNull(), found).otherwise(none("array<struct<id:string,text:string,category:string>>"))).withColumn("recommendations", F.when(F.col("occ").isNotNull(), recommended).otherwise(none("array<struct<id:string,text:string>>")))


def _edges(facts: DataFrame) -> DataFrame:
    def edge(src: Column, rel: str, dst: Column) -> Column:
        return F.struct(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"))

    occ, circular = F.col("occ"), F.col("circular")
    every = lambda name, rel: F.flatten(F.transform(name, lambda x: F.transform("regulations", lambda g: edge(x["id"], rel, g))))
    found = F.concat(
        F.transform("regulations", lambda g: edge(occ, "CITES", g)),
        F.transform("circulars", lambda c: edge(occ, "REFERENCES_AC", c)),
        F.transform("aircraft", lambda a: edge(occ, "INVOLVES", a)),
        F.transform("regulations", lambda g: edge(g, "GUIDED_BY", circular)),
        F.transform("findings", lambda f: edge(occ, "HAS_FINDING", f["id"])),
        F.transform("recommendations", lambda r: edge(occ, "HAS_RECOMMENDATION", r["id"])),
        every("findings", "FINDING_CITES"),
        every("recommendations", "IMPLEMENTS"),
    )
    return facts.select(F.explode(found).alias("e")).select("e.*").where("src is not null and dst is not null").distinct()


def edges_of(chunks: DataFrame) -> DataFrame:
    """Edges (src, rel, dst), each once, out of chunk texts: CITES, REFERENCES_AC, INVOLVES, HAS_FINDING and
    HAS_RECOMMENDATION of occurrences, FINDING_CITES of findings and IMPLEMENTS of recommendations with the regulations of
    their chunk, GUIDED_BY of regulations and the circular whose text cites them."""
    return _edges(_facts(chunks))


def tables_of(chunks: DataFrame) -> dict[str, DataFrame]:
    """The graph as tables, from one extraction that is written once: ``edges`` and the nodes ``occurrences``, ``findings``,
    ``recommendations``, ``regulations``, ``circulars`` and ``aircraft``, ids unique. Of findings and recommendations with one
    id the properties written last in scan order stay."""
    wanted = ["chunk_id", "doc_id", "corpus", "lang", "page", "source_url", "section_title", "occ", "circular", "regulations", "circulars", "aircraft", "findings", "recommendations"]
    facts = materialize(_facts(chunks).where("corpus in ('tsb', 'tc')").select(*wanted), "facts")

    def written(name: str, *fields: str) -> DataFrame:
        rows = facts.select("chunk_id", "doc_id", "corpus", "lang", "page", F.posexplode(name).alias("nth", "x"))
        rows = rows.select(F.col("x.id").alias("id"), *[F.col(f"x.{f}").alias(f) for f in fields], "lang", F.col("doc_id").alias("source_doc_id"), "page", "doc_id", "corpus", "chunk_id", "nth")
        return last_of(rows, ["id"], [*lake.scan_order(rows), F.col("nth")]).drop("doc_id", "corpus", "chunk_id", "nth")

    cited = lambda name: facts.select(F.explode(name).alias("id")).distinct()
    titled = circular_nodes(facts)
    return {
        "edges": _edges(facts),
        "occurrences": occurrences(facts),
        "findings": written("findings", "text", "category"),
        "recommendations": written("recommendations", "text"),
        "regulations": cited("regulations"),
        "circulars": cited("circulars").join(titled.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.min_by("title", "doc_id").alias("title")), "id", "full_outer"),
        "aircraft": cited("aircraft").withColumn("type_family", type_family(F.col("id"))),
    }


def hop_one(ids: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Nested facts of occurrences: occ_id, occ_url, findings (one struct for each finding and regulation that it cites),
    recommendations, direct_regs, acs, rec_regs (implemented by recommendations) and reg_guided_acs (circulars that guide
    those). Unknown ids are dropped, repeated ones come once, missing facts are an empty list."""
    edges, asked = tables["edges"], ids.select("id").distinct()
    rel = lambda name, a, b: edges.where(F.col("rel") == name).select(F.col("src").alias(a), F.col("dst").alias(b))
    cites = rel("FINDING_CITES", "finding", "cites_reg")
    found = rel("HAS_FINDING", "id", "finding").join(asked, "id", "left_semi").join(cites, "finding", "left").join(tables["findings"].withColumnRenamed("id", "finding"), "finding")
    said = rel("HAS_RECOMMENDATION", "id", "rec").join(asked, "id", "left_semi")
    implemented = said.join(rel("IMPLEMENTS", "rec", "reg"), "rec")
    guided = implemented.join(rel("GUIDED_BY", "reg", "ac"), "reg")
    said = said.join(tables["recommendations"].withColumnRenamed("id", "rec"), "rec")
    branches = {
        "findings": found.select("id", F.struct("text", "category", "lang", "source_doc_id", "page", "cites_reg").alias("fact")),
        "recommendations": said.select("id", F.struct(F.col("rec").alias("id"), "text", "lang", "source_doc_id", "page").alias("fact")),
        "direct_regs": rel("CITES", "id", "fact"),
        "acs": rel("REFERENCES_AC", "id", "fact"),
        "rec_regs": implemented.select("id", F.col("reg").alias("fact")),
        "reg_guided_acs": guided.select("id", F.col("ac").alias("fact")),
    }
    out = context(asked, tables["occurrences"].select("id", F.col("source_url").alias("occ_url")), branches)
    return out.withColumnRenamed("id", "occ_id")


def looked_up(doc: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The facts of one document, by its name with or without the corpus; no such occurrence is an error."""
    spark = tables["edges"].sparkSession
    out = hop_one(spark.createDataFrame([(doc.split("/", 1)[-1],)], "id string"), tables)
    if not out.limit(1).count():
        raise LookupError(f"no graph data for {doc}")
    return out


def missing_nodes(edges: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Edges (src, rel, dst) an end of which is no node: what a check of the stored graph reports."""
    known = None
    for name, nodes in tables.items():
        if name != "edges":
            known = nodes.select("id") if known is None else known.unionByName(nodes.select("id"))
    known = known.distinct()
    return edges.join(known.withColumnRenamed("id", "src"), "src", "left_anti").unionByName(edges.join(known.withColumnRenamed("id", "dst"), "dst", "left_anti")).distinct()


def existing_edges(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct edges (src, dst) whose ends are both known (column ``id``)."""
    return edges.distinct().join(sources.select(F.col("id").alias("src")).distinct(), "src", "left_semi").join(targets.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")


def last_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key: properties of repeated facts are those written last."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(row, F.struct(*order)).alias("r")).select("r.*")


def adjacency(cites: DataFrame) -> DataFrame:
    """Citation rows (occ_id, reg, occ_url) folded by occurrence: regs in order, each once, and the first url by name.
    Ids differ by case in dirty rows and are taken in lower case; rows without a regulation count for the url."""
    rows = cites.where("occ_id is not null").select(F.lower("occ_id").alias("occ_id"), "reg", "occ_url")
    return rows.groupBy("occ_id").agg(F.array_sort(F.collect_set("reg")).alias("regs"), F.min("occ_url").alias("occ_url"))


def citing(cites: DataFrame, *, part: int = 10_000) -> DataFrame:
    """The same folded by regulation: (reg, part, occs): the occurrences in order, each once. A regulation that very many
    cite has several parts of about ``part`` of them, split by hash."""
    rows = cites.where("occ_id is not null and reg is not null").select("reg", F.lower("occ_id").alias("occ_id")).distinct()
    sizes = rows.groupBy("reg").agg(F.ceil(F.count("*") / part).alias("parts"))
    rows = rows.join(sizes, "reg").withColumn("part", F.pmod(F.xxhash64("occ_id"), F.col("parts")))
    return rows.groupBy("reg", "part").agg(F.array_sort(F.collect_list("occ_id")).alias("occs"))


def context(ids: DataFrame, occ: DataFrame, branches: dict[str, DataFrame]) -> DataFrame:
    """Nested facts of occurrences (hop 1): ``ids`` (id) that exist, each once, with one column for each branch, a list of
    the distinct ``fact`` values of its rows (id, fact). Branches are aggregated before they are joined, so they don't
    multiply; unknown ids are dropped, missing facts are an empty list."""
    out = occ.join(ids.select("id").distinct(), "id", "left_semi")
    for name, rows in branches.items():
        facts = rows.where("fact is not null").join(ids.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("fact")).alias(name))
        kind = facts.schema[name].dataType
        out = out.join(facts, "id", "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def recurring(seeds: DataFrame, cites: DataFrame, *, max_regs: int = 5, max_siblings: int = 3, max_degree: int = 15, count_all_seeds: bool = False) -> DataFrame:
    """Regulations that seeds (query_id, id) share with other occurrences: (query_id, reg, occ_count, siblings).

    A regulation counts if more occurrences cite it than there are seeds with a citation (``count_all_seeds``: seeds at
    all), and no more than ``max_degree``: hubs fall out before the join with their occurrences. The most cited first,
    then by name.
    """
    edges = cites.where("src is not null and dst is not null").select("src", "dst").distinct()
    degree = edges.groupBy("dst").agg(F.count("*").alias("occ_count")).where(F.col("occ_count") <= max_degree)
    seeds = seeds.select("query_id", "id").distinct()
    own = edges.join(seeds, F.col("src") == F.col("id")).select("query_id", "id", F.col("dst").alias("reg"))
    counted = (seeds if count_all_seeds else own.select("query_id", "id").distinct()).groupBy("query_id").agg(F.count("*").alias("n_seeds"))
    regs = own.select("query_id", "reg").distinct().join(degree, F.col("reg") == F.col("dst")).drop("dst").join(counted, "query_id").where("occ_count > n_seeds")
    others = regs.join(edges, F.col("reg") == F.col("dst")).select("query_id", "reg", "occ_count", F.col("src").alias("id")).join(seeds, ["query_id", "id"], "left_anti")
    out = others.groupBy("query_id", "reg", "occ_count").agg(F.slice(F.array_sort(F.collect_list("id")), 1, max_siblings).alias("siblings"))
    from corpusloom.operators.search import ranked

    return ranked(out, "query_id", [F.desc("occ_count"), F.col("reg")], max_regs)


def type_family(aircraft_id: Column) -> Column:
    return F.substring_index(aircraft_id, "-", 1)


def entity_counts(chunks: DataFrame) -> DataFrame:
    """Tallies of an extraction in one pass: distinct regulations, circulars and aircraft; rows of findings, recommendations and
    of links between recommendations or circulars and regulations."""
    facts = _facts(chunks)
    kind = lambda name, values: F.transform(values, lambda x: F.struct(F.lit(name).alias("kind"), x.alias("value")))
    own = F.coalesce("circular", F.col("occ")).isNotNull()
    number = lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: i.cast("string"))).otherwise(F.array().cast("array<string>"))
    rows = F.concat(
        F.array(F.struct(F.lit("chunks").alias("kind"), F.lit("").alias("value"))),
        kind("regulations", F.col("regulations")),
        kind("circulars", F.col("circulars")),
        kind("aircraft", F.col("aircraft")),
        kind("findings", F.transform("findings", lambda f: f["id"])),
        kind("recommendations", F.transform("recommendations", lambda r: r["id"])),
        kind("rec_reg_links", number(F.size("recommendations") * F.size("regulations"))),
        kind("reg_ac_links", F.when(own & F.col("circular").isNotNull(), F.col("regulations")).otherwise(F.array().cast("array<string>"))),
    )
    # values of one kind first, so that no task counts all of them
    counts = facts.select(F.explode(rows).alias("r")).groupBy("r.kind", "r.value").agg(F.count("*").alias("n")).groupBy("kind").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_values"))
    pick = lambda name, column: F.coalesce(F.max(F.when(F.col("kind") == name, F.col(column))), F.lit(0)).alias(name)
    return counts.agg(*[pick(n, "n_rows") for n in ("chunks", "findings", "recommendations", "rec_reg_links", "reg_ac_links")], *[pick(n, "n_values") for n in ("regulations", "circulars", "aircraft")])


def merged_findings(by_rule: Column, by_model: Column) -> Column:
    """Findings of a model where it gave any, else those found by rule."""
    return F.when(F.coalesce(F.size(by_model), F.lit(0)) > 0, by_model).otherwise(by_rule)


def merged_recommendations(ids_by_rule: Column, by_model: Column) -> Column:
    """Recommendations as array of (id, text): those of the model, and by rule the ids that it lacks, without text."""
    own = F.coalesce(by_model, F.array().cast("array<struct<id: string, text: string>>"))
    missing = F.array_except(ids_by_rule, F.transform(own, lambda r: r["id"]))
    return F.concat(F.transform(missing, lambda i: F.struct(i.alias("id"), F.lit("").alias("text"))), own)


def extracted(chunks: DataFrame, model) -> DataFrame:
    """Chunks with entities where ``model`` (a function of an iterator of Arrow batches (chunk_id, text), which gives chunk_id,
    findings array<struct<category, text>> and recommendations array<struct<id, text>>) reads the chunks with sections, at most
    3,000 characters of each; what it gives goes before what the rules found. Other chunks never reach it."""
    rows = entities(chunks)
    kinds = "findings array<struct<category:string,text:string>>, recommendations array<struct<id:string,text:string>>"
    asked = chunks.where(F.coalesce(F.col("corpus").isin("tsb", "tc"), F.lit(False)) & has_sections(F.col("text"))).select("chunk_id", F.substring("text", 1, 3000).alias("text"))
    said = asked.mapInArrow(model, f"chunk_id long, {kinds}").select(F.col("chunk_id").alias("__id"), F.col("findings").alias("__findings"), F.col("recommendations").alias("__recommendations"))
    out = rows.join(said, F.col("chunk_id") == F.col("__id"), "left")
    out = out.withColumn("findings", merged_findings(F.col("findings"), F.col("__findings"))).withColumn("recommendations", merged_recommendations(F.col("recommendation_ids"), F.col("__recommendations")))
    return out.drop("__id", "__findings", "__recommendations")
