import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking, evaluation, feedback, graph, lake, links, search

CHUNK = "chunk_id long, doc_id string, source_url string, section_title string, page int, bbox array<double>, page_bboxes array<array<double>>, corpus string, kind string, chunk_hash string, lang string, text string, extra string"


def chunk(i, doc="tsb/a", text="t", lang="en", h=None, **more):
    row = dict(chunk_id=i, doc_id=doc, source_url=None, section_title=None, page=1, bbox=None, page_bboxes=None, corpus=None, kind=None, chunk_hash=h or f"{i:064d}", lang=lang, text=text, extra="x")
    return tuple({**row, **more}.values())


def test_records_fill_what_is_missing(spark):
    df = spark.createDataFrame([chunk(1, page=None), chunk(2, bbox=[1.0, 2.0, 3.0, 4.0], page=7, corpus="", kind=""), chunk(3, page_bboxes=[[9.0, 0.0, 0.0, 1.0, 1.0]])], CHUNK)
    r = {x["chunk_id"]: x for x in lake.records(df).collect()}
    assert (r[1]["page"], r[1]["bbox"], r[1]["page_bboxes"], r[1]["section_title"], r[1]["kind"], r[1]["corpus"]) == (0, [0.0] * 4, [], "", "text", "tsb")
    assert r[2]["page_bboxes"] == [[7.0, 1, 2, 3, 4]] and r[2]["corpus"] == "tsb"
    assert r[3]["page_bboxes"] == [[9.0, 0, 0, 1, 1]]
    assert lake.records(df.limit(0)).count() == 0


def test_first_in_scan_order_wins(spark):
    df = lake.records(spark.createDataFrame([chunk(1, "tc/x", lang="fr", h="h"), chunk(2, "tsb/y", lang="fr", h="h"), chunk(3, "ttsb/z", lang="zh", h="h"), chunk(4, "tc/w", h="g")], CHUNK))
    assert {(r["chunk_hash"], r["chunk_id"]) for r in lake.new_chunks(df).collect()} == {("h", 2), ("g", 4)}
    assert [r["chunk_hash"] for r in lake.new_chunks(df, df.where("chunk_hash = 'h'")).collect()] == ["g"]


def test_upsert_keeps_the_latest(spark):
    a = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, x string")
    b = spark.createDataFrame([(1, 2, "c"), (3, 1, "d")], "k int, v int, x string")
    assert {tuple(r) for r in lake.upsert(a, b, ["k"], "v").collect()} == {(1, 2, "c"), (2, 1, "b"), (3, 1, "d")}


def test_admission_order_of_rules(spark):
    docs = spark.createDataFrame([("en", "tsb/none"), ("en", "tsb/short"), ("en", "tsb/cover"), ("zh", "ttsb/latin"), ("en", "tsb/ok"), ("zh", "ttsb/ok")], "lang string, doc_id string")
    rows = [chunk(1, "tsb/short", "x" * 199), *[chunk(10 + i, "tsb/cover", "y" * 79) for i in range(3)], chunk(20, "ttsb/latin", "z" * 300, "zh"), chunk(21, "tsb/ok", "z" * 200), chunk(22, "ttsb/ok", "安" * 100 + "z" * 200, "zh")]
    got = {r["doc_id"]: r["reason"] for r in lake.admissions(docs, spark.createDataFrame(rows, CHUNK)).collect()}
    assert got == {"tsb/none": "empty", "tsb/short": "sub_threshold", "tsb/cover": "cover_only", "ttsb/latin": "lang_misdetect", "tsb/ok": None, "ttsb/ok": None}
    tally = {(r["slice"], r["value"]): (r["admitted"], r["rejected"]) for r in lake.manifest(lake.admissions(docs, spark.createDataFrame(rows, CHUNK))).collect()}
    assert tally[("all", "")] == (2, 4) and tally[("lang", "zh")] == (1, 1) and tally[("reason", "empty")] == (0, 1)


def brute_windows(n, window, overlap):
    out, start, step = [], 0, max(1, window - overlap)
    while start < n:
        end = min(start + window, n)
        out.append((start, end))
        if end == n:
            break
        start += step
    return out


def test_text_windows(spark):
    texts = [(i, " ".join(f"w{j}" for j in range(n))) for i, n in enumerate([0, 1, 7, 8, 9, 12, 13, 40])] + [(100, None), (101, " \n ")]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    for window, overlap in ((8, 2), (8, 7), (5, 9)):
        got = {}
        for r in chunking.text_windows(df, window=window, overlap=overlap).collect():
            got.setdefault(r["doc_id"], []).append((r["start_tok"], r["end_tok"]))
            words = dict(texts)[r["doc_id"]].split()
            assert r["text"].split() == words[r["start_tok"] : r["end_tok"]]
        for i, t in texts:
            assert sorted(got.get(i, [])) == brute_windows(len((t or "").split()), window, overlap)


def test_page_windows_equal_the_joined_text(spark):
    rng = random.Random(3)
    pages, want = [], {}
    for d in range(6):
        texts = [" ".join(f"d{d}p{p}w{i}" for i in range(rng.choice([0, 1, 5, 30]))) for p in range(1, rng.choice([2, 9, 40]))]
        if d == 2:
            texts[len(texts) // 2] = "2.1 Scope\n" + texts[len(texts) // 2]
        pages += [(f"x/{d}", p + 1, t, "e") for p, t in enumerate(texts)]
        joined = "\n\n".join(texts)
        spans = [m.span() for m in __import__("re").finditer(r"\S+", joined)]
        want[f"x/{d}"] = [joined[spans[a][0] : spans[b - 1][1]] for a, b in brute_windows(len(spans), 16, 4)]
    df = spark.createDataFrame(pages, "doc_id string, page int, text string, extra string")
    got = {}
    for r in chunking.page_windows(df, keys=["doc_id"], window=16, overlap=4).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append(r)
    for d, texts in want.items():
        assert [" ".join(r["text"].split()) for r in got.get(d, [])] == [" ".join(t.split()) for t in texts]
    titles = [r["section_title"] for r in got.get("x/2", [])]
    assert titles == sorted(titles) and set(titles) <= {"", "2.1 Scope"}


def test_glyph_boxes(spark):
    chars = [(c, float(i), float(i + 1), 0.0, 10.0, 12.0, 1) for i, c in enumerate("abd")]
    df = spark.createDataFrame([("d", 1, "ab cd", chars), ("d", 2, "x", None)], "doc_id string, page int, text string, chars array<struct<text string, x0 double, x1 double, top double, bottom double, size double, page int>>")
    glyphs = chunking.aligned_glyphs(df, ["doc_id"])
    assert sorted(r["place"] for r in glyphs.collect()) == [0, 1, 4]
    extents = chunking.page_extents(df, ["doc_id"])
    spans = spark.createDataFrame([("d", 1, 0, 0, 2), ("d", 2, 0, 0, 1)], "doc_id string, page int, span int, lo int, hi int")
    box = {(r["page"], r["span"]): (r["x0"], r["x1"]) for r in chunking.span_boxes(spans, glyphs, extents, ["doc_id"]).collect()}
    assert box == {(1, 0): (0.0, 3.0), (2, 0): (None, None)}  # small boxes widen to the page
    box = {r["page"]: r["x1"] for r in chunking.span_boxes(spans, glyphs, extents, ["doc_id"], least_area=1.0).collect()}
    assert box[1] == 2.0
    lines = spark.createDataFrame([("k", 1, "ab", 0.0, 0.0, 200.0, 100.0)], "key string, line_no int, text string, x0 double, top double, x1 double, bottom double")
    got = [(r["glyph"], r["x0"], r["x1"], r["size"]) for r in chunking.line_glyph_boxes(lines).orderBy("nth").collect()]
    assert got == [("a", 0.0, 36.0, 36.0), ("b", 36.0, 72.0, 36.0)]


GLYPHS = "array<struct<text string, x0 double, x1 double, top double, bottom double, size double, page int>>"


def glyphs_of(text, page, size=10.0, left=0.0):
    return [(c, left + 100.0 * i, left + 100.0 * i + 90.0, 50.0, 150.0, size, page) for i, c in enumerate(text)]


def test_windows_have_boxes_and_large_headings(spark):
    body = "a b c d e f"
    pages = [
        ("x", 1, "Large Title\n" + body, [*[(c, 0.0, 50.0, 0.0, 200.0, 20.0, 1) for c in "LrgT"], *glyphs_of(body, 1)]),
        ("x", 2, "g h i", glyphs_of("g h i", 2, left=7.0)),
        ("x", 3, "", []),
        ("y", 1, "1 2 3", None),
    ]
    df = spark.createDataFrame(pages, f"doc_id string, page int, text string, chars {GLYPHS}")
    got = {(r["doc_id"], r["chunk_no"]): r for r in chunking.page_windows(df, keys=["doc_id"], window=6, overlap=2).collect()}
    assert [got["x", i]["text"] for i in range(3)] == ["Large Title\na b c d", "c d e f\n\ng h", "g h i"]
    assert {got["x", i]["section_title"] for i in range(3)} == {"Large Title"} and got["y", 0]["section_title"] == ""
    two = got["x", 1]
    assert [b[0] for b in two["page_bboxes"]] == [1.0, 2.0]
    assert two["page_bboxes"][1][1:] == [7.0, 50.0, 297.0, 150.0]  # g and h, not i
    assert got["y", 0]["page_bboxes"] == [] and got["y", 0]["bbox"] == [0.0] * 4
    plain = chunking.page_windows(df.drop("chars"), keys=["doc_id"], window=6, overlap=2)
    assert "bbox" not in plain.columns and {r["section_title"] for r in plain.collect()} == {""}


def test_large_lines_are_headings(spark):
    small, large = glyphs_of("abcdefgh" * 3, 1), [("X", 0.0, 1.0, 0.0, 1.0, 13.0, 1)]
    pages = [("d", 1, "abc\nX\nhe\n" + "X" * 121, 0, small + large), ("e", 1, "X", 0, [("X", 0.0, 1.0, 0.0, 1.0, 0.0, 1)])]
    df = spark.createDataFrame(pages, f"doc_id string, page int, text string, base long, chars {GLYPHS}")
    sized = df.join(chunking.glyph_sizes(df, ["doc_id"]).select("doc_id", "heading_size"), "doc_id", "left")
    assert [(r["doc_id"], r["token"], r["title"]) for r in chunking.headings(sized, ["doc_id"]).collect()] == [("d", 1, "X")]


def test_dense_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    v[7] = 0
    v[11] = v[12]
    rows = [(i, [float(x) for x in v[i]], i % 3) for i in range(300)] + [(999, None, 0)]
    p = spark.createDataFrame(rows, "point_id long, vector array<double>, label int")
    q = p.where("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), "vector", "label")
    n = np.linalg.norm(v, axis=1, keepdims=True)
    u = v / np.where(n == 0, 1, n)
    s = np.round(u @ u.T, 6) + 0.0
    for within in (None, "label"):
        got = {}
        for r in search.dense_topk(q, p, k=5, block_rows=64, within=within).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["point_id"])
        for i in range(0, 300, 20):
            pool = [j for j in range(300) if within is None or j % 3 == i % 3]
            assert got[i] == sorted(pool, key=lambda j: (-s[i, j], j))[:5]


def test_payload_filters(spark):
    df = spark.createDataFrame([("tsb/a", "tsb", "en"), ("ttsb/b", "ttsb", "zh"), ("tc/c", "tc", "fr")], "doc_id string, corpus string, lang string")
    assert search.payload_filter(df, source="tsb").count() == 1
    assert search.payload_filter(df, source="tsb", loose_source=True).count() == 2
    assert search.payload_filter(df, lang=[]).count() == 3 and search.payload_filter(df, lang=["en", "fr"]).count() == 2 and search.payload_filter(df, lang="zh").count() == 1


def test_rrf_and_budget(spark):
    d = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, point_id int, rank int")
    s = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, point_id int, rank int")
    got = [r["point_id"] for r in search.rrf_fuse(d, s).orderBy("rank").collect()]
    assert got == [11, 10, 12]
    rows = spark.createDataFrame([(1, 1, "x" * 50), (1, 2, "x" * 10), (1, 3, "x" * 10), (2, 1, "x" * 5), (2, 2, "x" * 5), (2, 3, "x" * 30), (2, 4, "x")], "query_id int, rank int, text string")
    assert {(r["query_id"], r["rank"]) for r in search.within_budget(rows, budget=20).collect()} == {(1, 1), (2, 1), (2, 2)}


def test_merge_puts_unranked_candidates_first(spark):
    cols = "query_id int, point_id int, score double, rank int, rerank_score double"
    a = spark.createDataFrame([(1, 1, 0.5, 1, 0.9), (1, 2, 0.4, 2, 0.2)], cols)
    b = spark.createDataFrame([(1, 2, 0.9, 1, None), (1, 3, 0.8, 2, None)], cols)
    assert [r["point_id"] for r in search.merge_candidates(a, b, top_k=3).orderBy("rank").collect()] == [3, 1, 2]


def test_entities(spark):
    texts = [
        (1, "tsb/a1", "Under CAR 602.115 and CARs 507.20; section 602.115 of the CARs. See AC 702-001. A99-03. C-FHGR, DHC-8-402, Cessna 172n"),
        (2, "tsb/a1", "Findings as to risk\n1. A long enough finding about a valve\n2. short\n- Another long enough finding here\nSafety action taken"),
        (3, "caac/x", "CAR 602.115"),
        (4, "tc/AC_700_001", "CAR 602.115 guides"),
    ]
    df = lake.records(spark.createDataFrame([chunk(i, d, t) for i, d, t in texts], CHUNK))
    r = {x["chunk_id"]: x for x in graph.entities(df).collect()}
    assert r[1]["regulations"] == ["602.115", "507.20"] and r[1]["circulars"] == ["702-001"] and r[1]["recommendation_ids"] == ["A99-03"]
    assert r[1]["aircraft"] == ["DHC-8-402", "DHC-8", "Cessna-172N", "C-FHGR"]
    assert [(f["category"], f["text"]) for f in r[2]["findings"]] == [("risk", "A long enough finding about a valve"), ("risk", "Another long enough finding here\nSafety action taken")]
    assert r[3]["regulations"] == []
    edges = {tuple(e) for e in graph.edges_of(df).collect()}
    assert ("a1", "HAS_RECOMMENDATION", "A99-03") in edges and sum(e[1] == "HAS_FINDING" for e in edges) == 2
    assert ("a1", "CITES", "602.115") in edges and ("602.115", "GUIDED_BY", "700-001") in edges and ("A99-03", "IMPLEMENTS", "507.20") in edges


AIRCRAFT = [
    ("DHC 8 402 and DHC-8--311B", ["DHC-8-402", "DHC-8-311", "DHC-8"]),
    ("DHC\u00a08-402", ["DHC-8-402", "DHC-8"]),
    ("Q100 then Q400, Q 300", ["DHC-8-102", "DHC-8-402", "DHC-8-311"]),
    ("a Dash 8", ["DHC-8"]),
    ("CRJ-900 and CRJ200", ["CRJ-900", "CRJ-200", "CRJ"]),
    ("Canadair Regional Jet 700", ["CRJ-700"]),
    ("Canadair Regional Jet", ["CRJ"]),
    ("learjet 45a", ["Learjet-45A"]),
    ("Challenger 604 (CL-600)", ["Challenger-604", "CL-600"]),
    ("Global XRS, GLOBAL express, Global 7500", ["Global-Xrs", "Global-Express", "Global-7500"]),
    ("BD 700", ["BD-700"]),
    ("Twin  Otter", ["DHC-6"]),
    ("Beaver", ["DHC-2"]),
    ("Single\u00a0Otter", ["DHC-3"]),
    ("DHC-7", ["DHC-7"]),
    ("ATR 72-500", ["ATR-72"]),
    ("ERJ145 and E190-E2", ["ERJ-145", "E190"]),
    ("King\u00a0Air\u00a0350", ["King-Air-350"]),
    ("Beechcraft 1900D", ["Beechcraft-1900"]),
    ("pa-31t", ["PA-31T"]),
    ("PC12 and PC-24", ["PC-12", "PC-24"]),
    ("Gulfstream G550, Falcon 900EX", ["G550"]),
    ("C-GABC c-gabc C-GABCD C-FXYZ", ["C-GABC", "C-FXYZ"]),
    ("", []),
]


def test_aircraft(spark):
    rows = [(i, t) for i, (t, _) in enumerate(AIRCRAFT)] + [(99, None)]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "i int, text string").select("i", graph.aircraft(F.col("text"))).collect()}
    for i, (text, want) in enumerate(AIRCRAFT):
        assert got[i] == want, text
    assert not got[99]


def graph_chunks(spark):
    texts = [
        (1, "tsb/a1", "en", 3, "CAR 602.115. Findings as to risk\n1. A long enough finding about a valve\nA19-01"),
        (2, "tsb/a1", "fr", 4, "A19-01 and AC 702-001, C-FHGR"),
        (3, "tsb/b2", "en", 1, "nothing"),
        (4, "tc/AC_700_001", "en", 1, "CAR 602.115 and CAR 601.01, A20-02"),
        (5, "caac/x", "zh", 1, "CAR 602.115"),
    ]
    return lake.records(spark.createDataFrame([chunk(i, d, t, lang, page=p, source_url=f"https://h.test/{i}") for i, d, lang, p, t in texts], CHUNK))


def test_graph_tables_and_hop_one(spark):
    t = graph.tables_of(graph_chunks(spark))
    assert {r["id"] for r in t["regulations"].collect()} == {"602.115", "601.01"}
    assert {(r["id"], r["type_family"]) for r in t["aircraft"].collect()} == {("C-FHGR", "C")}
    assert {r["id"] for r in t["circulars"].collect()} == {"702-001", "700-001"}
    rec = {r["id"]: (r["lang"], r["page"]) for r in t["recommendations"].collect()}
    assert rec == {"A19-01": ("fr", 4)}  # the last in scan order; circulars make no recommendations
    ids = spark.createDataFrame([("a1",), ("a1",), ("zz",), ("b2",)], "id string")
    out = {r["occ_id"]: r for r in graph.hop_one(ids, t).collect()}
    assert set(out) == {"a1", "b2"}
    a = out["a1"]
    assert [(f["category"], f["text"].split("\n")[0], f["cites_reg"], f["page"]) for f in a["findings"]] == [("risk", "A long enough finding about a valve", "602.115", 3)]
    assert a["occ_url"] == "https://h.test/1" and a["direct_regs"] == ["602.115"] and a["acs"] == ["702-001"]
    assert [r["id"] for r in a["recommendations"]] == ["A19-01"] and a["rec_regs"] == ["602.115"] and a["reg_guided_acs"] == ["700-001"]
    b = out["b2"]
    assert b["findings"] == [] and b["reg_guided_acs"] == [] and b["rec_regs"] == []
    assert graph.looked_up("tsb/a1", t).count() == 1
    with pytest.raises(LookupError):
        graph.looked_up("tsb/none", t)
    assert graph.missing_nodes(t["edges"], t).count() == 0
    block = {r["occ_id"]: r["block"] for r in feedback.context_block(graph.hop_one(ids, t)).collect()}
    assert "[tsb/a1 p.3] risk: A long enough" in block["a1"] and "recommendations implement: 602.115" in block["a1"] and block["b2"] == "- Occurrence b2  https://h.test/3"
    n = graph.entity_counts(graph_chunks(spark)).collect()[0]
    assert (n["chunks"], n["regulations"], n["circulars"], n["aircraft"], n["findings"], n["recommendations"], n["rec_reg_links"], n["reg_ac_links"]) == (5, 2, 1, 1, 1, 2, 1, 2)
    items = spark.createDataFrame([("i", "a1", ["VALVE"]), ("j", "b2", []), ("k", "zz", []), ("l", "a1", ["pump"])], "item_id string, occ_id string, keywords array<string>")
    got = {r["item_id"]: (r["n_findings"], r["n_regs"], r["keyword_hit"], r["score"]) for r in evaluation.traversal_scores(items, graph.hop_one(ids, t)).collect()}
    assert got == {"i": (1, 1, True, 1.0), "j": (0, 0, True, 0.0), "k": (0, 0, True, 0.0), "l": (1, 1, False, 0.0)}


def test_model_reads_sections_only(spark):
    import pyarrow as pa

    def model(batches):
        for b in batches:
            assert all("risk" in t for t in b.column("text").to_pylist())
            n = len(b)
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pa.array([[{"category": "cause", "text": "said"}]] * n), pa.array([[{"id": "A19-01", "text": "do"}]] * n)], ["chunk_id", "findings", "recommendations"])

    got = {r["chunk_id"]: r for r in graph.extracted(graph_chunks(spark), model).collect()}
    assert [f["text"] for f in got[1]["findings"]] == ["said"] and [(r["id"], r["text"]) for r in got[1]["recommendations"]] == [("A19-01", "do")]
    assert [(r["id"], r["text"]) for r in got[2]["recommendations"]] == [("A19-01", "")] and got[3]["findings"] == []


def test_anchored_languages(spark):
    seeds = spark.createDataFrame([("q", 1, "d/a", None, 1, "t"), ("p", 3, "d/b", "en", 1, "t"), ("r", 5, "d/c", "zh", 1, "seed")], "query_id string, point_id long, doc_id string, lang string, rank long, text string")
    rows = [(1, "d/a", None, 1, "fuel pump", "h1"), (2, "d/a", "fr", 2, "fuel", "h2"), (3, "d/b", "en", 1, "pump", "h3"), (4, "d/b", "fr", 1, "fuel pump", "h4"), (6, "d/c", "en", 1, "x", "h6"), (7, "d/c", None, 1, "x", "h7")]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id string, lang string, page int, text string, chunk_hash string")
    q = spark.createDataFrame([("q", "fuel pump"), ("p", "fuel pump"), ("r", "fuel pump")], "query_id string, query string")
    ids = lambda **o: {(r["query_id"], r["chunk_id"]) for r in search.anchored(seeds, chunks, q, **o).collect()}
    assert ids() == {("q", 1), ("q", 2), ("p", 3), ("r", 5)}  # no language of the seed: no filter; nothing left: the seeds
    assert ids(lang="fr") == {("q", 2), ("p", 4), ("r", 5)}
    assert ids(lang=[]) == {("q", 1), ("q", 2), ("p", 3), ("p", 4), ("r", 6), ("r", 7)}
    out = search.anchored(seeds, chunks, q, lang=[], budget=8, scorer=lambda query, text: F.length(text).cast("double")).where("query_id = 'q'").collect()
    assert [r["chunk_id"] for r in out] == [1]


def test_retrieve(spark):
    e = lambda i: [1.0 if j == i else 0.1 * (j + 1) for j in range(4)]
    points = spark.createDataFrame([(i, e(i % 4), f"word{i} common", "en" if i < 4 else "fr", "tsb", f"tsb/{i}", f"h{i}") for i in range(8)], "point_id long, vector array<double>, text string, lang string, corpus string, doc_id string, chunk_hash string")
    q = spark.createDataFrame([("a", "word5 zzz", e(1)), ("b", "  ", e(2)), ("c", "unseen", e(3))], "query_id string, query string, vector array<double>")
    got = search.retrieve(q, points, ann_k=4, top_k=2).collect()
    assert {r["query_id"] for r in got} == {"a", "c"} and {r["point_id"] for r in got if r["query_id"] == "a" and r["rank"] == 1} == {5}
    assert {r["lang"] for r in search.retrieve(q, points, ann_k=4, top_k=4, lang="fr").collect()} == {"fr"}
    gone = spark.createDataFrame([("h5",)], "chunk_hash string")
    assert 5 not in {r["point_id"] for r in search.retrieve(q, points, excluded=gone).collect()}
    with pytest.raises(ValueError):
        search.retrieve(q, points, ann_k=1, top_k=2)
    both = search.retrieve(q, points, ann_k=3, top_k=3, hybrid=True).collect()
    assert sum(r["query_id"] == "c" for r in both) == 3 and sum(r["query_id"] == "a" for r in both) == 3  # the only sparse hit is among the dense ones
    maps = points.withColumn("weights", F.map_from_arrays(F.array(F.lit(1), F.lit(2)), F.array(F.col("point_id").cast("double"), F.lit(0.5))))
    asked = spark.createDataFrame([("a", {1: 2.0}), ("n", {})], "query_id string, weights map<int,double>")
    top = search.sparse_topk(asked, maps, k=2, text="weights", weigh=search.map_weights).orderBy("rank").collect()
    assert [(r["query_id"], r["point_id"], r["score"]) for r in top] == [("a", 7, 14.0), ("a", 6, 12.0)]
    assert search.sparse_topk(asked.limit(0), maps, text="weights", weigh=search.map_weights).count() == 0


def test_blocks_of_queries_give_the_same(spark):
    rng = np.random.default_rng(4)
    p = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)], f"w{i % 7} w{i % 5}") for i in range(120)], "point_id long, vector array<double>, text string").repartition(3)
    q = p.where("point_id % 3 = 0").withColumnRenamed("point_id", "query_id")
    for f in (search.dense_topk, search.sparse_topk):
        a, b = ({tuple(r) for r in f(q, p, k=4, block_rows=n).collect()} for n in (1000, 7))
        assert a == b and len(a) == 160


def test_hops(spark):
    from corpusloom.operators import agent

    q = spark.createDataFrame([("a", "fuel"), ("b", "sure thing"), ("none", "zzz")], "query_id string, query string")

    def retrieve(asked):
        score = F.when(F.col("query").contains("sure"), 0.9).when(F.col("query").contains("valve"), 0.7).otherwise(0.1)
        return asked.where("query not like 'zzz%'").select("query_id", F.length("query").cast("long").alias("point_id"), F.lit("valve fuel").alias("text"), F.lit("tsb/x").alias("doc_id"), F.lit(1.0).alias("score"), score.alias("rerank_score"), F.lit(1).cast("long").alias("rank"), F.lit("h").alias("chunk_hash"))

    found, state = agent.hops(q, retrieve, max_hops=3)
    assert {r["query_id"]: (r["hop"], r["reformulated"]) for r in state.collect()} == {"a": (2, "fuel valve"), "b": (1, None), "none": (3, None)}
    assert {r["query_id"]: r["point_id"] for r in found.collect()} == {"a": 10, "b": 10}
    merged, _ = agent.hops(q, retrieve, max_hops=2, replace=False)
    assert sorted(r["point_id"] for r in merged.where("query_id = 'a'").collect()) == [4, 10]
    assert {r["hop"] for r in agent.hops(q, retrieve, max_hops=1)[1].collect()} == {1}
    cites = spark.createDataFrame([("x", "r"), ("y", "r"), ("z", "r")], "src string, dst string")
    assert {(r["query_id"], r["reg"]) for r in agent.broadened(found, cites).collect()} == {("a", "r"), ("b", "r")}
    assert agent.broadened(found, cites, most_docs=0).count() == 0
    answers = spark.createDataFrame([("a", [1.0], "text"), ("b", [1.0], None)], "query_id string, query_emb array<double>, answer string")
    rows = {r["query_id"]: r for r in agent.rejections(state, found, answers).collect()}
    assert rows["a"]["terms"] == ["valve"] and rows["b"]["terms"] is None and rows["a"]["chunk_hashes"] == ["h"]
    with pytest.raises(ValueError):
        agent.rejections(state, found, answers, order_by="x")


def test_rejections_are_written_and_resolved(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = spark.createDataFrame([(1, "q", [1.0, 0.0], "bad", ["h1"], None), (2, "r", [0.0, 1.0], "worse", ["h2"], ["t"])], "id long, query string, query_emb array<double>, answer string, chunk_hashes array<string>, terms array<string>")
    feedback.written(rows, path)
    points = spark.createDataFrame([(1, "h1", [1.0, 0.0]), (2, "h2", [0.0, 1.0]), (3, "h3", [1.0, 0.1])], "point_id long, chunk_hash string, vector array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, [1.0, -5.0])], "query_id long, vector array<double>")
    got = {r["query_id"]: (r["id"], r["excluded"], r["hits_excluded"]) for r in evaluation.replayed(asked, spark.read.parquet(path), points).collect()}
    assert got == {7: (1, 1, 1), 8: (None, 0, 0)}
    feedback.resolved(spark.createDataFrame([(1,), (9,)], "id long"), path)
    log = spark.read.parquet(path)
    assert {r["id"]: r["resolved_at"] is not None for r in feedback.latest(log).collect()} == {1: True, 2: False}
    assert feedback.similar_rejections(asked, log).where("query_id = 7").count() == 0


def test_prompt_parts(spark):
    from corpusloom.operators import agent

    p = spark.createDataFrame([("a", None), ("b", "x" * 500)], "query_id string, rejected_prior string")
    got = {r["query_id"]: r["system"] for r in agent.system_prompt("base", p).collect()}
    assert got["a"] == "base" and got["b"].endswith("evidence than: " + "x" * 400)
    d = spark.createDataFrame([("a", "text \n"), ("b", None)], "query_id string, draft string")
    s = spark.createDataFrame([("a", "**Sources:** [x p.1]")], "query_id string, block string")
    assert {r["query_id"]: r["final"] for r in agent.finished(d, s).collect()} == {"a": "text\n\n---\n**Sources:** [x p.1]", "b": ""}
    turns = spark.createDataFrame([("c", 2, "assistant", "yes", None), ("c", 1, "user", "hi", None), ("c", 3, "assistant", "thought", "m"), ("c", 4, "user", "", None)], "chat_id string, turn int, role string, content string, metadata string")
    assert [[(m["role"], m["content"]) for m in r["messages"]] for r in agent.messages(turns).collect()] == [[("user", "hi"), ("assistant", "yes")]]
    turns = spark.createDataFrame([("c", i, "[d/b p.1]" if i == 9 else "no tags") for i in range(1, 11)], "chat_id string, turn int, answer string")
    sources = spark.createDataFrame([("c", i, r, doc, f"u{r}") for i in range(1, 11) for r, doc in enumerate(["d/a", "d/b", "d/b"])], "chat_id string, turn int, rank int, doc_id string, source_url string")
    links_ = {(r["turn"], r["doc_id"], r["source_url"]) for r in agent.turn_links(turns, sources).collect()}
    assert links_ == {(9, "d/b", "u1")} | {(i, x, u) for i in (3, 4, 5, 6, 7, 8, 10) for x, u in (("d/a", "u0"), ("d/b", "u1"))}
    trace = spark.createDataFrame([("t", 0, "retrieve", 5, None, 0.5, None), ("t", 1, "graph_expand", None, None, None, 3), ("t", 2, "synthesize", None, None, None, None), ("u", 0, "finalize", None, None, None, None)], "thread string, step int, node string, n_new int, n_merged int, best_rerank double, n_rows int")
    assert {r["thread"]: (r["block"], r["steps"]) for r in agent.bullets(trace).collect()} == {"t": ("- Retrieved 5 chunks · best score 0.50\n- Graph context · 3 edges\n- Synthesised the answer", 3), "u": ("- Loaded cached answer", 1)}


def test_display(spark):
    hits = spark.createDataFrame([("q", "d/a", 1, 1, None, "text"), ("q", "d/a", 1, 2, 0.5, "figure"), ("q", "d/b", 2, 3, 0.9, None)], "query_id string, doc_id string, page int, rank int, rerank_score double, kind string")
    assert [r["rank"] for r in search.displayed(hits).orderBy("place").collect()] == [3, 2, 1]
    assert {(r["doc_id"], r["best"], tuple(r["ranks"]), r["figure"]) for r in search.grouped(hits, by=["doc_id", "page"]).collect()} == {("d/a", 0.5, (1, 2), True), ("d/b", 0.9, (3,), False)}
    assert search.chosen(None, ["a", "b"]) == [] and search.chosen(["b", "a"], ["a", "b"]) == [] and search.chosen(["a", "z"], ["a", "b"]) == ["a"]
    assert '"rank":1' in evaluation.result_json(hits).collect()[0]["json"]


def test_process_and_embed(spark):
    import pyarrow as pa

    long = "word " * 60
    rows = lake.records(spark.createDataFrame([chunk(1, "tsb/ok", long, h="a" * 64), chunk(2, "tsb/short", "tiny", h="b" * 64), chunk(3, "tsb/late", long, h="a" * 64), chunk(4, "tsb/late", long, h="b" * 64), chunk(5, "tsb/done", long, h="c" * 64)], CHUNK))
    docs = spark.createDataFrame([("en", f"tsb/{x}") for x in ("ok", "short", "late", "done", "empty")], "lang string, doc_id string")
    new, verdict = lake.processed(docs, rows, done=docs.where("doc_id = 'tsb/done'"))
    assert {r["chunk_id"] for r in new.collect()} == {3, 4}  # a rejected document's text claims no hash, of equal ones the first document's stays
    assert {r["doc_id"]: r["reason"] for r in verdict.collect()} == {"tsb/ok": None, "tsb/short": "sub_threshold", "tsb/late": None, "tsb/done": None, "tsb/empty": "empty"}

    def embedder(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([[float(len(t))] if len(t) > 10 else None for t in b.column("text").to_pylist()], pa.list_(pa.float64()))], ["key", "vector"])

    out = lake.embedded(rows, embedder).collect()
    assert {(r["chunk_id"], r["vector"][0]) for r in out} == {(1, 300.0), (3, 300.0), (5, 300.0)}  # of one hash the least text is embedded, here a short one


def test_rebuilt_urls(spark):
    refs = spark.createDataFrame([("tsb", "en", "A13Q0098"), ("tsb", "fr", "a13q0098"), ("ttsb", "zh", "12_a_b"), ("ttsb", "zh", "x_a"), ("ttsb", "zh", "12_"), ("caac", "zh", "name"), ("tc", "en", "AC_700_001")], "source string, lang string, stem string")
    seeds = spark.createDataFrame([("https://h.test/x/name.pdf",), (None,)], "url string")
    got = [r["source_url"] for r in links.rebuilt_urls(refs, seeds).orderBy("source", "lang", "stem").collect()]
    base = "https://www.bst-tsb.gc.ca/sites/default/files/rapports-reports/aviation/a13q0098"
    assert got == ["https://h.test/x/name.pdf", None, f"{base}/eng/a13q0098.pdf", f"{base}/fra/a13q0098.pdf", None, "https://www.ttsb.gov.tw/media/12/a_b.pdf", None]
    assert links.rebuilt_urls(refs).where("source_url is not null").count() == 3
    bad = spark.createDataFrame([("/r/tsb/x.pdf",)], "p string")
    with pytest.raises(Exception, match="no language"):
        bad.select(links.document_reference(F.col("p"))).collect()


def test_region_candidates(spark):
    rows = [chunk(1, text="x" * 40, bbox=[0.0, 0.0, 10.0, 10.0], h="a"), chunk(2, text="x" * 40, bbox=[0.0, 0.0, 9.0, 10.0]), chunk(3, text="x" * 20, bbox=[0.0, 0.0, 10.0, 10.0]), chunk(4, text="x" * 40, bbox=[0.0, 0.0, 10.0, 10.0], page=0), chunk(5, text="x" * 40, bbox=[0.0, 0.0, 10.0]), chunk(6, text="x" * 40, bbox=[10.0, 10.0, 0.0, 0.0]), chunk(7, text=None)]
    df = spark.createDataFrame(rows, CHUNK)
    assert [r["chunk_id"] for r in evaluation.region_candidates(df).collect()] == [1] and evaluation.region_sample(df, n=5).count() == 1
    pairs = spark.createDataFrame([(i, x) for i, x in enumerate([0.5, 0.1, None, 0.3])], "chunk_id int, similarity double")
    assert [r["chunk_id"] for r in evaluation.worst(pairs, n=2).collect()] == [1, 3]


def test_context_and_recurrence(spark):
    cites = spark.createDataFrame([("a", "r1"), ("b", "r1"), ("c", "r1"), ("a", "r2"), ("a", "hub"), *[(f"o{i}", "hub") for i in range(20)], (None, "r1")], "src string, dst string")
    seeds = spark.createDataFrame([("q", "a"), ("q", "zz"), ("q", "a")], "query_id string, id string")
    got = graph.recurring(seeds, cites).collect()
    assert [(r["reg"], r["occ_count"], r["siblings"]) for r in got] == [("r1", 3, ["b", "c"])]
    assert graph.recurring(seeds, cites.where("src <> 'c'"), count_all_seeds=True).count() == 0
    occ = spark.createDataFrame([("a",), ("b",)], "id string")
    out = graph.context(spark.createDataFrame([("a",), ("b",), ("nope",), ("a",)], "id string"), occ, {"regs": cites.select(F.col("src").alias("id"), F.col("dst").alias("fact"))})
    assert {r["id"]: r["regs"] for r in out.collect()} == {"a": ["hub", "r1", "r2"], "b": ["r1"]}


def test_feedback(spark):
    log = spark.createDataFrame([(1, "q", [1.0, 0.0], "a", ["h1"], None, 1, None), (1, "q", [1.0, 0.0], "a", ["h1"], None, 2, 3), (2, "q", [1.0, 0.1], None, ["h2", "h3"], None, 1, None), (3, "q", [0.0, 0.0], None, [], None, 1, None)], "id long, query string, query_emb array<double>, answer string, chunk_hashes array<string>, terms array<string>, created_at long, resolved_at long")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<double>")
    near = feedback.similar_rejections(asked, log)
    assert [r["id"] for r in near.collect()] == [2]
    assert {r["chunk_hash"] for r in feedback.exclusions(near, log).collect()} == {"h2", "h3"}


def test_reformulation(spark):
    q = spark.createDataFrame([("q", "fuel pump"), ("none", "x")], "query_id string, query string")
    c = spark.createDataFrame([("q", 1, "The fuel pump valve ac700-001 valve"), ("q", 2, "vent")], "query_id string, rank int, text string")
    t = feedback.novel_terms(c, q)
    assert [r["term"] for r in t.orderBy("rank").collect()] == ["valve", "ac700-001", "vent"]
    assert {r["query_id"]: r["query"] for r in feedback.reformulated(q, t).collect()} == {"q": "fuel pump valve ac700-001 vent", "none": "x"}


def test_metrics(spark):
    rows = [(["a", "a", "b"], ["b", "c"]), (["a"], []), ([], ["a"]), (None, ["a"]), (["c", "c", "a"], ["a", "c"])]
    df = spark.createDataFrame(rows, "actual array<string>, expected array<string>")
    a, e = F.col("actual"), F.col("expected")
    got = df.select(evaluation.recall_at(a, e, 2).alias("r"), evaluation.reciprocal_rank(a, e).alias("rr"), evaluation.ndcg_at(a, e, 5).alias("n")).collect()
    assert [r["r"] for r in got] == [0.0, 0.0, 0.0, 0.0, 0.5]
    assert [round(r["rr"], 6) for r in got] == [0.333333, 0.0, 0.0, 0.0, 1.0]
    assert got[4]["n"] == pytest.approx(1.0) and all(r["n"] <= 1 for r in got)
    pairs = spark.createDataFrame([(x,) for x in (0.1, 0.4, 0.5, 0.9, None)], "similarity double")
    r = evaluation.similarity_report(pairs).collect()[0]
    assert (r["n_ok"], r["n_hit"], r["mean"], r["median"]) == (4, 3, 0.475, 0.5)
    s = spark.createDataFrame([("Abc ", "abc"), ("", ""), ("", "x"), (None, None)], "a string, b string")
    assert [x[0] for x in s.select(evaluation.sequence_ratio("a", "b")).collect()] == [1.0, 1.0, 0.0, 1.0]


def test_links(spark):
    html = '<a href="x/y">1</a> <A class=z HREF=\'/d/e.PDF?q=1\'>2</a><a name="n">3</a><a href="x/y">again</a>'
    pages = spark.createDataFrame([("https://a.h.test/base/", html), ("https://a.h.test/2", None)], "url string, html string")
    found = links.links(pages)
    assert {r["target"] for r in found.collect()} == {"https://a.h.test/base/x/y", "https://a.h.test/d/e.PDF?q=1"}
    assert [r[0] for r in links.detail_links(found, host_suffix="h.test", base_path="/base/").collect()] == ["https://a.h.test/base/x/y"]
    assert [r[0] for r in links.pdf_links(found, host_suffix="h.test").collect()] == ["https://a.h.test/d/e.PDF?q=1"]
    lines = spark.createDataFrame([(1, "# c"), (2, " "), (3, "https://h.test/a/x.pdf"), (4, "https://h.test/b/x.pdf"), (5, "https://other.test/y.pdf"), (6, "https://h.test/y.html")], "line_no int, value string")
    assert [r["url"] for r in links.seeds(lines, host_suffix="h.test").collect()] == ["https://h.test/a/x.pdf"]
    ref = spark.createDataFrame([("/r/ttsb/zh/9_report.pdf",)], "p string").select(links.document_reference(F.col("p")).alias("r")).collect()[0]["r"]
    assert (ref["source"], ref["lang"], ref["doc_id"]) == ("ttsb", "zh", "ttsb/9_report")


def test_sample_and_parity(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 900, "a").when(F.col("id") < 999, "b"))
    got = {r["g"]: r["count"] for r in search.stratified_sample(df, most=100, stratum="g", key="id").groupBy("g").count().collect()}
    assert got == {"a": 90, "b": 10, None: 1}
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y")], "query_id int, doc_id string")
    b = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y")], "query_id int, doc_id string")
    assert [tuple(r) for r in search.parity(a, b).collect()] == [(1, 3, 3, 2)]


def test_regions(spark):
    from corpusloom.operators import regions

    text = "Fuel  pump near\nfuel pump. The Pump"
    chars = [(c, float(i), float(i + 1), 0.0 if i < 16 else 20.0, 10.0 if i < 16 else 30.0, 12.0, 1) for i, c in enumerate(text)]
    pages = spark.createDataFrame([("d", 1, text, chars), ("d", 2, None, None)], "doc_id string, page int, text string, chars array<struct<text string, x0 double, x1 double, top double, bottom double, size double, page int>>")
    terms = spark.createDataFrame([("fuel pump",), (" ",), (None,), ("near fuel",)], "term string")
    hits = regions.term_hits(pages, terms, ["doc_id"])
    assert {(r["term"], r["lo"], r["hi"]) for r in hits.collect()} == {("fuel pump", 0, 10), ("fuel pump", 16, 25), ("near fuel", 11, 20)}
    boxes = regions.line_boxes(hits, pages, ["doc_id"])
    assert {(r["term"], r["x0"], r["x1"], r["top"]) for r in boxes.collect()} == {("fuel pump", 0.0, 10.0, 0.0), ("fuel pump", 16.0, 25.0, 20.0), ("near fuel", 11.0, 16.0, 0.0), ("near fuel", 16.0, 20.0, 20.0)}
    assert regions.line_boxes(hits, pages, ["doc_id"], most=2).count() == 2
    q = spark.createDataFrame([("a b, c d e f g h i END", "zz b c d e f g h i end"), ("x", ""), (None, "x")], "t string, q string")
    got = [r[0] for r in q.select(regions.quote_hit(F.col("t"), F.col("q"))).collect()]
    assert (got[0]["lo"], got[0]["hi"]) == (5, 22) and got[1] is None and got[2] is None
    b = spark.createDataFrame([("d", 0.0, 0.0, 10.0, 10.0), ("d", 11.0, 0.0, 20.0, 10.0), ("d", 21.5, 5.0, 30.0, 8.0), ("d", 100.0, 0.0, 110.0, 5.0), ("d", None, 0.0, 1.0, 1.0)], "k string, x0 double, top double, x1 double, bottom double")
    assert {tuple(r)[1:] for r in regions.merge_touching(b, ["k"]).collect()} == {(0.0, 0.0, 30.0, 10.0), (100.0, 0.0, 110.0, 5.0)}
    p = spark.createDataFrame([(1, "The pump was found broken near the hill. It was a bright day for all.", "They say the pump was found broken near a hill."), (2, None, "x")], "k int, a string, b string")
    got = regions.best_sentence(p, key="k", passage="a", draft="b").collect()
    assert [(r["k"], r["sentence"]) for r in got] == [(1, "The pump was found broken near the hill.")]
    box = spark.range(1).select(F.array(F.lit(36.0), F.lit(-5.0), F.lit(72.0), F.lit(900.0)).alias("b"))
    assert box.select(regions.pixels(F.col("b"), dpi=144, width=100, height=1000)).collect()[0][0] == [72, 0, 100, 1000]


def test_model_extractions_merge(spark):
    df = spark.createDataFrame([(["A01-01", "A02-02"], [("A02-02", "text"), (None, "more")]), (["A01-01"], None)], "ids array<string>, m array<struct<id string, text string>>")
    got = [[tuple(x) for x in r[0]] for r in df.select(graph.merged_recommendations(F.col("ids"), F.col("m"))).collect()]
    assert got == [[("A01-01", ""), ("A02-02", "text"), (None, "more")], [("A01-01", "")]]
    ctx = spark.createDataFrame([("a", ["r1"], ["x"], []), ("b", [], [], [])], "id string, direct_regs array<string>, acs array<string>, reg_guided_acs array<string>")
    assert {r["block"] for r in feedback.context_block(ctx).collect()} == {"Occurrence a:\n  cited regulations: r1\n  referenced ACs: x", "- Occurrence b"}
