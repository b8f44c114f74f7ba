import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import running
from corpusloom.functions import text as T


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(r,) for r in rows], f"t {kind}")
    return [r[0] for r in df.select(column(F.col("t"))).collect()]


def test_chunk_hash_squeezes_all_white_space(spark):
    rows = ["A  b c\n", "a B C", "", None]
    got = values(spark, T.chunk_hash, rows)
    assert got[0] == got[1] == hashlib.sha256(b"a b c").hexdigest()
    assert got[2] == hashlib.sha256(b"").hexdigest() and got[3] is None


def test_point_id(spark):
    h = "0123456789abcdef" * 4
    assert values(spark, T.point_id, [h, None]) == ["01234567-89ab-cdef-0123-456789abcdef", None]
    with pytest.raises(Exception, match="too short"):
        values(spark, T.point_id, ["abc"])


def test_tokens_match_the_pattern(spark):
    rows = ["See AC 700-001, the C-FHGR/x at 10.5!", "", None, "安全 action"]
    want = [[m.lower() for m in re.findall(T.TOKEN, r or "")] for r in rows]
    assert values(spark, T.tokens, rows) == want


def test_boilerplate(spark):
    rows = ["- 2 -", "26 JULY 2003", "x" * 79, "x" * 80, "  " + "y" * 80 + " ", "2003-07-26"]
    assert values(spark, T.is_boilerplate, rows) == [True, True, True, False, False, True]


def test_headings(spark):
    rows = ["Findings as to causes and contributing factors", "1.2 Scope", "1.2 scope", "Mesures de sécurité prises", "text", "Safety action " + "x" * 120, ""]
    assert values(spark, T.is_heading, rows) == [True, True, False, True, False, False, False]


def test_citations(spark):
    a = 'As [tsb/a1 p.2 §X] says "first" and [tsb/a1 p.2] "second"; [tc/b p. 10] too.'
    assert values(spark, T.cited_pages, [a]) == [["tsb/a1 p.2", "tc/b p.10"]]
    got = values(spark, T.quoted_citations, [a])[0]
    assert [(r["doc"], r["page"], r["quote"]) for r in got] == [("tsb/a1", "2", "first")]


def test_answer_cleanup(spark):
    assert values(spark, T.without_reasoning, ["<think>x\ny</think>\nAnswer", "plain"]) == ["Answer", "plain"]
    assert values(spark, T.without_sources, ["Text [tsb/a p.1].\n\n---\n**Sources:** [tsb/a p.1]", "Text\nSources: [a p.1]"]) == ["Text.", "Text"]
    assert values(spark, T.rescued_json, ['```json\n{"a": 1}\n``` done', "none", None]) == ['{"a": 1}', "{}", "{}"]
    r = values(spark, T.parsed_caption, ["Caption: A wing\nTranscribed text: ABC 12"])[0]
    assert (r["caption"], r["ocr_text"]) == ("A wing", "ABC 12")


def test_urls(spark):
    from urllib.parse import urljoin

    base = "https://h.test/a/b/index.html?x=1"
    hrefs = ["c.pdf", "/c.pdf", "//o.test/c", "https://z.test/q", "../d/e.pdf", "./f", "?y=2", "#p"]
    df = spark.createDataFrame([(h,) for h in hrefs], "h string")
    got = [r[0] for r in df.select(T.joined_url(F.lit(base), F.col("h"))).collect()]
    assert got == [urljoin(base, h) for h in hrefs]
    assert values(spark, T.file_name, ["https://h.test/x/l%27a+b%20c.pdf?q"]) == ["l'a+b c.pdf"]


def test_running_sum_over_buckets(spark):
    rows = [("d", p, (p * 7) % 5) for p in range(300)] + [("e", 3, 4)]
    df = spark.createDataFrame(rows, "d string, page int, n int")
    got = {(r["d"], r["page"]): r["base"] for r in running.before_sum(df, ["d"], "page", "n", "base", width=16).collect()}
    total = 0
    for d, p, n in rows[:-1]:
        assert got[(d, p)] == total
        total += n
    assert got[("e", 3)] == 0


def test_last_known_over_buckets(spark):
    rows = [("d", p, f"t{p}" if p % 37 == 5 else None) for p in range(200)]
    df = spark.createDataFrame(rows, "d string, page int, title string")
    got = {r["page"]: r["s"] for r in running.last_known(df, ["d"], F.col("page"), "title", "s", position="page", width=16).collect()}
    last = None
    for _, p, t in rows:
        last = t or last
        assert got[p] == last
