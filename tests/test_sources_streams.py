import tempfile

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import lake
from corpusloom.sources import lake as source
from corpusloom.streaming import live
from tests.test_operators import CHUNK, chunk


def test_records_round_trip_and_prune(spark):
    root = tempfile.mkdtemp() + "/lake"
    df = lake.records(spark.createDataFrame([chunk(1, "tsb/a", "x"), chunk(2, "tc/b", "y", "fr"), chunk(3, "tsb/c", "z")], CHUNK))
    source.write_records(df, root)
    assert source.read_records(spark, root).count() == 3
    some = source.read_records(spark, root, lang="en", source="tsb")
    assert {r["doc_id"] for r in some.collect()} == {"tsb/a", "tsb/c"}
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(lang" in plan
    assert source.read_records(spark, root, limit=2).count() == 2
    with pytest.raises(ValueError):
        source.read_records(spark, root, lang="de")


def test_files_and_freshness(spark, tmp_path):
    for p in ("tsb/fr/b.pdf", "tsb/en/a.pdf", "tc/en/c.pdf"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(p.encode())
    files = source.corpus_files(spark, str(tmp_path))
    assert [r["doc_id"] for r in files.collect()] == ["tsb/a", "tc/c", "tsb/b"]
    done = files.where("doc_id = 'tsb/a'").select("doc_id", "modificationTime")
    assert {r["doc_id"] for r in source.stale(files, done).collect()} == {"tc/c", "tsb/b"}
    assert source.file_hashes(spark, str(tmp_path)).count() == 3
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))

    def opener(data):
        if data.startswith(b"tc"):
            raise ValueError("broken")

    bad = source.probe(content, opener).collect()
    assert len(bad) == 1 and bad[0]["error_class"] == "ValueError"


def test_items(spark, tmp_path):
    (tmp_path / "i.jsonl").write_text('# c\n\n{"id": "1", "query": "q", "expected": ["a"], "other": 1}\n')
    assert [tuple(r) for r in source.read_items(spark, str(tmp_path / "i.jsonl"), "id string, query string, expected array<string>").collect()] == [("1", "q", ["a"])]
    (tmp_path / "e.jsonl").write_text("# only\n")
    with pytest.raises(ValueError):
        source.read_items(spark, str(tmp_path / "e.jsonl"), "id string")
    assert source.read_or_empty(spark, str(tmp_path / "missing"), spark.range(1).schema).count() == 0
    assert source.export({"t": spark.range(5)}, str(tmp_path / "out")) == {"t": 5}


def test_tables_manifests_and_pages(spark, tmp_path):
    import pyarrow as pa

    schema = spark.createDataFrame([], "a long, b string").schema
    path = str(tmp_path / "points")
    assert source.ensure_table(spark, path, schema).count() == 0
    spark.createDataFrame([(1, "x")], schema).write.mode("append").parquet(path)
    assert source.ensure_table(spark, path, schema).count() == 1
    other = spark.createDataFrame([], "a long, c string").schema
    with pytest.raises(ValueError):
        source.ensure_table(spark, path, other)
    assert source.ensure_table(spark, path, other, recreate=True).columns == ["a", "c"]

    (tmp_path / "in" / "tsb").mkdir(parents=True)
    (tmp_path / "in" / "tsb" / "x.pdf").write_bytes(b"two pages")
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path / "in"))
    pages = source.read_pages(content, lambda data: [(1, "text", [("t", 0.0, 1.0, 0.0, 1.0, 9.0)], False), (2, " ", None, True), (3, None, [], False)])
    got = {r["page"]: r for r in pages.collect()}
    assert [got[i]["image_only"] for i in (1, 2, 3)] == [False, True, False] and got[1]["chars"][0]["page"] == 1 and got[3]["text"] == ""

    def reader(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("page"), pa.array([f"read by {r}" for r in b.column("reader").to_pylist()])], ["path", "page", "text"])

    read = source.recognised(pages.withColumn("lang", F.lit("zh")).withColumn("source", F.lit("ttsb")), reader)
    assert {r["page"]: r["text"] for r in read.collect()} == {1: "text", 2: "read by chinese_cht", 3: ""}

    bad = spark.createDataFrame([("file:/c/tsb/x.pdf", "ValueError", "broken")], "path string, error_class string, message string")
    for _ in range(2):
        source.quarantined(bad, str(tmp_path / "q"), root="file:/c/", quarantine="file:/gone")
    rows = spark.read.option("header", True).csv(str(tmp_path / "q")).collect()
    assert len(rows) == 2 and rows[0]["quarantine_path"] == "file:/gone/tsb/x.pdf" and rows[0]["quarantined_at"]
    source.write_manifest(spark.createDataFrame([("all", "", 1, 2)], "slice string, value string, admitted int, rejected int"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 1


def test_checkpoint_folder(spark):
    from corpusloom import session

    root = session.checkpoint_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir")

    class Conf:
        def get(self, name, default=None):
            return "spark://h:7077" if name == "spark.master" else default

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="share"):
        session.checkpoint_root(Session())


def test_windows_of_a_stream(spark, tmp_path):
    rows = [("a", 1.0, "2024-01-01 10:00:00"), ("a", 2.0, "2024-01-03 10:00:00"), ("b", 4.0, "2024-01-01 11:00:00"), ("a", 8.0, "2024-01-02 23:00:00"), ("z", 16.0, "2023-12-01 00:00:00"), (None, 1.0, "2024-01-03 00:00:00"), ("a", 1.0, None)]
    import time

    for r in rows:
        spark.createDataFrame([r], "k string, v double, t string").withColumn("t", F.to_timestamp("t")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    s = live.file_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    got = {(r["k"], str(r["start"])[:10]): (r["n"], r["total"]) for r in live.counted_once(s, time="t", key="k", value="v").collect()}
    # a day late still counts, a month late does not
    assert got == {("a", "2024-01-01"): (1, 1.0), ("b", "2024-01-01"): (1, 4.0), ("a", "2024-01-03"): (1, 2.0), ("a", "2024-01-02"): (1, 8.0), (None, "2024-01-03"): (1, 1.0)}


def test_stream_upsert_and_counts(spark, tmp_path):
    rows = [(1, 1, "2024-01-01 00:00:00"), (1, 5, "2024-01-01 01:00:00"), (2, 3, "2024-01-02 00:00:00")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "k int, v int, t string").withColumn("t", F.to_timestamp("t")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = live.file_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    assert {(r["k"], r["v"]) for r in live.upsert_once(s, ["k"], ["v"]).collect()} == {(1, 5), (2, 3)}
    s = live.file_stream(spark, str(tmp_path / "in"))
    assert live.run_once(live.new_keys(s, "k", time="t")).count() == 2


def test_sessions_and_frames(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:29:59"), (1, "2024-01-01 01:00:00"), (None, "2024-01-01 00:00:00")], "user_id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["events"] for r in live.sessions(e).collect()) == [1, 2]
    lines = ["event: a", 'data: {"x":', "data: 1}", "", "event: b", "data: broken{", "", "data: {}", "", "event: c", "data: {}"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "stream_id int, seq int, line string")
    assert [(r["event"], r["data"]) for r in live.frames(df).collect()] == [("a", '{"x":\n1}')]
