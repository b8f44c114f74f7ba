"""Readers and writers: chunk records as JSON lines, corpus files, seeds, evaluation items, artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators import lake
from corpusloom.operators.lake import LANGUAGES, SOURCES
from corpusloom.operators.links import document_reference

RECORD = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("section_title", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("bbox", T.ArrayType(T.DoubleType())),
        T.StructField("page_bboxes", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("kind", T.StringType()),
        T.StructField("chunk_hash", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def _known(value: str | None, values: list[str], what: str) -> str | None:
    if value in (None, "all"):
        return None
    if value not in values:
        raise ValueError(f"unknown {what}: {value}")
    return value


def write_records(chunks: DataFrame, root: str, *, mode: str = "append") -> None:
    """Chunk records as JSON lines under lang=/corpus=; Spark's commit protocol makes the write atomic."""
    chunks.select(*[f.name for f in RECORD.fields], "lang", "corpus").repartition("lang", "corpus", F.pmod(F.xxhash64("chunk_hash"), F.lit(16))).write.mode(mode).partitionBy("lang", "corpus").json(root)


def read_records(spark: SparkSession, root: str, *, lang: str | None = None, source: str | None = None, limit: int | None = None) -> DataFrame:
    """Chunk records of a root, filtered by partition (pruned before any file is read); ``all`` or None is no filter, an
    unknown value an error. Fields that an older writer left out get their defaults."""
    df = spark.read.schema(T.StructType([*RECORD.fields, T.StructField("lang", T.StringType()), T.StructField("corpus", T.StringType())])).json(root)
    if l_ := _known(lang, LANGUAGES, "language"):
        df = df.where(F.col("lang") == l_)
    if s_ := _known(source, SOURCES, "source"):
        df = df.where(F.col("corpus") == s_)
    df = lake.records(df)
    return df if limit is None else df.limit(limit)


def corpus_files(spark: SparkSession, root: str, *, pattern: str = "*.pdf") -> DataFrame:
    """Files under a root with their document reference, in scan order: path, modificationTime, length, source, lang, stem,
    doc_id. The content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).drop("content")
    rows = files.withColumn("ref", document_reference(F.col("path"))).select("path", "modificationTime", "length", "ref.*")
    place = lambda c, values: F.array_position(F.array(*map(F.lit, values)), F.col(c))
    return rows.orderBy(place("lang", LANGUAGES), place("source", SOURCES), F.substring_index("path", "/", -1))


def file_hashes(spark: SparkSession, root: str, *, pattern: str = "*") -> DataFrame:
    """SHA-256 and size of each file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def stale(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Inputs (doc_id, modificationTime) that no output of the same document is as new as."""
    done = outputs.groupBy("doc_id").agg(F.max("modificationTime").alias("done"))
    return inputs.join(done, "doc_id", "left").where(F.col("done").isNull() | (F.col("done") < F.col("modificationTime"))).drop("done")


def probe(files: DataFrame, opener) -> DataFrame:
    """Files whose content ``opener(bytes)`` can't open: (path, error_class, message)."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            bad = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    opener(bytes(content))
                except Exception as e:  # noqa: BLE001
                    bad.append((path, type(e).__name__, str(e)[:500]))
            yield pd.DataFrame(bad, columns=["path", "error_class", "message"])

    return files.select("path", "content").mapInPandas(run, "path string, error_class string, message string")


def read_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Items of a file of JSON lines; blank lines, comments and unknown fields are skipped, a file without items is an error."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    items = lines.select(F.from_json("value", schema).alias("i")).select("i.*")
    if items.limit(1).count() == 0:
        raise ValueError(f"no items in {path}")
    return items


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parquet artifact, empty where it is missing."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def export(tables: dict[str, DataFrame], root: str) -> dict[str, int]:
    """Writes tables as parquet and checks that as many rows can be read as were written (Spark counts them while it writes); their
    numbers."""
    from pyspark.sql import Observation

    counts = {}
    for name, df in tables.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{root}/{name}")
        counts[name] = df.sparkSession.read.parquet(f"{root}/{name}").count()
        if counts[name] != seen.get["n"]:
            raise ValueError(f"{name}: rows written and read differ")
    return counts


def ensure_table(spark: SparkSession, path: str, schema: T.StructType, *, recreate: bool = False) -> DataFrame:
    """The parquet table at ``path``, made empty where it is missing or with ``recreate``; a table of other columns is an error, as a
    change of columns needs ``recreate``."""
    there = read_or_empty(spark, path, schema)
    kinds = lambda s: {f.name: f.dataType.simpleString() for f in s.fields}
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if recreate or not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
        return spark.read.schema(schema).parquet(path)
    if kinds(spark.read.parquet(path).schema) != kinds(schema):
        raise ValueError(f"{path} has other columns")
    return there


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The tallies of a run (see ``lake.manifest``) as JSON lines with the time of writing, appended."""
    manifest.withColumn("written_at", F.current_timestamp()).write.mode("append").json(path)


def quarantined(bad: DataFrame, path: str, *, root: str, quarantine: str) -> None:
    """Appends files that can't be opened (path, error_class, message) to a CSV manifest, with the place that mirrors theirs under
    ``quarantine`` and the time. Moving the files is left to the caller."""
    place = F.concat(F.lit(quarantine.rstrip("/")), F.expr("substring(path, length(root) + 1)"))
    rows = bad.withColumn("root", F.lit(root.rstrip("/"))).select(F.col("path").alias("original_path"), place.alias("quarantine_path"), "error_class", F.col("message").alias("error_message"), F.current_timestamp().alias("quarantined_at"))
    rows.write.mode("append").option("header", True).csv(path)


def read_pages(files: DataFrame, opener) -> DataFrame:
    """Pages of files (path, content): path, page, text, chars, image_only (blank text on a page with images). ``opener`` is a
    function from bytes to an iterator of (page, text, chars as tuples (text, x0, x1, top, bottom, size), has_images)."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = []
                for page, text, chars, images in opener(bytes(content)):
                    glyphs = [dict(zip(("text", "x0", "x1", "top", "bottom", "size"), c), page=page) for c in chars or []]
                    rows.append((path, page, text or "", glyphs, not (text or "").strip() and bool(images)))
                yield pd.DataFrame(rows, columns=["path", "page", "text", "chars", "image_only"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string, chars array<struct<text:string,x0:double,x1:double,top:double,bottom:double,size:double,page:int>>, image_only boolean")


def recognised(pages: DataFrame, reader) -> DataFrame:
    """Pages (path, page, text, image_only, lang, source, ...) whose image-only ones were read: ``reader`` is a function of an iterator
    of Arrow batches (path, page, reader: the model's name) that gives (path, page, text). A page that it gives nothing for stays
    empty."""
    from corpusloom.functions.text import ocr_language

    asked = pages.where("image_only").select("path", "page", ocr_language(F.col("lang"), F.col("source")).alias("reader"))
    read = asked.mapInArrow(reader, "path string, page int, text string").withColumnRenamed("text", "__read")
    out = pages.join(read, ["path", "page"], "left")
    return out.withColumn("text", F.when(F.col("image_only"), F.coalesce("__read", "text")).otherwise(F.col("text"))).drop("__read")
