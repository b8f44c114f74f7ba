"""Structured Streaming: keyed upserts, open rejections, idle sessions and event frames.

Each function takes a streaming DataFrame and gives one, or starts a query with ``availableNow`` into a folder so that a
batch DataFrame can be read afterwards.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.running import before_sum
from corpusloom.session import checkpoint_root


def file_stream(spark: SparkSession, path: str, *, files_per_trigger: int = 8) -> DataFrame:
    """A parquet table (file or folder) as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    single = spark.read.format("binaryFile").load(path).select("path").limit(2).collect()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if len(single) == 1 and single[0][0].rstrip("/").endswith(name):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run_once(stream: DataFrame, *, mode: str = "append") -> DataFrame:
    """All that is there now, through a parquet sink in the shared folder; the result as a batch."""
    spark = stream.sparkSession
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def upsert_once(stream: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Keeps of each key the row of the greatest version: every micro-batch is reduced and appended as a delta with its
    number, so a batch that is run again overwrites its own delta; readers take the latest of all deltas."""
    spark = stream.sparkSession
    root = f"{checkpoint_root(spark)}/upsert-{uuid.uuid4().hex}"
    columns = stream.columns
    latest = lambda df: df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(F.struct(*columns), F.struct(*version)).alias("r")).select("r.*")

    def write(batch: DataFrame, number: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return latest(spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{root}/out"))


def new_keys(stream: DataFrame, key: str, *, time: str, delay: str = "7 days") -> DataFrame:
    """Rows whose key did not come before within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, *, time: str, key: str, value: str, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Counts and sums by window and key; late rows count up to the watermark's delay."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def counted_once(stream: DataFrame, *, time: str, key: str, value: str, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """``windowed_counts`` of all that is there now: each micro-batch writes the windows that it changed, under its number, into the
    shared folder (a batch that is run again overwrites its own), and the latest state of each window is read."""
    spark = stream.sparkSession
    root = f"{checkpoint_root(spark)}/windows-{uuid.uuid4().hex}"
    counts = windowed_counts(stream, time=time, key=key, value=value, width=width, delay=delay)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    counts.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    schema = counts.withColumn("number", F.lit(0)).schema
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{root}/out")
    return rows.groupBy("start", key).agg(F.max_by("n", "number").alias("n"), F.max_by("total", "number").alias("total"))


def sessions(events: DataFrame, *, time: str = "ts", key: str = "user_id", idle: str = "30 minutes") -> DataFrame:
    """Sessions that end after ``idle`` without an event: key, start, end (last event plus idle), number of events. Works on
    batches and, with a watermark set before, on streams."""
    return events.where(F.col(time).isNotNull() & F.col(key).isNotNull()).groupBy(key, F.session_window(time, idle).alias("s")).agg(F.count("*").alias("events")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


def frames(lines: DataFrame, *, stream: str = "stream_id", order: str = "seq", line: str = "line") -> DataFrame:
    """Event frames out of the lines of event streams: a blank line ends a frame, its data lines are joined; frames without
    event or data, with broken JSON, or not ended are dropped. (stream, frame, event, data)."""
    blank = F.trim(F.coalesce(line, F.lit(""))) == ""
    rows = before_sum(lines.withColumn("blank", blank).withColumn("__n", blank.cast("int")), [stream], order, "__n", "frame").drop("__n")
    part = lambda name: F.when(F.col(line).startswith(f"{name}:"), F.regexp_replace(F.col(line), f"^{name}: ?", ""))
    data = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(part("data").isNotNull(), F.struct(F.col(order).alias("o"), part("data").alias("d"))))), lambda x: x["d"]), "\n")
    out = rows.groupBy(stream, "frame").agg(F.max_by(part("event"), F.when(part("event").isNotNull(), F.col(order))).alias("event"), data.alias("data"), F.bool_or("blank").alias("ended"))
    return out.where(F.col("ended") & F.col("event").isNotNull() & (F.col("data") != "") & F.try_parse_json("data").isNotNull()).select(stream, "frame", "event", "data")
