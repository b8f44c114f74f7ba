"""Lines repeated across the documents of one source: document bitmaps per line.

1. Every line gets a key of its letters and a key of its stored form (a variant). A line that comes up less often than
   the fewest documents that make it excessive in its source can't be in so many and leaves at once.
2. Documents get numbers that are dense within a partition; the documents of a variant are kept as bitmaps by source, one
   for each block of 32,768 document numbers that has any (Spark compresses what it shuffles and writes, so the empty bytes of
   a sparse one cost little).
3. The bitmaps of a line's variants are united and their bits counted: exact numbers of documents, compared with the
   source's share.
4. A line is deleted where the bit of its document is set in the bitmap of an excessive line.

A block holds at most 32,768 bits whatever the size of a source, so a source or a line with a third of all rows is
spread over many groups. At most ``1 / min_share`` times the mean number of distinct lines of a document can be
excessive, so the lookup side stays small as documents grow; Spark chooses the join by its measured size.

Rows whose document or text is null have no repeated lines; an empty text has one empty line, which never counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize


def letters(line: Column) -> Column:
    """The letters of a line in lower case, all other signs dropped."""
    return F.lower(F.regexp_replace(line, r"\P{L}+", ""))


def _bit(bitmap: Column, position: Column) -> Column:
    """Whether the bit at ``position`` is set."""
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def repeated_lines(df: DataFrame, *, key: str = "chunk_id", doc: str = "doc_id", text: str = "text", source: Column | None = None, min_docs: int = 4, min_share: float = 0.04, min_letters: int = 12) -> DataFrame:
    """Every place (key, line_no) of a line that at least ``min_docs`` documents and at least the share ``min_share``
    of the documents of its source hold. ``source`` is the document's name before the slash if not given."""
    source = F.substring_index(F.col(doc), "/", 1) if source is None else source
    rows = df.select(F.col(key).alias("key"), F.col(doc).alias("doc"), source.alias("source"), F.col(text).alias("text"))
    rows = rows.where("doc is not null and source is not null")
    docs = materialize(rows.select("source", "doc").distinct().withColumn("number", F.monotonically_increasing_id()), "documents")
    sources = docs.groupBy("source").agg(F.count("*").alias("docs"))

    lines = rows.select("key", "doc", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("letters", letters(F.col("line")))
    lines = lines.where(F.length("letters") >= min_letters)
    lines = lines.select("key", "doc", "source", (F.col("pos") + 1).alias("line_no"), F.unhex(F.md5("letters")).alias("same"), F.xxhash64(F.trim("line")).alias("variant"))
    enough = F.greatest(F.lit(min_docs).cast("double"), F.lit(min_share) * F.col("docs"))
    often = lines.groupBy("source", "same").agg(F.count("*").alias("n")).join(sources, "source").where(F.col("n") >= enough).select("source", "same")
    places = lines.join(often, ["source", "same"], "left_semi").join(docs.select("source", "doc", "number"), ["source", "doc"])
    places = places.select("key", "line_no", "source", "same", "variant", F.bitmap_bucket_number("number").alias("block"), F.bitmap_bit_position("number").alias("bit"))
    places = materialize(places, "line-places")

    variants = places.groupBy("source", "same", "variant", "block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    union = materialize(variants.groupBy("source", "same", "block").agg(F.bitmap_or_agg("bitmap").alias("bitmap")), "line-bitmaps")
    count = union.groupBy("source", "same").agg(F.sum(F.bitmap_count("bitmap")).alias("held"))
    count = count.join(sources, "source").where(F.col("held") >= enough)
    excessive = union.join(count.select("source", "same"), ["source", "same"], "left_semi")
    found = places.join(excessive, ["source", "same", "block"]).where(_bit(F.col("bitmap"), F.col("bit")))
    return found.select(F.col("key").alias(key), F.col("line_no").cast("int").alias("line_no")).distinct()


def without_repeated_lines(df: DataFrame, *, key: str = "chunk_id", text: str = "text", **options) -> DataFrame:
    """``df`` with ``text`` freed of its source's repeated lines; other columns stay. Rows that share a key share its
    deletions, so keys should be unique."""
    gone = repeated_lines(df, key=key, text=text, **options).groupBy(F.col(key).alias("id")).agg(F.collect_set("line_no").alias("numbers"))
    rows = df.select(F.col(key).alias("own"), F.col(text).alias("stored"), F.struct("*").alias("row")).join(gone, F.col("own") == F.col("id"), "left")
    kept = F.expr("array_join(filter(split(stored, '\\n'), (x, i) -> not array_contains(numbers, i + 1)), '\\n')")
    clean = F.when(F.col("numbers").isNull(), F.col("stored")).otherwise(kept)
    return rows.select(*[clean.alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns])
