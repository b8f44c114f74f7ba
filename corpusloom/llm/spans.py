"""Long exact spans shared between records: hashing of lines and the sentences in them.

Units are lines, and in them sentences; a unit is normalised (lower case, no white space) before it is hashed.

``repeated_lines``, ``without_repeats``: digests of lines are grouped globally, the occurrence of least rank is kept, all
others are reported with their offsets in the stored text, or removed from it.

``shared_characters``: a window of ``length`` characters stands for the longest whole sentence or line in it, of equal ones
the first; a window without any (a long line) for its least-hashed gram of ``gram`` characters (half the length). So every window has one unit, and
two equal windows have equal units whatever stands around them.

1. A block is a range of windows of one unit. Digests of units are grouped globally; only blocks whose unit several
   records hold go on.
2. Verbatim text decides, coarse to fine: the text of a whole block (128 bits) that several records hold is shared whole.
   Of the others, parts of ``STEP`` windows, counted from the unit's beginning, are compared, and of parts that are not
   shared as a whole but whose windows have a text in common with another record each window.
3. The shared ranges of a record are merged and their characters counted once.

Nothing pairs records with each other, so a text with many copies costs no more than as many different texts; grouping is
by hash with partial aggregation, and a hot digest is split by adaptive skew handling in the join that carries its flag
back. Of records that share a block, two stand for it where others may share a part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import codepoints as cp
from corpusloom.llm.sentences import FULL_STOPS, STOPS
from corpusloom.session import materialize

PIECE = 1 << 19
STEP = 12


def _pieces(points: np.ndarray, offsets: np.ndarray, length: int):
    """(row, start, points) of pieces of at most PIECE windows; pieces of a row overlap by length - 1."""
    for row in range(len(offsets) - 1):
        lo, hi = int(offsets[row]), int(offsets[row + 1])
        for start in range(lo, hi - length + 1, PIECE):
            yield row, start - lo, points[start : min(hi, start + PIECE + length - 1)]


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values) - width + 1
    pad = -len(values) % width
    full = np.concatenate((values, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def blocks(points: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Blocks of a batch: row, lo and hi (first and last window), at (place of the unit) and unit (its digest)."""
    names = ("row", "lo", "hi", "at", "unit")
    done, parts, size = [], [], 0
    for piece in _pieces(points, offsets, length):
        parts.append(piece)
        size += len(piece[2])
        if size > PIECE:
            done.append(_blocks(parts, length, gram))
            parts, size = [], 0
    if parts:
        done.append(_blocks(parts, length, gram))
    return {n: np.concatenate([d[n] for d in done]) if done else np.zeros(0, np.int64) for n in names}


def _blocks(pieces: list[tuple[int, int, np.ndarray]], length: int, gram: int) -> dict[str, np.ndarray]:
    rows, starts, parts = (list(x) for x in zip(*pieces))
    flat = np.concatenate(parts)
    begin = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    space = (cp.classes()[flat] & cp.SPACE) > 0
    # a unit begins after a line's end, or after a sentence's end and white space: two characters tell
    new = np.zeros(len(flat), bool)
    new[1:] = (flat[:-1] == 0x0A) | np.isin(flat[:-1], FULL_STOPS)
    new[2:] |= space[1:-1] & np.isin(flat[:-2], STOPS)
    unit = np.flatnonzero(new & ~space)
    # stretches of windows with the same whole units
    owner = np.searchsorted(begin, unit, side="right") - 1
    last = begin[1:] - length
    change = np.concatenate((unit - 1, unit + 1 - length))
    inside = (change >= np.tile(begin[owner], 2)) & (change <= np.tile(last[owner], 2))
    lo = np.unique(np.concatenate((begin[:-1], change[inside])))
    piece = np.searchsorted(begin, lo, side="right") - 1
    hi = np.append(lo[1:] - 1, last[-1])
    hi = np.minimum(hi, last[piece])
    first, stop = np.searchsorted(unit, lo + 2), np.searchsorted(unit, lo + length) - 1
    size = np.diff(unit, append=len(flat))
    best, many = first.copy(), stop - first
    for k in range(1, int(many.max(initial=0))):
        some = np.flatnonzero(many > k)
        longer = some[size[first[some] + k] > size[best[some]]]
        best[longer] = first[longer] + k
    whole = many > 0
    # unit digests, normalised
    kept = np.concatenate(([0], np.cumsum(~space)))
    prefix = cp.prefix_hash(cp.random_table(1)[cp.lower_table()[flat[~space]]])
    at = unit[best[whole]]
    digest = cp.mix(cp.span_hash(prefix, kept[at], kept[at + size[best[whole]]]))
    out = [(piece[whole], lo[whole], hi[whole], at, digest)]
    if not whole.all():
        bare = np.flatnonzero(~whole)
        head = np.flatnonzero(np.concatenate(([True], (np.diff(bare) > 1) | (np.diff(piece[bare]) > 0))))
        tail = np.append(head[1:], len(bare)) - 1
        out.append(_without_units(flat, piece[bare[head]], lo[bare[head]], hi[bare[tail]], length, gram))
    piece, lo, hi, at, digest = (np.concatenate(x) for x in zip(*out))
    # neighbouring stretches of one unit are one block
    order = np.lexsort((lo, piece))
    piece, lo, hi, at, digest = piece[order], lo[order], hi[order], at[order], digest[order]
    head = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]) | (at[1:] != at[:-1]) | (digest[1:] != digest[:-1]))))
    tail = np.append(head[1:], len(lo)) - 1
    shift = np.array(starts)[piece[head]] - begin[piece[head]]
    return {"row": np.array(rows)[piece[head]], "lo": lo[head] + shift, "hi": hi[tail] + shift, "at": at[head] + shift, "unit": digest[head]}


def _without_units(flat: np.ndarray, piece: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int, gram: int):
    """Blocks of stretches of windows without a whole unit: their least-hashed grams."""
    size = hi - lo + length
    begin = np.concatenate(([0], np.cumsum(size)))
    text = flat[np.arange(size.sum()) - np.repeat(begin[:-1], size) + np.repeat(lo, size)]
    prefix = cp.prefix_hash(cp.random_table(2)[text])
    place = np.arange(len(text) - gram + 1)
    h = cp.mix(cp.span_hash(prefix, place, place + gram))
    key = (h >> np.uint64(24) << np.uint64(24)) | (place & 0xFFFFFF).astype(np.uint64)
    pos = (_sliding_min(key, length - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    window = np.arange(len(pos))
    pos += window & ~0xFFFFFF
    pos += np.where(pos < window, 1 << 24, 0)
    of = np.searchsorted(begin, window, side="right") - 1
    valid = window + length <= begin[of + 1]
    window, pos, of = window[valid], pos[valid], of[valid]
    head = np.flatnonzero(np.concatenate(([True], (pos[1:] != pos[:-1]) | (of[1:] != of[:-1]))))
    tail = np.append(head[1:], len(pos)) - 1
    shift = lo[of[head]] - begin[of[head]]
    return piece[of[head]], window[head] + shift, window[tail] + shift, pos[head] + shift, h[pos[head]]


def _blocks_of(length: int, gram: int):
    def run(batches):
        for batch in batches:
            for first, texts in cp.slices(batch.column("text"), PIECE):
                b = blocks(*cp.decode(texts), length, gram)
                if len(b["row"]):
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(b["row"] + first)), *(pa.array(b[n].astype(np.int32)) for n in ("lo", "hi", "at")), pa.array(b["unit"].view(np.int64))], ["key", "lo", "hi", "at", "unit"])

    return run


def _parts_of(length: int, step: int | None):
    """The parts of ``step`` windows of each record's ranges (whole ranges without it): key, lo, hi, at, core (what all windows
    of the part have in common; of whole ranges their unit) and two 64-bit digests of the part's text."""

    def run(batches):
        for batch in batches:
            for first, texts in cp.slices(batch.column("text"), PIECE):
                points, offsets = cp.decode(texts)
                listed = batch.column("ranges").slice(first, len(texts))
                row = np.repeat(np.arange(len(texts)), pa.compute.list_value_length(listed).fill_null(0).to_numpy(zero_copy_only=False))
                ranges = listed.flatten()
                lo, hi, at, unit = (ranges.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("lo", "hi", "at", "unit"))
                fits = hi + length <= np.diff(offsets)[row]  # texts of one key that differ
                row, lo, hi, at, core = row[fits], lo[fits], hi[fits], at[fits], unit[fits]
                if not len(row):
                    continue
                prefix = [cp.prefix_hash(cp.random_table(seed)[points]) for seed in (2, 3)]
                if step:
                    least, most = (at - hi) // step, (at - lo) // step
                    times = most - least + 1
                    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(least, times)
                    row, lo, hi, at = (np.repeat(x, times) for x in (row, lo, hi, at))
                    top = at - step * nth
                    lo, hi = np.maximum(lo, top - step + 1), np.minimum(hi, top)
                    core = cp.mix(cp.span_hash(prefix[0], offsets[row] + top, offsets[row] + top - step + 1 + length)).view(np.int64)
                extent = (at - lo).astype(np.uint64) * np.uint64(0x9E3779B1) + (hi - lo).astype(np.uint64)
                if step == 1:
                    extent = np.uint64(0)
                a, b = (cp.mix(cp.span_hash(p, offsets[row] + lo, offsets[row] + hi + length) + extent).view(np.int64) for p in prefix)
                for i in range(0, len(row), 200_000):
                    s = slice(i, i + 200_000)
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row[s] + first)), *(pa.array(x[s].astype(np.int32)) for x in (lo, hi, at)), *(pa.array(x[s]) for x in (core, a, b))], ["key", "lo", "hi", "at", "core", "a", "b"])

    return run


def _judged(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts that several records hold as a whole, and those that may be shared in part: such whose core several records hold,
    of parts shared as a whole two for all."""
    digests = parts.groupBy("core", "a", "b").agg(F.min("key").alias("lo_key"), F.max("key").alias("hi_key"))
    cores = digests.groupBy("core").agg(F.min("lo_key").alias("one"), F.max("hi_key").alias("other"), F.count("*").alias("kinds")).where("one != other").select("core", "kinds")
    marked = digests.join(cores, "core").withColumn("whole", F.col("lo_key") != F.col("hi_key"))
    judged = parts.join(marked, ["core", "a", "b"])
    return judged.where("whole").select("key", "lo", "hi"), judged.where("not whole or kinds > 1 and key in (lo_key, hi_key)")


def _ranges(parts: DataFrame, unit: str) -> DataFrame:
    return parts.groupBy("key").agg(F.collect_set(F.struct("lo", "hi", "at", F.col(unit).alias("unit"))).alias("ranges"))


def shared_characters(df: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = 300, gram: int | None = None) -> DataFrame:
    """One row (key, shared_chars) for each record with spans of at least ``length`` code points (4 at least) that another
    record (another key) holds verbatim. Null, empty and shorter texts have none; rows repeated under one key count once, rows
    without a key not at all."""
    gram = gram or length // 2
    if length < 4 or not 0 < gram <= length:
        raise ValueError("length must be 4 at least, gram between 1 and length")
    records = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where((F.length("text") >= length) & F.col("key").isNotNull())
    kind = records.schema["key"].dataType
    fields = lambda *more: T.StructType([T.StructField("key", kind), *(T.StructField(n, T.IntegerType()) for n in ("lo", "hi", "at")), *(T.StructField(n, T.LongType()) for n in more)])
    parts_of = lambda texts, step: texts.mapInArrow(_parts_of(length, step), fields("core", "a", "b"))

    found = materialize(records.mapInArrow(_blocks_of(length, gram), fields("unit")), "blocks")
    held = found.groupBy("unit").agg(F.min("key").alias("one"), F.max("key").alias("other")).where("one != other").select("unit")
    ranges = materialize(_ranges(found.join(held, "unit"), "unit"), "ranges")
    # Spark broadcasts the ranges where their files are small and joins by sorting elsewhere
    texts = materialize(records.join(ranges, "key"), "texts")
    whole, open_ = _judged(materialize(parts_of(texts, None), "whole-blocks"))
    texts = texts.select("key", "text")
    edges = materialize(_ranges(open_, "core"), "edges")
    part, open_ = _judged(materialize(parts_of(texts.join(edges, "key"), STEP), "parts"))
    last = materialize(_ranges(open_, "core"), "ends")
    windows = materialize(parts_of(texts.join(last, "key"), 1), "windows")
    several = windows.groupBy("a", "b").agg((F.min("key") != F.max("key")).alias("several")).where("several").select("a", "b")
    single = windows.join(several, ["a", "b"]).select("key", "lo", "hi")

    spans = whole.unionByName(part).unionByName(single)
    spans = spans.select("key", F.col("lo").cast("long").alias("lo"), (F.col("hi") + length).cast("long").alias("hi"))
    before = F.max("hi").over(W.partitionBy("key").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("more", F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", F.coalesce(before, F.lit(0)))))
    return spans.groupBy(F.col("key").alias(key)).agg(F.sum("more").alias("shared_chars"))


def _lines_of(least: int):
    def run(batches):
        for batch in batches:
            for first, texts in cp.slices(batch.column("text"), PIECE):
                points, offsets = cp.decode(texts)
                if not len(points):
                    continue
                solid = (cp.classes()[points] & cp.SPACE) == 0
                kept = np.concatenate(([0], np.cumsum(solid)))
                low = cp.lower_table()[points[solid]]
                prefix = [cp.prefix_hash(cp.random_table(seed)[low]) for seed in (1, 3)]
                start = np.unique(np.concatenate((offsets[:-1], np.flatnonzero(points == 0x0A) + 1)))
                start = start[start < len(points)]
                row = np.searchsorted(offsets, start, side="right") - 1
                end = np.append(start[1:], len(points))
                end -= (points[end - 1] == 0x0A) & (end > start)
                # of a line that only a text's end follows the next row's start is the end
                end = np.minimum(end, offsets[row + 1])
                number = np.arange(len(start)) - np.searchsorted(row, row) + 1
                long = kept[end] - kept[start] >= least
                row, start, end, number = row[long], start[long], end[long], number[long]
                a, b = (cp.mix(cp.span_hash(p, kept[start], kept[end])).view(np.int64) for p in prefix)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row + first)), *(pa.array(x.astype(np.int32)) for x in (number, start - offsets[row], end - offsets[row])), pa.array(a), pa.array(b)], ["key", "line_no", "lo", "hi", "a", "b"])

    return run


def repeated_lines(df: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = 40) -> DataFrame:
    """Every occurrence but the first of a line of at least ``least`` characters (case and white space apart): (key, line_no
    from 1, lo, hi: code points of the stored text, first_key, first_line). Occurrences rank by key, then line. Null and empty
    texts have no lines, rows without a key don't count; keys should be unique."""
    records = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where((F.length("text") >= least) & F.col("key").isNotNull())
    kind = records.schema["key"].dataType
    fields = T.StructType([T.StructField("key", kind), *(T.StructField(n, T.IntegerType()) for n in ("line_no", "lo", "hi")), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    lines = materialize(records.mapInArrow(_lines_of(least), fields), "lines")
    rank = F.struct("key", "line_no")
    first = lines.groupBy("a", "b").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where("first != last").select("a", "b", "first")
    again = lines.join(first, ["a", "b"]).where(rank != F.col("first"))
    return again.select(F.col("key").alias(key), "line_no", "lo", "hi", F.col("first.key").alias("first_key"), F.col("first.line_no").alias("first_line"))


def without_repeats(df: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = 40) -> DataFrame:
    """``df`` with ``text`` freed of the lines that stand before it in another place (see ``repeated_lines``); other columns stay,
    and so do texts without such lines."""
    gone = repeated_lines(df, key=key, text=text, least=least).groupBy(F.col(key).alias("__id")).agg(F.collect_set("line_no").alias("__numbers"))
    gone = materialize(gone, "repeats")
    out = df.join(gone, F.col(key) == F.col("__id"), "left")
    kept: Column = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains("__numbers", i + 1)), "\n")
    return out.withColumn(text, F.when(F.col("__numbers").isNull(), F.col(text)).otherwise(kept)).select(*df.columns)
