"""Evaluation texts leaking into training text: Wu-Manber multi-pattern search over words.

Patterns are all windows of ``length`` consecutive words of every test passage. A block is two neighbouring
words. The shift table says, for each block, how far its last place in any pattern is from the pattern's end;
a block of no pattern lets the search skip ``length - 1`` words. Where the shift is 0, the bucket of the block
(as suffix of a pattern) and of the window's first block (as prefix) selects test windows, and their words are
compared directly. All rows of a batch are searched in step, so each step is array arithmetic.

The pattern tables go to the tasks in blocks of at most about ``items_per_block`` test items and ``chars_per_block``
characters, each block a scan of its own. One block is sent at a time: what the driver and the tasks hold has a bound whatever
the number and length of test items.

Results: one row (document key, item key) for each document that holds at least ``length`` consecutive words of
the item's passage. Null and shorter texts or passages give none; repeated rows give one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import codepoints as cp
from corpusloom.session import materialize


def _block(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the two words that end at ``at``."""
    return cp.mix(h[at - 1] * np.uint64(3) + h[at])


class Patterns:
    """Shift, suffix and prefix tables of a set of passages."""

    def __init__(self, passages: list[str | None], length: int):
        column = pa.array(passages, pa.string())
        self.points, offsets = cp.decode(column)
        self.points = cp.lower_table()[self.points]
        self.words, self.start, self.end, first = cp.words(self.points, offsets)
        self.length = length
        count = np.maximum(0, np.diff(first) - length + 1)
        item = np.repeat(np.arange(len(count)), count)
        begin = np.repeat(first[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        if not len(begin):
            self.size = 0
            return
        blocks, shifts = [], []
        for j in range(1, length):
            blocks.append(_block(self.words, begin + j))
            shifts.append(np.full(len(begin), length - 1 - j))
        blocks, shifts = np.concatenate(blocks), np.concatenate(shifts)
        order = np.lexsort((shifts, blocks))
        blocks, shifts = blocks[order], shifts[order]
        one = np.concatenate(([True], blocks[1:] != blocks[:-1]))
        self.blocks, self.shifts = blocks[one], shifts[one]
        key = self.bucket(self.words, begin + length - 1)
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.begin, self.size = key[order], item[order], begin[order], len(key)

    def bucket(self, h: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Suffix and prefix block of the windows that end at ``end``."""
        return cp.mix(_block(h, end) * np.uint64(5) + _block(h, end - self.length + 2))

    def shift(self, block: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.blocks, block), len(self.blocks) - 1)
        return np.where(self.blocks[at] == block, self.shifts[at], self.length - 1)

    def search(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of all occurrences."""
        none = np.zeros(0, np.int64)
        if not self.size:
            return none, none
        points, offsets = cp.decode(column)
        h, start, end, first = cp.words(points, offsets)
        n = self.length
        row = np.flatnonzero(np.diff(first) >= n)
        at, stop = first[row] + n - 1, first[row + 1]
        ends, rows = [], []
        while len(row):
            jump = self.shift(_block(h, at))
            hit = jump == 0
            if hit.any():
                ends.append(at[hit])
                rows.append(row[hit])
            at = at + np.maximum(jump, 1)
            go = at < stop
            row, at, stop = row[go], at[go], stop[go]
        if not ends:
            return none, none
        ends, rows = np.concatenate(ends), np.concatenate(rows)
        key = self.bucket(h, ends)
        lo, hi = np.searchsorted(self.key, key), np.searchsorted(self.key, key, side="right")
        count = hi - lo
        pattern = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        ends, rows = np.repeat(ends, count), np.repeat(rows, count)
        step = np.arange(n)
        same = (h[(ends - n + 1)[:, None] + step] == self.words[self.begin[pattern][:, None] + step]).all(axis=1)
        out_rows, out_items = [], []
        low = cp.lower_table()[points]
        seen = set()
        for r, p, e in zip(rows[same].tolist(), pattern[same].tolist(), ends[same].tolist()):
            pair = (r, int(self.item[p]))
            if pair in seen:
                continue
            b = int(self.begin[p])
            if all(np.array_equal(low[start[e - n + 1 + i] : end[e - n + 1 + i]], self.points[self.start[b + i] : self.end[b + i]]) for i in range(n)):
                seen.add(pair)
                out_rows.append(r)
                out_items.append(pair[1])
        return np.array(out_rows, np.int64), np.array(out_items, np.int64)


def leaked_items(documents: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", length: int = 12, items_per_block: int = 20_000, chars_per_block: int = 8_000_000) -> DataFrame:
    """Documents that hold ``length`` consecutive words of a test passage (see the module).

    ``items_per_block`` and ``chars_per_block`` bound what is collected and sent to the tasks at once.
    """
    documents = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    items = items.select(F.col(item).alias("item"), F.col(passage).alias("passage")).where(F.length("passage") > 0).distinct()
    schema = T.StructType([T.StructField(key, documents.schema["key"].dataType), T.StructField(item, items.schema["item"].dataType)])
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("passage")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // items_per_block), -(-size["chars"] // chars_per_block))
    found = []
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item", "passage"), F.lit(blocks)) == b).orderBy("item", "passage").toPandas()
        if not len(block):
            continue
        names = pa.array(block["item"])
        tables = documents.sparkSession.sparkContext.broadcast(Patterns(block["passage"].tolist(), length))

        def search(batches, tables=tables, names=names):
            for batch in batches:
                for first, texts in cp.slices(batch.column("text")):
                    rows, hits = tables.value.search(texts)
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows + first)), names.take(pa.array(hits))], [key, item])

        hits = documents.mapInArrow(search, schema)
        if blocks > 1:
            hits = materialize(hits.distinct(), "leaks")
            tables.destroy()
        found.append(hits)
    if not found:
        return documents.sparkSession.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()
