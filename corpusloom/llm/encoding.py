"""Encoding of a corpus with a public byte-level BPE tokenizer by recursive queries.

Spark splits the texts into words (a regular expression, in the JVM); each batch of a partition is then encoded by
DuckDB inside the task, without a shuffle: rows (piece, position, token) join the merge table, each piece contracts
its leftmost pair of least rank, again and again until no pair is left, and an ordered aggregation gives each
piece's ids. Only distinct pieces of a batch are encoded; documents gather the ids of their pieces.

Pieces are words, cut further between two bytes that stand side by side in no token of the vocabulary: no merge
can cross such a place, so the cut changes nothing, and runs without spaces (Chinese, long codes) stay short.

Null and empty texts get the empty list. Special tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Fixed value: the word pattern of this family of tokenizers.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

ENCODE = """
WITH RECURSIVE step AS (
    SELECT piece, pos, token, rank, min(rank) OVER (PARTITION BY piece) AS best
    FROM (
        SELECT piece, pos, token, m.rank
        FROM (SELECT piece, pos, token, lead(token) OVER (PARTITION BY piece ORDER BY pos) AS following FROM bytes) b
        LEFT JOIN merges m ON m.first = b.token AND m.second = b.following)
  UNION ALL
    SELECT piece, pos, token, rank, min(rank) OVER (PARTITION BY piece) AS best
    FROM (
        SELECT piece, pos, token, m.rank
        FROM (
            SELECT piece, pos, token, lead(token) OVER (PARTITION BY piece ORDER BY pos) AS following
            FROM (
                SELECT piece, pos, CASE WHEN pos = place THEN best ELSE token END AS token
                FROM (
                    SELECT piece, pos, token, best, place, lag(pos) OVER (PARTITION BY piece ORDER BY pos) AS previous
                    FROM (
                        SELECT *, min(CASE WHEN rank = best THEN pos END) OVER (PARTITION BY piece) AS place
                        FROM step WHERE best IS NOT NULL))
                WHERE previous IS DISTINCT FROM place)) c
        LEFT JOIN merges m ON m.first = c.token AND m.second = c.following)
)
SELECT piece, list(token ORDER BY pos) AS ids FROM step WHERE best IS NULL GROUP BY piece ORDER BY piece
"""


class Vocabulary:
    """Merge table, byte tokens and the byte pairs inside tokens, of a file of base64 tokens and ranks."""

    def __init__(self, path: str):
        import duckdb

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.inside = np.zeros((256, 256), bool)
        first, second, rank = [], [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                self.inside[token[i - 1], token[i]] = True
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    first.append(a)
                    second.append(b)
                    rank.append(r)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB"})
        self.db.register("pairs", pa.table({"first": pa.array(first, pa.int32()), "second": pa.array(second, pa.int32()), "rank": pa.array(rank, pa.int32())}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM pairs")
        self.db.unregister("pairs")

    def encode_pieces(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order, and n + 1 offsets into them."""
        n = len(offsets) - 1
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        piece = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
        pos = (np.arange(len(raw)) - offsets[piece]).astype(np.int32)
        bytes_ = pa.table({"piece": piece, "pos": pos, "token": self.of_byte[raw]})
        self.db.register("bytes", bytes_)
        try:
            out = self.db.sql(ENCODE).to_arrow_table()
        finally:
            self.db.unregister("bytes")
        ids = out.column("ids").combine_chunks()
        if isinstance(ids, pa.ChunkedArray):
            ids = pa.concat_arrays(ids.chunks)
        return ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.concatenate(([0], np.cumsum(pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False)))).astype(np.int64)

    def encode_words(self, words: pa.Array) -> pa.Array:
        """Ids of lists of words: one list of int for each row."""
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        per_row = pa.compute.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = words.flatten().cast(pa.large_string())
        if not len(flat):
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(words) + 1, np.int32)), pa.array([], pa.int32()))
        _, offs, data = flat.buffers()
        offs = np.frombuffer(offs, np.int64, len(flat) + 1, flat.offset * 8)
        raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
        offs = offs - offs[0]
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = ~self.inside[raw[:-1], raw[1:]]
        cut[offs] = True
        ends = np.flatnonzero(cut)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())])
        coded = pieces.dictionary_encode()
        which = coded.indices.to_numpy()
        _, doffs, ddata = coded.dictionary.buffers()
        doffs = np.frombuffer(doffs, np.int64, len(coded.dictionary) + 1, coded.dictionary.offset * 8)
        ids, starts = self.encode_pieces(np.frombuffer(ddata, np.uint8)[doffs[0] : doffs[-1]], doffs - doffs[0])
        size = (starts[1:] - starts[:-1])[which]
        total = np.concatenate(([0], np.cumsum(size)))
        out = ids[np.repeat(starts[which] - total[:-1], size) + np.arange(total[-1])]
        row_words = np.concatenate(([0], np.cumsum(per_row)))
        row_ids = total[np.searchsorted(ends, offs[row_words])]
        return pa.ListArray.from_arrays(pa.array(row_ids.astype(np.int32)), pa.array(out))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(df: DataFrame, vocabulary_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, ids) for each row of ``df``, ids without special tokens (see the module).

    ``vocabulary_path`` is a file of base64 tokens and ranks on the driver's machine; Spark hands it out to the executors.
    """
    if not os.path.exists(vocabulary_path):
        raise FileNotFoundError(vocabulary_path)
    df.sparkSession.sparkContext.addFile(os.path.abspath(vocabulary_path))
    name = os.path.basename(vocabulary_path)
    words = F.coalesce(F.regexp_extract_all(F.col(text), F.lit("(?U)" + WORD), F.lit(0)), F.array().cast("array<string>"))
    rows = df.select(F.col(key).alias("key"), words.alias("words"))

    def run(batches):
        known = vocabulary(SparkFiles.get(name))
        for batch in batches:
            for first, part in _parts(batch.column("words")):
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(first, len(part)), known.encode_words(part)], ["key", "ids"])

    kind = rows.schema["key"].dataType
    return rows.mapInArrow(run, T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])).withColumnRenamed("key", key)


def _parts(words: pa.Array, most: int = 400_000):
    """Consecutive parts of at most ``most`` words each, or one longer row."""
    ends = np.cumsum(pa.compute.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(words):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield start, words.slice(start, stop - start)
        start = stop


