"""Language of documents and of segments in other languages: string kernels.

The kernel of two sentences is the number of n-grams (``n`` from 1 to 3, blended spectrum, presence only) that both
hold, over the geometric mean of their numbers. Nyström landmarks span the feature space and kernel ridge
regression, one language against the rest, is fitted on the driver on a bounded sample of labelled rows. Kernel
values with the landmarks are products of presence matrices, so landmarks, Nyström map and regression fold into one
matrix (n-gram bucket x language); a batch of sentences is scored by the product of its presence rows, which are sparse,
with it.

Each text is a chain of sentences; the best chain of languages, with a price for each change, gives the segments,
so that lone names, codes and short ends of lines stay with their neighbours.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import codepoints as cp
from corpusloom.llm import sentences

# Usual names and codes of the languages.
NAMES = {
    "en": ["en", "eng", "english", "anglais", "inglés", "英文", "英语"],
    "fr": ["fr", "fra", "fre", "français", "francais", "french", "francés", "法文", "法语"],
    "zh": ["zh", "zho", "chi", "cmn", "yue", "chinese", "chinois", "chino", "mandarin", "中文", "汉语"],
    "es": ["es", "spa", "esp", "spanish", "espagnol", "español", "espanol", "castellano"],
}
BUCKETS, ORDERS = 1 << 13, (1, 2, 3)
CHINESE = 3  # letters that a Chinese character says as much as


def known_label(label: Column) -> Column:
    """The language that a label names, null where it names none of NAMES: case and what follows - or _ don't count."""
    head = F.regexp_extract(F.lower(F.trim(label)), r"^([^-_\s(]*)", 1)
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(head.isin(names), F.lit(code)).otherwise(out)
    return out


@functools.cache
def _alphabet() -> np.ndarray:
    """Letters in lower case, all other signs as one space."""
    return np.where((cp.classes() & (cp.LETTER | cp.MARK)) > 0, cp.lower_table(), 0x20).astype(np.uint32)


def grams(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-gram buckets of each sentence: buckets, n + 1 offsets, and the number of letters (a Chinese
    character counts CHINESE)."""
    n = len(start)
    size = end - start
    owner = np.repeat(np.arange(n), size)
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    low = _alphabet()[points[at]]
    blank = low == 0x20
    keep = ~(blank & np.concatenate(([False], blank[:-1])) & np.concatenate(([False], owner[1:] == owner[:-1])))
    low, owner = low[keep].astype(np.uint64), owner[keep]
    solid = low != 0x20
    letters = np.bincount(owner[solid], weights=np.where((cp.classes()[low[solid]] & cp.CJK) > 0, CHINESE, 1), minlength=n).astype(np.int64)
    buckets, owners = [], []
    code = np.zeros(len(low), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        m = len(low) - order + 1
        if m <= 0:
            break
        code = code[:m] * np.uint64(0x100000001B3) + low[order - 1 :] + np.uint64(order)
        ok = owner[:m] == owner[order - 1 :]
        if order == 1:
            ok &= low[:m] != 0x20
        buckets.append((cp.mix(code[ok]) % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[:m][ok])
    buckets, owners = np.concatenate(buckets or [np.zeros(0, np.int64)]), np.concatenate(owners or [np.zeros(0, np.int64)])
    # presence: of equal (sentence, bucket) places the last writer stays
    out_b, out_o = [], []
    block = 256
    seen = np.empty(block * BUCKETS, np.int32)
    order = np.argsort(owners // block, kind="stable")
    buckets, owners = buckets[order], owners[order]
    cuts = np.searchsorted(owners // block, np.arange(n // block + 2))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if hi > lo:
            place = (owners[lo:hi] % block) * BUCKETS + buckets[lo:hi]
            seen[place] = np.arange(hi - lo, dtype=np.int32)
            one = seen[place] == np.arange(hi - lo)
            out_b.append(buckets[lo:hi][one])
            out_o.append(owners[lo:hi][one])
    if not out_b:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64), letters
    buckets, owners = np.concatenate(out_b), np.concatenate(out_o)
    order = np.argsort(owners, kind="stable")
    return buckets[order], np.searchsorted(owners[order], np.arange(n + 1)), letters


class LanguageModel:
    """Folded weights of the kernel ridge regression."""

    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights.astype(np.float32)

    def scores(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Regression values (sentence x language), about 1 for the language and -1 for others; number of letters."""
        out, letters = np.zeros((len(start), len(self.languages)), np.float32), np.zeros(len(start), np.int64)
        for i in range(0, len(start), 4096):
            s, e = start[i : i + 4096], end[i : i + 4096]
            buckets, offsets, letters[i : i + 4096] = grams(points, s, e)
            size = np.diff(offsets)
            rows = np.flatnonzero(size)
            if len(rows):
                for k in range(len(self.languages)):
                    out[i + rows, k] = np.add.reduceat(self.weights[buckets, k], offsets[rows]) / np.sqrt(size[rows])
        return out, letters


def _presence(points, start, end) -> np.ndarray:
    buckets, offsets, _ = grams(points, start, end)
    out = np.zeros((len(start), BUCKETS), np.float32)
    size = np.diff(offsets)
    out[np.repeat(np.arange(len(start)), size), buckets] = np.repeat(1 / np.sqrt(np.maximum(1, size)), size)
    return out


def fit(labelled: DataFrame, *, text: str = "text", label: str = "lang", per_language: int = 400, most_chars: int = 50_000, landmarks: int = 240, most_sentences: int = 900, ridge: float = 0.3) -> LanguageModel:
    """Fits the model on a bounded sample: of each language the ``per_language`` texts of least hash that have
    40 to ``most_chars`` characters, and of those at most ``most_sentences`` sentences. Sentences that the first fit puts elsewhere (wrong labels, other languages
    inside a text) are left out of the second."""
    rows = labelled.select(known_label(F.col(label)).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.length("text").between(40, most_chars))
    rows = rows.withColumn("h", F.xxhash64("text"))
    first = F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))
    sample = rows.withColumn("n", first).where(F.col("n") <= per_language).select("lang", "text").orderBy("lang", "h").toPandas()
    languages = [x for x in NAMES if (sample["lang"] == x).any()]
    if not languages:
        raise ValueError("no labelled text to fit on")
    points, start, end, row = sentences.in_usual_form(*cp.decode(pa.array(sample["text"], pa.string())))
    of = np.array([languages.index(x) for x in sample["lang"]])[row]
    long = end - start >= 12
    start, end, of = start[long], end[long], of[long]
    pick = np.random.default_rng(7).permutation(len(start))
    pick = np.concatenate([pick[of[pick] == k][:most_sentences] for k in range(len(languages))])
    start, end, of = start[pick], end[pick], of[pick]
    weights = None
    for _ in range(2):
        x = _presence(points, start, end)
        share = max(1, landmarks // len(languages))
        marks = x[np.concatenate([np.flatnonzero(of == k)[:share] for k in range(len(languages))])]
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        good = values > 1e-6 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good])
        z = (x @ marks.T).astype(np.float64) @ root
        target = np.where(of[:, None] == np.arange(len(languages)), 1.0, -1.0)
        weight = (len(of) / np.maximum(1, np.bincount(of, minlength=len(languages))))[of]
        w = np.linalg.solve(z.T @ (z * weight[:, None]) + ridge * len(languages) * np.eye(z.shape[1]), z.T @ (target * weight[:, None]))
        weights = marks.T.astype(np.float64) @ (root @ w)
        ok = (x @ weights.astype(np.float32)).argmax(axis=1) == of
        del x
        start, end, of = start[ok], end[ok], of[ok]
    return LanguageModel(languages, weights)


SWITCH, FULL = 2.0, 60


def chain(model: LanguageModel, points: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language index of each sentence by the best chain of its text, and its evidence (sentence x language)."""
    scores, letters = model.scores(points, start, end)
    evidence = scores * (np.minimum(letters, FULL) / 10)[:, None]
    n, k = evidence.shape
    out = np.zeros(n, np.int64)
    if not n:
        return out, evidence
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    size = np.diff(np.append(first, n))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    back = np.zeros((n, k), np.int8)
    state = evidence[first].astype(np.float64)
    live = len(first)
    final = np.zeros(len(first), np.int64)
    for step in range(1, int(size[0]) + 1):
        still = int(np.searchsorted(-size, -step, side="left"))  # texts with more than ``step`` sentences
        final[still:live] = state[still:live].argmax(axis=1)
        live = still
        if not live:
            break
        best = state[:live].argmax(axis=1)
        change = state[:live].max(axis=1)[:, None] - SWITCH
        stay = state[:live] >= change
        at = first[:live] + step
        back[at] = np.where(stay, np.arange(k), best[:, None])
        state = np.where(stay, state[:live], change) + evidence[at]
    now = final
    for step in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -step, side="left"))
        at = first[:live] + step
        out[at] = now[:live]
        now[:live] = back[at, now[:live]] if step else now[:live]
    return out, evidence


def segments_of(model: LanguageModel, texts: pa.Array, figure: np.ndarray) -> dict[str, np.ndarray]:
    """Segments of a batch: row, number from 1, language index, confidence, first and last sentence number. What
    stands in a figure takes the language of its caption, the first paragraph."""
    points, start, end, row = sentences.in_usual_form(*cp.decode(texts))
    new_row = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
    for i in np.flatnonzero(new_row & figure[row]):  # the tag before a caption has no language
        tag = np.flatnonzero(points[start[i] : end[i] - 1] == ord("]"))
        start[i] += tag[0] + 1 if len(tag) else 0
    lang, evidence = chain(model, points, start, end, row)
    first = np.flatnonzero(new_row)
    nth = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) + 1 if len(row) else row
    if figure.any() and len(row):
        caption = evidence[first].argmax(axis=1)
        lang = np.where(figure[row], np.repeat(caption, np.diff(np.append(first, len(row)))), lang)
    new = new_row.copy()
    if len(row):
        new[1:] |= lang[1:] != lang[:-1]
    head = np.flatnonzero(new)
    if not len(head):
        none = np.zeros(0, np.int64)
        return {"row": none, "seg_no": none, "lang": none, "confidence": none.astype(float), "first": none, "last": none}
    total = np.add.reduceat(evidence, head, axis=0).astype(np.float64)
    odds = np.exp(np.clip(total - total.max(axis=1, keepdims=True), -50, 0))
    confidence = odds[np.arange(len(head)), lang[head]] / odds.sum(axis=1)
    seg_row = row[head]
    seg_first = np.flatnonzero(np.concatenate(([True], seg_row[1:] != seg_row[:-1])))
    seg_no = np.arange(len(head)) - np.repeat(seg_first, np.diff(np.append(seg_first, len(head)))) + 1
    return {"row": seg_row, "seg_no": seg_no, "lang": lang[head], "confidence": confidence, "first": nth[head], "last": nth[np.append(head[1:], len(row)) - 1]}


def _segment_rows(rows: DataFrame, model: LanguageModel, key: str, wrong_only: bool) -> DataFrame:
    """Segments of rows (key, text, figure, label); with ``wrong_only`` of those that ``mislabelled`` reports."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        languages = shared.value.languages
        names = pa.array(languages)
        for batch in batches:
            for at, texts in cp.slices(batch.column("text"), 1 << 19):
                s = segments_of(shared.value, texts, batch.column("figure").slice(at, len(texts)).to_numpy(zero_copy_only=False))
                if wrong_only and len(s["row"]):
                    label = np.array([languages.index(x) if x in languages else -1 for x in batch.column("label").slice(at, len(texts)).to_pylist()])
                    bad = np.zeros(len(texts), bool)
                    bad[s["row"][(s["lang"] != label[s["row"]]) | (s["seg_no"] > 1)]] = True
                    s = {n: x[bad[s["row"]]] for n, x in s.items()}
                if len(s["row"]):
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(s["row"] + at)), pa.array(s["seg_no"], pa.int32()), names.take(pa.array(s["lang"])), pa.array(s["confidence"]), pa.array(s["first"], pa.int32()), pa.array(s["last"], pa.int32())], ["key", "seg_no", "lang", "confidence", "first_sent", "last_sent"])

    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("seg_no", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("first_sent", T.IntegerType()), T.StructField("last_sent", T.IntegerType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def _rows(df: DataFrame, key: str, text: str, kind: str | None, label: Column) -> DataFrame:
    figure = F.lower(F.col(kind)).eqNullSafe("figure") | F.col(text).startswith("[Figure p.") if kind else F.lit(False)
    return df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(figure, F.lit(False)).alias("figure"), label.alias("label")).where(F.length("text") > 0)


def segments(df: DataFrame, model: LanguageModel, *, key: str = "chunk_id", text: str = "text", kind: str | None = "kind") -> DataFrame:
    """One row for each longest run of sentences in one language: key, seg_no, lang, confidence, first and last
    sentence (from 1). Null, empty and blank texts have none; repeated rows repeat their segments."""
    return _segment_rows(_rows(df, key, text, kind, F.lit("")), model, key, False)


def mislabelled(df: DataFrame, model: LanguageModel, *, key: str = "chunk_id", text: str = "text", label: str = "lang", kind: str | None = "kind") -> DataFrame:
    """Segments of the texts whose label is missing, names no language or another one, and of all texts in several
    languages; each row is judged by itself, in one pass."""
    return _segment_rows(_rows(df, key, text, kind, known_label(F.col(label))), model, key, True)
