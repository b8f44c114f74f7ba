"""Text in one consistent form: visually identical text gets identical characters.

The whole batch is handled as one code-point array: a lookup-table gather replaces characters one to one,
expansion offsets make room for those that become several, and marks are put into canonical order and composed with their
bases by a sorted pair table (Hangul by its arithmetic). No string function runs per row.

Usual form:
* compatibility letters and digits (full-width, ligatures, mathematical alphabets, radicals, compatibility
  ideographs) become ordinary ones; every kind of space becomes a plain space, hyphens become ``-``, invisible
  format characters go; accented letters become one character;
* a Cyrillic or Greek look-alike becomes the Latin letter where its word has Latin letters too, or is made of look-alikes
  only in a text that has no more unmistakable letters of that script than Latin ones;
* line and paragraph separators become line breaks;
* full-width signs become plain ones on lines without Chinese, and stay Chinese punctuation elsewhere;
* Greek quantities, fractions, raised and circled figures, ordinary punctuation and line breaks stay.

Null stays null and empty stays empty.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import codepoints as cp

# Letters of other scripts that look like a Latin letter.
CYRILLIC = {"А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "Ӏ": "I"}
GREEK = {"Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "α": "a", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "χ": "x", "γ": "y"}
LATIN = {"ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l"}
HYPHENS = "\u2010\u2011\u2012\u2043\ufe63\u02d7"
LINE_ENDS = "\u0085\u2028\u2029"
KEPT_FORMATS = "\u061c"
# The Hangul letters and syllables that Unicode composes by arithmetic.
LEAD, VOWEL, TRAIL, SYLLABLE, VOWELS, TRAILS = 0x1100, 0x1161, 0x11A7, 0xAC00, 21, 28


@functools.cache
def _tables() -> dict[str, np.ndarray]:
    """Built from the Unicode database by rule, once in each Python worker."""
    single = np.arange(cp.SPAN, dtype=np.uint32)
    many: dict[int, str] = {}
    for i in range(cp.SPAN):
        c, parts = chr(i), unicodedata.decomposition(chr(i))
        if unicodedata.category(c) == "Cf" and c not in KEPT_FORMATS or 0xFE00 <= i <= 0xFE0F or 0xE0100 <= i <= 0xE01EF or i == 0x034F:
            many[i] = ""
            continue
        if not parts or 0xAC00 <= i <= 0xD7A3:
            continue
        tag = parts.split()[0] if parts[0] == "<" else ""
        form = unicodedata.normalize("NFKC" if tag else "NFC", c)
        plain = all(unicodedata.category(x)[0] in "LN" for x in form)
        if tag in ("", "<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>") and (plain or not tag or tag == "<narrow>") or tag == "<compat>" and plain and i not in (0xB5, 0x17F) and not 0x2460 <= i <= 0x24FF:
            if form != c:
                if len(form) == 1:
                    single[i] = ord(form)
                else:
                    many[i] = form
    for i in range(0x10000):
        if unicodedata.category(chr(i)) == "Zs":
            single[i] = 0x20
    for c in HYPHENS:
        single[ord(c)] = 0x2D
    for c, to in LATIN.items():
        single[ord(c)] = ord(to)
    wide = np.arange(cp.SPAN, dtype=np.uint32)  # signs that depend on the line
    for i in range(0xFF01, 0xFF5F):
        if single[i] == i:
            wide[i] = i - 0xFEE0
    for c in LINE_ENDS:
        single[ord(c)] = 0x0A
    length = np.ones(cp.SPAN, np.int8)
    start = np.zeros(cp.SPAN, np.int32)
    pool: list[int] = []
    for i, form in many.items():
        length[i], start[i] = len(form), len(pool)
        pool += map(ord, form)
    like = np.zeros(cp.SPAN, np.uint32)
    script = np.zeros(cp.SPAN, np.uint8)  # 1 Latin, 2 Cyrillic, 4 Greek
    for i in [*range(0x41, 0x250), *range(0x1E00, 0x1F00)]:
        if unicodedata.category(chr(i))[0] == "L":
            script[i] = 1
    script[0x400:0x530] = 2
    script[0x370:0x400] = 4
    for table in (CYRILLIC, GREEK):
        for c, to in table.items():
            like[ord(c)] = ord(to)
    keys, values = [], []
    for i in range(cp.SPAN):
        parts = unicodedata.decomposition(chr(i))
        if parts and parts[0] != "<" and len(parts.split()) == 2 and unicodedata.normalize("NFC", chr(i)) == chr(i):
            a, b = (int(x, 16) for x in parts.split())
            keys.append(a << 21 | b)
            values.append(i)
    order = np.argsort(np.array(keys, np.uint64))
    combining = np.zeros(cp.SPAN, bool)
    combining[[v & 0x1FFFFF for v in keys]] = True
    order_class = np.array([unicodedata.combining(chr(i)) for i in range(cp.SPAN)], np.uint8)
    dirty = (single != np.arange(cp.SPAN)) | (length != 1) | (wide != np.arange(cp.SPAN)) | (like > 0) | combining | (order_class > 0)
    dirty[VOWEL : VOWEL + VOWELS] = dirty[TRAIL + 1 : TRAIL + TRAILS] = True
    return {"order": order_class, "single": single, "length": length, "start": start, "pool": np.array(pool or [0], np.uint32), "wide": wide, "like": like, "script": script, "pairs": np.array(keys, np.uint64)[order], "composed": np.array(values, np.uint32)[order], "combining": combining, "dirty": dirty}


def _expand(points: np.ndarray, offsets: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    length = t["length"][points].astype(np.int64)
    ends = np.zeros(len(points) + 1, np.int64)
    np.cumsum(length, out=ends[1:])
    source = np.repeat(np.arange(len(points)), length)
    out = t["single"][points[source]]
    more = length[source] > 1
    nth = np.arange(len(out)) - ends[source]
    out[more] = t["pool"][t["start"][points[source[more]]] + nth[more]]
    return out, ends[offsets]


def _without(points: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.zeros(len(points) + 1, np.int64)
    np.cumsum(keep, out=ends[1:])
    return points[keep], ends[offsets]


def _hangul(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of a syllable become the syllable: lead and vowel, then what ends it."""
    for lead in (True, False):
        first = np.zeros(len(points) + 1, bool)
        first[offsets] = True
        base, after = points[:-1].astype(np.int64), points[1:].astype(np.int64)
        if lead:
            hit = (base >= LEAD) & (base < LEAD + 19) & (after >= VOWEL) & (after < VOWEL + VOWELS)
            new = SYLLABLE + ((base - LEAD) * VOWELS + after - VOWEL) * TRAILS
        else:
            hit = (base >= SYLLABLE) & (base < 0xD7A4) & ((base - SYLLABLE) % TRAILS == 0) & (after > TRAIL) & (after < TRAIL + TRAILS)
            new = base + after - TRAIL
        at = np.flatnonzero(hit & ~first[1:-1])
        if len(at):
            points = points.copy()
            points[at] = new[at]
            keep = np.ones(len(points), bool)
            keep[at + 1] = False
            points, offsets = _without(points, offsets, keep)
    return points, offsets


def _compose(points: np.ndarray, offsets: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Puts the marks of each letter in canonical order and joins them to it, as far as that gives one character and no
    mark of the same class stands between."""
    first = np.zeros(len(points) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    order = t["order"][points]
    mark = (t["combining"][points] | (order > 0)) & ~first
    if not mark.any():
        return points, offsets
    if (mark[1:] & (order[1:] > 0) & (order[:-1] > order[1:])).any():
        put = np.lexsort((order, np.cumsum((order == 0) | first)))
        points, order = points[put], order[put]
        mark = (t["combining"][points] | (order > 0)) & ~first
    points = points.copy()
    keep = np.ones(len(points), bool)
    at = np.flatnonzero(mark & ~np.concatenate(([False], mark[:-1])))
    base, last = at - 1, np.zeros(len(at), np.uint8)  # the letter, and the class of the mark left before
    while len(at):
        key = points[base].astype(np.uint64) << np.uint64(21) | points[at]
        found = np.minimum(np.searchsorted(t["pairs"], key), len(t["pairs"]) - 1)
        free = (last < order[at]) | (last == 0) & (order[at] == 0)
        hit = (t["pairs"][found] == key) & free
        points[base[hit]] = t["composed"][found[hit]]
        keep[at[hit]] = False
        letter = ~hit & (order[at] == 0)
        base, last = np.where(letter, at, base), np.where(hit, last, order[at])
        at = at + 1
        go = at < len(points)
        go[go] = mark[at[go]]
        at, base, last = at[go], base[go], last[go]
    return _without(points, offsets, keep)


def _runs(flag: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``flag``, none across a position of ``cut``."""
    before = np.concatenate(([False], flag[:-1]))
    starts = np.flatnonzero(flag & (~before | cut[:-1]))
    after = np.concatenate((flag[1:], [False]))
    ends = np.flatnonzero(flag & (~after | cut[1:])) + 1
    return starts, ends


def _lookalikes(points: np.ndarray, offsets: np.ndarray, t: dict) -> np.ndarray:
    """A word's Cyrillic and Greek look-alikes become Latin where the word has Latin letters, or is nothing but look-alikes in a
    text that is not of their script; a lone small Greek letter stays a quantity."""
    like = t["like"][points]
    if not like.any():
        return points
    script = t["script"][points]
    cut = np.zeros(len(points) + 1, bool)
    cut[offsets] = True
    starts, ends = _runs(script > 0, cut)
    sizes = ends - starts
    count = lambda mask: np.add.reduceat(np.append(mask, False).astype(np.int32), starts) if len(starts) else np.zeros(0, int)
    # reduceat sums up to the next start, so characters between words must count nothing
    latin, foreign, other = count(script == 1), count((script > 1) & (like > 0)), count((script > 1) & (like == 0))
    greek_only = count((script == 4) & (like > 0))
    capital = np.isin(points[starts], [ord(c) for c in GREEK if c.isupper()])
    quantity = (sizes == 1) & (greek_only == 1) & ~capital
    # unmistakable letters of the whole text
    row = cp.row_of(offsets)
    in_row = lambda mask: np.bincount(row[mask], minlength=len(offsets) - 1)
    of = row[starts]
    cyrillic, greek = in_row((script == 2) & (like == 0)), in_row((script == 4) & (like == 0) & (points != 0x394) & (points != 0x3BC))
    foreign_text = np.where(script[starts] == 4, greek[of], cyrillic[of]) > in_row(script == 1)[of]
    turn = (foreign > 0) & ~quantity & ((latin > 0) | (other == 0) & ~foreign_text)
    word = np.repeat(turn, sizes)
    at = np.concatenate([np.zeros(0, np.int64), np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())])
    at = at[word].astype(np.int64)
    at = at[like[at] > 0]
    points = points.copy()
    points[at] = like[at]
    return points


def _wide_signs(points: np.ndarray, offsets: np.ndarray, t: dict) -> np.ndarray:
    """Full-width signs become plain ones on lines without Chinese."""
    plain = t["wide"][points]
    if (plain == points).all():
        return points
    line_start = np.zeros(len(points) + 1, bool)
    line_start[offsets] = True
    line_start[1:] |= points == 0x0A
    line = np.cumsum(line_start[:-1])
    chinese = np.zeros(line[-1] + 1, bool)
    chinese[line[(cp.classes()[points] & cp.CJK) > 0]] = True
    return np.where(chinese[line], points, plain)


def normalize_points(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The usual form of a batch. Rows without a character that could change are copied as they are."""
    t = _tables()
    hit = t["dirty"][points]
    if not hit.any():
        return points, offsets
    total = np.zeros(len(points) + 1, np.int64)
    np.cumsum(hit, out=total[1:])
    rows = (total[offsets[1:]] - total[offsets[:-1]]) > 0
    mask = np.repeat(rows, np.diff(offsets))
    sizes = np.diff(offsets)[rows]
    sub, sub_offsets = points[mask], np.concatenate(([0], np.cumsum(sizes)))
    sub, sub_offsets = _expand(sub, sub_offsets, t)
    sub, sub_offsets = _compose(*_hangul(sub, sub_offsets), t)
    sub = _lookalikes(sub, sub_offsets, t)
    sub, sub_offsets = _compose(sub, sub_offsets, t)  # marks on letters that were of another script
    sub = _wide_signs(sub, sub_offsets, t)
    lengths = np.diff(offsets).copy()
    lengths[rows] = np.diff(sub_offsets)
    out_offsets = np.concatenate(([0], np.cumsum(lengths)))
    out = np.empty(out_offsets[-1], np.uint32)
    to = np.repeat(rows, lengths)
    out[to], out[~to] = sub, points[~mask]
    return out, out_offsets


def normalize_array(column: pa.Array) -> pa.Array:
    points, offsets = cp.decode(column)
    out, out_offsets = normalize_points(points, offsets)
    if out is points:
        return column.cast(pa.string())
    return cp.encode(out, out_offsets, np.asarray(column.is_null()))


@F.arrow_udf(T.StringType())
def _usual_form(column: pa.Array) -> pa.Array:
    return normalize_array(column)


def usual_form(column: Column | str) -> Column:
    """The usual form of a text column (see the module)."""
    return _usual_form(column)


@F.arrow_udf(T.StringType())
def _usual_form_once(column: pa.Array) -> pa.Array:
    return normalize_array(column)


# so declared, a filter on the result does not compute it a second time
_usual_form_once = _usual_form_once.asNondeterministic()


def form_hash(column: Column) -> Column:
    """SHA-256 of a text with each run of white space made one space, ends stripped, in lower case."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(column, r"(?U)\s+", " "))), 256)


def normalize_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` in usual form; other columns, order and names stay."""
    return df.withColumns({c: usual_form(F.col(f"`{c}`")) for c in columns})


def changed_fields(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row (key, field_name, form_hash) for each field that is not in its usual form.

    Null and empty fields are in their usual form. Repeated rows give repeated results.
    """
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(f"`{c}`").cast("string").alias("stored")) for c in columns]))
    rows = df.select(F.col(f"`{key}`").alias(key), fields.alias("f")).select(key, "f.*")
    # plain ASCII is always in its usual form, so it never crosses to Python
    rows = rows.where(F.col("stored").rlike(r"[^\x00-\x7F]")).withColumn("form", _usual_form_once("stored"))
    return rows.where(F.col("form") != F.col("stored")).select(key, "field_name", form_hash(F.col("form")).alias("form_hash"))
