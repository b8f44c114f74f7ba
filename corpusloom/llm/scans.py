"""Noise of scanned pages: furniture, divided words and misread words.

1. The chunks of image-only pages are found by their page; a chunk that stands as text on another version's page of the
   same number is none.
2. Lines are read in pairs (a line and the next), and logistic classifiers of line pairs decide on furniture and joins. One
   tells running headers from text (fitted on lines that come back at the top of a document's pages and on lines from inside
   pages), one page numbers among short first and last lines (fitted on those with a clean number and on lines from inside pages), one whether a hyphen at a line's end parts a word or is its own (fitted on pairs of which the vocabulary
   knows one form better). Each is fitted on the driver on a bounded sample (``most`` lines of each kind) and applied to
   all; without a sample of a kind there is nothing to decide on, and no line is furniture.
3. Words that the vocabulary of all other chunks lacks get candidates by an inverted join on positional character
   q-grams. Gradient-boosted trees rank the candidates (edit distance, shared q-grams, how often the same letters are
   confused over all pages, frequency, agreement at the ends); they are fitted on a bounded sample of vocabulary words
   that are corrupted by the confusions found. Numbers with letters in them are read as digits.

Words are runs of letters and digits of one script: text between Chinese characters, long dashes and slashes between words
is looked at by itself. Chinese characters that were read wrongly are not corrected, they have no words to be looked up in.

A word that no candidate explains stays as it is. Null and empty texts have no lines to repair, rows without chunk_id or
doc_id no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.session import materialize

# Letters read for digits, the signs that end a divided line, white space, and invisible characters.
DIGITS = {"o": "0", "O": "0", "D": "0", "Q": "0", "l": "1", "I": "1", "i": "1", "|": "1", "z": "2", "Z": "2", "S": "5", "s": "5", "b": "6", "G": "6", "B": "8", "g": "9", "q": "9"}
HYPHENS = "-\u2010\u2011\u00ac\u00ad"
WHITE = " \t\n\x0b\x0c\r\u0085\u00a0\u2028\u2029\u202f\u3000"
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# A whole word of Latin letters in lower case, with hyphens of its own.
WORD = r"(?<![\p{L}\p{M}])(?<![\p{L}\p{M}]-)[a-z\u00df-\u024f]++(?:-[a-z\u00df-\u024f]++)*+(?!-?[\p{L}\p{M}])"
PAGE_NO = re.compile(r"^[\W_]*(?:(?:page|p\.?)\s*)?(?:[0-9lOoISsBZz]{1,4}|[ivxlcdm]{1,7})(?:\s*(?:of|sur|de|/)\s*[0-9lOoISsBZz]{1,4})?[^\w.,;:]*$", re.IGNORECASE)
CODE = re.compile(r"^(?:[A-Z]\d{2,6}|[A-Z]{1,3}-[A-Z]{2,5}|\d{2,3}-\d{2,3}|[A-Z]{2,})$")
EDGE = ".,;:!?()[]«»\"“”…"
RUN = re.compile(r"[^\s\u2013\u2014\u3000-\u303f\u3400-\u9fff\uf900-\ufaff\uff00-\uffef]+")
SLASH = re.compile(r"(?<=[^\W\d_]{2})/(?=[^\W\d_]{2})")
LINES = "chunk_id long, doc_id string, line_no int, role string, value string, features array<double>"


def scanned_chunks(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """chunk_id, doc_id and text of the chunks of image-only pages, figures left out."""
    form = F.xxhash64(F.lower(F.translate("text", WHITE, "")))
    scanned = pages.where("image_only").select("doc_id", "page").distinct()
    typed = pages.where("not image_only and length(text) > 0").select("doc_id", "page", form.alias("form")).distinct()
    rows = chunks.where("chunk_id is not null and doc_id is not null and length(text) > 0 and not (lower(kind) <=> 'figure') and not startswith(text, '[Figure p.')").select("chunk_id", "doc_id", "page", "text")
    rows = rows.join(scanned, ["doc_id", "page"], "left_semi").withColumn("form", form)
    return rows.join(typed, ["doc_id", "page", "form"], "left_anti").select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), "text")


def _pair(line: str, following: str, median: float) -> list[float]:
    """Features of a line and the next one."""
    words = re.findall(r"[^\W\d_]+", line)
    letters = sum(map(len, words)) or 1
    return [
        sum(w[:1].isupper() for w in words) / max(1, len(words)),
        sum(c.isupper() for c in line) / letters,
        float(line.rstrip()[-1:] in ".,;:-\u00ac"),
        float(following[:1].isupper()),
        float(re.search(r"\S {2,}\S", line) is not None),
        len(line) / max(1.0, median),
        float(re.search(r"\d:\d|\d\.\d", line) is not None),
        float(len(words)),
        sum(c.isdigit() or c in DIGITS for c in line) / max(1, sum(c.isalnum() for c in line)),
        float(re.search(r"^\W|[\W_]$", line.strip()) is not None),
    ]


def _logistic(sample: DataFrame) -> Column:
    """Probability of label 1 for ``features``, fitted on the driver on a bounded sample (features, label)."""
    rows = sample.select("features", "label").toPandas()
    if not len(rows):
        return F.lit(0.5)
    x, y = np.array(rows["features"].tolist(), np.float64), rows["label"].to_numpy(np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w, ridge = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, 0.01 * len(x)), 1e-3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
    odds = F.lit(float(w[-1]))
    for i in range(len(mean)):
        odds = odds + (F.col("features")[i] - float(mean[i])) * float(w[i] / scale[i])
    return 1 / (1 + F.exp(-odds))


def _runs(line: str) -> list[str]:
    return [x for run in RUN.findall(line) for x in SLASH.split(run)]


def _read_page(chunk: int, doc: str, text: str) -> Iterator[tuple]:
    """Rows of LINES: what may be page numbers (with features and, last, whether they hold a clean number), lines at the top
    and inside, divided words and the other words."""
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip()]
    if not full:
        return
    sizes = sorted(len(lines[i]) for i in full)
    median = float(sizes[len(sizes) // 2])
    numbers = {i for i in (*full[:2], *full[-1:]) if PAGE_NO.match(lines[i].strip()) and len(full) > 1}
    body = [i for i in full if i not in numbers]
    for i in sorted(numbers):
        following = next((lines[k].strip() for k in full if k > i), "")
        clean = re.search(r"(?<!\w)\d+(?!\w)", lines[i]) is not None
        yield chunk, doc, i + 1, "number", lines[i], [*_pair(lines[i], following, median), float(clean)]
    carried = False
    for k, i in enumerate(body):
        line = lines[i].strip()
        following = lines[body[k + 1]].strip() if k + 1 < len(body) else ""
        role = "top" if k == 0 and i in full[:2] else "inner"
        yield chunk, doc, i + 1, role, line, _pair(lines[i], following, median)
        words = _runs(line)
        if carried:
            words = words[1:]
        carried = False
        if words and following and re.search(rf"[^\W\d_][{HYPHENS}]$", words[-1]) and re.match(r"[^\W\d_]", following) and following[:1].islower():
            left, right = words.pop()[:-1].lstrip(EDGE), _runs(following)[0].rstrip(EDGE)
            yield chunk, doc, i + 1, "hyphen", f"{left}|{right}".lower(), None
            carried = True
        words = [w for w in (x.strip(EDGE) for x in words) if w]
        if words:
            yield chunk, doc, i + 1, "words", " ".join(words), None


def read_pages(pages: DataFrame) -> DataFrame:
    """The lines and words of scanned pages (see LINES)."""

    def run(batches):
        for pdf in batches:
            rows = [r for c, d, t in zip(pdf["chunk_id"].tolist(), pdf["doc_id"].tolist(), pdf["text"].tolist()) for r in _read_page(c, d, t)]
            yield pd.DataFrame(rows, columns=["chunk_id", "doc_id", "line_no", "role", "value", "features"])

    return pages.select("chunk_id", "doc_id", "text").mapInPandas(run, LINES)


def _line_words(line: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.col(line)), F.lit(r"(\p{L}{3,})")))


def headers(lines: DataFrame, *, most: int = 4000, least_pages: int = 3) -> DataFrame:
    """(chunk_id, line_no) of running headers, by the line-pair classifier."""
    top = lines.where("role = 'top'")
    words = top.select("chunk_id", "line_no", "doc_id", "value", F.explode(_line_words("value")).alias("word"))
    known = words.groupBy("doc_id", "word").agg(F.countDistinct("value", "chunk_id").alias("pages"))
    back = words.join(known, ["doc_id", "word"]).groupBy("chunk_id", "line_no").agg(F.avg((F.col("pages") >= least_pages).cast("double")).alias("back"))
    top = top.join(back, ["chunk_id", "line_no"], "left").withColumn("back", F.coalesce("back", F.lit(0.0)))
    inner = lines.where("role = 'inner'").orderBy(F.xxhash64("value", "chunk_id")).limit(most).withColumn("back", F.lit(0.0))
    # how often the words of a line stand at the top of pages
    place = lines.where("role in ('top', 'inner')").select("role", F.explode(_line_words("value")).alias("word"))
    place = place.groupBy("word").agg(F.avg((F.col("role") == "top").cast("double")).alias("at_top"))
    rows = top.select("chunk_id", "line_no", "role", "value", "features", "back").unionByName(inner.select("chunk_id", "line_no", "role", "value", "features", "back"))
    mean = rows.select("chunk_id", "line_no", F.explode(_line_words("value")).alias("word")).join(place, "word").groupBy("chunk_id", "line_no").agg(F.avg("at_top").alias("at_top"))
    rows = rows.join(mean, ["chunk_id", "line_no"], "left").withColumn("features", F.concat(F.slice("features", 1, 8), F.array(F.coalesce("at_top", F.lit(0.0)))))
    rows = materialize(rows, "pairs")
    top = rows.where("role = 'top'")
    again = top.where((F.col("back") >= 0.75) & (F.col("features")[2] == 0)).select("features", F.lit(1.0).alias("label"))
    sample = again.orderBy(F.xxhash64("features")).limit(most).unionByName(rows.where("role = 'inner'").select("features", F.lit(0.0).alias("label")))
    return top.where(_logistic(sample) > 0.5).select("chunk_id", "line_no")


def page_numbers(lines: DataFrame, *, most: int = 4000) -> DataFrame:
    """(chunk_id, line_no) of lines that are page numbers only, by the line-pair classifier."""
    maybe = lines.where("role = 'number'").withColumn("clean", F.col("features")[10]).withColumn("features", F.slice("features", 1, 10))
    sure = maybe.where("clean = 1").orderBy(F.xxhash64("value", "chunk_id")).limit(most).select("features", F.lit(1.0).alias("label"))
    inner = lines.where("role = 'inner'").orderBy(F.xxhash64("value", "chunk_id")).limit(most).select("features", F.lit(0.0).alias("label"))
    return maybe.where(_logistic(sure.unionByName(inner)) > 0.5).select("chunk_id", "line_no")


def divided_words(lines: DataFrame, known: DataFrame, *, most: int = 4000) -> DataFrame:
    """(chunk_id, line_no, joined, form, known) of words divided between a line and the next: ``form`` is the word as the
    classifier joins it, with or without the hyphen, ``known`` whether the vocabulary has it."""
    split = lines.where("role = 'hyphen'").select("chunk_id", "line_no", F.split_part("value", F.lit("|"), F.lit(1)).alias("left"), F.split_part("value", F.lit("|"), F.lit(2)).alias("right"))
    split = split.withColumn("joined", F.concat("left", "right")).withColumn("own", F.concat_ws("-", "left", "right"))
    for c in ("joined", "own", "left", "right"):
        split = split.join(known.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}")), c, "left")
    log = lambda c: F.log1p(F.coalesce(F.col(f"n_{c}"), F.lit(0)).cast("double"))
    both = (F.col("n_left").isNotNull() & F.col("n_right").isNotNull()).cast("double")
    more = F.coalesce("n_joined", F.lit(0)) - F.coalesce("n_own", F.lit(0))
    split = split.withColumn("features", F.array(log("joined"), log("own"), log("left"), log("right"), both, F.length("left").cast("double"), F.length("right").cast("double"))).withColumn("more", more)
    split = materialize(split.select("chunk_id", "line_no", "joined", "own", "n_joined", "n_own", "features", "more"), "divided")
    sample = split.where("more != 0").select("features", (F.col("more") > 0).cast("double").alias("label"))
    sample = sample.groupBy("features", "label").agg(F.count("*").alias("n")).orderBy(F.xxhash64("features", "label")).limit(most)
    join = _logistic(sample) >= 0.5
    return split.select("chunk_id", "line_no", "joined", F.when(join, F.col("joined")).otherwise(F.col("own")).alias("form"), F.when(join, F.col("n_joined")).otherwise(F.col("n_own")).isNotNull().alias("known"))


def vocabulary(texts: DataFrame, *, text: str = "text", min_count: int = 3) -> DataFrame:
    """(word, n) of all plain words of ``texts`` that come up at least ``min_count`` times."""
    clean = F.lower(F.translate(F.col(text), INVISIBLE, ""))
    words = texts.select(F.explode(F.regexp_extract_all(clean, F.lit(WORD), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _grams(word: Column, spread: int) -> Column:
    """Positional bigrams of the padded word, each at its place and up to ``spread`` places away."""
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    at = F.sequence(F.lit(1), F.length(padded) - 1)
    if not spread:
        return F.array_distinct(F.transform(at, lambda i: F.concat_ws("@", i, F.substring(padded, i, F.lit(2)))))
    near = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(-spread), F.lit(spread)), lambda s: F.concat_ws("@", i + s, F.substring(padded, i, F.lit(2))))))
    return F.array_distinct(near)


def candidates(unknown: DataFrame, known: DataFrame) -> DataFrame:
    """(wrong, n_wrong, word, n, shared, edits) of all vocabulary words within two edits of an unknown word, one for
    unknown words of three letters or fewer: an inverted join on q-grams, then the exact distance. Two edits spoil at most four
    bigrams, so of an unknown word its five rarest are enough to find every such word."""
    padded = F.concat(F.lit("^"), F.col("wrong"), F.lit("$"))
    at = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.struct(i.alias("at"), F.substring(padded, i, F.lit(2)).alias("pair")))
    right = known.select("word", "n", F.explode(_grams(F.col("word"), 0)).alias("gram"))
    often = right.groupBy(F.substring_index("gram", "@", -1).alias("pair")).agg(F.count("*").alias("often"))
    left = unknown.select("wrong", "n_wrong", F.explode(at).alias("g")).select("wrong", "n_wrong", "g.*").join(often, "pair")
    rarest = F.row_number().over(W.partitionBy("wrong").orderBy("often", "at"))
    # pairs that the vocabulary lacks are spoilt for certain: they take a place among the five
    lacking = F.length(F.col("wrong")) + 1 - F.count("*").over(W.partitionBy("wrong"))
    left = left.withColumn("place", rarest + lacking).where(F.col("place") <= 5)
    near = F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda s: F.concat_ws("@", F.col("at") + s, "pair"))
    pairs = left.select("wrong", "n_wrong", F.explode(near).alias("gram")).join(right, "gram")
    pairs = pairs.where(F.abs(F.length("wrong") - F.length("word")) <= 2).select("wrong", "n_wrong", "word", "n").distinct()
    pairs = pairs.withColumn("edits", F.levenshtein("wrong", "word", 2))
    pairs = pairs.where((F.col("edits") > 0) & ((F.length("wrong") > 3) | (F.col("edits") == 1)))
    return pairs.withColumn("shared", F.size(F.array_intersect(_grams(F.col("wrong"), 2), _grams(F.col("word"), 0))).cast("long")).where("shared > 0")


def _differing(wrong: Column, word: Column) -> tuple[Column, Column]:
    """What is left of both words without their common beginning and end."""
    least = F.least(F.length(wrong), F.length(word))
    ahead = F.size(F.filter(F.sequence(F.lit(0), least), lambda i: F.substring(wrong, F.lit(1), i) == F.substring(word, F.lit(1), i))) - 1
    a, b = F.expr("substring(wrong, ahead + 1)"), F.expr("substring(word, ahead + 1)")
    return ahead, (a, b)


def with_confusion(pairs: DataFrame) -> DataFrame:
    """Adds what was read (``read``) for which letters (``meant``)."""
    ahead, (a, b) = _differing(F.col("wrong"), F.col("word"))
    pairs = pairs.withColumn("ahead", ahead).withColumn("a", F.reverse(a)).withColumn("b", F.reverse(b))
    least = F.least(F.length("a"), F.length("b"))
    behind = F.size(F.filter(F.sequence(F.lit(0), least), lambda i: F.substring(F.col("a"), F.lit(1), i) == F.substring(F.col("b"), F.lit(1), i))) - 1
    pairs = pairs.withColumn("behind", behind)
    return pairs.withColumn("read", F.reverse(F.expr("substring(a, behind + 1)"))).withColumn("meant", F.reverse(F.expr("substring(b, behind + 1)"))).drop("a", "b")


def _weighed(pairs: DataFrame, confusions: DataFrame) -> DataFrame:
    """Adds how often the letters of a candidate are confused (``times``) and its share among its rivals (``share``)."""
    pairs = pairs.join(confusions, ["read", "meant"], "left").withColumn("times", F.coalesce("times", F.lit(0.0)))
    rivals = pairs.groupBy("wrong").agg(F.sum("times").alias("all_times"))
    return pairs.join(rivals, "wrong").withColumn("share", F.when(F.col("all_times") > 0, F.col("times") / F.nullif(F.col("all_times"), F.lit(0.0))).otherwise(F.lit(0.0))).drop("all_times")


def confused_letters(pairs: DataFrame, *, least_times: float, rounds: int = 3) -> DataFrame:
    """(read, meant, times): how often letters are confused over all pages. Each unknown word counts once for all its
    candidates together, at first in equal parts, then by what was found the round before."""
    among = pairs.groupBy("wrong").agg(F.count("*").alias("rivals"))
    parts = pairs.join(among, "wrong").withColumn("part", F.col("n_wrong") / F.col("rivals"))
    for n in range(rounds):
        found = parts.groupBy("read", "meant").agg(F.sum("part").alias("times"), F.countDistinct("word").alias("words"))
        found = materialize(found.where((F.col("times") >= least_times) & (F.col("words") >= 2)).select("read", "meant", "times"), f"confusions-{n}")
        parts = _weighed(pairs, found).withColumn("part", F.col("n_wrong") * F.col("share"))
    return found


def _features(pairs: DataFrame, confusions: DataFrame) -> DataFrame:
    most = F.greatest(F.length("wrong"), F.length("word"))
    pairs = _weighed(pairs, confusions)
    return pairs.withColumn("features", array_to_vector(F.array(*[c.cast("double") for c in (F.col("share"), F.col("edits"), F.col("shared") / (most + 1), F.log1p("times"), F.log1p("n"), F.length("word"), (F.col("ahead") > 0), (F.col("behind") > 0), F.length("read"), F.length("meant"))])))


def corrections(unknown: DataFrame, known: DataFrame, *, training_words: int = 3000, least_times: float = 3.0) -> DataFrame:
    """(wrong, word): the best candidate of each unknown word (wrong, n_wrong), where the ranking accepts one."""
    pairs = materialize(with_confusion(candidates(unknown, known)), "candidates")
    confusions = confused_letters(pairs, least_times=least_times)
    # training pairs: vocabulary words spoilt by the confusions found, against their other candidates
    clean = known.where(F.length("word") >= 4).orderBy(F.xxhash64("word")).limit(training_words).select(F.col("word").alias("truth"))
    parts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("truth")), lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substring(F.col("truth"), i, n)))))
    spoilt = clean.select("truth", F.explode(parts).alias("meant")).distinct().join(confusions, "meant")
    spoilt = spoilt.withColumn("wrong", F.expr("concat(substring(truth, 1, locate(meant, truth) - 1), read, substring(truth, locate(meant, truth) + length(meant)))"))
    spoilt = spoilt.join(known, F.col("wrong") == known["word"], "left_anti").orderBy(F.xxhash64("wrong", "truth")).limit(2 * training_words).select("wrong", "truth")
    spoilt = materialize(spoilt.groupBy("wrong").agg(F.min("truth").alias("truth")), "spoilt")
    train = with_confusion(candidates(spoilt.select("wrong", F.lit(1).alias("n_wrong")), known)).join(spoilt, "wrong")
    train = materialize(train, "training-candidates")
    train = materialize(_features(train, confusions).select("features", (F.col("word") == F.col("truth")).cast("double").alias("label")), "training-pairs")
    if train.select("label").distinct().count() < 2:  # no confusion comes up often enough: nothing is known to rank by
        return pairs.where("false").select("wrong", "word")
    model = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, seed=5).fit(train.coalesce(2))
    scored = model.transform(_features(pairs, confusions)).withColumn("score", vector_to_array("probability")[1])
    best = scored.groupBy("wrong").agg(F.max_by("word", F.struct("score", "times", "n", "word")).alias("word"), F.max("score").alias("score"), F.max_by("times", F.struct("score", "times", "n", "word")).alias("times"))
    return best.where((F.col("score") >= 0.5) & (F.col("times") > 0)).select("wrong", "word")


def _as_number(word: Column) -> Column:
    """A number with letters in it as digits, null for anything else."""
    shape = word.rlike(r"^(?=.*[0-9])(?=.*[A-Za-z|])[0-9" + "".join(re.escape(c) for c in DIGITS) + r"]+(?:[.,:/][0-9" + "".join(re.escape(c) for c in DIGITS) + r"]+)*$")
    return F.when(shape & ~word.rlike(r"^[A-Z][0-9]{2,6}$"), F.translate(word, "".join(DIGITS), "".join(DIGITS.values())))


def _places(chunks: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scanned chunks, and their noise with what stands in the text, in lower case (``wrong``)."""
    scanned = materialize(scanned_chunks(chunks, pages), "scanned")
    lines = materialize(read_pages(scanned), "lines")
    top = materialize(headers(lines), "headers")
    typed = chunks.where("length(text) > 0").join(scanned.select("chunk_id"), "chunk_id", "left_anti")
    known = materialize(vocabulary(typed.select("text")), "vocabulary")

    words = lines.where("role = 'words'").join(top, ["chunk_id", "line_no"], "left_anti").select("chunk_id", "line_no", F.explode(F.split("value", " ")).alias("value")).withColumn("wrong", F.lower("value"))
    words = words.withColumn("number", _as_number(F.col("value")))
    odd = words.where(F.col("number").isNull() & ~F.col("value").rlike(CODE.pattern) & F.col("wrong").rlike(r"^[a-z0-9\u00df-\u024f'|-]+$") & F.col("wrong").rlike(r"[a-z\u00df-\u024f]"))
    odd = odd.join(known, F.col("wrong") == F.col("word"), "left_anti")
    parts = F.filter(F.split("wrong", "'"), lambda x: x != "")
    # an elision of known words is no unknown word: its last part is looked up, parts of one or two letters are articles
    odd = odd.withColumn("last", F.when((F.size(parts) > 1) & (F.length(parts[0]) <= 4) & ~F.col("wrong").rlike(r"e'[a-z]*$"), F.element_at(parts, -1)).otherwise(F.col("wrong")))
    odd = odd.join(known, F.col("last") == F.col("word"), "left_anti").select("chunk_id", "line_no", "wrong")

    split = materialize(divided_words(lines, known), "joins")

    unknown = odd.select("wrong").unionByName(split.where("not known and form = joined").select(F.col("joined").alias("wrong"))).groupBy("wrong").agg(F.count("*").alias("n_wrong"))
    right = materialize(corrections(unknown, known), "corrections")
    row = lambda df, kind, value, wrong: df.select("chunk_id", "line_no", F.lit(kind).alias("noise"), value.alias("repaired"), wrong.alias("wrong"))
    none = F.lit(None).cast("string")
    found = row(page_numbers(lines), "page_no", F.lit(""), none)
    found = found.unionByName(row(top, "header", F.lit(""), none))
    found = found.unionByName(row(odd.join(right, "wrong"), "misread", F.col("word"), F.col("wrong")))
    found = found.unionByName(row(words.where("number is not null"), "misread", F.lower("number"), F.col("wrong")))
    split = split.join(right, (F.col("form") == F.col("wrong")) & ~F.col("known"), "left")
    return scanned, found.unionByName(row(split, "hyphen", F.coalesce("word", "form"), F.col("joined")))


def noise(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """One row (chunk_id, line_no, noise, repaired) for each piece of noise: ``header`` and ``page_no`` with an empty
    repair, ``hyphen`` and ``misread`` with the right word or number in lower case."""
    return _places(chunks, pages)[1].select("chunk_id", "line_no", "noise", "repaired").distinct()


def _cased(right: str, like: str) -> str:
    """The right word with the capitals of what stood in its place."""
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return right.upper()
    return right[:1].upper() + right[1:] if like[:1].isupper() else right


def _replaced(token: str, right: str) -> str:
    core = token.strip(EDGE)
    return token.replace(core, _cased(right, core), 1)


def repair(text: str, found: list[tuple]) -> str:
    """The text without furniture, with whole and right words, its lines joined into paragraphs. ``found`` has (line_no,
    noise, repaired, wrong). A paragraph ends at a blank line and after a short line that ends a sentence."""
    lines = text.split("\n")
    gone = {n for n, kind, _, _ in found if kind in ("header", "page_no")}
    divided = {n: right for n, kind, right, _ in found if kind == "hyphen"}
    misread = {(n, wrong): right for n, kind, right, wrong in found if kind == "misread"}
    full = [i for i, x in enumerate(lines) if x.strip() and i + 1 not in gone]
    words = {i: lines[i].split() for i in full}
    for i in full:
        words[i] = [_replaced(w, misread[i + 1, k]) if (k := w.strip(EDGE).lower()) and (i + 1, k) in misread else w for w in words[i]]
    for i, after in zip(full, full[1:]):
        if i + 1 in divided and words[i] and words[after]:
            left, right = words[i].pop(), words[after].pop(0)
            head, tail = left[: len(left) - len(left.lstrip(EDGE))], right[len(right.rstrip(EDGE)) :]
            words[i].append(head + _cased(divided[i + 1], left.strip(EDGE + HYPHENS)) + tail)
    sizes = sorted(len(lines[i]) for i in full)
    short = 0.7 * sizes[len(sizes) // 2] if sizes else 0
    out, before = [], None
    for i in full:
        line = " ".join(words[i])
        blank = before is not None and any(not lines[k].strip() for k in range(before + 1, i) if k + 1 not in gone)
        ends = before is not None and len(lines[before]) < short and lines[before].rstrip()[-1:] in ".!?:。！？："
        if before is None or blank or ends:
            out.append(line)
        elif line:
            solid = re.search(r"[\u3000-\u303f\u4e00-\u9fff\uff00-\uffef]$", out[-1]) and re.match(r"[\u3000-\u303f\u4e00-\u9fff\uff00-\uffef]", line)
            out[-1] += ("" if solid or not out[-1] else " ") + line
        before = i
    return "\n".join(x for x in out if x)


def repaired(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """``chunks`` with the text of scanned pages repaired (see ``repair``), other rows untouched."""
    scanned, found = _places(chunks, pages)
    fixes = found.groupBy("chunk_id").agg(F.collect_set(F.struct("line_no", "noise", "repaired", "wrong")).alias("found"))

    def run(batches):
        for pdf in batches:
            new = [repair(t, [] if f is None else [(x["line_no"], x["noise"], x["repaired"], x["wrong"]) for x in f]) for t, f in zip(pdf["old"], pdf["found"])]
            yield pd.DataFrame({"__id": pdf["chunk_id"], "__form": pdf["form"], "__new": new})

    # a key that stands for several texts: the digest tells which one is meant
    new = scanned.select("chunk_id", F.col("text").alias("old"), F.xxhash64("text").alias("form")).join(fixes, "chunk_id", "left").mapInPandas(run, "__id long, __form long, __new string")
    new = materialize(new.dropDuplicates(["__id", "__form"]), "repaired")
    out = chunks.join(new, (F.col("chunk_id").cast("long") == F.col("__id")) & (F.xxhash64("text") == F.col("__form")), "left")
    return out.withColumn("text", F.coalesce("__new", "text")).select(*chunks.columns)
