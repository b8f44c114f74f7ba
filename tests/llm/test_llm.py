"""Every operator against a brute-force version, an exact round trip or held-out cases, and over odd rows."""

import hashlib
import os
import random
import re
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import alignment, boilerplate, encoding, language, leakage, normalize, scans, sentences, spans
from corpusloom.llm import codepoints as cp

ODD = [None, "", " \n\t ", "x", "é" * 50_000, "安全。" * 20_000, "a b " * 60_000]


# --- code points -------------------------------------------------------------------------------------------------


def test_code_points_round_trip():
    texts = ["", None, "aé安🛩", "x\n", None, "𝒜"]
    column = pa.array(texts)
    points, offsets = cp.decode(column)
    assert cp.encode(points, offsets, column.is_null().to_numpy(zero_copy_only=False)).to_pylist() == texts
    points, offsets = cp.decode(column.slice(2, 3))
    assert cp.encode(points, offsets).to_pylist() == ["aé安🛩", "x\n", ""]
    assert [len(x) for _, x in cp.slices(pa.array(["a" * 10] * 7), 30)] == [3, 3, 1]


def plain_words(text):
    out, cur = [], ""
    for c in text.lower():
        if "一" <= c <= "鿿":
            out += ([cur] if cur else []) + [c]
            cur = ""
        elif unicodedata.category(c)[0] in "LN":
            cur += c
        else:
            out += [cur] if cur else []
            cur = ""
    return out + ([cur] if cur else [])


def test_words_equal_plain_words():
    texts = ["Abc d'É 12安全x3.", "", "..", "a安", "½ m²-k"]
    points, offsets = cp.decode(pa.array(texts))
    h, start, end, first = cp.words(points, offsets)
    for i, t in enumerate(texts):
        got = ["".join(map(chr, cp.lower_table()[points[s:e]])) for s, e in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]])]
        assert got == plain_words(t)
    same = {w: h[j] for i in range(len(texts)) for j, w in zip(range(first[i], first[i + 1]), plain_words(texts[i]))}
    assert len(set(same.values())) == len(same)


# --- 3: one consistent form --------------------------------------------------------------------------------------

PAIRS = [
    ("Ｓｎｏ­ｗ　ｃｌｅａｒｉｎｇ", "Snow clearing"),
    ("près dе l'été", "près de l'été"),
    ("适⽤范围，更更。", "适用范围，更更。"),
    ("Меtеοrοlοgісаl", "Meteorological"),
    ("12.5 kΝ and Δ of α in ½ m²", "12.5 kN and Δ of α in ½ m²"),
    ("01:０１:17！", "01:01:17!"),
    ("时间：５时！", "时间：5时！"),
    ("a b c d‑eﬁn", "a b c d-efin"),
    ("а̀ la", "à la"),
    ("Привет мир", "Привет мир"),
    ("line\nbreak  kept", "line\nbreak  kept"),
]


def test_usual_form():
    dirty, clean = zip(*PAIRS)
    assert normalize.normalize_array(pa.array(dirty)).to_pylist() == list(clean)
    assert normalize.normalize_array(pa.array(clean)).to_pylist() == list(clean)


def test_marks_compose_as_nfc():
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice("aeiouyncsz \u0327\u0300\u0301\u0302\u0308") for _ in range(12))
        assert normalize.normalize_array(pa.array([t])).to_pylist()[0] == unicodedata.normalize("NFC", t)
    letters = "aeouncsz\uac00\uac01\u1100\ub098\u1161\u1169\u11a8\u11ab \u0327\u0323\u0325\u0301\u0302\u0303\u0308\u0331"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    assert normalize.normalize_array(pa.array(texts)).to_pylist() == [unicodedata.normalize("NFC", t) for t in texts]
    assert normalize.normalize_array(pa.array(["e\u0302\u0323", "c\u0301\u0327", None, "\u0301" * 3])).to_pylist() == ["\u1ec7", "\u1e09", None, "\u0301" * 3]


def test_lookalikes_are_judged_by_the_text():
    russian = "Желтая оса и хор"
    texts = [russian, "The \u043e\u0441\u0430 flew", "\u043e\u0441\u0430", "ο λόγος", "line\u2028next"]
    assert normalize.normalize_array(pa.array(texts)).to_pylist() == [russian, "The oca flew", "oca", "ο λόγος", "line\nnext"]


def test_changed_fields_over_odd_rows(spark):
    rows = [(i, t, t, "clash") for i, t in enumerate([*ODD, PAIRS[0][0], PAIRS[0][0]])]
    df = spark.createDataFrame(rows, "chunk_id long, text string, section_title string, form string")
    got = normalize.changed_fields(df, "chunk_id", ["text", "section_title"])
    h = hashlib.sha256(b"snow clearing").hexdigest()
    assert {tuple(r) for r in got.collect()} == {(i, f, h) for i in (7, 8) for f in ("text", "section_title")}
    assert normalize.changed_fields(df.limit(0), "chunk_id", ["text"]).count() == 0
    out = normalize.normalize_columns(df, ["text"])
    assert out.columns == df.columns and out.where("text is null").count() == 1


# --- 2: repeated lines -------------------------------------------------------------------------------------------


def test_repeated_lines_equal_brute_force(spark):
    rng = random.Random(2)
    common = ["Please share this page with others", "PRINTED COPIES are not controlled %d", "short"]
    rows = []
    for i in range(400):
        source, doc = ("a", rng.randrange(60)) if i % 3 else ("b", rng.randrange(5))
        lines = [f"a line of its own number {i} {'x' * (i % 7)}"] + [c % i if "%" in c else c for c in common if rng.random() < 0.3] + ["", "A" * 5000 if i % 50 == 0 else "z"]
        rng.shuffle(lines)
        rows.append((i, f"{source}/{doc}", "\n".join(lines), i))
    rows += [(900, None, "Please share this page with others", 0), (901, "a/1", None, 0), (902, "a/2", "", 0), (3, *rows[3][1:])]
    df = spark.createDataFrame(rows, "chunk_id long, doc_id string, text string, number int")
    key = lambda x: "".join(c for c in x.lower() if c.isalpha())
    held, docs = {}, {}
    for _, d, t, _ in rows:
        if d:
            docs.setdefault(d[0], set()).add(d)
            for x in (t or "").split("\n"):
                held.setdefault((d[0], key(x)), set()).add(d)
    bad = {k for k, v in held.items() if len(k[1]) >= 12 and len(v) >= 4 and len(v) >= 0.04 * len(docs[k[0]])}
    want = {(i, n + 1) for i, d, t, _ in rows if d for n, x in enumerate((t or "").split("\n")) if (d[0], key(x)) in bad}
    assert bad and {tuple(r) for r in boilerplate.repeated_lines(df).collect()} == want
    clean = {(r["chunk_id"], r["number"]): r["text"] for r in boilerplate.without_repeated_lines(df).collect()}
    assert clean[(901, 0)] is None and clean[(902, 0)] == "" and clean[(900, 0)] == rows[400][2]
    for i, d, t, n in rows[:400]:
        assert clean[(i, n)] == "\n".join(x for x in t.split("\n") if (d[0], key(x)) not in bad)
    assert boilerplate.repeated_lines(df.limit(0)).count() == 0


# --- 4: languages ------------------------------------------------------------------------------------------------

WORDS = {
    "en": "the wing of this aircraft was found near the hill and the crew had not seen what happened before they left",
    "fr": "le pilote de cet avion avait une longue expérience mais les passagers ne savaient pas que la piste était fermée",
    "es": "el piloto de este avión tenía mucha experiencia pero los pasajeros no sabían que la pista estaba cerrada",
    "zh": "机组没有收到任何关于跑道关闭的警告飞机在雾中降落调查发现记录不完整",
}


def sentence(rng, lang):
    if lang == "zh":
        return "".join(rng.choice(WORDS["zh"]) for _ in range(18)) + "。"
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(14)).capitalize() + "."


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(" ".join(sentence(rng, x) for _ in range(4)), x if rng.random() > 0.05 else "en") for x in WORDS for _ in range(80)]
    return language.fit(spark.createDataFrame(rows, "text string, lang string"))


def test_labels(spark):
    labels = ["en", "EN-ca", "English", "zh_Hant", "Français", " fr ", "spa", "??", "", None, "n/a", "de", "und"]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    got = [r[0] for r in df.select(language.known_label(F.col("l"))).collect()]
    assert got == ["en", "en", "en", "zh", "fr", "fr", "es", None, None, None, None, None, None]


def test_held_out_segments(spark, model):
    rng = random.Random(9)
    rows, want = [], {}
    for i in range(120):
        runs, text = [], ""
        for _ in range(rng.choice([1, 1, 2, 3])):
            lang = rng.choice([x for x in WORDS if not runs or x != runs[-1]])
            runs.append(lang)
            text += " ".join(sentence(rng, lang) for _ in range(rng.randint(1, 3))) + rng.choice([" ", "\n"])
        rows.append((i, text, "en", "text"))
        want[i] = runs
    rows += [(500 + i, t, None, None) for i, t in enumerate(ODD)] + [(600, "[Figure p.3] " + WORDS["en"] + "\n\nLE LA LES", "en", "figure")]
    df = spark.createDataFrame(rows, "chunk_id long, text string, lang string, kind string").withColumn("seg_no", F.lit("clash"))
    got = {}
    for r in language.segments(df, model).orderBy("chunk_id", "seg_no").collect():
        got.setdefault(r["chunk_id"], []).append(r["lang"])
        assert 0 <= r["confidence"] <= 1 and r["first_sent"] <= r["last_sent"]
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    assert got[600] == ["en"] and 500 not in got and 501 not in got and 502 not in got and len(got[505]) == 1
    cases = {r["chunk_id"] for r in language.mislabelled(df, model).collect()}
    right = {i for i in want if got[i] == want[i]}
    assert {i for i in cases if i in right} == {i for i in right if want[i] != ["en"]}
    assert language.mislabelled(df.limit(0), model).count() == 0


def test_sentences():
    texts = ["One. Two! 3.5 is no end? Yes\nNext line", "句一。句二！end", "", " \n ", "A. B."]
    points, offsets = cp.decode(pa.array(texts))
    start, end, row = sentences.split(points, offsets)
    got = [("".join(map(chr, points[s:e])), int(r)) for s, e, r in zip(start, end, row)]
    assert got == [("One.", 0), ("Two!", 0), ("3.5 is no end?", 0), ("Yes", 0), ("Next line", 0), ("句一。", 1), ("句二！", 1), ("end", 1), ("A.", 4), ("B.", 4)]


# --- 1: alignment ------------------------------------------------------------------------------------------------


def bilingual(rng, doc, first_id, n):
    """A report in two languages with sentences left out, joined and moved; its chunks and the true pairs."""
    left, right = [], []
    for i in range(n):
        code, number = f"{rng.choice('ABCDEF')}{rng.randint(1000, 99999)}", rng.randint(100, 9999)
        filler = lambda x: " ".join(rng.choice(WORDS[x].split()) for _ in range(9))
        left.append(f"{filler('en').capitalize()} {code} {number} metres.")
        right.append([i, f"{filler('fr').capitalize()} {code} à {number} mètres."])
    kept = [x for x in right if rng.random() > 0.08]
    if len(kept) > 6:
        kept.insert(1, kept.pop(4))
        a, b = kept[-2], kept[-1]
        kept[-2:] = [[(a[0], b[0]), a[1][:-1] + " ; de plus, " + b[1][0].lower() + b[1][1:]]]
    rows, pairs = [], set()
    place = {}
    for k in range(0, n, 4):
        rows.append((first_id + k // 4, doc, " ".join(left[k : k + 4]), k // 4 + 1, "en"))
        for j in range(k, min(n, k + 4)):
            place[j] = (first_id + k // 4, j - k + 1)
    second = first_id + 1000
    for k in range(0, len(kept), 5):
        rows.append((second + k // 5, doc, "\n".join(x[1] for x in kept[k : k + 5]), k // 5 + 1, "fr"))
        for j, (i, _) in enumerate(kept[k : k + 5]):
            for one in i if isinstance(i, tuple) else (i,):
                pairs.add((*place[one], second + k // 5, j + 1))
    return rows, pairs


def test_alignment_finds_the_pairs(spark, model):
    rng = random.Random(4)
    rows, want = [], set()
    for k, n in enumerate([3, 12, 20, 33, 400]):
        r, p = bilingual(rng, f"x/{k}", 10_000 * (k + 1), n)
        rows, want = rows + r, want | p
    twin = (90_000, *rows[0][1:])
    rows += [twin, (90_001, "x/odd", None, 1, None), (90_002, None, "text", 1, "en"), (None, "x/odd", "text", 1, "en")] + [(90_010 + i, "x/odd", t, None, None) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "chunk_id long, doc_id string, text string, page int, lang string").withColumn("kind", F.lit("text")).withColumn("side", F.lit(1)).withColumn("id", F.lit("clash"))
    got = {tuple(r) for r in alignment.align(df, model, block_chunks=16).collect()}
    again = {(c, d, 90_000, b) for a, b, c, d in want if a == rows[0][0]}
    want |= again
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)
    assert alignment.align(df.limit(0), model).count() == 0


def test_versions_need_no_common_first_page(spark, model):
    rng = random.Random(14)
    rows, want = bilingual(rng, "x/late", 10_000, 40)
    gone = {r[0] for r in rows if r[4] == "fr" and r[3] == 1}
    rows, want = [r for r in rows if r[0] not in gone], {p for p in want if p[2] not in gone}
    short, _ = bilingual(rng, "x/other", 20_000, 40)
    rows += [r for r in short if r[4] == "en"] + [(29_000, "x/other", " ".join(sentence(rng, "fr") for _ in range(4)), 1, "fr")]
    # one chunk of the second version only: the first 4 sentences of 60 are rendered
    part, pairs = bilingual(rng, "x/part", 30_000, 60)
    rows += [r for r in part if r[4] == "en" or r[0] == 31_000]
    want |= {p for p in pairs if p[2] == 31_000}
    df = spark.createDataFrame(rows, "chunk_id long, doc_id string, text string, page int, lang string").withColumn("kind", F.lit("text"))
    got = {tuple(r) for r in alignment.align(df, model).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)
    assert not any(20_000 <= r[0] < 30_000 for r in got) and any(r[2] == 31_000 for r in got)


def test_three_versions_and_mixed_chunks(spark, model):
    rng = random.Random(21)
    rows, want = bilingual(rng, "x/three", 10_000, 24)
    # a third version of fewer sentences, and a sentence of the second one that stands in a chunk of the first
    third = [(i, re.search(r" ([A-F]\d+) (\d+) metres", s).groups()) for r in rows if r[4] == "en" for i, s in enumerate(re.split(r"(?<=\.) ", r[2]))]
    keys = [(r[0], i + 1) for r in rows if r[4] == "en" for i in range(len(re.split(r"(?<=\.) ", r[2])))]
    spanish = [f"{' '.join(rng.choice(WORDS['es'].split()) for _ in range(9)).capitalize()} {c} de {n} metros." for _, (c, n) in third]
    rows += [(12_000 + k, "x/three", " ".join(spanish[k * 4 : k * 4 + 4]), 50 + k, "es") for k in range(3)]
    en_es = {(*keys[i], 12_000 + i // 4, i % 4 + 1) for i in range(12)}
    code = third[20][1]
    first = next(r for r in rows if r[0] == 10_000)
    stray = f"{' '.join(rng.choice(WORDS['fr'].split()) for _ in range(12)).capitalize()} {code[0]} à {code[1]} mètres."
    rows = [r for r in rows if r is not first] + [(*first[:2], first[2] + " " + stray, *first[3:])]
    df = spark.createDataFrame(rows, "chunk_id long, doc_id string, text string, page int, lang string").withColumn("kind", F.lit("text"))
    got = {tuple(r) for r in alignment.align(df, model).collect()}
    assert len(got & en_es) >= 0.9 * len(en_es) and len(got & want) >= 0.9 * len(want)
    languages = {(r[0] // 1000, r[2] // 1000) for r in got}
    assert (11, 12) in languages or (12, 11) in languages  # French and Spanish are versions of each other, too
    assert len(spanish) == 24


def test_length_price_is_the_tail_of_the_normal_distribution():
    import math

    import numpy as np

    for z in (0.0, 0.5, 1.0, 2.0, 4.0):
        l1 = 100.0
        # lengths whose difference is z standard deviations of their mean
        l2 = next(x for x in np.arange(100.0, 400.0, 0.001) if (x - l1) / np.sqrt((l1 + x) / 2 * alignment.VARIANCE) >= z)
        got = alignment._length_price(np.array([l1]), np.array([l2]), np.array([1.0]))[0]
        assert got == pytest.approx(min(12, -math.log(math.erfc(z / math.sqrt(2)))), abs=0.01)


def test_parts_left_out_shift_nothing(spark, model):
    rng = random.Random(15)
    rows, pairs = bilingual(rng, "x/cut", 10_000, 900)
    # the second version lacks a third of the report, and holds a chunk of its end near its beginning
    first_of = {}
    for a, b, c, d in pairs:
        first_of.setdefault(c, a)
    gone = {c for c, a in first_of.items() if 10_040 <= a < 10_120}
    far = max(c for c, a in first_of.items() if a < 10_200)
    move = {far: 11_001.5}
    seconds = sorted((c for c in first_of if c not in gone), key=lambda c: move.get(c, c))
    new = {c: 12_000 + k for k, c in enumerate(seconds)}
    rows = [(new.get(r[0], r[0]), *r[1:]) for r in rows if r[0] not in gone]
    want = {(a, b, new[c], d) for a, b, c, d in pairs if c not in gone}
    df = spark.createDataFrame(rows, "chunk_id long, doc_id string, text string, page int, lang string").withColumn("kind", F.lit("text"))
    got = {tuple(r) for r in alignment.align(df, model, block_chunks=16).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)
    moved = {p for p in want if p[2] == new[far]}
    assert moved and len(got & moved) >= 0.8 * len(moved)


def test_sentences_moved_out_of_their_block_equal_brute_force(spark):
    import math

    rng = random.Random(31)
    weights = {m: rng.choice([5, 8, 12]) for m in range(300)}
    docs, found = {}, [("b", 100, 1, 200, 1)]
    for doc, n in (("a", 60), ("b", 120), ("c", 1)):
        first = [sorted(rng.sample(range(300), 4)) for _ in range(n)]
        second = [x if rng.random() < 0.6 else x[1:] + [rng.randrange(300)] if rng.random() < 0.5 else sorted(rng.sample(range(300), 3)) for x in rng.sample(first, len(first))]
        second += second[:3]  # two that hold the same: none is the one best
        hot = [[*x, 400] for x in first], [[*x, 400] for x in second]  # one mark in every sentence
        for side, part in enumerate(hot):
            for k, held in enumerate(part):
                docs[doc, side, 100 * (side + 1) + k // 4, k % 4 + 1] = {m: weights.get(m, 8) for m in held}
    rows = {}
    for (doc, side, i, no), held in docs.items():
        rows.setdefault((doc, side, i), []).append((no, {**held, 10_000 + i: alignment.COARSE}))
    table = [(d, s, i, [n for n, _ in x], [len(h) for _, h in x], [m for _, h in x for m in h], [w for _, h in x for w in h.values()]) for (d, s, i), x in rows.items()]
    chunks = spark.createDataFrame(table, "doc string, side int, id long, numbers array<int>, counts array<int>, marks array<int>, weights array<tinyint>")
    pairs = spark.createDataFrame(found, "doc string, id_1 long, no_1 int, id_2 long, no_2 int")
    want = set()
    for doc in "abc":
        gone = {(0, *f[1:3]) for f in found if f[0] == doc} | {(1, *f[3:]) for f in found if f[0] == doc}
        free = [{k[2:]: h for k, h in docs.items() if k[:2] == (doc, s) and k[1:] not in gone} for s in (0, 1)]
        count = [{}, {}]
        for s in (0, 1):
            for h in free[s].values():
                for m in h:
                    count[s][m] = count[s].get(m, 0) + 1
        scores = {}
        for a, x in free[0].items():
            for b, y in free[1].items():
                both = x.keys() & y.keys()
                info = [sum(math.log(len(free[s]) / count[s][m]) for m in both) for s in (0, 1)]
                w = sum(x[m] for m in both)
                if w >= alignment.MOVED * max(sum(x.values()), sum(y.values())) and w >= 10 and all(info[s] - math.log(len(free[s])) >= alignment.FAR for s in (0, 1)):
                    scores[a, b] = round(sum(info), 6)
        for (a, b), v in scores.items():
            mine, theirs = [u for (p, _), u in scores.items() if p == a], [u for (_, q), u in scores.items() if q == b]
            if v == max(mine) == max(theirs) and mine.count(v) == theirs.count(v) == 1:
                want.add((doc, *a, *b))
    got = [tuple(r) for r in alignment.moved_far(chunks, pairs).collect()]
    assert len(want) > 60 and set(got) == want and len(got) == len(want)
    assert alignment.moved_far(chunks.limit(0), pairs.limit(0)).count() == 0


def test_all_documents_teach_the_lexicon(spark, model):
    # no marks anywhere and equal lengths; each pair of words comes up in 4 of 3,300 documents only
    rng = random.Random(16)
    name = lambda k, letters: "".join(letters[(k // 6**p) % 6] for p in range(6))
    rows, want = [], set()
    for d in range(3300):
        own = [d // 4 * 2, d // 4 * 2 + 1]
        for side, (lang, letters) in enumerate((("en", "bdgkmp"), ("fr", "fhlnrs"))):
            say = lambda k: " ".join([*(rng.choice(WORDS[lang].split()) for _ in range(6)), *[name(k, letters) + x for x in "aeiou"]]).capitalize() + "."
            rows.append((10 * d + side, f"x/{d}", " ".join(say(k) for k in (own if side == 0 or d % 4 else own[::-1])), 1, lang))
        want |= {(10 * d, 1 + i, 10 * d + 1, (1 + i) if d % 4 else 2 - i) for i in (0, 1)}
    df = spark.createDataFrame(rows, "chunk_id long, doc_id string, text string, page int, lang string").withColumn("kind", F.lit("text"))
    got = {tuple(r) for r in alignment.align(df, model).collect()}
    assert len(got & want) >= 0.98 * len(want)


def test_memory_of_alignment_goes_by_sentences_not_rows(monkeypatch):
    """A task puts whole blocks of a bounded number of sentences together, however its rows come in; the pairs stay the same."""
    import numpy as np

    rng, rows, said = random.Random(7), [], []
    for b in range(300):
        doc, place = f"d{b // 2}", b % 2
        part = b // 30
        if b % 30 == 0:
            rows += [{"part": part, "block_no": alignment.BEFORE, "word": part, "other": part + 100, "value": 1.0}, {"part": part, "block_no": alignment.BEFORE, "word": 50, "other": 150, "value": 1.0}]
        for side in (0, 1):
            for k in range(rng.randint(1, 4)):
                n = rng.randint(1, 5)
                marks = [1000 + 100 * k + i for i in range(n)]
                bare = [0 if rng.random() < 0.3 else 1 for _ in range(n)]
                marks = [m for m, x in zip(marks, bare) if x]
                rows.append({"part": part, "block_no": b // 3, "doc": doc, "place": place, "ratio": 1.0, "side": side, "id": b * 10 + side * 5 + k, "numbers": list(range(1, n + 1)), "lengths": [50] * n, "counts": bare, "marks": marks, "weights": [12] * len(marks), "lex_counts": [1] * n, "lexemes": [rng.choice((part, 50)) + 100 * side for _ in range(n)]})
    whole = pa.Table.from_pylist(rows, pa.schema([("part", pa.int64()), ("block_no", pa.int64()), ("doc", pa.string()), ("place", pa.int64()), ("ratio", pa.float64()), ("side", pa.int32()), ("id", pa.int64()), *[(c, pa.list_(pa.int8() if c == "weights" else pa.int32())) for c in alignment._PARTS], ("word", pa.int32()), ("other", pa.int32()), ("value", pa.float64())])).combine_chunks()
    align_blocks = alignment.align_blocks
    monkeypatch.setattr(alignment, "align_blocks", lambda side, *a, **k: said.append(len(side)) or align_blocks(side, *a, **k))
    pairs = lambda batches: sorted(tuple(r.values()) for b in alignment._aligned()(batches) for r in b.to_pylist())
    expected = pairs(whole.to_batches())
    assert len(expected) > 500 and len(said) == 1
    monkeypatch.setattr(alignment.whole_blocks, "__defaults__", (200,))
    for size in (10_000, 7, 1):
        said.clear()
        assert pairs(whole.to_batches(max_chunksize=size)) == expected
        assert sum(said) == sum(len(r.get("numbers", ())) for r in rows) and max(said) <= 200 + 3 * 2 * 20
    for batch in alignment.whole_blocks(whole.to_batches(max_chunksize=50), 1):
        assert len(np.unique(batch.column("block_no"))) == 1
    assert pairs([]) == pairs(whole.slice(0, 0).to_batches()) == []


def test_cuts_follow_the_marks():
    import numpy as np

    n, kept = 3000, np.concatenate((np.arange(300), np.arange(2200, 3000), [1000]))
    side, block = np.repeat([0, 1], [n, len(kept)]), np.zeros(n + len(kept), np.int64)
    mark_of, mark = np.arange(n + len(kept)), np.concatenate((np.arange(n), kept)).astype(np.int32)
    source, s, b, mo, m, w, of = alignment.cut_long(side, block, mark_of, mark, np.full(n + len(kept), 12.0))
    i, j = alignment.align_blocks(s, b, np.full(len(source), 50.0), mo, m, w, np.ones(len(of)))
    assert {(int(x), int(y)) for x, y in zip(source[i], source[j])} == {(int(x), n + k) for k, x in enumerate(kept)}


def test_long_blocks_are_cut():
    import numpy as np

    n = 1500
    side, block = np.repeat([0, 1], n), np.zeros(2 * n, np.int64)
    mark_of, mark = np.arange(2 * n), np.concatenate((np.arange(n), np.arange(n))).astype(np.int32)
    source, s, b, mo, m, w, of = alignment.cut_long(side, block, mark_of, mark, np.full(2 * n, 12.0))
    assert np.bincount(b[s == 0]).max() <= 600 and (of == 0).all()
    i, j = alignment.align_blocks(s, b, np.full(len(source), 50.0), mo, m, w, np.ones(len(of)))
    assert {(int(x), int(y)) for x, y in zip(source[i], source[j])} == {(k, n + k) for k in range(n)}


# --- 5: scanned pages --------------------------------------------------------------------------------------------


def test_scanned_noise(spark):
    rng = random.Random(6)
    vocabulary = "maintenance records showed that the hydraulic line had been replaced earlier under work order and several passengers received minor injuries when turbulence struck near mountain station before landing".split()
    clean = [" ".join(rng.choice(vocabulary) for _ in range(60)) + "." for _ in range(120)]
    chunks, pages, want = [], [], set()
    for i, t in enumerate(clean):
        chunks.append((i, f"a/{i}", 1, t, "text"))
        pages.append((f"a/{i}", 1, t, False))
    confusions = [("m", "rn"), ("e", "c"), ("l", "1"), ("o", "0"), ("u", "ii")]
    for p in range(60):
        words, lines = [rng.choice(vocabulary) for _ in range(48)], []
        for k in range(0, 48, 8):
            lines.append(words[k : k + 8])
        chunk = 1000 + p
        for k in (1, 3):
            w = lines[k][2]
            a, b = confusions[(p + k) % len(confusions)]
            if a in w and len(w) > 4:
                lines[k][2] = w.replace(a, b, 1)
                want.add((chunk, k + 2, "misread", w))
        long = lines[4][7]
        text = [" ".join(x) for x in lines]
        if len(long) > 7:
            text[4], text[5] = " ".join(lines[4][:7]) + " " + long[:4] + "-", long[4:] + " " + text[5]
            want.add((chunk, 6, "hyphen", long))
        head = f"Runway Excursion Hesper Torvik Nolway {p // 6}"
        chunks.append((chunk, f"s/{p // 6}", p % 6 + 1, "\n".join([head, *text, str(p % 6 + 1)]), "text"))
        pages.append((f"s/{p // 6}", p % 6 + 1, "", True))
        want |= {(chunk, 1, "header", ""), (chunk, 8, "page_no", "")}
    chunks += [(5000, "s/0", 1, None, None), (5001, None, 1, "x", None), (None, "s/0", 1, "x", None), (5002, "s/0", 1, "", "figure")]
    pages += [("s/0", 1, "", True), (None, None, None, None)]
    c = spark.createDataFrame(chunks, "chunk_id long, doc_id string, page int, text string, kind string").withColumn("word", F.lit("clash"))
    g = spark.createDataFrame(pages, "doc_id string, page int, text string, image_only boolean").withColumn("line_no", F.lit(1))
    got = {tuple(r) for r in scans.noise(c, g).collect()}
    for kind, least in (("header", 0.99), ("page_no", 0.99), ("hyphen", 0.99), ("misread", 0.9)):
        a, b = {x for x in want if x[2] == kind}, {x for x in got if x[2] == kind}
        assert len(a & b) >= least * len(a) and len(a & b) >= least * len(b), kind
    assert scans.noise(c.limit(0), g.limit(0)).count() == 0


def test_scanned_text_is_repaired(spark):
    found = [(1, "header", "", None), (3, "misread", "member", "rnember"), (3, "hyphen", "landing", "landing"), (5, "misread", "2013", "2o13"), (6, "page_no", "", None)]
    text = "Head Of Page\n\nRnember of the crew saw it before lan-\nding. Then the wing was\nseen in (2O13).\n7"
    assert scans.repair(text, found) == "Member of the crew saw it before landing. Then the wing was seen in (2013)."
    assert scans.repair("安全\n检查\n\nnew one", []) == "安全检查\nnew one"
    c = spark.createDataFrame([(1, "a/1", 1, "one\ntwo", "text"), (2, "a/2", 1, "one\ntwo\n3", "text"), (3, "a/1", 1, None, None), (None, "a/2", 1, "x\ny", "text")], "chunk_id long, doc_id string, page int, text string, kind string")
    g = spark.createDataFrame([("a/1", 1, "one two", False), ("a/2", 1, "", True)], "doc_id string, page int, text string, image_only boolean")
    got = {r["chunk_id"]: r["text"] for r in scans.repaired(c, g).collect()}
    assert got == {1: "one\ntwo", 2: "one two", 3: None, None: "x\ny"}


# --- 6: encoding -------------------------------------------------------------------------------------------------

VOCABULARY = os.path.join(os.environ.get("CORPUSLOOM_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_encoding_equals_the_library(spark):
    import base64

    import tiktoken

    with open(VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    own = tiktoken.Encoding("own", pat_str=encoding.WORD, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    texts = [None, "", " ", "\r\n\r\n x", "<|endoftext|>", "It's we'll  don't　 安全🛩️ שלום नमस्ते", "a" * 3000, "x   y   \n"]
    texts += ["".join(rng.choice("abc de'1234 \n\téÉ安全，.!?—-_½²🛩") for _ in range(rng.randint(1, 200))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    got = {r["doc_id"]: r["ids"] for r in encoding.encode(df, VOCABULARY).collect()}
    assert got == {i: own.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert encoding.encode(df.limit(0), VOCABULARY).count() == 0
    with pytest.raises(FileNotFoundError):
        encoding.encode(df, "/nowhere")


# --- 7: leakage --------------------------------------------------------------------------------------------------


def test_leakage_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "安", "全"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(f"q{i}", say(rng.choice([5, 12, 30]))) for i in range(40)] + [("null", None), ("empty", ""), ("q0", say(15))]
    docs = []
    for i in range(200):
        t = say(rng.choice([0, 8, 60]))
        if rng.random() < 0.5:
            p = rng.choice(items[:40])[1].split()
            a = rng.randrange(max(1, len(p) - 10))
            t += rng.choice([" ", ", "]) + " / ".join(p[a : a + rng.choice([11, 12, 13, 40])]).upper() + " " + say(3)
        docs.append((i, t))
    docs += [(1000 + i, t) for i, t in enumerate(ODD)] + [(5, docs[5][1])]
    grams = {}
    for k, p in items:
        w = plain_words(p or "")
        for i in range(len(w) - 11):
            grams.setdefault(tuple(w[i : i + 12]), set()).add(k)
    want = set()
    for i, t in docs:
        w = plain_words(t or "")
        for j in range(len(w) - 11):
            want |= {(i, k) for k in grams.get(tuple(w[j : j + 12]), ())}
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    q = spark.createDataFrame(items, "item_id string, passage string").withColumn("text", F.lit("clash"))
    assert want
    for block in (20_000, 7):
        out = leakage.leaked_items(d, q, items_per_block=block)
        assert out.count() == len(want) and {tuple(r) for r in out.collect()} == want
    assert leakage.leaked_items(d.limit(0), q).count() == 0 and leakage.leaked_items(d, q.limit(0)).count() == 0


# --- 8: shared spans ---------------------------------------------------------------------------------------------


def brute_shared(docs, length):
    own = {}
    for k, t in docs:
        for i in range(len(t or "") - length + 1):
            own.setdefault(t[i : i + length], set()).add(k)
    out = {}
    for k, t in docs:
        inside = set()
        for i in range(len(t or "") - length + 1):
            if len(own[t[i : i + length]]) > 1:
                inside.update(range(i, i + length))
        if inside:
            out[k] = len(inside)
    return out


@pytest.mark.parametrize("piece", [1 << 19, 64])
def test_shared_spans_equal_brute_force(spark, monkeypatch, piece):
    rng = random.Random(11)
    say = lambda n: "".join(rng.choice("abcd \n安") for _ in range(n))
    base = [say(rng.randint(0, 260)) for _ in range(40)]
    docs = []
    for i in range(160):
        t = say(rng.randint(0, 60))
        for _ in range(rng.choice([0, 0, 1, 2])):
            b = rng.choice(base)
            a = rng.randrange(max(1, len(b) - 25))
            t += b[a : a + rng.randint(20, 200)] + rng.choice(["", say(9)])
        docs.append((i, t))
    docs += [(500 + i, docs[3][1] + say(80)) for i in range(6)] + [(600 + i, "ab" * 50) for i in range(4)] + [(700, None), (701, ""), (702, "a" * 90)]
    want = brute_shared(docs, 30)
    df = spark.createDataFrame(docs + [docs[8]], "doc_id long, text string").withColumn("lo", F.lit("clash")).repartition(3)
    monkeypatch.setattr(spans, "PIECE", piece)
    got = {r["doc_id"]: r["shared_chars"] for r in spans.shared_characters(df, length=30, gram=12).collect()}
    assert want and got == want
    assert spans.shared_characters(df.limit(0)).count() == 0


def test_shared_sentences_equal_brute_force(spark):
    """Texts of lines and sentences: units of both kinds, spans that begin and end inside them, many copies."""
    rng = random.Random(12)
    say = lambda: " ".join("".join(rng.choice("abé安") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 7))) + rng.choice([". ", "! ", "。", ".\n", "\n", "\r\n\n", " "])
    base = ["".join(say() for _ in range(rng.randint(2, 14))) for _ in range(25)]
    docs = []
    for i in range(150):
        t = "".join(say() for _ in range(rng.randint(0, 4)))
        for _ in range(rng.choice([0, 1, 2])):
            b = rng.choice(base)
            a = rng.randrange(max(1, len(b) - 30))
            t += b[a : a + rng.randint(25, 220)] + rng.choice(["", say(), say()])
        docs.append((str(i), t))
    docs += [(f"c{i}", base[0] * 2) for i in range(12)]
    want = brute_shared(docs, 40)
    df = spark.createDataFrame(docs, "doc_id string, text string").repartition(3)
    assert want and {r["doc_id"]: r["shared_chars"] for r in spans.shared_characters(df, length=40).collect()} == want


def test_repeated_lines_keep_the_first(spark):
    line = "The board recommends that operators revise the checklist for the pump."
    docs = [(3, f"{line}\r\nshort\nown line of the third document, which stands alone"), (1, f"short\n\n  {line.upper()}"), (2, f"{line}\n{line}\nshort"), (4, None), (5, ""), (None, line), (6, "é" * 60_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("line_no", F.lit("clash"))
    got = {tuple(r) for r in spans.repeated_lines(df).collect()}
    assert got == {(2, 1, 0, 70, 1, 3), (2, 2, 71, 141, 1, 3), (3, 1, 0, 71, 1, 3)}
    clean = {r["doc_id"]: r["text"] for r in spans.without_repeats(df).collect()}
    assert clean[2] == "short" and clean[3].startswith("short\nown") and clean[1] == docs[1][1] and clean[4] is None and clean[5] == "" and clean[None] == line
    assert spans.without_repeats(df).columns == df.columns and spans.without_repeats(df.limit(0)).count() == 0


def test_one_key_shares_nothing_with_itself(spark):
    df = spark.createDataFrame([(1, "x" * 1000), (1, "x" * 1000), (None, "x" * 1000)], "doc_id long, text string")
    assert spans.shared_characters(df).count() == 0


def test_queries_are_registered():
    from corpusloom.llm import queries

    assert {f"p{i}_found" for i in (1, 2, 3, 4, 5, 7, 8)} | {"p2_text", "p5_text", "p6_ids", "p8_text"} <= set(queries.queries())
    assert re.fullmatch(r"[\w./-]+", queries.TOKENIZERS)
