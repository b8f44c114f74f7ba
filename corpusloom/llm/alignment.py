"""Sentence alignment in bilingual documents: length-based dynamic programming.

1. Each chunk is split into sentences and these go to the versions of their languages; a sentence keeps its length and
   its marks: numbers, codes and names, which translations share.
2. Of every document with several languages each two are aligned, however few their sentences and wherever they stand; the
   alignment tells whether they are two versions: more than half of the shorter one's sentences have a rendering by marks or
   words, a part of one left aside for chance (stretches in another language inside one version have none). The first
   version is cut into blocks of neighbouring chunks (short documents are one block), so that no task holds more than a few
   hundred chunks whatever the size of a document; the second version's chunks go where marks that each version has once put
   them, and to the neighbour blocks, so that parts left out of a version shift nothing.
3. Within a block the best path over one-to-one, omission, merge and split beads is found. The price of a bead is
   the negative log-probability of its length ratio (two-sided, a normal distribution around the ratio of the two languages,
   which is measured over all bilingual documents, with a variance of VARIANCE for each character), of its kind, and of the
   marks that its sides share or lack.
   Sentences without marks are told apart by their words: a first run over all blocks gives pairs of
   such sentences by length and place, their words that come up together make a lexicon (Dice), of which each part of the
   blocks gets the entries of its own words, and the lexicon's agreement is part of the price in the run over all blocks.
4. Sentences that the path leaves out were moved where most of their marks stand in a sentence that still has these
   marks to give; they pair across the path. Of documents of several blocks the sentences left out on both sides are then
   joined over the whole document by their marks (``moved_far``); one without rare marks, or whose rendering is part of a
   sentence already paired, is found within reach of its block only.

The programme runs over many blocks at once, a row of all their tables in one array operation. A block comes to it as one row
a chunk, and the blocks of AT_ONCE sentences are put together there, so that memory is bounded by sentences and not by the rows of
a task. Chunks written twice
are aligned once and give a pair each. Results: (chunk_id_1, sent_no_1, chunk_id_2, sent_no_2), the smaller chunk_id
first, each row once. Null, empty and blank texts have no sentences; rows without a key or document are left out.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.running import before_sum, last_known
from corpusloom.llm import codepoints as cp
from corpusloom.llm import sentences
from corpusloom.llm.language import LanguageModel, chain
from corpusloom.session import materialize

# Prices (negative log-probabilities) of the kinds of beads.
ONE, OMIT, MERGE = 0.1, 3.0, 1.6
VARIANCE = 13.6
WORDS = 3.5  # price of a sentence without marks whose known words are not rendered; as much is gained where they are
CHANCE = 0.5  # sentences that agree by chance: one alone is no version
RENDERED = 0.5  # of the shorter version's sentences more have a sure rendering, else there are no two versions
MOVED = 0.65  # least share of a moved sentence's marks
LONG = 600  # sentences of a side from which on a block is cut
FAR = 3.0  # -log of the expected number of sentences that share as much with one moved to another block by chance
COARSE = 3  # weight of a rounded number, which says nothing that the number doesn't
SCALE = 4  # weights of marks are whole numbers of quarters
AT_ONCE = 1 << 15  # sentences that a task aligns in one array operation
PART = 2048  # chunks whose blocks share their lexicon's entries
BEFORE = -(1 << 63)  # block_no of a part's lexicon


def marks(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks of each sentence: sentence, 32-bit hash and weight (in quarters). Numbers count without leading zeros and
    thousands separators, long ones also rounded to two figures; codes have letters and digits; names begin with a
    capital letter."""
    edges = np.append(start, end[-1:] if len(end) else np.zeros(0, np.int64))
    h, ws, we, first = cp.words(points, edges)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(start)), np.diff(first))
    size = we - ws
    digit = (points >= 48) & (points <= 57)
    digits = np.add.reduceat(np.append(digit, False), ws).astype(np.int64)
    digits = np.minimum(digits, size)
    number = (digits == size) & (size <= 12)
    code = (digits > 0) & ~number & (size >= 3) & (points[ws] < 128)
    capital = (points[ws] >= 65) & (points[ws] <= 90)
    name = capital & (digits == 0) & (size >= 4)
    opening = np.isin(np.arange(len(h)), first[:-1]) & (points[np.minimum(we, len(points) - 1)] == 0x20)
    name &= ~opening  # an opening word's capital says nothing, but before Chinese it is a name
    # values of the numbers
    at = np.flatnonzero(number)
    value = np.zeros(len(h), np.int64)
    for k in range(12):
        more = at[size[at] > k]
        value[more] = value[more] * 10 + points[ws[more] + k] - 48
    gap = np.zeros(len(h), bool)
    one = (ws[1:] - we[:-1]) == 1
    between = points[np.minimum(we[:-1], len(points) - 1)]
    gap[1:] = one & np.isin(between, [0x2C, 0x20, 0x2E]) & number[1:] & number[:-1] & (size[1:] == 3) & (size[:-1] <= 3) & (owner[1:] == owner[:-1])
    joined = number.copy()
    follow = np.flatnonzero(gap)
    value[follow] += value[follow - 1] * 1000
    joined[follow - 1] = False
    keep = joined | code | name
    figures = np.where(number, np.floor(np.log10(np.maximum(value, 1))).astype(np.int64) + 1, 0)
    hashed = np.where(number, cp.mix(value.astype(np.uint64) + np.uint64(17)), h)
    weight = np.where(number, np.where(figures >= 3, 5, np.where(figures == 2, 4, 2)), np.where(code, 12, 8))
    exact = (owner[keep], hashed[keep], weight[keep])
    big = joined & (figures >= 3)
    power = 10 ** np.maximum(figures[big] - 2, 0)
    coarse = (owner[big], cp.mix((value[big] // power * 64 + figures[big]).astype(np.uint64) + np.uint64(1 << 40)), np.full(big.sum(), 3))
    owner, hashed, weight = (np.concatenate(x) for x in zip(exact, coarse))
    hashed = (hashed >> np.uint64(32)).astype(np.uint32).view(np.int32)
    _, once = np.unique(owner.astype(np.uint64) << np.uint64(32) | hashed.view(np.uint32).astype(np.uint64), return_index=True)
    return owner[once], hashed[once], weight[once]


def lexemes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each sentence that are no marks, each once: sentence and 32-bit hash. Of Latin words those in small letters
    and the opening one, of Chinese pairs of neighbouring characters."""
    edges = np.append(start, end[-1:] if len(end) else np.zeros(0, np.int64))
    h, ws, we, first = cp.words(points, edges)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(start)), np.diff(first))
    kind = cp.classes()[points[ws]]
    chinese = (kind & cp.CJK) > 0
    small = ((kind & cp.LETTER) > 0) & ~chinese & (we - ws >= 2)
    opening = np.isin(np.arange(len(h)), first[:-1])
    low = cp.lower_table()[points[ws]] == points[ws]
    keep = small & (low | opening)
    pair = chinese[:-1] & chinese[1:] & (owner[:-1] == owner[1:]) & (we[:-1] == ws[1:])
    both = cp.mix(h[:-1] * np.uint64(7) + h[1:])[pair]
    owner, hashed = np.concatenate((owner[keep], owner[:-1][pair])), np.concatenate((h[keep], both))
    hashed = (hashed >> np.uint64(32)).astype(np.uint32)
    _, once = np.unique(owner.astype(np.uint64) << np.uint64(32) | hashed.astype(np.uint64), return_index=True)
    return owner[once], hashed[once].view(np.int32)


def _features(model: LanguageModel, texts: pa.Array) -> tuple[np.ndarray, dict[str, list]]:
    """For each row and each language in it: the row, and the language's sentences with numbers, lengths, marks and words."""
    points, start, end, row = sentences.in_usual_form(*cp.decode(texts))
    lang, _ = chain(model, points, start, end, row)
    number = np.arange(len(row)) - np.searchsorted(row, row) + 1
    part = row * len(model.languages) + lang
    order = np.argsort(part, kind="stable")
    parts, per = np.unique(part, return_counts=True)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))  # of each sentence among those ordered by part
    offs = lambda sizes: pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    first = np.concatenate(([0], np.cumsum(per)))
    lists = lambda o, v, t: pa.ListArray.from_arrays(o, pa.array(v, t))

    def held(of: np.ndarray, *values: np.ndarray):
        """Numbers a sentence, offsets by part, and the values in the sentences' order."""
        count = np.bincount(place[of], minlength=len(order))
        put = np.argsort(place[of], kind="stable")
        ends = np.concatenate(([0], np.cumsum(count)))
        return count, pa.array(ends[first].astype(np.int32)), *(v[put] for v in values)

    count, mark_offs, mark, weight = held(*marks(points, start, end))
    lex_count, lex_offs, lex = held(*lexemes(points, start, end))
    return parts // len(model.languages), {
        "lang": pa.array(parts % len(model.languages), pa.int32()),
        "numbers": lists(offs(per), number[order], pa.int32()),
        "lengths": lists(offs(per), (end - start)[order], pa.int32()),
        "counts": lists(offs(per), count, pa.int32()),
        "marks": lists(mark_offs, mark, pa.int32()),
        "weights": lists(mark_offs, weight, pa.int8()),
        "lex_counts": lists(offs(per), lex_count, pa.int32()),
        "lexemes": lists(lex_offs, lex, pa.int32()),
    }


def _length_price(l1: np.ndarray, l2: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """-log of the probability that the lengths differ so much by chance: the normal distribution's two tails, their probability
    by a rational approximation (error below 1e-6 of log), bounded at 12."""
    mean = (l1 + l2 / ratio) / 2
    z = np.abs(l2 / ratio - l1) / np.sqrt(np.maximum(mean, 1) * 2 * VARIANCE)
    t = 1 / (1 + 0.5 * z)
    # Coefficients of the complementary error function's expansion.
    series = np.full_like(t, 0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        series = series * t + c
    return np.minimum(z * z - series - np.log(t), 12)


def _mark_price(common: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
    most, least = np.maximum(w1, w2), np.minimum(w1, w2)
    share = common / np.maximum(most, 1)
    return np.where(most == 0, 0.3, np.where(least == 0, np.minimum(9.0, 1.5 * most), 9.0 - 16.0 * share))


class Lexicon:
    """Words of the one language with those of the other that come up in their renderings, and how surely: 1 for the
    surest rendering of a word. Entries may come several times."""

    def __init__(self, words: np.ndarray, others: np.ndarray, values: np.ndarray):
        place = words.view(np.uint32).astype(np.uint64) << np.uint64(32) | others.view(np.uint32).astype(np.uint64)
        _, once = np.unique(place, return_index=True)
        once = once[np.argsort(words[once], kind="stable")]
        self.words, self.others, self.values = words[once], others[once], values[once]


def bare_scores(lexicon: Lexicon, bare: np.ndarray, side: np.ndarray, block: np.ndarray, lex_of: np.ndarray, lex: np.ndarray):
    """For sentences without marks (``bare``): the share of their words that the lexicon knows, and (sentence, sentence of
    the other side, share of the known words that it renders)."""
    at = np.flatnonzero(bare[lex_of])
    lo, hi = np.searchsorted(lexicon.words, lex[at]), np.searchsorted(lexicon.words, lex[at], side="right")
    known = hi > lo
    size = np.bincount(lex_of[at], minlength=len(bare))
    n_known = np.bincount(lex_of[at[known]], minlength=len(bare))
    at, lo, count = at[known], lo[known], (hi - lo)[known]
    entry = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(at, count)
    sent = lex_of[at]
    # the other side's words by (block, side, word)
    place = lambda b, s, w: (b.astype(np.uint64) * np.uint64(2) + s.astype(np.uint64)) << np.uint64(32) | w.view(np.uint32).astype(np.uint64)
    there = place(block[lex_of], side[lex_of], lex)
    order = np.argsort(there, kind="stable")
    wanted = place(block[sent], 1 - side[sent], lexicon.others[entry])
    lo, hi = np.searchsorted(there[order], wanted), np.searchsorted(there[order], wanted, side="right")
    count = hi - lo
    other = lex_of[order[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]]
    at, value = np.repeat(at, count), np.repeat(lexicon.values[entry], count)
    # of each word its best rendering in each sentence
    order = np.lexsort((-value, other, at))
    at, other, value = at[order], other[order], value[order]
    best = np.concatenate(([True], (at[1:] != at[:-1]) | (other[1:] != other[:-1])))[: len(at)]
    at, other, value = lex_of[at[best]], other[best], value[best]
    pair = at.astype(np.uint64) << np.uint64(32) | other.astype(np.uint64)
    pair, which = np.unique(pair, return_inverse=True)
    i, j = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return n_known / np.maximum(1, size), i, j, np.bincount(which, weights=value, minlength=len(pair)) / np.maximum(1, n_known[i])


def _path(l1, l2, w1, w2, common, n, m, ratio, words=None):
    """Best bead paths of D blocks: arrays padded to N x M. Yields (block, i, j, bead) arrays of the one-to-one (0), two-to-one
    (1) and one-to-two (2) beads, i and j being the last sentences of the bead."""
    d, big_n, big_m = common.shape
    r = ratio[:, None, None]
    one = ONE + _length_price(l1[:, :, None], l2[:, None, :], r) + _mark_price(common, w1[:, :, None], w2[:, None, :])
    if words is not None:
        one = one + words
    inf = np.float32(1e9)
    two = np.full_like(one, inf)  # sentences i - 1 and i with j
    if big_n > 1:
        two[:, 1:] = MERGE + _length_price((l1[:, 1:] + l1[:, :-1])[:, :, None], l2[:, None, :], r) + _mark_price(common[:, 1:] + common[:, :-1], (w1[:, 1:] + w1[:, :-1])[:, :, None], w2[:, None, :])
        if words is not None:
            two[:, 1:] += words[:, 1:] + words[:, :-1]
    split = np.full_like(one, inf)
    if big_m > 1:
        split[:, :, 1:] = MERGE + _length_price(l1[:, :, None], (l2[:, 1:] + l2[:, :-1])[:, None, :], r) + _mark_price(common[:, :, 1:] + common[:, :, :-1], w1[:, :, None], (w2[:, 1:] + w2[:, :-1])[:, None, :])
        if words is not None:
            split[:, :, 1:] += words[:, :, 1:] + words[:, :, :-1]
    step = np.arange(big_m + 1) * OMIT
    rows = [np.broadcast_to(step, (d, big_m + 1)).astype(np.float64)]
    came = np.full((d, big_n + 1, big_m + 1), 3, np.int8)  # 3: from the left (omission in the second version)
    for i in range(1, big_n + 1):
        up = rows[i - 1]
        options = np.full((5, d, big_m + 1), np.float64(inf))
        options[0, :, 1:] = up[:, :-1] + one[:, i - 1]
        if i > 1:
            options[1, :, 1:] = rows[i - 2][:, :-1] + two[:, i - 1]
        options[2, :, 2:] = up[:, :-2] + split[:, i - 1, 1:]
        options[4] = up + OMIT
        kind = options.argmin(axis=0)
        base = np.take_along_axis(options, kind[None], axis=0)[0]
        best = np.minimum.accumulate(base - step, axis=1) + step
        came[:, i] = np.where(best < base - 1e-9, 3, kind)
        rows.append(best)
    i, j, live = n.copy(), m.copy(), np.arange(d)
    out = []
    came[:, 1:, 0] = 4
    while len(live):
        kind = came[live, i[live], j[live]]
        hit = kind < 3
        out.append((live[hit], i[live[hit]] - 1, j[live[hit]] - 1, kind[hit]))
        i[live] -= np.array([1, 2, 1, 0, 1])[kind]
        j[live] -= np.array([1, 1, 2, 1, 0])[kind]
        live = live[(i[live] > 0) | (j[live] > 0)]
    return (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def _anchors(side: np.ndarray, local: np.ndarray, owner: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (side 0, side 1) of the marks, and of neighbouring marks together, that each side has once."""
    h = mark.view(np.uint32).astype(np.uint64)
    same = owner[1:] == owner[:-1]
    key = np.concatenate((cp.mix(h + np.uint64(1)), cp.mix(h[:-1] * np.uint64(7) + h[1:] + np.uint64(1 << 40))[same]))
    owner = np.concatenate((owner, owner[1:][same]))
    once = []
    for s in (0, 1):
        mine = np.flatnonzero(side[owner] == s)
        keys, at, n = np.unique(key[mine], return_index=True, return_counts=True)
        once.append((keys[n == 1], local[owner[mine[at[n == 1]]]]))
    _, i, j = np.intersect1d(once[0][0], once[1][0], assume_unique=True, return_indices=True)
    pairs = np.unique(np.stack((once[0][1][i], once[1][1][j]), axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _rising(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs form a longest chain that rises on both sides."""
    order = np.lexsort((-j, i))
    ends, at, before = [], [], np.full(len(i), -1)
    for x in order.tolist():
        k = bisect.bisect_left(ends, j[x])
        before[x] = at[k - 1] if k else -1
        ends[k : k + 1], at[k : k + 1] = [j[x]], [x]
    chain, x = [], at[-1] if at else -1
    while x >= 0:
        chain.append(x)
        x = before[x]
    return np.array(chain[::-1], np.int64)


def held_by(source: np.ndarray, of: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """What the sentences ``source`` hold, where ``values`` belong to the sentences ``of``: new owners and values."""
    lo, hi = np.searchsorted(of, source), np.searchsorted(of, source, side="right")
    size = hi - lo
    at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return np.repeat(np.arange(len(source)), size), *(v[at] for v in values)


def cut_long(side, block, mark_of, mark, weight, *, most: int = LONG):
    """Cuts blocks of more than ``most`` sentences on a side into even parts of side 0. Sentences of side 1 go to the part
    where the chain of marks that both sides have once puts them, in proportion between two such marks, and to its
    neighbours; marks off the chain take their sentence to their own part too. Gives the source of each sentence, the
    new columns and the old block of each new one."""
    blocks = int(block.max()) + 1 if len(block) else 0
    n = np.stack([np.bincount(block[side == s], minlength=blocks) for s in (0, 1)])
    parts = np.maximum(1, -(-n.max(axis=0) // most))
    if (parts == 1).all():
        return np.arange(len(block)), side, block, mark_of, mark, weight, np.arange(blocks)
    begin = np.searchsorted(block, np.arange(blocks))
    local = np.arange(len(block)) - begin[block] - np.where(side == 1, n[0][block], 0)
    part, extra = np.zeros(len(block), np.int64), []
    for b in np.flatnonzero(parts > 1):
        lo, mid, hi = begin[b], begin[b] + n[0, b], begin[b] + n[0, b] + n[1, b]
        m = slice(np.searchsorted(mark_of, lo), np.searchsorted(mark_of, hi))
        i, j = _anchors(side, local, mark_of[m], mark[m])
        way = _rising(i, j)
        place = np.interp(local[mid:hi], np.concatenate(([0], j[way], [n[1, b]])), np.concatenate(([0], i[way], [n[0, b]])))
        while True:  # a stretch of side 1 without counterpart may crowd into one part: smaller parts of side 0
            per = parts[b] / max(1, n[0, b])
            part[lo:mid] = local[lo:mid] * parts[b] // max(1, n[0, b])
            part[mid:hi] = np.minimum((place * per).astype(np.int64), parts[b] - 1)
            crowd = np.bincount(part[lo:mid], minlength=parts[b]).max(initial=0) * 3 * np.bincount(part[mid:hi], minlength=parts[b]).max(initial=0)
            if crowd <= 6 * most * most or parts[b] >= n[0, b]:
                break
            parts[b] *= 2
        far = np.flatnonzero(np.abs(part[lo + i] - part[mid + j]) > 1)
        extra.append(np.unique(np.stack((mid + j[far], part[lo + i[far]]), axis=1), axis=0))
    first = np.concatenate(([0], np.cumsum(parts)))
    source, new = [], []
    for step in (-1, 0, 1):
        go = (part + step >= 0) & (part + step < parts[block]) & ((side == 1) | (step == 0))
        source.append(np.flatnonzero(go))
        new.append((first[block] + part + step)[go])
    for x in extra:
        source.append(x[:, 0])
        new.append(first[block[x[:, 0]]] + x[:, 1])
    source, new = np.concatenate(source), np.concatenate(new)
    order = np.lexsort((source, side[source], new))
    source, new = source[order], new[order]
    return source, side[source], new, *held_by(source, mark_of, mark, weight), np.repeat(np.arange(blocks), parts)


def align_blocks(side: np.ndarray, block: np.ndarray, length: np.ndarray, mark_of: np.ndarray, mark: np.ndarray, weight: np.ndarray, ratio: np.ndarray, *, lex_of: np.ndarray | None = None, lex: np.ndarray | None = None, lexicon: Lexicon | None = None, cells: int = 400_000, sure: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (sentence of side 0, sentence of side 1) of sentences sorted by block, side and order. ``ratio`` is the
    expected length of side 1 for one character of side 0, by block. ``sure`` takes whether marks or words confirm a pair."""
    blocks = len(ratio)
    n = np.bincount(block[side == 0], minlength=blocks)
    m = np.bincount(block[side == 1], minlength=blocks)
    begin = np.searchsorted(block, np.arange(blocks))
    local = np.arange(len(block)) - begin[block] - np.where(side == 1, n[block], 0)
    total = np.bincount(mark_of, weights=weight, minlength=len(block)) / SCALE
    # common marks of the two sides of a block
    key = block[mark_of].astype(np.uint64) << np.uint64(32) | mark.view(np.uint32).astype(np.uint64)
    a, b = np.flatnonzero(side[mark_of] == 0), np.flatnonzero(side[mark_of] == 1)
    b = b[np.argsort(key[b], kind="stable")]
    lo, hi = np.searchsorted(key[b], key[a]), np.searchsorted(key[b], key[a], side="right")
    count = hi - lo
    left = np.repeat(a, count)
    right = b[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    si, sj, w = mark_of[left], mark_of[right], weight[left] / SCALE
    pair_block = block[si]
    order = np.argsort(pair_block, kind="stable")
    si, sj, w, pair_block = si[order], sj[order], w[order], pair_block[order]

    known = bare = None
    if lexicon is not None and len(lexicon.words) and len(lex):
        bare = total == 0
        known, xi, xj, xs = bare_scores(lexicon, bare, side, block, lex_of, lex)

    both = np.flatnonzero((n > 0) & (m > 0))
    both = both[np.argsort(n[both] * 4096 + m[both], kind="stable")]
    firsts, seconds = [], []
    at = 0
    while at < len(both):
        take, top_n, top_m = 0, 0, 0
        while at + take < len(both):
            x = both[at + take]
            tn, tm = max(top_n, n[x]), max(top_m, m[x])
            if take and (take + 1) * tn * tm > cells:
                break
            top_n, top_m, take = tn, tm, take + 1
        group = both[at : at + take]
        at += take
        slot = np.full(blocks, -1)
        slot[group] = np.arange(take)
        own = slot[block] >= 0
        grid = np.zeros((2, 2, take, max(top_n, top_m)))
        s = np.flatnonzero(own)
        grid[side[s], 0, slot[block[s]], local[s]] = length[s]
        grid[side[s], 1, slot[block[s]], local[s]] = total[s]
        p = np.flatnonzero(slot[pair_block] >= 0)
        common = np.bincount((slot[pair_block[p]] * top_n + local[si[p]]) * top_m + local[sj[p]], weights=w[p], minlength=take * top_n * top_m).reshape(take, top_n, top_m)
        l1, w1, l2, w2 = grid[0, 0, :, :top_n], grid[0, 1, :, :top_n], grid[1, 0, :, :top_m], grid[1, 1, :, :top_m]
        words = None
        if bare is not None:
            # a bare sentence whose known words the other one does not render is no rendering of it
            words = np.zeros(common.shape)
            b = np.flatnonzero(own & bare)
            for one_side in (0, 1):
                x = b[side[b] == one_side]
                price = np.zeros(grid.shape[2:])
                price[slot[block[x]], local[x]] = known[x] * WORDS
                words += price[:, :top_n, None] if one_side == 0 else price[:, None, :top_m]
                p = np.flatnonzero((side[xi] == one_side) & (slot[block[xi]] >= 0))
                a_, b_ = (local[xi[p]], local[xj[p]]) if one_side == 0 else (local[xj[p]], local[xi[p]])
                np.add.at(words, (slot[block[xi[p]]], a_, b_), -known[xi[p]] * xs[p] * 2 * WORDS)
        d, i, j, kind = _path(l1, l2, w1, w2, common, n[group], m[group], ratio[group], words)
        i2 = np.concatenate((i, i[kind == 1] - 1, i[kind == 2]))
        j2 = np.concatenate((j, j[kind == 1], j[kind == 2] - 1))
        d2 = np.concatenate((d, d[kind == 1], d[kind == 2]))
        c, x, y = common[d2, i2, j2], w1[d2, i2], w2[d2, j2]
        alone = np.concatenate((kind == 0, np.repeat(False, len(d2) - len(d))))
        fine = np.where(alone, c >= 0.4 * np.maximum(x, y), c >= 0.4 * np.minimum(x, y)) | (np.minimum(x, y) == 0) & ((np.maximum(x, y) <= 2) | ~alone)
        if words is not None:
            fine &= words[d2, i2, j2] < 0.5 * WORDS
        d2, i2, j2 = d2[fine], i2[fine], j2[fine]
        # moved sentences: left out by the path, most of their marks in a sentence whose marks are not yet taken
        free1, free2 = np.ones(l1.shape, bool), np.ones(l2.shape, bool)
        free1[d2, i2] = free2[d2, j2] = False
        taken1, taken2 = np.zeros(l1.shape), np.zeros(l2.shape)
        np.add.at(taken1, (d2, i2), common[d2, i2, j2])
        np.add.at(taken2, (d2, j2), common[d2, i2, j2])
        open1 = (common + taken1[:, :, None] <= 1.15 * w1[:, :, None] + 0.5) & (common >= 2.5)
        open2 = (common + taken2[:, None, :] <= 1.15 * w2[:, None, :] + 0.5) & (common >= 2.5)
        share = np.where(open2, common / np.maximum(1, w1[:, :, None]), 0) * free1[:, :, None]
        d3, i3 = np.nonzero(share.max(axis=2) >= MOVED)
        j3 = share.argmax(axis=2)[d3, i3]
        share = np.where(open1, common / np.maximum(1, w2[:, None, :]), 0) * free2[:, None, :]
        d4, j4 = np.nonzero(share.max(axis=1) >= MOVED)
        i4 = share.argmax(axis=1)[d4, j4]
        if words is not None:
            # moved sentences without marks: the best of each other by their words
            price = np.where(free1[:, :, None] & free2[:, None, :] & (w1 == 0)[:, :, None] & (w2 == 0)[:, None, :], words, 0)
            d5, i5 = np.nonzero(price.min(axis=2) <= -0.8 * WORDS)
            j5 = price.argmin(axis=2)[d5, i5]
            mutual = price.argmin(axis=1)[d5, j5] == i5
            d3, i3, j3 = (np.concatenate(x) for x in ((d3, d5[mutual]), (i3, i5[mutual]), (j3, j5[mutual])))
        d2, i2, j2 = np.concatenate((d2, d3, d4)), np.concatenate((i2, i3, i4)), np.concatenate((j2, j3, j4))
        if sure is not None:
            confirmed = common[d2, i2, j2] > 0
            sure.append(confirmed if words is None else confirmed | (words[d2, i2, j2] < -0.2 * WORDS))
        firsts.append(begin[group[d2]] + i2)
        seconds.append(begin[group[d2]] + n[group[d2]] + j2)
    none = np.zeros(0, np.int64)
    return np.concatenate(firsts or [none]), np.concatenate(seconds or [none])


_FEATURES = T.StructType([T.StructField("lang", T.IntegerType()), T.StructField("numbers", T.ArrayType(T.IntegerType())), T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("marks", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.ByteType())), T.StructField("lex_counts", T.ArrayType(T.IntegerType())), T.StructField("lexemes", T.ArrayType(T.IntegerType()))])

_PARTS = [f.name for f in _FEATURES.fields if f.name != "lang"]


def whole_blocks(batches, most: int = AT_ONCE):
    """The rows of ``batches``, where rows of one block_no follow each other, in batches of whole blocks: of about ``most`` sentences
    (only the rest of a block that began in another batch comes on top), or of one block."""
    put = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    kept, held = [], 0  # rows not yet given out, and their sentences
    for batch in batches:
        if not len(batch):
            continue
        no = batch.column("block_no").to_numpy()
        size = pa.compute.fill_null(pa.compute.list_value_length(batch.column("numbers")), 0).to_numpy(zero_copy_only=False)
        before = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        new = not kept or kept[-1].column("block_no")[-1].as_py() != no[0]
        begin = np.flatnonzero(np.concatenate(([new], no[1:] != no[:-1])))
        at = 0
        for lo, hi in zip(begin.tolist(), np.append(begin[1:], len(no)).tolist()):
            if (kept or lo > at) and held + before[hi] - before[at] > most:
                yield put([*kept, batch.slice(at, lo - at)])
                kept, held, at = [], 0, lo
        kept.append(batch.slice(at))
        held += before[-1] - before[at]
    if kept:
        yield put(kept)


def _aligned(learn: bool = False):
    """Aligns the blocks of batches of rows (block_no, doc, place, ratio, side and features of a chunk; before the blocks of a part
    its lexicon's rows, without doc): the pairs, or with ``learn`` the words of pairs of sentences without marks and how often
    each comes up (side 0 or 1) and comes up with a word of the other (side 2)."""

    def run(batches):
        last = None  # the lexicon's rows of the part that may go on
        for batch in whole_blocks(batches):
            lexicon = None
            if not learn:
                entries = pa.Table.from_batches([batch.filter(batch.column("doc").is_null()).select(["part", "word", "other", "value"])])
                part = batch.column("part")
                if last is not None:
                    entries = pa.concat_tables([last.filter(pa.compute.equal(last.column("part"), part[0])), entries])
                last = entries.filter(pa.compute.equal(entries.column("part"), part[-1])).combine_chunks()
                lexicon = Lexicon(*(entries.column(x).to_numpy() for x in ("word", "other", "value")))
            c = batch.filter(batch.column("doc").is_valid())
            as_np = lambda name: c.column(name).to_numpy(zero_copy_only=False)
            flat = lambda name: c.column(name).flatten().to_numpy(zero_copy_only=False)
            no, place, doc = as_np("block_no"), as_np("place"), c.column("doc")
            other = (no[1:] != no[:-1]) | (place[1:] != place[:-1]) | pa.compute.not_equal(doc[1:], doc[:-1]).to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(np.concatenate(([True], other))[: len(c)])
            sents = pa.compute.list_value_length(c.column("numbers")).to_numpy(zero_copy_only=False)
            chunk_of = np.repeat(np.arange(len(c)), sents)
            block = (np.searchsorted(begin, np.arange(len(c)), side="right") - 1)[chunk_of]
            side, ids = as_np("side")[chunk_of].astype(np.int64), as_np("id")[chunk_of]
            numbers, lengths = flat("numbers"), flat("lengths").astype(np.float64)
            mark_of, lex_of = (np.repeat(np.arange(len(numbers)), flat(n)) for n in ("counts", "lex_counts"))
            mark, weight = flat("marks").astype(np.int32), flat("weights").astype(np.float64)
            lex = flat("lexemes").astype(np.int32)
            source, side, block, mark_of, mark, weight, of = cut_long(side, block, mark_of, mark, weight)
            cut_lex_of, cut_lex = held_by(source, lex_of, lex)
            sure = []
            i, j = align_blocks(side, block, lengths[source], mark_of, mark, weight, as_np("ratio")[begin][of], lex_of=cut_lex_of, lex=cut_lex, lexicon=lexicon, sure=sure)
            if not learn:
                docs = doc.take(pa.array(begin[of[block[i]]]))
                i, j = source[i], source[j]
                yield pa.RecordBatch.from_arrays([docs, pa.array(ids[i], pa.int64()), pa.array(numbers[i], pa.int32()), pa.array(ids[j], pa.int64()), pa.array(numbers[j], pa.int32()), pa.array(np.concatenate(sure or [np.zeros(0, bool)]))], ["doc", "id_1", "no_1", "id_2", "no_2", "sure"])
                continue
            bare = np.bincount(mark_of, minlength=len(source)) == 0
            keep = bare[i] & bare[j]
            i, j = i[keep], j[keep]
            ends = np.searchsorted(cut_lex_of, np.arange(len(source) + 1))
            size = np.diff(ends)
            spread = lambda which, times: np.repeat(which, times)
            a = np.repeat(ends[i] - (np.cumsum(size[i]) - size[i]), size[i]) + np.arange(size[i].sum())
            b = np.repeat(ends[j] - (np.cumsum(size[j]) - size[j]), size[j]) + np.arange(size[j].sum())
            of_a = spread(np.arange(len(i)), size[i])
            # each word of the first sentence with all words of the second
            times = size[j][of_a]
            first = np.repeat(cut_lex[a], times)
            second = cut_lex[np.repeat(ends[j][of_a] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
            rows = np.concatenate((_tally(0, cut_lex[a], cut_lex[a]), _tally(1, cut_lex[b], cut_lex[b]), _tally(2, first, second)))
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0], pa.int32()), pa.array(rows[:, 1], pa.int32()), pa.array(rows[:, 2], pa.int32()), pa.array(rows[:, 3], pa.int64())], ["side", "word", "other", "n"])

    return run


def _bare_words(batches):
    """(part, word) of the words of sentences without marks, each once for a part and a batch."""
    for batch in batches:
        flat = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False)
        sents = pa.compute.list_value_length(batch.column("numbers")).to_numpy(zero_copy_only=False)
        parts, part = np.unique(batch.column("part").to_numpy(), return_inverse=True)
        lex_of = np.repeat(np.repeat(part, sents), flat("lex_counts"))
        bare = np.repeat(flat("counts") == 0, flat("lex_counts"))
        pair = np.unique(lex_of[bare].astype(np.uint64) << np.uint64(32) | flat("lexemes").astype(np.int32)[bare].view(np.uint32).astype(np.uint64))
        words = pa.array((pair & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(parts[(pair >> np.uint64(32)).astype(np.int64)]), words], ["part", "word"])


def _marks_of_sentences(batches):
    """(doc, side, id, no, mark, weight) of each mark of each sentence."""
    for batch in batches:
        numbers = batch.column("numbers")
        chunk_of = np.repeat(np.arange(len(batch)), pa.compute.list_value_length(numbers).to_numpy(zero_copy_only=False))
        sent_of = np.repeat(np.arange(len(chunk_of)), batch.column("counts").flatten().to_numpy(zero_copy_only=False))
        held = [batch.column(c).take(pa.array(chunk_of[sent_of])) for c in ("doc", "side", "id")]
        yield pa.RecordBatch.from_arrays([*held, numbers.flatten().take(pa.array(sent_of)), batch.column("marks").flatten(), batch.column("weights").flatten().cast(pa.int32())], ["doc", "side", "id", "no", "mark", "weight"])


def moved_far(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, id_1, no_1, id_2, no_2) of sentences that were moved out of reach of their block: of the sentences of ``chunks`` (doc,
    side and features) without a pair in ``found`` those that are each other's one best by the marks they share. They share
    MOVED of the marks of both, and so rare ones that less than exp(-FAR) sentences of either version do by chance. Marks are
    joined from the rarest on, and of a sentence only those without which it couldn't share enough."""
    sent = ["doc", "side", "id", "no"]
    rows = chunks.select("doc", "side", "id", "numbers", "counts", "marks", "weights").mapInArrow(_marks_of_sentences, "doc string, side int, id long, no int, mark int, weight int")
    paired = found.select("doc", F.explode(F.array(*[F.struct(F.lit(s - 1).alias("side"), F.col(f"id_{s}").alias("id"), F.col(f"no_{s}").alias("no")) for s in (1, 2)])).alias("s")).select("doc", "s.*")
    free = materialize(rows.where(F.col("weight") != COARSE).join(paired, sent, "left_anti"), "left-out")
    at = lambda s: F.count_if(F.col("side") == s)
    n = free.select(*sent).distinct().groupBy("doc").agg(at(0).alias("n0"), at(1).alias("n1"))
    rare = free.groupBy("doc", "mark").agg(at(0).alias("m0"), at(1).alias("m1")).join(n, "doc")
    rare = rare.select("doc", "mark", (F.col("m0") * F.col("m1")).alias("often"), *[F.log(F.col(f"n{s}") / F.greatest(F.col(f"m{s}"), F.lit(1))).alias(f"info{s}") for s in (0, 1)])
    sents = free.join(rare, ["doc", "mark"]).groupBy(*sent).agg(F.sum("weight").alias("total"), F.sort_array(F.collect_list(F.struct("often", "mark", "weight", "info0", "info1"))).alias("marks"))
    sents = sents.where(F.col("total") >= 2.5 * SCALE)
    ahead = F.transform("marks", lambda x, i: F.aggregate(F.slice("marks", 1, i), F.lit(0).cast("long"), lambda a, y: a + y["weight"]))
    probes = F.filter(F.zip_with("marks", ahead, lambda x, a: F.struct(x["mark"].alias("mark"), x["often"].alias("often"), a.alias("ahead"))), lambda x: (x["often"] > 0) & (x["ahead"] <= (1 - MOVED) * F.col("total")))
    sents = materialize(sents.withColumn("probe", F.explode(F.transform(probes, lambda x: x["mark"]))), "probes")
    a, b = (sents.where(F.col("side") == s - 1).select("doc", "probe", F.col("id").alias(f"id_{s}"), F.col("no").alias(f"no_{s}"), F.col("total").alias(f"total_{s}"), F.col("marks").alias(f"marks_{s}")) for s in (1, 2))
    common = F.filter("marks_1", lambda x: F.array_contains(F.transform("marks_2", lambda y: y["mark"]), x["mark"]))
    pairs = a.join(b, ["doc", "probe"]).withColumn("common", common).where(F.col("common")[0]["mark"] == F.col("probe"))  # each pair once
    summed = lambda field: F.aggregate("common", F.lit(0.0), lambda x, y: x + y[field])
    pairs = pairs.select("doc", "id_1", "no_1", "id_2", "no_2", F.greatest("total_1", "total_2").alias("most"), *[summed(x).alias(x) for x in ("weight", "info0", "info1")])
    pairs = pairs.where((F.col("weight") >= MOVED * F.col("most")) & (F.col("weight") >= 2.5 * SCALE)).join(n, "doc")
    pairs = pairs.where((F.col("info0") - F.log(F.greatest("n0", F.lit(1))) >= FAR) & (F.col("info1") - F.log(F.greatest("n1", F.lit(1))) >= FAR)).withColumn("score", F.round(F.col("info0") + F.col("info1"), 6))
    of = [W.partitionBy("doc", f"id_{s}", f"no_{s}") for s in (1, 2)]
    best = pairs.withColumns({f"top_{i}": F.max("score").over(w) for i, w in enumerate(of)}).where("score = top_0 and score = top_1")
    return best.withColumns({f"same_{i}": F.count("*").over(w) for i, w in enumerate(of)}).where("same_0 = 1 and same_1 = 1").select("doc", "id_1", "no_1", "id_2", "no_2")


def _tally(side: int, words: np.ndarray, others: np.ndarray) -> np.ndarray:
    """(side, word, other, number) of equal pairs."""
    pair = words.view(np.uint32).astype(np.uint64) << np.uint64(32) | others.view(np.uint32).astype(np.uint64)
    pair, n = np.unique(pair, return_counts=True)
    low = lambda x: x.astype(np.uint32).view(np.int32).astype(np.int64)
    return np.stack((np.full(len(pair), side), low(pair >> np.uint64(32)), low(pair & np.uint64(0xFFFFFFFF)), n), axis=1).astype(np.int64)


def places(chunks: DataFrame) -> DataFrame:
    """(doc, side, id, places) of the chunks of long documents (doc, side, id, nth, marks, blocks, and the chunks n_a and n_b of the
    versions): blocks of side 0 are even; a chunk of side 1 goes to the blocks of the marks that each version has once,
    and to those next to where the anchored chunks before and after it stand and to the proportion between them. An
    anchored chunk stands at the median of its marks. A document without such marks is cut in proportion."""
    pairs = F.when(F.size("marks") > 1, F.zip_with(F.expr("slice(marks, 1, size(marks) - 1)"), F.expr("slice(marks, 2, size(marks) - 1)"), lambda x, y: F.xxhash64(x, y))).otherwise(F.array().cast("array<bigint>"))
    keys = chunks.select("doc", "side", "nth", F.explode(F.concat(F.transform("marks", lambda x: x.cast("long")), pairs)).alias("key"))
    at = lambda s: F.max(F.when(F.col("side") == s, F.col("nth")))
    once = keys.groupBy("doc", "key").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"), at(0).alias("x"), at(1).alias("nth"))
    once = once.where("n0 = 1 and n1 = 1").groupBy("doc", "nth").agg(F.collect_set("x").alias("own"), F.percentile_approx("x", 0.5).alias("x"))
    second = chunks.where("side = 1").select("doc", "id", "nth", "blocks", "n_a", "n_b").join(once, ["doc", "nth"], "left")
    second = materialize(second.withColumn("anchor", F.when(F.col("x").isNotNull(), F.struct("nth", "x"))), "anchors")
    shifted = lambda df, by, name: df.select("doc", (F.col("nth") + by).alias("nth"), F.col(name))
    before = last_known(second.select("doc", "nth", "anchor"), ["doc"], F.col("nth"), "anchor", "before", position="nth")
    back = second.select("doc", "nth", "anchor", (-F.col("nth")).alias("from_end"))
    after = last_known(back, ["doc"], F.col("from_end"), "anchor", "after", position="from_end")
    second = second.join(shifted(before, 1, "before"), ["doc", "nth"], "left").join(shifted(after, -1, "after"), ["doc", "nth"], "left")
    px, py = F.coalesce("before.x", F.lit(0)), F.coalesce("before.nth", F.lit(0))
    nx, ny = F.coalesce("after.x", F.col("n_a")), F.coalesce("after.nth", F.col("n_b"))
    between = px + (F.col("nth") - py) * (nx - px) / F.greatest(F.lit(1), ny - py)
    block = lambda x: F.least(F.floor(x * F.col("blocks") / F.col("n_a")), F.col("blocks") - 1)
    about = F.filter(F.array(block(F.col("before.x")), block(F.col("after.x")), block(F.col("x")), block(between)), lambda x: x.isNotNull())
    near = F.flatten(F.transform(about, lambda b: F.array(b - 1, b, b + 1)))
    own = F.transform(F.coalesce("own", F.array().cast("array<bigint>")), block)
    second = second.select("doc", F.lit(1).alias("side"), "id", F.filter(F.array_distinct(F.concat(near, own)), lambda b: (b >= 0) & (b < F.col("blocks"))).alias("places"))
    return chunks.where("side = 0").select("doc", "side", "id", F.array(block(F.col("nth"))).alias("places")).unionByName(second)


def align(df: DataFrame, model: LanguageModel, *, key: str = "chunk_id", doc: str = "doc_id", text: str = "text", page: str = "page", kind: str = "kind", block_chunks: int = 64) -> DataFrame:
    """Pairs of sentences of one document in different languages of which one renders the other (see the module)."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(doc).alias("doc"), F.col(page).alias("page"), F.col(text).alias("text"), F.col(kind).alias("kind"))
    rows = rows.where("id is not null and doc is not null and length(text) > 0 and not (lower(kind) <=> 'figure') and not startswith(text, '[Figure p.')")
    # chunks written twice: the first stands for all
    digests = rows.select("doc", F.coalesce("page", F.lit(-1)).alias("page"), F.md5("text").alias("digest"), "id").distinct()
    first = digests.groupBy("doc", "page", "digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = digests.join(first, ["doc", "page", "digest"]).select(F.col("first").alias("id"), F.col("id").alias("copy"))
    again = materialize(again, "copies")
    later = again.where("id != copy").select(F.col("copy").alias("id"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def features(batches):
        for batch in batches:
            for at, texts in cp.slices(batch.column("text"), 1 << 19):
                row, f = _features(shared.value, texts)
                if len(row):
                    which = pa.array(row + at)
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(which), batch.column("doc").take(which), *f.values()], ["id", "doc", *f])

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("doc", T.StringType()), *_FEATURES.fields])
    chunks = rows.join(later, "id", "left_anti").select("id", F.col("doc").cast("string").alias("doc"), "text").mapInArrow(features, schema)
    chunks = materialize(chunks, "sentences")

    # versions: each two languages of a document, which has no more than the model knows
    chars = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    versions = chunks.groupBy("doc", "lang").agg(F.count("*").alias("chunks"), F.sum(chars).alias("chars"), F.sum(F.size("numbers")).alias("sents"))
    versions = versions.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("lang", "chunks", "chars", "sents"))).alias("v")).where(F.size("v") > 1)
    versions = versions.select("doc", F.explode("v").alias("a"), "v").select("doc", "a", F.explode("v").alias("b")).where("a.lang < b.lang")
    versions = versions.withColumn("pair", F.concat_ws("\u0001", "doc", F.col("a.lang").cast("string"), F.col("b.lang").cast("string")))
    versions = materialize(versions.withColumn("blocks", F.ceil(F.greatest("a.chunks", "b.chunks") / block_chunks)), "versions")
    # the nearer two versions are in length, the more they say about the ratio of the languages
    even = F.pow(F.least("a.sents", "b.sents") / F.greatest("a.sents", "b.sents"), 4)
    ratios = versions.groupBy(F.col("a.lang").alias("la"), F.col("b.lang").alias("lb")).agg((F.sum(F.col("b.chars") * even) / F.sum(F.col("a.chars") * even)).alias("ratio"))
    versions = versions.join(F.broadcast(ratios), (F.col("a.lang") == F.col("la")) & (F.col("b.lang") == F.col("lb"))).drop("la", "lb")
    long_one = (F.col("blocks") > 1) | (F.greatest("a.sents", "b.sents") > LONG)
    versions = materialize(versions.withColumn("long", long_one), "ratios")

    def placed(some: DataFrame) -> DataFrame:
        rows = chunks.join(some, "doc").where("lang in (a.lang, b.lang)").withColumn("side", F.when(F.col("lang") == F.col("a.lang"), 0).otherwise(1))
        return rows.select(F.col("pair").alias("doc"), "ratio", "side", "id", *_PARTS, "blocks", F.col("a.chunks").alias("n_a"), F.col("b.chunks").alias("n_b"))

    # the place of a chunk in its version matters in long documents only; counting runs in buckets of ids
    cut = materialize(placed(materialize(versions.where("long"), "long-versions")), "long-documents")
    long = cut.where("blocks > 1").select("doc", "side", "id", "marks", "blocks", "n_a", "n_b", F.lit(1).alias("one"))
    long = materialize(before_sum(long, ["doc", "side"], "id", "one", "nth"), "long")
    one_block = F.array(F.lit(0).cast("long"))
    columns = ["doc", "ratio", "side", "id", *_PARTS]
    short = placed(versions.where("not long")).select(*columns, one_block.alias("places"))
    cut_up = cut.join(places(long), ["doc", "side", "id"], "left").select(*columns, F.coalesce("places", one_block).alias("places"))
    blocks = short.unionByName(cut_up).select(*columns, F.explode("places").alias("place"))
    blocks = materialize(blocks.withColumn("block_no", F.xxhash64("doc", "place")), "blocks")

    def in_blocks(rows: DataFrame, by: str) -> DataFrame:
        return rows.repartition(by).sortWithinPartitions(*dict.fromkeys([by, "block_no", "doc", "place", "side", "id"]))

    together = in_blocks(blocks, "block_no").mapInArrow(_aligned(learn=True), "side int, word int, other int, n long")
    together = materialize(together.groupBy("side", "word", "other").agg(F.sum("n").alias("n")).where("side < 2 or n >= 3"), "words")
    alone = together.where("side < 2").select("side", "word", F.col("n").alias("alone"))
    dice = together.where("side = 2").join(alone.where("side = 0").select("word", F.col("alone").alias("n1")), "word")
    dice = dice.join(alone.where("side = 1").select(F.col("word").alias("other"), F.col("alone").alias("n2")), "other")
    dice = dice.withColumn("value", 2 * F.col("n") / (F.col("n1") + F.col("n2"))).where("value >= 0.25").select("word", "other", "value")
    # both ways, the surest rendering of a word counts fully
    ways = dice.unionByName(dice.select(F.col("other").alias("word"), F.col("word").alias("other"), "value")).groupBy("word", "other").agg(F.max("value").alias("value"))
    ways = materialize(ways, "ways")
    entries = ways.join(ways.groupBy("word").agg(F.max("value").alias("best")), "word").select("word", "other", (F.col("value") / F.col("best")).alias("value"))
    # each part gets the entries of its own words: the lexicon is never in one place
    parted = blocks.withColumn("part", F.pmod("block_no", F.lit(1 + blocks.count() // PART)))
    needed = parted.select("part", "numbers", "counts", "lex_counts", "lexemes").mapInArrow(_bare_words, "part long, word int").distinct()
    needed = needed.join(entries, "word").select("part", F.lit(BEFORE).alias("block_no"), "word", "other", "value")
    found = in_blocks(parted.unionByName(needed, allowMissingColumns=True), "part").mapInArrow(_aligned(), "doc string, id_1 long, no_1 int, id_2 long, no_2 int, sure boolean")
    found = materialize(found, "found")
    confirmed = found.where("sure").select("doc", F.posexplode(F.array(F.struct(F.col("id_1").alias("id"), F.col("no_1").alias("no")), F.struct(F.col("id_2").alias("id"), F.col("no_2").alias("no")))).alias("side", "sent")).distinct()
    confirmed = confirmed.groupBy("doc").agg(F.count_if(F.col("side") == 0).alias("sure_a"), F.count_if(F.col("side") == 1).alias("sure_b"))
    rendered = F.when(F.col("a.sents") <= F.col("b.sents"), (F.col("sure_a") - CHANCE) / F.col("a.sents")).otherwise((F.col("sure_b") - CHANCE) / F.col("b.sents"))
    two = versions.drop("doc").withColumnRenamed("pair", "doc").join(confirmed, "doc").where(rendered > RENDERED).select("doc")
    found = found.join(two, "doc", "left_semi").drop("sure")
    far = moved_far(cut.join(two, "doc", "left_semi"), found)
    found = found.unionByName(far).drop("doc")
    for side in ("1", "2"):
        twin = again.select(F.col("id").alias(f"id_{side}"), F.col("copy").alias(f"copy_{side}"))
        found = found.join(twin, f"id_{side}", "left").withColumn(f"id_{side}", F.coalesce(f"copy_{side}", f"id_{side}"))
    swap = F.struct("id_1", "no_1") > F.struct(F.col("id_2").alias("id_1"), F.col("no_2").alias("no_1"))
    pick = lambda name, a, b: F.when(swap, F.col(b)).otherwise(F.col(a)).alias(name)
    return found.select(pick("chunk_id_1", "id_1", "id_2"), pick("sent_no_1", "no_1", "no_2"), pick("chunk_id_2", "id_2", "id_1"), pick("sent_no_2", "no_2", "no_1")).distinct()
