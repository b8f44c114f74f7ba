"""Sentences of a batch of texts, as ranges of code points.

A sentence ends after ``.``, ``!`` or ``?`` before white space, after ``。``, ``！`` or ``？``, and at a line's end;
ends are stripped and blank sentences left out.
"""

from __future__ import annotations

import numpy as np

from corpusloom.llm import codepoints as cp
from corpusloom.llm import normalize

STOPS, FULL_STOPS = [ord(c) for c in ".!?"], [ord(c) for c in "。！？"]


def split(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each sentence."""
    n = len(points)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none
    space = (cp.classes()[points] & cp.SPACE) > 0
    after = np.concatenate((space[1:], [True]))
    cut = np.zeros(n + 1, bool)
    cut[1:] = (np.isin(points, STOPS) & after) | np.isin(points, FULL_STOPS) | (points == 0x0A)
    cut[offsets] = True
    cut[n] = True
    at = np.flatnonzero(cut)
    solid = np.flatnonzero(~space)
    if not len(solid):
        return none, none, none
    lo, hi = np.searchsorted(solid, at[:-1]), np.searchsorted(solid, at[1:])
    full = hi > lo
    start, end = solid[lo[full]], solid[hi[full] - 1] + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def in_usual_form(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentences as the stored text has them, then in usual form: points, start, end and row."""
    start, end, row = split(points, offsets)
    size = end - start
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    out, ends = normalize.normalize_points(points[at], np.concatenate(([0], np.cumsum(size))))
    return out, ends[:-1], ends[1:], row
