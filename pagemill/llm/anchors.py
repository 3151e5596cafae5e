"""Anchors: positions that equal windows choose alike.

Every window of W symbols is owned by the one of its k-mers with the smallest
scrambled hash (the leftmost of equals). Equal windows have equal k-mers at equal places, so
repeated windows are found among the windows of equal anchors: about 2 / (W - k + 2) of all positions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from pagemill.llm.common import mix64

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LEFT, _RIGHT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
MAX_SYMBOLS = 1 << 22  # in one call: positions take 22 bits


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate([x[by:], np.full(min(by, len(x)), x[-1] if len(x) else 0, x.dtype)])


def _wide(x: np.ndarray, size: int, combine) -> np.ndarray:
    """``combine`` over ``size`` symbols from each position on, by doubling; the last positions are void."""
    have = 1
    while have * 2 <= size:
        x = combine(x, _shifted(x, have))
        have *= 2
    return combine(x, _shifted(x, size - have)) if size > have else x


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept for the next call."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(n, base)
            x[0] = 1
            _POWERS[i] = np.multiply.accumulate(x)
    return _POWERS[0][:n], _POWERS[1][:n]


class Sums:
    """Hashes of any run of symbols, from running sums of the symbols' values times powers of an odd base."""

    def __init__(self, values: np.ndarray):
        power, self.inverse = _powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[:-1], out=self.sums[1:])

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        plain = (self.sums[end] - self.sums[begin]) * self.inverse[begin]
        return mix64(plain + (end - begin).astype(np.uint64) * _LEFT)


@dataclass
class Anchors:
    """Of several texts laid end to end; positions count from the begin of all."""

    text: np.ndarray  # number of the text
    place: np.ndarray  # of the k-mer
    first: np.ndarray  # the first window start the anchor owns
    last: np.ndarray
    kmer: np.ndarray  # hash of the k-mer
    context: np.ndarray  # hash of all owned windows together and where the anchor lies in them


def contexts(sums: Sums, place: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Hash of the symbols of windows ``first`` to ``last`` and of the anchor's place in them."""
    return mix64(sums.hashes(first, last + window) + (place - first).astype(np.uint64) * _RIGHT)


def find_anchors(values: np.ndarray, lengths: np.ndarray, window: int, k: int, sums: Sums) -> Anchors:
    """``values``: a random unsigned 64-bit number for each symbol."""
    none = np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    if len(values) > MAX_SYMBOLS:
        raise ValueError("too many symbols at once")
    starts = ends - lengths
    room = lengths - window + 1
    long_enough = np.flatnonzero(room > 0)
    if not len(long_enough):
        return Anchors(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    kmers = np.zeros(len(values), np.uint64)  # those that pass the end stay void; no owned window has them
    at = np.arange(len(values) - k + 1)
    kmers[:len(at)] = sums.hashes(at, at + k)
    low = np.uint64(MAX_SYMBOLS - 1)
    keys = (kmers & ~low) | np.arange(len(values), dtype=np.uint64)
    least = _wide(keys, window - k + 1, np.minimum)
    n = room[long_enough]
    text = np.repeat(long_enough, n)
    start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + starts[text]
    place = (least[start] & low).astype(np.int64)
    new = np.concatenate([[True], place[1:] != place[:-1]])
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(start)]]) - 1
    first, last, place = start[begin], start[end], place[begin]
    return Anchors(text[begin], place, first, last, kmers[place], contexts(sums, place, first, last, window))


def groups_of(lengths: list[int], most: int = 1 << 20) -> list[tuple[int, int]]:
    """Runs of texts with at most ``most`` symbols together, or one text alone."""
    runs, begin, held = [], 0, 0
    for i, n in enumerate(lengths):
        if i > begin and held + n > most:
            runs.append((begin, i))
            begin, held = i, 0
        held += n
    if begin < len(lengths):
        runs.append((begin, len(lengths)))
    return runs


def find_all(values: np.ndarray, lengths: np.ndarray, window: int, k: int, sums: Sums) -> Anchors:
    """Like ``find_anchors``; a single text of any length is cut in overlapping pieces and joined again."""
    if len(values) <= MAX_SYMBOLS:
        return find_anchors(values, lengths, window, k, sums)
    assert len(lengths) == 1
    parts = []
    step = MAX_SYMBOLS - window
    for at in range(0, len(values) - window + 1, step):
        piece = values[at:at + step + window - 1]
        part = find_anchors(piece, np.array([len(piece)]), window, k, Sums(piece))
        parts.append((part, at))
    joined = [np.concatenate([getattr(p, f) + (at if f in ("place", "first", "last") else 0) for p, at in parts])
              for f in ("text", "place", "first", "last", "kmer")]
    text, place, first, last, kmer = joined
    new = np.concatenate([[True], place[1:] != place[:-1]])  # an anchor met from two pieces owns both runs
    begin = np.flatnonzero(new)
    last = last[np.concatenate([begin[1:], [len(place)]]) - 1]
    first, place = first[begin], place[begin]
    return Anchors(text[begin], place, first, last, kmer[begin], contexts(sums, place, first, last, window))
