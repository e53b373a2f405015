"""Locally consistent names for parts of word sequences, by recompression.

A sequence of hashed words is compressed in rounds.  In a round, first every run of one symbol becomes one
symbol named by it and the run's length; then every symbol is left or right by a bit of its hash, and every
left one followed by a right one becomes one symbol, named by the two.  Names are hashes of what they stand
for, so all tasks give equal parts equal names without asking one another.

Within any window of words, the symbols not touched by what stands around the window can be told from the
window alone: a run at its ends may go on outside, a right symbol at its start and a left one at its end
may have a partner outside; all others are inside.  So equal windows, wherever they stand, have equal
symbols inside.  A window's anchor is the one inside it, at the highest round of at most ROUNDS that has
any, that stands for most words, then of the least name, then leftmost: equal windows have equal anchors.
"""

from __future__ import annotations

import numpy as np
import xxhash

ROUNDS = 3
GOLD, BETA, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 0x5851F42D4C957F2D
#: What a round's sides are drawn with.
SIDES = [np.uint64((k + 1) * 0xD6E8FEB86659FD93 % (1 << 64)) for k in range(16)]
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * GOLD
    x = (x ^ (x >> np.uint64(29))) * BETA
    return x ^ (x >> np.uint64(32))


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n - 1, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(1 << 16, 1 << (n - 1).bit_length())
        both = []
        for base in (BASE, BASE_INVERSE):
            p = np.ones(1, np.uint64)
            while len(p) < m:  # doubling
                p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
            both.append(p)
        _POWERS[:] = both
    return _POWERS[0][:n], _POWERS[1][:n]


class Spans:
    """Hashes of any spans of a sequence, by prefix sums."""

    def __init__(self, h: np.ndarray):
        up, self.down = powers(len(h) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h) * up[:-1], dtype=np.uint64)])

    def hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))


def _runs(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol's run, and each run's first symbol."""
    first = np.concatenate([[True], sym[1:] != sym[:-1]])
    return np.cumsum(first) - 1, np.flatnonzero(first)


def _least(value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Places of the least values in the non-empty ranges lo to hi, leftmost first."""
    k = np.log2(hi - lo).astype(np.int64) if len(lo) else np.zeros(0, np.int64)
    k -= (1 << k) > (hi - lo)
    table, out = np.arange(len(value)), np.empty(len(lo), np.int64)
    for level in range(int(k.max(initial=0)) + 1):
        at = np.flatnonzero(k == level)
        a, b = table[lo[at]], table[hi[at] - (1 << level)]
        out[at] = np.where(value[b] < value[a], b, a)
        if (step := 1 << level) >= len(table):
            break
        a, b = table[:-step], table[step:]
        table = np.concatenate([np.where(value[b] < value[a], b, a), table[-step:]])
    return out


def anchors(h: np.ndarray, window: int, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of the windows of `window` words that start at `first`: a name, and the anchor's first word."""
    name, place = np.zeros(len(first), np.uint64), np.zeros(len(first), np.int64)
    sym, start = mix(h), np.arange(len(h))
    live, lo, hi = np.arange(len(first)), first.astype(np.int64), first.astype(np.int64) + window
    for r in range(rounds + 1):
        if r < rounds:
            run, head = _runs(sym)
            length = np.diff(np.concatenate([head, [len(sym)]]))
            s1 = np.where(length > 1, mix(sym[head] + length.astype(np.uint64) * GOLD), sym[head])
            lo1, hi1 = run[lo] + 1, run[hi - 1]
            left = mix(s1 ^ SIDES[r]) & np.uint64(1) == 0
            joined = np.zeros(len(s1), bool)
            joined[:-1] = left[:-1] & ~left[1:]
            begins = np.ones(len(s1), bool)
            begins[1:] = ~joined[:-1]
            group, at = np.cumsum(begins) - 1, np.flatnonzero(begins)
            after = np.concatenate([s1[1:], [np.uint64(0)]])
            s2 = np.where(joined[at], mix(mix(s1[at]) + after[at] * GOLD), s1[at])
            some = lo1 < hi1
            a, b = np.where(some, lo1, 0), np.where(some, hi1 - 1, 0)
            lo2, hi2 = group[a] + ~left[a], group[b] + ~left[b]
            some &= lo2 < hi2
        else:
            some = np.zeros(len(lo), bool)
        if not some.all():  # these windows' last round with a symbol inside
            done = ~some
            words = np.diff(np.concatenate([start, [len(h)]]))
            rank = (np.uint64(255) - np.minimum(words, 255).astype(np.uint64)) << np.uint64(56) | sym >> np.uint64(8)
            k = _least(rank, lo[done], hi[done])
            name[live[done]], place[live[done]] = sym[k] + np.uint64(r), start[k]
        if r == rounds or not some.any():
            break
        live, lo, hi = live[some], lo2[some], hi2[some]
        sym, start = s2, start[head][at]
    return name, place
