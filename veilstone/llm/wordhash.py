"""Hashes of the words of a line, all at once: differences of running polynomial sums modulo 2^64."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
STRETCH = 1 << 20
_POWERS: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse for i below STRETCH."""
    if not _POWERS:
        for factor in (BASE, pow(BASE, -1, 1 << 64)):
            run = np.full(STRETCH, factor, np.uint64)
            run[0] = 1
            _POWERS.append(np.cumprod(run))
    return _POWERS[0], _POWERS[1]


def word_hashes(line: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of ``line``, which single spaces or line feeds separate.
    A hash depends on the word's bytes alone. A stretch of STRETCH bytes is held at a time (a word longer
    than that is hashed in parts)."""
    raw = np.frombuffer(line, np.uint8)
    gaps = np.flatnonzero((raw == 32) | (raw == 10))
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(raw)]])
    up, down = powers()
    if len(raw) <= STRETCH:
        return starts, ends, _stretch(raw, starts, ends, up, down)
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STRETCH, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        if hi - lo <= STRETCH:
            out[i:j] = _stretch(raw[lo:hi], starts[i:j] - lo, ends[i:j] - lo, up, down)
        else:
            whole = np.uint64(0)
            for p in range(lo, hi, STRETCH):
                part = raw[p : min(hi, p + STRETCH)]
                whole = whole * np.uint64(31) + _stretch(part, np.array([0]), np.array([len(part)]), up, down)[0]
            out[i] = whole
        i = j
    return starts, ends, out


def _stretch(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    got = (sums[ends] - sums[starts]) * down[np.minimum(starts, STRETCH - 1)]
    return (got ^ (got >> np.uint64(32))) * np.uint64(BASE)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` hashes in a row (a polynomial, then mixed)."""
    n = len(hashes) - k + 1
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= np.uint64(BASE)
        out += hashes[j : j + n]
    return (out ^ (out >> np.uint64(29))) * np.uint64(BASE)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each hash stirred so that all of its bits depend on all bits of it."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x
