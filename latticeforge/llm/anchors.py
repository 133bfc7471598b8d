"""Content-defined anchors: the sampled suffixes of operator 2.

Texts are symbols: bytes, or 64-bit codes of words.  Every window of `length` symbols holds
length - gram + 1 grams; its anchor is the leftmost one of least hash.  Equal windows have their anchors
at equal offsets, wherever they stand, so comparing the few suffixes that start at anchors finds
every repeat of `length` symbols.  Neighbouring windows mostly share an anchor; such a run of windows is
one entry.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ._kernels import mix64, prefix_hash, span_hash

#: Symbols of a gram: bytes, or words.
BYTE_GRAM, WORD_GRAM = 64, 8
#: Window starts handled at once; the position of an anchor needs as many bits and one more.
PIECE_BITS = 19
_BASE = np.uint64(0x9FB21C651E98DF25)
_OFFSET = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(symbols: np.ndarray, size: int) -> np.ndarray:
    """Hashes of symbols[i:i+size] for all i, by doubling (size is a power of two)."""
    h = mix64(symbols.astype(np.uint64) + _BASE)
    factor, span = _BASE, 1
    with np.errstate(over="ignore"):
        while span < size:
            h = h[:-span] * factor + h[span:]
            factor, span = factor * factor, span * 2
    return mix64(h)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """min(values[i:i+width]) for all i."""
    least, span = values, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _inside(off: np.ndarray, length: int, at: int, n: int) -> np.ndarray:
    """Of the window starts at..at+n, those whose window lies in one document, counted from `at`."""
    first, last = np.clip(off[:-1], at, at + n) - at, np.clip(off[1:] - length + 1, at, at + n) - at
    some = last > first
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, first[some], 1)
    np.add.at(change, last[some], -1)
    return np.flatnonzero(np.cumsum(change[:-1]))


@dataclass(frozen=True)
class Runs:
    """Runs of windows with one anchor: windows start at a..b (symbols of the chunk), the anchor is at p."""

    a: np.ndarray
    b: np.ndarray
    p: np.ndarray
    key: np.ndarray
    fp: np.ndarray


def anchor_runs(symbols: np.ndarray, off: np.ndarray, length: int, gram: int) -> Runs:
    """All runs of a chunk; windows lie inside documents, and every window is in one run.

    Two runs of a document that a piece's border cuts apart may share an anchor; they are entries of their own.
    """
    none = np.zeros(0, np.int64)
    found = []
    piece = 1 << PIECE_BITS
    low = np.uint64((1 << (PIECE_BITS + 1)) - 1)
    for at in range(0, len(symbols) - length + 1, piece):
        n = min(piece, len(symbols) - length + 1 - at)
        inside = _inside(off, length, at, n)
        if not len(inside):
            continue
        hashes = gram_hashes(symbols[at : at + n + length - 1], gram)
        least = sliding_least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
        anchor = (least[inside] & low).astype(np.int64)
        new = np.ones(len(inside), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1] + 1)
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(inside)) - 1
        found.append((inside[head] + at, inside[last] + at, anchor[head] + at, hashes[anchor[head]]))
    if not found:
        return Runs(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    a, b, p, key = (np.concatenate(x) for x in zip(*found))
    with np.errstate(over="ignore"):
        fp = mix64(span_hash(prefix_hash(symbols), a, b + length) + (p - a).astype(np.uint64) * _OFFSET)
    return Runs(a, b, p, key, fp)
