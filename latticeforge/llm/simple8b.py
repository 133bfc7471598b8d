"""Simple-8b word-aligned coding of unsigned integers.

A 64-bit word holds a 4-bit selector in its top bits and, below, as many equal-width values as the
selector says, lowest first.  Selector 15 is the escape: its low 60 bits are unused and the whole
next word is one value of up to 64 bits.  A block's last word may be padded with zeros, the block's
count says how many values count.  A block is self-contained:

    4 bytes magic | u32 count | u32 words | words as little-endian u64

so blocks decode independently and, within a block, every selector decodes in one vectorised step.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"S8B1"
#: (values in a word, bits of each), most values first; the position is the selector.
PACKINGS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
_COUNTS = np.asarray([c for c, _ in PACKINGS] + [0] * (ESCAPE - len(PACKINGS)) + [1])


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, 1 for zero."""
    high = values >> np.uint64(32)
    low_bits = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    bits = np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, low_bits) if high.any() else low_bits
    return np.maximum(bits, 1).astype(np.uint8)


def _all_of_next(ok: np.ndarray, count: int) -> np.ndarray:
    """Whether ok[i:i+count] are all true."""
    span = 1
    while span * 2 <= count:
        ok = ok[:-span] & ok[span:]
        span *= 2
    rest = count - span
    return ok[:-rest] & ok[rest:] if rest else ok


def encode(values: np.ndarray) -> bytes:
    """One block of any number of unsigned integers below 2**64."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    width = np.concatenate([_widths(values), np.zeros(60, np.uint8)])  # the padding fits any word
    code = np.full(n, ESCAPE, np.int8)
    low = int(width[:n].min()) if n else 1
    for selector in range(len(PACKINGS) - 1, -1, -1):  # a word of more values wins
        count, bits = PACKINGS[selector]
        if bits >= low:
            code[_all_of_next(width <= bits, count)[:n]] = selector
    step = _COUNTS[code].tolist()
    heads = []
    i = 0
    while i < n:
        heads.append(i)
        i += step[i]
    heads = np.asarray(heads, np.int64)
    kind = code[heads]
    place = np.cumsum(1 + (kind == ESCAPE)) - (1 + (kind == ESCAPE))
    words = np.zeros(int(len(heads) + (kind == ESCAPE).sum()), np.uint64)
    padded = np.concatenate([values, np.zeros(60, np.uint64)])
    for selector in np.unique(kind):
        own = kind == selector
        mine = heads[own]
        if selector == ESCAPE:
            words[place[own]] = np.uint64(ESCAPE << 60)
            words[place[own] + 1] = values[mine]
            continue
        count, bits = PACKINGS[selector]
        word = np.full(len(mine), np.uint64(int(selector) << 60), np.uint64)
        for k in range(count):
            word |= padded[mine + k] << np.uint64(k * bits)
        words[place[own]] = word
    return MAGIC + np.asarray([n, len(words)], "<u4").tobytes() + words.astype("<u8").tobytes()


def decode(block: bytes) -> np.ndarray:
    """The values of a block as uint64."""
    if block[:4] != MAGIC:
        raise ValueError("not a Simple-8b block")
    n, size = np.frombuffer(block, "<u4", 2, 4)
    words = np.frombuffer(block, "<u8", int(size), 12)
    kind = (words >> np.uint64(60)).astype(np.int8)
    plain = kind != ESCAPE
    if not plain.all():  # the word after an escape is a value, whatever its top bits say
        plain = np.ones(len(words), bool)
        at = 0
        for i in np.flatnonzero(kind == ESCAPE).tolist():
            if i >= at:
                plain[i] = False
                kind[i + 1] = ESCAPE
                at = i + 2
        kind[~plain] = -1
        kind[np.flatnonzero(~plain) + 1] = ESCAPE
    counts = np.asarray([c for c, _ in PACKINGS] + [0] * (ESCAPE - len(PACKINGS)) + [1, 0])[kind]
    place = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for selector in np.unique(kind[kind >= 0]):
        mine = np.flatnonzero(kind == selector)
        if selector == ESCAPE:
            out[place[mine]] = words[mine]
            continue
        count, bits = PACKINGS[selector]
        mask = np.uint64((1 << bits) - 1)
        for k in range(count):
            out[place[mine] + k] = (words[mine] >> np.uint64(k * bits)) & mask
    return out[: int(n)]
