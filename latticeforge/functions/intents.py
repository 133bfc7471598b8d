"""Attribute sets: arrays of ascending ids for exchange, 63-bit words in BIGINT columns for work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

WORD = 63


def n_words(n_attrs: int) -> int:
    return max(1, -(-n_attrs // WORD))


def word_names(n_attrs: int, prefix: str = "w") -> list[str]:
    return [f"{prefix}{k}" for k in range(n_words(n_attrs))]


def to_words(intent: Column, n_attrs: int) -> list[Column]:
    """Bitmap words of an id array."""
    return [_to_word(intent, k * WORD) for k in range(n_words(n_attrs))]


def _to_word(intent: Column, low: int) -> Column:
    own = F.filter(intent, lambda a: (a >= low) & (a < low + WORD))
    return F.aggregate(own, F.lit(0).cast("long"), lambda acc, a: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), a - low)))


def from_words(words: list[Column], n_attrs: int) -> Column:
    """Ascending ids of bitmap words."""
    parts = [_from_word(w, k * WORD, min(WORD, n_attrs - k * WORD)) for k, w in enumerate(words) if n_attrs > k * WORD]
    return F.concat(*parts) if parts else F.array().cast("array<int>")


def _from_word(word: Column, low: int, size: int) -> Column:
    return F.filter(F.sequence(F.lit(low), F.lit(low + size - 1)), lambda a: has_bit(word, a - low))


def has_bit(word: Column, bit: Column) -> Column:
    return F.call_function("shiftrightunsigned", word, bit).bitwiseAND(F.lit(1).cast("long")) == 1


def below(bit: Column, k: int) -> Column:
    """The mask of ids below `bit` in word k."""
    m = F.greatest(F.lit(0), F.least(bit - k * WORD, F.lit(WORD)))
    return F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), m))


def contains(intent: Column, a) -> Column:
    return F.array_contains(intent, a)


def add(intent: Column, a: Column) -> Column:
    return F.array_sort(F.array_union(intent, F.array(a)))


def intersect(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def until(intent: Column, j: Column | int) -> Column:
    """The ids below j."""
    return F.filter(intent, lambda a: a < j)


def equal_until(a: Column, b: Column, j: Column | int) -> Column:
    """The canonicity test: both agree below j."""
    return until(a, j) == until(b, j)


def equal_within(a: Column, b: Column, mask: Column) -> Column:
    return F.array_sort(F.array_intersect(a, mask)) == F.array_sort(F.array_intersect(b, mask))


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def words_subset(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, ((x.bitwiseAND(y) == x) for x, y in zip(a, b)))


def words_size(words: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(w) for w in words))


def full(n_attrs: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n_attrs - 1)) if n_attrs else F.array().cast("array<int>")


def empty() -> Column:
    return F.array().cast("array<int>")


def text(intent: Column) -> Column:
    """Space-joined ascending ids."""
    return F.concat_ws(" ", intent.cast("array<string>"))
