"""Merge strategies: from counts of label codes to one label, as column expressions.

Every strategy works on n and the counts of each component's codes, in columns or, for large domains, in a map of the
codes that occur (see context.payload_of), so a merge is a projection over sums that aggregate anywhere.  Ties in a mode go to the smallest code.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from ..functions.labels import CONFLICT, UNKNOWN, LabelSchema
from .context import HISTOGRAM, code_key, count_name, payload_of, summary_name

#: From a label schema, and whether counts of large domains are summed up already (context.summed_counts).
Strategy = Callable[..., Column]


class _Columns:
    """Counts of label codes in a column each."""

    def __init__(self, labels: LabelSchema) -> None:
        self.codes = [(UNKNOWN, CONFLICT, *d.codes) for d in labels.domains]

    def count(self, i: int, code: int) -> Column:
        return F.col(count_name(i, code))

    def unanimous(self, i: int) -> Column:
        """The one value that all known labels have; unknown if none is known."""
        known = self.codes[i][1:]
        held = reduce(lambda a, b: a + b, (F.when(self.count(i, c) > 0, 1).otherwise(0) for c in known))
        out = F.when(held == 0, UNKNOWN).when((held > 1) | (self.count(i, CONFLICT) > 0), CONFLICT)
        for c in known[1:]:
            out = out.when(self.count(i, c) > 0, c)
        return out.cast("int")

    def mode(self, i: int) -> tuple[Column, Column]:
        """(most frequent code, its count)."""
        best = F.greatest(*(self.count(i, c) for c in self.codes[i]))
        first, *others = self.codes[i]
        out = F.when(self.count(i, first) == best, first)
        for c in others:
            out = out.when(self.count(i, c) == best, c)
        return out.cast("int"), best


class _Map:
    """Counts of the codes that occur, in one map."""

    def count(self, i: int, code: int) -> Column:
        return F.coalesce(F.try_element_at(F.col(HISTOGRAM), code_key(i, code)), F.lit(0))

    def unanimous(self, i: int) -> Column:
        known = F.filter(F.map_keys(HISTOGRAM), lambda k: (k > code_key(i, UNKNOWN)) & (k < code_key(i + 1, UNKNOWN)))
        code = (F.get(known, F.lit(0)) - code_key(i, 0)).cast("int")
        return F.when(F.size(known) == 0, UNKNOWN).when(F.size(known) > 1, CONFLICT).otherwise(code).cast("int")

    def mode(self, i: int) -> tuple[Column, Column]:
        own = F.filter(F.map_entries(HISTOGRAM), lambda e: (e["key"] >= code_key(i, UNKNOWN)) & (e["key"] < code_key(i + 1, UNKNOWN)))
        best = F.array_max(F.transform(own, lambda e: F.struct(e["value"].alias("k"), (-e["key"]).alias("less"))))
        return (-best["less"] - code_key(i, 0)).cast("int"), best["k"]


class _Summed:
    """What context.summed_counts keeps of the counts of large domains."""

    def zero(self, i: int) -> Column:
        return F.col(summary_name("zero", i))

    def unanimous(self, i: int) -> Column:
        low, high = F.col(summary_name("low", i)), F.col(summary_name("high", i))
        return F.when(low.isNull(), UNKNOWN).when(low < high, CONFLICT).otherwise((low - code_key(i, 0)).cast("int")).cast("int")

    def mode(self, i: int) -> tuple[Column, Column]:
        top = F.col(summary_name("top", i))
        return (-top["less"] - code_key(i, 0)).cast("int"), top["k"]


def counts_of(labels: LabelSchema, summed: bool = False) -> _Columns | _Map | _Summed:
    if payload_of(labels)[1]:
        return _Summed() if summed else _Map()
    return _Columns(labels)


def _votes(labels: LabelSchema, summed: bool) -> Column:
    """First value minus all others; unknown and conflict vote against."""
    counts = counts_of(labels, summed)
    return 2 * (counts.zero(0) if isinstance(counts, _Summed) else counts.count(0, 0)) - F.col("n")


def no_counter_examples(labels: LabelSchema, summed: bool = False) -> Column:
    """Unanimity, component by component."""
    counts = counts_of(labels, summed)
    return F.array(*(counts.unanimous(i) for i in range(labels.width)))


def voting_majority(labels: LabelSchema, summed: bool = False) -> Column:
    """Binary: votes beyond half of n; ordinal: the mode; several components: the mode of each."""
    if labels.width == 1 and labels.domains[0].binary:
        half = F.expr("n div 2")
        v = _votes(labels, summed)
        return F.array(F.when(v > half, 0).when(v < -half, 1).otherwise(CONFLICT).cast("int"))
    counts = counts_of(labels, summed)
    return F.array(*(counts.mode(i)[0] for i in range(labels.width)))


def bounded_voting_majority(bound: int) -> Strategy:
    """As voting_majority, with votes (binary) or the mode's count (ordinal) beyond n - bound."""

    def merge(labels: LabelSchema, summed: bool = False) -> Column:
        if labels.width > 1:
            return voting_majority(labels, summed)
        domain, n = labels.domains[0], F.col("n")
        if domain.binary:
            v = _votes(labels, summed)
            return F.array(F.when(v > n - bound, 0).when(v < bound - n, 1).otherwise(CONFLICT).cast("int"))
        code, times = counts_of(labels, summed).mode(0)
        return F.array(F.when(n == 1, code).when(times > n - bound, code).otherwise(CONFLICT).cast("int"))

    return merge


def strategy(name: str) -> Strategy:
    """noCounterExamples, votingMajority or boundedVotingMajority:B (noop is class-wise mining, not a merge)."""
    if name == "noCounterExamples":
        return no_counter_examples
    if name == "votingMajority":
        return voting_majority
    head, _, bound = name.partition(":")
    if head == "boundedVotingMajority" and bound.isdigit():
        return bounded_voting_majority(int(bound))
    raise ValueError(f"unknown strategy {name!r}")
