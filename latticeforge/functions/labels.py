"""Target labels as small integer codes, and their meet algebra as column expressions.

A label is an array of codes, one for each component: an index into the component's values,
UNKNOWN (not known, the top of the lattice, written `?`) or CONFLICT (the bottom, written `*`).
Neither is ever NULL.  Domains of many values are tables (code, value) that are joined; the driver
and the plan hold the values of small ones only.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UNKNOWN, CONFLICT = -2, -1
UNKNOWN_TEXT, CONFLICT_TEXT = "?", "*"


class LabelError(ValueError):
    """A label text, descriptor or domain that does not fit."""


@dataclass(frozen=True)
class Domain:
    """The values of one label component; two values make a binary domain, any other number an ordinal one."""

    values: tuple[str, ...]
    binary: bool
    #: (code, value) of a domain with too many values to hold; `values` is empty then.
    table: DataFrame | None = field(default=None, compare=False)
    rows: int = 0

    @classmethod
    def of(cls, values) -> Domain:
        """The domain of observed texts: sorted, without the marks for unknown and conflict."""
        known = tuple(sorted(set(values) - {UNKNOWN_TEXT, CONFLICT_TEXT}))
        return cls(known, len(known) == 2)

    @property
    def size(self) -> int:
        return len(self.values) if self.table is None else self.rows

    @property
    def codes(self) -> range:
        return range(self.size)

    def encode(self, text: str) -> int:
        if self.table is not None:
            raise LabelError("the values of this domain are in a table: encode with LabelSchema.with_codes")
        if text in self.values:
            return self.values.index(text)
        if text in (UNKNOWN_TEXT, CONFLICT_TEXT):
            return UNKNOWN if text == UNKNOWN_TEXT else CONFLICT
        raise LabelError(f"unexpected label {text!r}, known are {', '.join(self.values)}")

    def decode(self, code: int) -> str:
        return {UNKNOWN: UNKNOWN_TEXT, CONFLICT: CONFLICT_TEXT}.get(code) or self.values[code]

    def descriptor(self) -> str:
        if self.table is not None:
            raise LabelError("the values of this domain are in a table: see LabelSchema.descriptor_row")
        return f"{'B' if self.binary else 'O'}({','.join(self.values)})"

    def same(self, other: Domain) -> bool:
        """Whether both give the same codes to the same texts; tables are compared by Spark."""
        if self != other or (self.table is None) != (other.table is None):
            return False
        return self.table is None or self.table.join(other.table, ["code", "value"], "left_anti").limit(1).count() == 0


_PART = re.compile(r"([BO])\(([^()]*)\)")


@dataclass(frozen=True)
class LabelSchema:
    """The components of a label."""

    domains: tuple[Domain, ...]

    @classmethod
    def parse(cls, descriptor: str) -> LabelSchema:
        """Reads concatenated `B(a,b)` and `O(a,b,c)` parts."""
        parts = _PART.findall(descriptor)
        if _PART.sub("", descriptor).strip():
            raise LabelError(f"not a label descriptor: {descriptor!r}")
        domains = []
        for kind, body in parts:
            values = [v.strip() for v in body.split(",")] if body.strip() else []
            if kind == "B" and len(values) != 2:
                raise LabelError(f"a binary domain has two values: {descriptor!r}")
            domains.append(Domain(tuple(values) if kind == "B" else tuple(sorted(values)), kind == "B"))
        return cls(tuple(domains))

    def descriptor(self) -> str:
        return "".join(d.descriptor() for d in self.domains)

    def descriptor_row(self, spark: SparkSession) -> DataFrame:
        """(descriptor): one row, whose text Spark puts together where a domain is a table."""
        parts = spark.createDataFrame([(i, d.descriptor()) for i, d in enumerate(self.domains) if d.table is None], "i int, part string")
        for i, d in enumerate(self.domains):
            if d.table is not None:
                ordered = F.array_sort(F.collect_list(F.struct("code", "value")))["value"]
                parts = parts.union(d.table.agg(F.lit(i).alias("i"), F.concat(F.lit("O("), F.array_join(ordered, ","), F.lit(")")).alias("part")))
        return parts.agg(F.array_join(F.array_sort(F.collect_list(F.struct("i", "part")))["part"], "").alias("descriptor"))

    def same(self, other: LabelSchema) -> bool:
        return self.width == other.width and all(a.same(b) for a, b in zip(self.domains, other.domains))

    @property
    def width(self) -> int:
        return len(self.domains)

    def encode(self, text: str) -> list[int]:
        words = text.split(" ")
        if len(words) != self.width:
            raise LabelError(f"{self.width} label components expected: {text!r}")
        return [d.encode(w) for d, w in zip(self.domains, words)]

    def decode(self, codes: list[int]) -> str:
        return " ".join(d.decode(c) for d, c in zip(self.domains, codes))

    def unknown(self) -> Column:
        return F.array_repeat(F.lit(UNKNOWN), self.width)

    def conflict(self) -> Column:
        return F.array_repeat(F.lit(CONFLICT), self.width)

    def encode_column(self, texts: list[Column]) -> Column:
        """Codes of one text column for each component; NULL components mark texts outside the domain."""
        return F.array(*(encode_text(d, c) for d, c in zip(self.domains, texts)))

    def with_codes(self, rows: DataFrame, texts: list[Column], label: str = "prop") -> DataFrame:
        """Adds the label of one text column for each component; domains that are tables are joined.

        NULL components mark texts outside the domain (see `checked`).
        """
        codes, made = [], []
        for i, (d, text) in enumerate(zip(self.domains, texts)):
            if d.table is None:
                codes.append(encode_text(d, text))
                continue
            made += [f"_text{i}", f"_code{i}"]
            own = d.table.select(F.col("value").alias(f"_text{i}"), F.col("code").alias(f"_code{i}"))
            rows = rows.withColumn(f"_text{i}", text).join(own, f"_text{i}", "left")
            codes.append(F.coalesce(F.col(f"_code{i}"), mark_code(F.col(f"_text{i}"))))
        return rows.withColumn(label, F.array(*codes).cast("array<int>")).drop(*made)

    def with_text(self, rows: DataFrame, label: str = "prop", out: str = "label") -> DataFrame:
        """Adds the label's text: components joined by a space; domains that are tables are joined by code."""
        if all(d.table is None for d in self.domains):
            return rows.withColumn(out, self.decode_column(F.col(label)))
        parts, made = [], []
        for i, d in enumerate(self.domains):
            code = F.col(label)[i]
            if d.table is None:
                parts.append(decode_code(d, code))
                continue
            made += [f"_code{i}", f"_text{i}"]
            own = d.table.select(F.col("code").alias(f"_code{i}"), F.col("value").alias(f"_text{i}"))
            rows = rows.withColumn(f"_code{i}", code).join(own, f"_code{i}", "left")
            marks = F.when(F.col(f"_code{i}") == UNKNOWN, F.lit(UNKNOWN_TEXT)).when(F.col(f"_code{i}") == CONFLICT, F.lit(CONFLICT_TEXT))
            parts.append(marks.otherwise(F.col(f"_text{i}")))
        return rows.withColumn(out, F.concat_ws(" ", *parts)).drop(*made)

    def decode_column(self, label: Column) -> Column:
        """The label's text: components joined by a space."""
        return F.concat_ws(" ", *(decode_code(d, label[i]) for i, d in enumerate(self.domains)))


def mark_code(text: Column) -> Column:
    """The code of the marks for unknown and conflict, NULL for other texts."""
    return F.when(text == UNKNOWN_TEXT, UNKNOWN).when(text == CONFLICT_TEXT, CONFLICT)


def encode_text(domain: Domain, text: Column) -> Column:
    """A component's code; the domain's own values win over the marks."""
    out = mark_code(text)
    if domain.values:
        place = F.array_position(F.array(*(F.lit(v) for v in domain.values)), text)
        out = F.when(place > 0, (place - 1).cast("int")).otherwise(out)
    return out.cast("int")


def decode_code(domain: Domain, code: Column) -> Column:
    values = F.from_json(F.lit(json.dumps(domain.values)), "array<string>")  # one literal, however many values
    known = F.try_element_at(values, code + 1) if domain.values else F.lit(None)
    return F.when(code == UNKNOWN, F.lit(UNKNOWN_TEXT)).when(code == CONFLICT, F.lit(CONFLICT_TEXT)).otherwise(F.when(code >= 0, known))


def checked(df: DataFrame, width: int, label: str = "prop") -> DataFrame:
    """Fails when one of a label's `width` components is a text that its domain does not know."""
    bad = reduce(lambda a, b: a | b, (F.get(label, F.lit(i)).isNull() for i in range(width)), F.lit(False)) & F.col(label).isNotNull()
    return df.withColumn(label, F.when(bad, F.raise_error(F.lit("a label is outside its domain"))).otherwise(F.col(label)))


def meet(a: Column, b: Column) -> Column:
    """Meet of two codes: unknown gives way to the other, different values conflict."""
    return F.when(a == UNKNOWN, b).when(b == UNKNOWN, a).when(a == b, a).otherwise(F.lit(CONFLICT)).cast("int")


def meet_labels(a: Column, b: Column) -> Column:
    """Component-wise meet of two labels."""
    return F.zip_with(a, b, meet)


def is_conflict(label: Column) -> Column:
    """All components conflict (so the label without components does)."""
    return F.forall(label, lambda c: c == CONFLICT)


def is_unknown(label: Column) -> Column:
    """There are components and all of them are unknown."""
    return (F.size(label) > 0) & F.forall(label, lambda c: c == UNKNOWN)


def class_key(label: Column) -> Column:
    """A text for grouping by label: the whole vector, so different labels never share a group."""
    return F.concat_ws(",", F.transform(label, lambda c: c.cast("string")))
