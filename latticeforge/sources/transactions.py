"""Transaction files: a header line, then a line of ids and a label for each row.

    # attributes: N properties: B(a,b)O(x,y,z)
    0 1 7 | a x

Contexts, models and predictions share this format.  Reading parses lines in parallel; only a
header of moderate length reaches the driver, the values in a longer one become tables.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import intents
from ..functions.labels import Domain, LabelError, LabelSchema, checked
from ..operators.context import Context
from ..operators.scaling import LITERAL_VALUES, label_domains
from ..storage import stored
from .tables import in_file_order

HEADER = re.compile(r"# attributes: (\d+) properties: (.*)")
#: Texts that survive the header: values may not hold its own separators.
UNSAFE = re.compile(r"[(),|\n]|^\s|\s$")
#: Longer headers, and longer parts of them, are taken apart by Spark.
HEADER_CHARS = 65_536


def parse_header(line: str) -> tuple[int, LabelSchema]:
    found = HEADER.fullmatch(line.strip())
    if not found:
        raise LabelError(f"not a header: {line!r}")
    return int(found[1]), LabelSchema.parse(found[2])


def long_header(head: DataFrame, *, part_chars: int = HEADER_CHARS, held: int = LITERAL_VALUES) -> tuple[int, LabelSchema]:
    """(attributes, labels) of a header row: parts longer than `part_chars` become tables, or values where they have few."""
    pattern = r"([BO]\([^()]*\))"
    text = F.regexp_extract("value", r"properties: (.*)$", 1)
    whole = head.select(F.regexp_extract("value", r"^\s*# attributes: (\d+) properties: ", 1).alias("n"), (F.trim(F.regexp_replace(text, pattern, "")) == "").alias("clean"), F.regexp_extract_all(text, F.lit(pattern)).alias("parts"))
    parts = stored(whole.select("n", "clean", F.posexplode_outer("parts").alias("component", "part")), "header")
    short = (F.length("part") <= part_chars) | (F.col("part").startswith("B") & (F.size(F.split("part", ",")) == 2))
    rows = parts.select("n", "clean", "component", F.left("part", F.lit(1)).alias("kind"), F.when(short, F.col("part")).alias("part")).collect()  # one row a component
    if not rows[0].n or not rows[0].clean:
        raise LabelError("not a header")
    rows = sorted((r for r in rows if r.component is not None), key=lambda r: r.component)
    if any(r.kind == "B" and r.part is None for r in rows):
        raise LabelError("a binary domain has two values")
    first = parts.head().n
    values = parts.where(~short).select(F.col("component").alias("col_idx"), F.explode(F.split(F.expr("substring(part, 3, length(part) - 3)"), ",")).alias("value"))
    large = label_domains(values.select("col_idx", F.trim("value").alias("value")), [r.component for r in rows if r.part is None], held=held)
    # A part says itself that its domain is ordinal, however few values it has.
    ordinal = {c: Domain(d.values, False, d.table, d.rows) for c, d in large.items()}
    return int(first), LabelSchema(tuple(ordinal[r.component] if r.part is None else LabelSchema.parse(r.part).domains[0] for r in rows))


def parse_line(line: Column) -> tuple[Column, Column]:
    """(ids, label text) of a line; NULL ids mark a line without a bar."""
    head, label = F.split_part(line, F.lit("|"), F.lit(1)), F.trim(F.regexp_extract(line, r"\|(.*)$", 1))
    ids = F.transform(F.regexp_extract_all(head, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    return F.when(line.contains("|"), F.array_sort(F.array_distinct(ids))), label


def read(spark: SparkSession, path: str, *, header_chars: int = HEADER_CHARS, held: int = LITERAL_VALUES) -> Context:
    """A context from a transaction file or folder; rows are numbered 0, 1, 2, ... in file order, so files pair up line by line."""
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith("# attributes:")).limit(1)
    first = head.select(F.when(F.length("value") <= header_chars, F.col("value")).alias("value")).collect()
    if not first:
        raise LabelError(f"no header in {path}")
    n_attrs, labels = parse_header(first[0].value) if first[0].value is not None else long_header(head, part_chars=header_chars, held=held)
    # Checks must not fire on the header, and filters may run after them: they look at rows of the body only.
    in_body = ~F.col("value").startswith("#") & (F.trim("value") != "")
    ids, label = parse_line(F.col("value"))
    body = in_file_order(lines.where(in_body))
    texts = F.split(label, " ")
    bad = in_body & (ids.isNull() | F.exists(ids, lambda a: a >= n_attrs))
    intent = F.when(bad, F.raise_error(F.concat(F.lit("malformed line: "), F.col("value"))).cast("array<int>")).otherwise(ids)
    rows = labels.with_codes(body, [F.try_element_at(texts, F.lit(i + 1)) for i in range(labels.width)])
    return Context(checked(rows.select("row_id", intent.alias("intent"), F.when(in_body, F.col("prop")).alias("prop")), labels.width), n_attrs, labels)


def lines(context: Context, rows: DataFrame | None = None) -> DataFrame:
    """(value): the text line of each row."""
    rows = context.rows if rows is None else rows
    return context.labels.with_text(rows).select(F.concat(intents.text(F.col("intent")), F.lit(" | "), F.col("label")).alias("value"))


def ordered_lines(context: Context) -> DataFrame:
    """(value): the text lines in row_id order, sorted after label texts are joined."""
    rows = context.labels.with_text(context.rows).orderBy("row_id")
    return rows.select(F.concat(intents.text(F.col("intent")), F.lit(" | "), F.col("label")).alias("value"))


def write(context: Context, path: str, *, ordered: bool = False) -> None:
    """Writes a folder of text parts, the header in the first; `ordered` keeps row_id order."""
    for domain in context.labels.domains:
        bad = [v for v in domain.values if UNSAFE.search(v) or not v]
        if domain.table is not None:
            bad = [r.value for r in domain.table.where(F.col("value").rlike(f"(?U){UNSAFE.pattern}") | (F.col("value") == "")).limit(5).collect()]
        if bad:
            raise LabelError(f"label values that a header cannot hold: {bad}")
    context.header_row().coalesce(1).union(ordered_lines(context) if ordered else lines(context)).write.text(path)
