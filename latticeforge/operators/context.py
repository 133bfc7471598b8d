"""Formal contexts: labelled rows of attribute sets, and their compressed form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import intents
from ..functions.labels import CONFLICT, UNKNOWN, LabelError, LabelSchema
from ..storage import stored
from .ranking import ranked_by_ranges

#: Attributes up to so many are renumbered by one row of their numbers that all tasks get.
BROADCAST_ATTRS = 100_000


@dataclass(frozen=True)
class Context:
    """rows(row_id BIGINT, intent ARRAY<INT>, prop ARRAY<INT>) over attributes 0..n_attrs-1."""

    rows: DataFrame
    n_attrs: int
    labels: LabelSchema

    @property
    def header(self) -> str:
        return f"# attributes: {self.n_attrs} properties: {self.labels.descriptor()}"

    def header_row(self) -> DataFrame:
        """(value): the header as one row, also where label domains are tables."""
        descriptor = self.labels.descriptor_row(self.rows.sparkSession)
        return descriptor.select(F.concat(F.lit(f"# attributes: {self.n_attrs} properties: "), "descriptor").alias("value"))

    @property
    def summary(self) -> str:
        """The header, with the size of a domain in place of more than a few values."""
        parts = (d.descriptor() if d.table is None and d.size <= 20 else f"{d.size} values" for d in self.labels.domains)
        return repr(f"# attributes: {self.n_attrs} properties: {''.join(parts)}")

    def with_rows(self, rows: DataFrame) -> Context:
        return Context(rows, self.n_attrs, self.labels)


def require_same_header(a: Context, b: Context) -> None:
    if a.n_attrs != b.n_attrs or not a.labels.same(b.labels):
        raise LabelError(f"incompatible contexts: {a.summary} and {b.summary}")


def count_name(component: int, code: int) -> str:
    return f"c{component}_{ {UNKNOWN: 'u', CONFLICT: 'x'}.get(code, code) }"


def count_names(labels: LabelSchema) -> list[str]:
    """Columns that count each code of each component."""
    return [count_name(i, code) for i, d in enumerate(labels.domains) for code in (UNKNOWN, CONFLICT, *d.codes)]


def label_counts(labels: LabelSchema, prop: Column) -> list[Column]:
    return [F.count_if(prop[i] == code).alias(count_name(i, code)) for i, d in enumerate(labels.domains) for code in (UNKNOWN, CONFLICT, *d.codes)]


#: Codes up to so many are counted in a column each, more in a map from the codes that occur to their counts.
DENSE_CODES = 64
#: That map: (component << 32) + code + 2 -> count.
HISTOGRAM = "label_counts"


def payload_of(labels: LabelSchema) -> tuple[list[str], bool]:
    """(columns that count label codes, whether a map counts them instead)."""
    dense = sum(d.size + 2 for d in labels.domains) <= DENSE_CODES
    return (count_names(labels) if dense else []), not dense


def code_key(component: Column | int, code: Column | int) -> Column:
    component = component if isinstance(component, Column) else F.lit(component)
    return F.call_function("shiftleft", component.cast("long"), F.lit(32)) + code + 2


def merged_counts(rows: DataFrame, *keys) -> DataFrame:
    """(keys, HISTOGRAM) from rows (keys, key, k): counts are summed as rows, on the map side first, and only then put into a map."""
    summed = rows.groupBy(*keys, "key").agg(F.sum("k").alias("k"))
    return summed.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("key", "k"))).alias(HISTOGRAM))


def summary_name(what: str, component: int) -> str:
    return f"{what}{component}"


def summed_counts(rows: DataFrame, width: int, *keys) -> DataFrame:
    """(keys, what a merge asks of each component) from rows (keys, key, k), without a map of them.

    top: (count, -key) of the most frequent code; low, high: the least and greatest key of known codes; zero: the count of code 0.
    """
    out = []
    for i in range(width):
        own = (F.col("key") >= code_key(i, UNKNOWN)) & (F.col("key") < code_key(i + 1, UNKNOWN))
        known = F.when(own & (F.col("key") > code_key(i, UNKNOWN)), F.col("key"))
        out.append(F.max(F.when(own, F.struct("k", (-F.col("key")).alias("less")))).alias(summary_name("top", i)))
        first = F.coalesce(F.sum(F.when(F.col("key") == code_key(i, 0), F.col("k"))), F.lit(0))
        out += [F.min(known).alias(summary_name("low", i)), F.max(known).alias(summary_name("high", i)), first.alias(summary_name("zero", i))]
    return rows.groupBy(*keys, "key").agg(F.sum("k").alias("k")).groupBy(*keys).agg(*out)


def label_rows(rows: DataFrame, *keys) -> DataFrame:
    """(keys, component, key): a row for each component of each row's label."""
    codes = rows.select(*keys, F.posexplode("prop").alias("component", "code"))
    return codes.withColumn("key", code_key(F.col("component"), F.col("code"))).drop("code")


def compress_labels(context: Context, *keys: Column) -> DataFrame:
    """(keys, w*, component, key, k, first_row): how often each label code occurs with each distinct intent, a row each."""
    words = [c.alias(name) for c, name in zip(intents.to_words(F.col("intent"), context.n_attrs), intents.word_names(context.n_attrs))]
    named = context.rows.select(*keys, *words, "row_id", "prop")
    own = [c for c in named.columns if c not in ("row_id", "prop")]
    return label_rows(named, *own, "row_id").groupBy(*own, "component", "key").agg(F.count("*").alias("k"), F.min("row_id").alias("first_row"))


def compress(context: Context, *keys: Column, counted: DataFrame | None = None) -> DataFrame:
    """One row for each distinct intent (and key): words, n, label counts and the first row's id.

    Concepts, supports and every merge depend on a context only through this; it aggregates on the
    map side, so it shuffles distinct intents, not rows.  Labels of large domains are not counted here but in rows of
    their own: `counted`, as compress_labels gives them.
    """
    words = [c.alias(name) for c, name in zip(intents.to_words(F.col("intent"), context.n_attrs), intents.word_names(context.n_attrs))]
    if payload_of(context.labels)[1]:
        counted = compress_labels(context, *keys) if counted is None else counted
        own = [c for c in counted.columns if c not in ("component", "key", "k", "first_row")]
        n = F.sum(F.when(F.col("component") == 0, F.col("k")))
        return counted.groupBy(*own).agg(n.alias("n"), F.min("first_row").alias("first_row"))
    return context.rows.groupBy(*keys, *words).agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"), *label_counts(context.labels, F.col("prop")))


def density(context: Context) -> DataFrame:
    """100 * cells set / (rows * attributes)."""
    return context.rows.agg((100.0 * F.sum(F.size("intent")) / (F.count("*") * F.lit(context.n_attrs))).alias("density"))


def attribute_support(context: Context) -> DataFrame:
    """(attr_id, support) over the rows."""
    return context.rows.select(F.explode("intent").alias("attr_id")).groupBy("attr_id").agg(F.count("*").alias("support"))


def mask_labels(context: Context) -> Context:
    """All labels unknown."""
    return context.with_rows(context.rows.withColumn("prop", context.labels.unknown()))


def reorder_by_support(context: Context, *, broadcast_attrs: int = BROADCAST_ATTRS) -> tuple[Context, DataFrame]:
    """Renumbers attributes rarest first (ties by id); also the map (attr_id, new_id). Result-neutral.

    Up to `broadcast_attrs` attributes their new numbers are sent to all tasks as one row; more are numbered by ranges and
    joined to the attributes of the rows, equal intents once.
    """
    ids = context.rows.sparkSession.range(context.n_attrs).select(F.col("id").cast("int").alias("attr_id"))
    ranked = ids.join(attribute_support(context), "attr_id", "left").select(F.coalesce("support", F.lit(0)).alias("support"), "attr_id")
    if context.n_attrs > broadcast_attrs:
        mapping = stored(ranked_by_ranges(ranked, None, ["support", "attr_id"], "new_id").select("attr_id", "new_id"), "order")
        distinct = context.rows.select("intent").distinct()
        cells = distinct.select("intent", F.explode("intent").alias("attr_id")).join(mapping, "attr_id")
        renamed = cells.groupBy("intent").agg(F.array_sort(F.collect_list("new_id")).alias("moved"))
        moved = context.rows.join(renamed, "intent", "left")
        return context.with_rows(moved.withColumn("intent", F.coalesce("moved", "intent")).select(context.rows.columns)), mapping
    order = ranked.select(F.struct("support", "attr_id").alias("a")).agg(F.array_sort(F.collect_list("a")).alias("order"))  # one row, one entry an attribute
    mapping = order.select(F.posexplode("order").alias("new_id", "a")).select("a.attr_id", "new_id")
    lookup = mapping.agg(F.array_sort(F.collect_list(F.struct("attr_id", "new_id")))["new_id"].alias("lookup"))
    moved = context.rows.join(F.broadcast(lookup))  # with that one row
    moved = moved.withColumn("intent", F.array_sort(F.transform("intent", lambda a: F.element_at("lookup", a + 1)))).drop("lookup")
    return context.with_rows(moved), mapping
