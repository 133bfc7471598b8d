"""Scaling: from tables of text columns to formal contexts.

A column becomes numeric when every distinct text reads as a double and there are more than ten of
them, else nominal.  Nominal values get one attribute each, in text order; numeric columns are cut
by recursive bisection of their histogram into overlapping intervals, a value setting the attributes
of the interval it lies in and of the one before.  Thresholds and the values of large label domains are
tables throughout: they are found, numbered and met with the rows by Spark, and never held by the driver or a plan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..functions.labels import CONFLICT_TEXT, UNKNOWN_TEXT, Domain, LabelSchema, checked
from ..shipping import ship_package
from ..storage import stored
from .context import Context
from .ranking import ranked_by_ranges

#: A numeric column has more distinct texts than this.
NUMERIC_MIN = 10
#: Candidate pivots of one bisection, and distinct values below which a side is not cut further.
CANDIDATES, SIDE_MIN = 25, 10
#: Distinct values that one task bisects; larger segments are cut by distributed counts first.
TASK_VALUES = 1_000_000
#: Dictionaries up to so many values become map literals; larger ones are joined.
LITERAL_VALUES = 2_000
#: Texts of numeric columns (some 100 bytes each), smallest columns first, whose dictionaries are sent to all tasks; by larger ones rows may be shuffled.
BROADCAST_TEXTS = 1_000_000
#: Segments of a level up to so many are sent to all tasks with their pivots (some 25 doubles each); more are joined.
BROADCAST_SEGMENTS = 10_000


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col_idx, value, cnt): how many rows hold each text in each column; null counts as empty text."""
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("col_idx"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for i, c in enumerate(columns))))
    return df.select(cells.alias("cell")).groupBy("cell.col_idx", "cell.value").agg(F.count("*").alias("cnt"))


def label_distribution(df: DataFrame, columns: list[str], labels: list[str]) -> DataFrame:
    """(col_idx, value, labels): the sorted set of label texts that each value occurs with."""
    label = F.concat_ws("", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in labels))
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("col_idx"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for i, c in enumerate(columns))))
    return df.select(label.alias("label"), cells.alias("cell")).groupBy("cell.col_idx", "cell.value").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def column_kinds(values: DataFrame) -> DataFrame:
    """(col_idx, n_values, numeric) from a distribution."""
    number = F.col("value").try_cast("double")
    return values.groupBy("col_idx").agg(F.count("*").alias("n_values"), F.bool_and(number.isNotNull()).alias("all_numbers")).select("col_idx", "n_values", (F.col("all_numbers") & (F.col("n_values") > NUMERIC_MIN)).alias("numeric"))


def nominal_dictionary(values: DataFrame, *, ranges: bool = False) -> DataFrame:
    """(col_idx, value, rank): the place of each text in its column's text order.

    One task ranks a column; with `ranges` one ranks a range of texts, behind the sizes of the ranges before.
    """
    if not ranges:
        rank = F.row_number().over(W.partitionBy("col_idx").orderBy("value")) - 1
        return values.select("col_idx", "value", rank.alias("rank"))
    return ranked_by_ranges(values, "col_idx", ["value"], "rank")


def bisect(values: np.ndarray, weights: np.ndarray) -> list[float]:
    """Thresholds of a histogram of ascending distinct values, in ascending order.

    Each step takes the first of the evenly spaced candidates that splits the rows most evenly.
    """
    out: list[float] = []
    work: list[tuple[int, int] | float] = [(0, len(values))]
    run = np.concatenate([[0], np.cumsum(weights)])
    while work:
        part = work.pop()
        if isinstance(part, float):
            out.append(part)
            continue
        lo, hi = part
        first, last = float(values[lo]), float(values[hi - 1])
        if hi - lo <= 2:
            out.append((first + last) / 2)
            continue
        step = (last - first) / CANDIDATES
        pivots = [first + i * step for i in range(CANDIDATES)]
        # Between infinities pivots are not numbers: nothing lies below such a one.
        cuts = lo + np.where(np.isnan(pivots), 0, np.searchsorted(values[lo:hi], pivots, "left"))
        balance = (run[cuts] - run[lo]).astype(np.float64) * (run[hi] - run[cuts]).astype(np.float64)
        best = int(np.argmax(balance))
        if balance[best] == 0:
            out.append((first + last) / 2)
            continue
        cut = int(cuts[best])
        if hi - cut >= SIDE_MIN:
            work.append((cut, hi))
        work.append(pivots[best])
        if cut - lo >= SIDE_MIN:
            work.append((lo, cut))
    return out


def first_split(histogram: DataFrame, keys: tuple[str, ...] = ("col_idx",), *, small: bool = True) -> DataFrame:
    """(keys, candidate, pivot): the first bisection of each numeric column or segment of one, by distributed counts.

    `small` tells that there are few enough of them to send their pivots to all tasks.
    """
    ends = histogram.groupBy(*keys).agg(F.min("v").alias("first"), F.max("v").alias("last"))
    i = F.explode(F.sequence(F.lit(0), F.lit(CANDIDATES - 1))).alias("candidate")
    pivots = ends.select(*keys, "first", "last", i).withColumn("pivot", F.col("first") + F.col("candidate") * ((F.col("last") - F.col("first")) / CANDIDATES))
    pivots = pivots.where(~F.isnan("pivot"))  # between infinities; nothing lies below such a one
    ladder = pivots.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("candidate", "pivot"))).alias("ladder"))
    pivots = ladder.select(*keys, F.posexplode("ladder").alias("step", "p")).select(*keys, "step", "p.candidate", "p.pivot")
    place = F.size(F.filter("ladder", lambda p: p["pivot"] <= F.col("v")))  # steps that leave v on the right
    binned = histogram.join(F.broadcast(ladder) if small else ladder, list(keys)).groupBy(*keys, place.alias("place")).agg(F.sum("n").alias("n"))
    left = F.sum(F.when(F.col("place") <= F.col("step"), F.col("n")).otherwise(0))
    scored = pivots.join(binned, list(keys)).groupBy(*keys, "candidate", "pivot").agg(left.alias("l"), F.sum("n").alias("t"))
    balance = F.col("l").cast("double") * (F.col("t") - F.col("l")).cast("double")
    return scored.groupBy(*keys).agg(F.max_by(F.struct("candidate", "pivot"), F.struct(balance, -F.col("candidate"))).alias("best")).select(*keys, "best.candidate", "best.pivot")


def numeric_histogram(values: DataFrame) -> DataFrame:
    """(col_idx, v, n): texts that read as the same double count together."""
    return values.select("col_idx", F.col("value").try_cast("double").alias("v"), "cnt").groupBy("col_idx", "v").agg(F.sum("cnt").alias("n"))


def number_histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col_idx, v, n) of columns that are numbers already; nulls are left out."""
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("col_idx"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns))))
    return df.select(cells.alias("cell")).where("cell.v is not null").groupBy("cell.col_idx", "cell.v").agg(F.count("*").alias("n"))


def _segment_thresholds(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("v")
    cuts = bisect(pdf["v"].to_numpy(np.float64), pdf["n"].to_numpy(np.int64))
    return pd.DataFrame({"col_idx": np.full(len(cuts), pdf["col_idx"].iloc[0], np.int32), "threshold": cuts})


def threshold_table(histogram: DataFrame, *, task_values: int = TASK_VALUES) -> DataFrame:
    """(col_idx, place, threshold): the ascending thresholds of each column, numbered from 0.

    Segments with more distinct values than a task takes are cut by distributed counts, all of a level at once, until
    every one fits; a column without rows has no thresholds.  Levels are stored, and the driver sees only how many
    segments are still too large.
    """
    spark = histogram.sparkSession
    ship_package(spark)
    key = ["col_idx", "segment"]
    rows = stored(histogram.select("col_idx", F.lit("").alias("segment"), "v", "n"), "histogram")
    found, ready = [], []
    while True:
        sizes = stored(rows.groupBy(*key).agg(F.count("*").alias("k"), F.min("v").alias("first"), F.max("v").alias("last")), "sizes")
        many = sizes.where(F.col("k") > task_values)
        n_many = many.count()
        if not n_many:
            ready.append(rows)
            break
        ready.append(rows.join(many, key, "left_anti"))
        large = rows.join(many.select(*key), key, "left_semi")
        best = first_split(large, tuple(key), small=n_many <= BROADCAST_SEGMENTS).select(*key, "pivot")
        best = stored(best, "pivots")
        left = large.join(best, key).where(F.col("v") < F.col("pivot")).groupBy(*key).agg(F.count("*").alias("l"))
        sides = many.join(best, key, "left").join(left, key, "left").withColumn("l", F.coalesce("l", F.lit(0)))
        sides = stored(sides.withColumn("splits", (F.col("l") > 0) & (F.col("l") < F.col("k"))), "sides")
        middle = (F.col("first") + F.col("last")) / 2  # where no candidate splits the segment
        found.append(sides.select("col_idx", F.when(F.col("splits"), F.col("pivot")).otherwise(middle).alias("threshold")))
        goes_left = F.col("v") < F.col("pivot")
        kept = F.when(goes_left, F.col("l")).otherwise(F.col("k") - F.col("l")) >= SIDE_MIN
        cut = large.join(sides.where("splits").select(*key, "pivot", "k", "l"), key).where(kept)
        rows = stored(cut.select("col_idx", F.concat("segment", F.when(goes_left, F.lit("l")).otherwise(F.lit("r"))).alias("segment"), "v", "n"), "histogram")
    whole = ready[0]
    for more in ready[1:]:
        whole = whole.union(more)
    out = whole.groupBy(*key).applyInPandas(_segment_thresholds, "col_idx int, threshold double").withColumn("threshold", F.coalesce("threshold", F.lit(float("nan"))))  # pandas' nulls
    out = stored(out, "cuts")  # ranges are sampled first: segments must not be bisected for that as well
    for more in found:
        out = out.union(more)
    return ranked_by_ranges(out, "col_idx", ["threshold"], "place").select("col_idx", "place", "threshold")


def numeric_thresholds(histogram: DataFrame, *, task_values: int = TASK_VALUES) -> dict[int, list[float]]:
    """The threshold table as lists, for a look at a few columns; scaling itself works on the table."""
    out: dict[int, list[float]] = {}
    for r in threshold_table(histogram, task_values=task_values).orderBy("col_idx", "place").collect():
        out.setdefault(r.col_idx, []).append(r.threshold)
    return out


def interval_dictionary(values: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(col_idx, value, rank, both): the interval of each numeric text, and whether the interval before is set as well.

    Texts and thresholds are merged by ranges of numbers: a text looks back for the last threshold that is not above it, and
    where its range has none, the ranges before tell how many there were.
    """
    at = F.col("value").try_cast("double")
    events = values.select("col_idx", at.alias("x"), F.lit(0).alias("kind"), "value", F.lit(None).cast("int").alias("place"))
    events = events.union(thresholds.select("col_idx", F.col("threshold").alias("x"), F.lit(1), F.lit(None).cast("string"), "place"))
    cut = stored(events.repartitionByRange("col_idx", "x").withColumn("part", F.spark_partition_id()), "intervals")  # equal numbers share a range
    ends = cut.groupBy("col_idx", "part").agg(F.max("place").alias("top"))
    before = F.max("top").over(W.partitionBy("col_idx").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select("col_idx", "part", (F.coalesce(before, F.lit(-1)) + 1).alias("earlier"))
    order = W.partitionBy("col_idx", "part").orderBy("x", F.desc("kind")).rowsBetween(W.unboundedPreceding, 0)  # a threshold stands before the texts that equal it
    last = F.last("place", ignorenulls=True).over(order)
    cut_at = F.last(F.when(F.col("kind") == 1, F.col("x")), ignorenulls=True).over(order)
    swept = cut.withColumns({"last": last, "cut_at": cut_at}).where("kind = 0").join(ends, ["col_idx", "part"])
    met = F.coalesce(F.col("cut_at") == F.col("x"), F.lit(False))
    below = F.when(met, F.col("last")).otherwise(F.coalesce(F.col("last") + 1, F.col("earlier")))
    return swept.select("col_idx", "value", below.alias("rank"), ((below > 0) & ~met).alias("both"))


def numeric_ids(value: Column, thresholds: list[float], offset: int) -> Column:
    """Attribute ids of a double: of its interval and the one before; of the one before alone on a threshold."""
    ladder = F.array(*(F.lit(float(t)) for t in np.sort(thresholds)))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, len(thresholds).bit_length())))))
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(ladder, at + step - 1) < value, at + step).otherwise(at))  # binary search
    first, second = (F.lit(offset) + below - 1), (F.lit(offset) + below)
    met = F.coalesce(F.get(ladder, below) == value, F.lit(False))
    return F.when(met | (below == 0), F.array(second)).otherwise(F.array(first, second))


@dataclass(frozen=True)
class NominalColumn:
    offset: int
    size: int
    values: tuple[str, ...] | None  # None: too many for a literal, the dictionary is joined


@dataclass(frozen=True)
class NumericColumn:
    offset: int
    size: int  # one more than there are thresholds
    texts: int = 0  # distinct texts, all in the dictionary


def fit_columns(df: DataFrame, columns: list[str]) -> tuple[list[NominalColumn | NumericColumn], DataFrame]:
    """The coder of each column, offsets running in column order; and the dictionary (col_idx, value, rank, both).

    A text sets the attribute of its rank and, with `both`, the one before.
    """
    values = stored(distribution(df, columns), "distribution")
    kinds = {r.col_idx: r for r in column_kinds(values).collect()}  # one row a column
    numeric = [i for i, k in kinds.items() if k.numeric]
    nominal = [k.n_values for k in kinds.values() if not k.numeric]
    dictionary = nominal_dictionary(values.where(~F.col("col_idx").isin(numeric)) if numeric else values, ranges=max(nominal, default=0) > TASK_VALUES).withColumn("both", F.lit(False))
    steps: dict[int, int] = {}
    if numeric:
        own = values.where(F.col("col_idx").isin(numeric))
        thresholds = stored(threshold_table(numeric_histogram(own)), "thresholds")
        steps = {r.col_idx: r.k for r in thresholds.groupBy("col_idx").agg(F.count("*").alias("k")).collect()}  # one row a column
        dictionary = dictionary.union(interval_dictionary(own, thresholds))
    if numeric or max(nominal, default=0) > LITERAL_VALUES:  # joined once for each such column
        dictionary = stored(dictionary, "dictionary")
    small = [i for i, k in kinds.items() if not k.numeric and k.n_values <= LITERAL_VALUES]
    held: dict[int, list[str]] = {i: [] for i in small}
    for r in dictionary.where(F.col("col_idx").isin(small)).orderBy("col_idx", "rank").collect() if small else []:
        held[r.col_idx].append(r.value)
    coders: list[NominalColumn | NumericColumn] = []
    offset = 0
    for i in range(len(columns)):
        if i in numeric:
            coders.append(NumericColumn(offset, steps.get(i, 0) + 1, kinds[i].n_values))
        else:
            size = kinds[i].n_values if i in kinds else 0
            coders.append(NominalColumn(offset, size, tuple(held[i]) if i in held else (() if i not in kinds else None)))
        offset += coders[-1].size
    return coders, dictionary


def label_domains(values: DataFrame, columns: list[int], *, held: int = LITERAL_VALUES) -> dict[int, Domain]:
    """The domain of each column of label texts (col_idx, value): held in full up to `held` values, else a table (code, value)."""
    known = stored(values.where(~F.col("value").isin(UNKNOWN_TEXT, CONFLICT_TEXT)).distinct(), "labels")
    sizes = {r.col_idx: r.k for r in known.groupBy("col_idx").agg(F.count("*").alias("k")).collect()}  # one row a column
    large = [i for i in columns if sizes.get(i, 0) > max(held, 2)]
    texts: dict[int, list[str]] = {i: [] for i in columns}
    for r in known.where(~F.col("col_idx").isin(large)).collect() if large else known.collect():  # at most `held` a column
        texts[r.col_idx].append(r.value)
    out = {i: Domain.of(texts[i]) for i in columns}
    if large:
        ranked = nominal_dictionary(known.where(F.col("col_idx").isin(large)), ranges=max(sizes[i] for i in large) > TASK_VALUES)
        ranked = stored(ranked.select("col_idx", F.col("rank").alias("code"), "value"), "domains")
        out |= {i: Domain((), False, ranked.where(F.col("col_idx") == i).select("code", "value"), sizes[i]) for i in large}
    return out


def fit_labels(df: DataFrame, columns: list[str], *, held: int = LITERAL_VALUES) -> LabelSchema:
    """The domain of each label column."""
    if not columns:
        return LabelSchema(())
    found = label_domains(distribution(df, columns).select("col_idx", "value"), list(range(len(columns))), held=held)
    return LabelSchema(tuple(found[i] for i in range(len(columns))))


def encode(df: DataFrame, label_columns: list[str] | list[int], *, row_id: str = "row_id", attribute_columns: list[str] | None = None, held_labels: int = LITERAL_VALUES) -> Context:
    """Scales a table into a context.  All columns but row_id and the labels become attributes.

    A label domain beyond `held_labels` values is a table that is joined; a label text outside its domain fails.
    """
    names = [c for c in df.columns if c != row_id]
    labels = [names[c] if isinstance(c, int) else c for c in label_columns]
    columns = attribute_columns if attribute_columns is not None else [c for c in names if c not in labels]
    coders, dictionary = fit_columns(df, columns)
    schema = fit_labels(df, labels, held=held_labels)
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = df
    texts = {i: c.texts for i, c in enumerate(coders) if isinstance(c, NumericColumn)}
    small, room = set(), BROADCAST_TEXTS
    for i in sorted(texts, key=lambda i: texts[i]):
        room -= texts[i]
        if room >= 0:
            small.add(i)
    parts = []
    for i, (name, coder) in enumerate(zip(columns, coders)):
        if isinstance(coder, NominalColumn) and coder.values is not None:
            place = F.array_position(F.array(*(F.lit(v) for v in coder.values)), text(name))
            parts.append(F.array((place + (coder.offset - 1)).cast("int")))
            continue
        at = (F.col("rank") + coder.offset).cast("int")
        ids = F.when(F.col("both"), F.array(at - 1, at)).otherwise(F.array(at))  # made once a text, not once a row
        own = dictionary.where(F.col("col_idx") == i).select(F.col("value").alias(f"_v{i}"), ids.alias(f"_a{i}"))
        rows = rows.join(F.broadcast(own) if i in small else own, text(name) == F.col(f"_v{i}"), "left")
        parts.append(F.col(f"_a{i}"))
    intent = F.concat(*parts) if parts else F.array().cast("array<int>")  # ascending: offsets run in column order
    rows = rows.select(F.col(row_id).cast("long").alias("row_id"), intent.alias("intent"), *(text(c).alias(f"_label{i}") for i, c in enumerate(labels)))
    out = schema.with_codes(rows, [F.col(f"_label{i}") for i in range(len(labels))]).select("row_id", "intent", "prop")
    return Context(checked(out, len(labels)) if labels else out, sum(c.size for c in coders), schema)
