"""Splits and samples, decided by a hash of the row id and a seed: the same on every run and retry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from .context import Context


def digest(*keys: Column) -> Column:
    """A number below 2**60 for each combination of keys: 15 hexadecimal digits of the MD5 of their texts, joined by `:`."""
    text = F.concat_ws(":", *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def chance(*keys: Column) -> Column:
    """A uniform number in [0, 1) for each combination of keys."""
    return F.shiftright(digest(*keys), 30) / float(1 << 30)


def split(context: Context, a: int, b: int, *, seed: int = 0) -> tuple[Context, Context]:
    """Each row goes to the first part with probability a / (a + b), else to the second."""
    first = chance(F.col("row_id"), F.lit(seed)) < a / (a + b)
    return context.with_rows(context.rows.where(first)), context.with_rows(context.rows.where(~first))


def parse_ratio(text: str) -> tuple[int, int]:
    a, colon, b = text.partition(":")
    if not colon or not a.isdigit() or not b.isdigit() or int(a) + int(b) == 0:
        raise ValueError(f"a ratio like 8:2 expected: {text!r}")
    return int(a), int(b)


def fold_samples(rows: DataFrame, folds: int, *, seed: int = 0) -> DataFrame:
    """(fold, row): for each fold, independently, n div folds rows in random order; folds may overlap.

    The cut-off is a quantile of the hash, found by exact rank within each fold.
    """
    spread = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("r", digest(F.col("row_id"), F.col("fold"), F.lit(seed)))
    size = rows.count() // folds
    bucket = F.shiftright("r", 46)  # ranks are taken within 16384 buckets, not within a whole fold
    counts = spread.groupBy("fold", bucket.alias("bucket")).agg(F.count("*").alias("k"))
    before = counts.withColumn("before", F.coalesce(F.sum("k").over(W.partitionBy("fold").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = spread.withColumn("bucket", bucket).join(before.select("fold", "bucket", "before"), ["fold", "bucket"])
    rank = F.row_number().over(W.partitionBy("fold", "bucket").orderBy("r", "row_id")) + F.col("before")
    return placed.withColumn("rank", rank).where(F.col("rank") <= size).select("fold", *rows.columns)
