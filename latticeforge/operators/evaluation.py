"""Comparison of predictions with the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import LabelError, is_conflict, is_unknown
from .context import Context, require_same_header


def evaluate(truth: Context, predictions: Context) -> DataFrame:
    """(correct, unknown, conflicts, total and their percentages); rows pair up by row_id.

    Fails on different headers, on unknown labels in the truth, and on rows without a partner.
    """
    require_same_header(truth, predictions)
    left = truth.rows.select("row_id", F.col("prop").alias("truth"), F.lit(True).alias("has_truth"))
    right = predictions.rows.select("row_id", "prop", F.lit(True).alias("has_prop"))
    pairs = left.join(right, "row_id", "full")
    guard = F.when(F.count_if(F.col("has_truth").isNull() | F.col("has_prop").isNull()) > 0, F.raise_error(F.lit("rows without a partner")).cast("long"))
    guard = guard.when(F.count_if(is_unknown(F.col("truth"))) > 0, F.raise_error(F.lit("unknown labels in the truth")).cast("long"))
    counts = pairs.agg(
        guard.otherwise(F.count("*")).alias("total"),
        F.count_if(F.col("truth") == F.col("prop")).alias("correct"),
        F.count_if(is_unknown(F.col("prop"))).alias("unknown"),
        F.count_if(is_conflict(F.col("prop"))).alias("conflicts"),
    )
    share = lambda c: (100.0 * F.col(c) / F.col("total")).alias(f"{c}_pct")
    return counts.select("correct", "unknown", "conflicts", "total", share("correct"), share("unknown"), share("conflicts"))


def require_known(context: Context) -> None:
    if context.rows.where(is_unknown(F.col("prop"))).limit(1).count():
        raise LabelError("unknown labels in the truth")
