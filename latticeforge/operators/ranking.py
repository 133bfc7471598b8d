"""Places in an order, numbered by ranges of it so that no task sorts a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from ..storage import stored


def ranked_by_ranges(rows: DataFrame, group: str | None, order: list[str], rank: str) -> DataFrame:
    """(group, order, rank): places from 0 in ascending order within each group, or over all rows; a task ranks one range."""
    own_group = [group] if group else []
    cut = rows.select(*own_group, *order).repartitionByRange(*own_group, *order).withColumn("part", F.spark_partition_id())
    cut = stored(cut, "ranges")  # a range must not move once it is counted
    sizes = cut.groupBy(*own_group, "part").agg(F.count("*").alias("k"))
    before = F.sum("k").over(W.partitionBy(*own_group).orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # one row a range
    sizes = sizes.select(*own_group, "part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy(*own_group, "part").orderBy(*order)) - 1
    ranked = cut.select(*own_group, "part", *order, own.alias("own")).join(sizes, [*own_group, "part"])
    return ranked.select(*own_group, *order, (F.col("before") + F.col("own")).cast("int").alias(rank))
