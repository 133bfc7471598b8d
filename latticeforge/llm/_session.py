"""Session settings and shared scratch tables."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship_package
from ..storage import delete as drop_path
from ..storage import scratch_path

__all__ = ["documents", "drop", "drop_path", "release", "scratch_path", "stored", "tune"]


def tune(spark: SparkSession) -> None:
    """Ships the package; sets the rows per Arrow batch, which bound what a Python worker holds."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, survives lost executors.

    The shuffle files that made the table are of no more use, so Spark is told to look for garbage.
    """
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, name)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            drop_path(table.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results are stored already."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
