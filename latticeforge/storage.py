"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession

#: Used only where driver and executors are one machine and the session names no shared folder.
LOCAL_FALLBACK = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; without one a cluster has no place that all machines see."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or LOCAL_FALLBACK).rstrip("/")


_opened: ContextVar[list[str] | None] = ContextVar("opened", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (opened := _opened.get()) is not None:
        opened.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes all scratch tables made inside on leaving, after success and after errors; results must be written before."""
    token = _opened.set(opened := [])
    try:
        yield
    finally:
        _opened.reset(token)
        for path in opened:
            delete(spark, path)


class Journal:
    """Named tables in a folder that outlive a run: what an earlier run has stored whole is read, not made again.

    A table counts once Spark's committer has written its _SUCCESS file; the leavings of a run that ended within a table are deleted.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _there(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not self._there(f"{path}/_SUCCESS"):
            delete(self.spark, path)
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table and reads it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def copied(spark: SparkSession, source: BinaryIO, piece: int = 1 << 20) -> str:
    """Copies a stream of bytes, such as standard input, to a scratch file piece by piece."""
    path = scratch_path(spark, "input")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    try:
        while part := source.read(piece):
            out.write(bytearray(part))
    finally:
        out.close()
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
