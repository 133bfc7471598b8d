"""Raw tables: CSV without a header, Parquet, and row ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

from ..shipping import ship_package
from ..storage import stored


def _file_order() -> WindowSpec:
    """Splits in the order of files, and of places in a file; part files are ordered by their number."""
    part = F.regexp_extract("_path", r"part-(\d+)[^/]*$", 1)
    return W.orderBy(F.regexp_replace("_path", r"[^/]*$", ""), F.when(part != "", part.cast("long")), "_path", "_start")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows of a file scan with their file, split and an id that rises within a split."""
    path, start = F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")
    return rows.select("*", path, start).withColumn("_id", F.monotonically_increasing_id())


def in_file_order(rows: DataFrame) -> DataFrame:
    """`rows` of a file scan with row_id 0, 1, 2, ... in the order of files, and of rows in a file.

    Spark deals large files out first, so ids given at the scan follow sizes, not names.  Only one row a split is put in
    order in one task.
    """
    names = rows.columns
    scanned = _placed(rows)
    splits = scanned.groupBy("_path", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(_file_order().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = splits.select("_path", "_start", (before - F.col("_first")).alias("_shift"))
    return scanned.join(shift, ["_path", "_start"]).select((F.col("_id") + F.col("_shift")).alias("row_id"), *names)


_QUOTED = r'[^"]*+(?:""[^"]*+)*+'
_CELLS = rf'(?:(?:"{_QUOTED}"[^,]*+|[^",][^,]*+|),)*+'
#: Lines that end inside a quoted cell: of those that begin outside one, and of those that begin inside.
_OPENS = rf'(?s)^{_CELLS}"{_QUOTED}$'
_STAYS = rf'(?s)^{_QUOTED}(?:"[^,]*+,{_CELLS}"{_QUOTED})?$'


def _state_before(order: WindowSpec) -> tuple[Column, Column]:
    """(what the steps before fix, or null; how often they change over after that) for steps that fix, keep or change a state.

    Steps have columns `fixed` (0, 1 or null) and `swap` (0 or 1); the order's partition is their sequence.
    """
    before, upto = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, 0)
    swaps = F.coalesce(F.sum("swap").over(before), F.lit(0))
    at_fixed = F.last("fixed_at", ignorenulls=True).over(before)
    return F.last("fixed", ignorenulls=True).over(before), swaps - F.coalesce(at_fixed, F.lit(0))


def _inside(opens: np.ndarray, stays: np.ndarray, begins: int) -> np.ndarray:
    """For each of some successive lines, and after them, whether a quoted cell is open, from that before the first."""
    fixed = opens == stays
    last = np.maximum.accumulate(np.concatenate([[-1], np.where(fixed, np.arange(len(opens)), -1)]))
    swaps = np.concatenate([[0], np.cumsum((opens == 1) & (stays == 0))])
    return np.where(last < 0, begins + swaps, opens[last] + swaps - swaps[last]) % 2 if len(opens) else np.asarray([begins])


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def _runs(new: np.ndarray) -> Iterator[tuple[int, int]]:
    """The bounds of runs of rows, from whether each row after the first differs from the one before."""
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(new) + 1]
    return zip(cuts, cuts[1:])


def _split_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split: the state that it ends in and the records that begin in it, if it begins outside a cell and if inside one."""
    key, states, counts = None, [0, 1], [0, 0]
    row = lambda: pa.record_batch([pa.array([x]) for x in (*key, *states, *counts)], names=["_path", "_start", "end0", "end1", "n0", "n1"])
    for batch in batches:
        if not batch.num_rows:
            continue
        path, (start, opens, stays, blank) = batch.column("_path"), _numbers(batch, "_start", "opens", "stays", "blank")
        moved = pc.not_equal(path.slice(1), path.slice(0, len(path) - 1)).to_numpy(zero_copy_only=False) | (np.diff(start) != 0)
        for s, e in _runs(moved):
            if key != (now := (path[s].as_py(), int(start[s]))):
                if key is not None:
                    yield row()
                key, states, counts = now, [0, 1], [0, 0]
            for k in (0, 1):
                inside = _inside(opens[s:e], stays[s:e], states[k])
                counts[k] += int(((inside[:-1] == 0) & (blank[s:e] == 0)).sum())
                states[k] = int(inside[-1])
    if key is not None:
        yield row()


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_id, _start, record, whole) of the records of splits whose lines stream in; pieces of records over several splits are not whole."""
    split = state = number = start = None
    held, whole = [], False  # lines of the last record, and whether it began in this split

    def rows(ids, at: int, texts, complete: bool) -> pa.RecordBatch:
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array([at] * len(ids), pa.int64()), texts, pa.array([complete] * len(ids))], names=["row_id", "_start", "record", "whole"])

    def last(closed: bool) -> pa.RecordBatch:
        lines = pa.concat_arrays(held)
        return rows([number - 1], start, pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n"), whole and closed)

    for batch in batches:
        if not batch.num_rows:
            continue
        if batch.column("split").null_count:
            raise ValueError("the files were split in another way when they were read again")
        splits, starts, ids, begins, before, opens, stays, blank = _numbers(batch, "split", "_start", "_id", "begins", "before", "opens", "stays", "blank")
        if (np.diff(ids) <= 0).any():
            raise ValueError("the lines of a split came out of order")
        for s, e in _runs(np.diff(splits) != 0):
            if split != splits[s]:
                if held:
                    yield last(state == 0)
                split, state, number, start, held, whole = splits[s], int(begins[s]), int(before[s]), int(starts[s]), [], False
            inside = _inside(opens[s:e], stays[s:e], state)
            kept = (blank[s:e] == 0) | (inside[:-1] == 1)
            lines, first = batch.column("value").slice(s, e - s).filter(pa.array(kept)), np.flatnonzero(inside[:-1][kept] == 0)
            upto = int(first[0]) if len(first) else len(lines)
            if upto:
                held.append(lines.slice(0, upto))
            if len(first):
                if held:
                    yield last(True)
                if len(first) > 1:
                    records = pa.ListArray.from_arrays(pa.array(first, pa.int32()), lines)
                    yield rows(np.arange(number, number + len(first) - 1), start, pc.binary_join(records, "\n"), True)
                number, held, whole = number + len(first), [lines.slice(int(first[-1]))], True
            state = int(inside[-1])
    if held:
        yield last(state == 0)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, record, fields): the CSV records of files in their order, with how many cells each has; quoted cells may hold line feeds.

    Files are read by lines, in splits, twice.  A line either changes from outside a quoted cell to inside or back, keeps that, or fixes it;
    states that run over a split, and then over the few splits of a file, tell where each line begins.  Tasks put lines together as
    they stream by; only pieces of records over several splits are shuffled.  A record that is one empty cell is skipped; a record that is
    still open ends with its file.
    """
    ship_package(spark)
    lines = _placed(spark.read.option("lineSep", "\n").text(path))
    quotes = F.col("value").contains('"')  # a line without any keeps the state
    opens, stays = F.when(quotes, F.col("value").rlike(_OPENS)).otherwise(False), F.when(quotes, F.col("value").rlike(_STAYS)).otherwise(True)
    bare = F.regexp_replace("value", r"\r$", "")
    blank = (F.length("value") < 4) & bare.isin("", '""')
    flags = [opens.alias("opens"), stays.alias("stays"), blank.alias("blank")]
    ends = lines.select("_path", "_start", *flags).mapInArrow(_split_states, "_path string, _start long, end0 long, end1 long, n0 long, n1 long")
    splits = stored(ends, "splits")

    same = F.col("end0") == F.col("end1")
    splits = splits.withColumns({"fixed": F.when(same, F.col("end0")), "swap": F.when(~same, F.col("end0")).otherwise(0)})
    inside_file = W.partitionBy("_path").orderBy("_start")  # a row for each split
    splits = splits.withColumn("fixed_at", F.when(F.col("fixed").isNotNull(), F.sum("swap").over(inside_file.rowsBetween(W.unboundedPreceding, 0))))
    fixed, swaps = _state_before(inside_file)
    splits = splits.withColumn("begins", (F.coalesce(fixed, F.lit(0)) + swaps) % 2).withColumn("n", F.when(F.col("begins") == 0, F.col("n0")).otherwise(F.col("n1")))
    before = F.coalesce(F.sum("n").over(_file_order().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("_path", "_start", "begins", before.alias("before"), F.row_number().over(_file_order()).alias("split"))

    placed = lines.join(F.broadcast(splits), ["_path", "_start"], "left").select("split", "_start", "_id", "begins", "before", *flags, "value")
    found = placed.mapInArrow(_assembled, "row_id long, _start long, record string, whole boolean")
    ended = F.regexp_replace("record", r"\r$", "")
    found = stored(found.withColumn("fields", F.when(F.col("whole"), _fields(ended))), "records")
    parts = F.array_sort(F.collect_list(F.struct("_start", "record")))
    several = found.where("not whole").groupBy("row_id").agg(parts.alias("parts"))
    several = several.select("row_id", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record")).select("row_id", ended.alias("record"))
    return found.where("whole").select("row_id", ended.alias("record"), "fields").unionByName(several.withColumn("fields", _fields(F.col("record"))))


def _fields(record: Column) -> Column:
    """How many cells a CSV record has: separators outside quotes, and one."""
    outside = F.regexp_replace(record, rf'(?s)(?<![^,])"{_QUOTED}"?', "")
    return F.length(outside) - F.length(F.replace(outside, F.lit(","), F.lit(""))) + 1


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """row_id (in file order) and text columns _c0, _c1, ...; quotes double inside quotes.

    Quoted cells may hold line feeds, wherever files are split.  A line that is one empty cell is skipped, one of spaces is a cell; an empty
    file has no rows.  There are as many columns as the widest row has cells; cells that a shorter row lacks count as empty.
    """
    found = records(spark, path)
    width = found.agg(F.max("fields")).head()[0] or 1
    names = [f"_c{i}" for i in range(width)]
    cells = F.from_csv("record", ", ".join(f"{n} string" for n in names), {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    return found.select("row_id", cells.alias("cells")).select("row_id", *(F.coalesce(F.col("cells")[n], F.lit("")).alias(n) for n in names))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, row_id: str | None = None) -> DataFrame:
    """Chosen columns of a Parquet table as text, and a row id (a column, or one given at the scan)."""
    table = spark.read.parquet(path)
    key = F.col(row_id).cast("long") if row_id else F.monotonically_increasing_id()
    return table.select(key.alias("row_id"), *(F.col(c).cast("string").alias(c) for c in columns or table.columns if c != row_id))
