"""Operator 12: documents dealt to shards of near-equal bytes by sampled splitters; DataFrame functions only.

The key of a document is a hash of its text, so equal texts share a key.  Keys are drawn with probability in proportion to
size; quantiles of the sample cut the keys into RANGES ranges of about equal bytes, and a key that fills a range of its own
gets one.  Exact sizes of all ranges are counted; ranges that came out overfull are sampled and cut again, until what is
overfull holds one key.  Ranges then go to shards, largest first, each to the shard with the fewest bytes.  A range of one key goes whole
as well (copies of a text share a shard) unless it exceeds a shard's share: then it is subdivided by row into pieces that are dealt alone.

Slots number a shard's rows by ranges: the rows before a range are a sum over ranges, and a range of too many rows (a common short
text) is numbered in pieces, so no task sorts a shard.  Samples, cuts and ranges are bounded by parameters; sample
and pieces are decided by hashes of stored rows, so a task that runs again decides alike.

Law: `bytes`.  A shard exceeds the mean by at most the largest range or single document it got; what a shard lacks is less than the last
one dealt.  Defined results: null text counts as empty (size 1, crc32 0) and shares its key; null doc_ids, repeated rows and shared
doc_ids are rows of their own (in a range ordered by key, doc_id with null first, and place in the table); a text longer than a share fills its shard alone
as far as sizes allow; with fewer rows than shards some shards stay empty; an empty table gives no rows; further columns are ignored by
`assign` and kept by `write_shards`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

from . import _session

SHARDS = 8
#: Ranges that the keys are cut into, and expected sampled keys of each.
RANGES, SAMPLES_EACH = 1024, 16
#: A range with several keys is cut again beyond so many times its due bytes.
OVERFULL = 3
#: Pieces into which a share's bytes of one text are subdivided.
PIECES_A_SHARE = 16
#: Rows that one task numbers, at most; with fewer rows in all, so many as OVERFULL ranges hold on average.
RANGE_ROWS = 500_000
#: Cells by the leading bits of a key, each with the few cuts inside it.
CELL_BITS = 10


def _all() -> WindowSpec:
    """One window over a whole table, for tables that parameters bound."""
    return W.partitionBy(F.lit(0))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key, place) of every row, stored."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("place"))
    return _session.stored(rows, "sizes")


def sampled_cuts(rows: DataFrame, total: int, ranges: int, seed: int) -> DataFrame:
    """(cut): keys after which a range ends, at size-weighted quantiles of `rows`; a heavy key has one on either side."""
    draws = ranges * SAMPLES_EACH
    chance = F.xxhash64("key", "place", F.lit(seed)).bitwiseAND((1 << 31) - 1) / float(1 << 31)
    drawn = rows.where(chance < F.col("size") * float(draws) / total).select("key", F.greatest(F.col("size").cast("double"), F.lit(total / draws)).alias("weight"))
    keys = drawn.groupBy("key").agg(F.sum("weight").alias("weight"))  # about `draws` rows at most twice
    upto, whole = F.sum("weight").over(_all().orderBy("key")), F.sum("weight").over(_all())
    keys = keys.select("key", (F.col("weight") * ranges / whole).alias("width"), (upto * ranges / whole).alias("upto"))
    heavy = F.col("width") >= 1
    ends = F.floor("upto") > F.floor(F.col("upto") - F.col("width"))
    return keys.where(heavy | ends).select(F.explode(F.when(heavy, F.array(F.col("key") - 1, F.col("key"))).otherwise(F.array("key"))).alias("cut")).distinct()


def _cell(key: Column) -> Column:
    return F.shiftright(key, 64 - CELL_BITS)


def in_ranges(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds range: how many cuts lie below the key.  The cuts are few; a row looks only at those in its key's cell."""
    half = 1 << (CELL_BITS - 1)
    cells = rows.sparkSession.range(-half, half).withColumnRenamed("id", "cell")
    held = cuts.groupBy(_cell(F.col("cut")).alias("cell")).agg(F.collect_list("cut").alias("cuts"))
    cells = cells.join(held, "cell", "left").select("cell", F.coalesce("cuts", F.array().cast("array<bigint>")).alias("cuts"))
    cells = cells.withColumn("before", F.sum(F.size("cuts")).over(_all().orderBy("cell")) - F.size("cuts"))
    placed = rows.withColumn("cell", _cell(F.col("key"))).join(F.broadcast(cells), "cell")  # 2 ** CELL_BITS rows
    return placed.withColumn("range", F.col("before") + F.size(F.filter("cuts", lambda c: c < F.col("key")))).drop("cell", "cuts", "before")


def split_ranges(rows: DataFrame, total: int, ranges: int = RANGES) -> tuple[DataFrame, DataFrame]:
    """(rows with their range, sizes of all ranges: range, bytes, n, one_key), no range of several keys overfull."""
    due = max(1, total // ranges)
    cuts, seed = _session.stored(sampled_cuts(rows, total, ranges, 0), "cuts"), 0
    while True:
        placed = in_ranges(rows, cuts)
        sizes = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), (F.min("key") == F.max("key")).alias("one_key"))
        sizes = _session.stored(sizes, "ranges")
        over = sizes.where(~F.col("one_key") & (F.col("bytes") > OVERFULL * due)).select("range", "bytes")
        n_over, n_bytes = over.agg(F.count("*"), F.sum("bytes")).head()
        if not n_over:
            return placed, sizes
        seed += 1
        inside = placed.join(F.broadcast(over.select("range")), "range")  # some of the ranges
        cuts = _session.stored(cuts.union(sampled_cuts(inside, n_bytes, max(2, 2 * n_bytes // due), seed)).distinct(), "cuts")


def dealt(atoms: DataFrame, shards: int) -> DataFrame:
    """(range, atom, shard): atoms (range, atom, bytes) largest first, each to the shard that holds the fewest bytes."""
    item = F.struct((-F.col("bytes")).alias("less"), "range", "atom")
    row = atoms.agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("homes"))

    def place(state: Column, x: Column) -> Column:
        home = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        loads = F.transform(state["loads"], lambda load, i: F.when(i == home, load - x["less"]).otherwise(load))
        return F.struct(loads.alias("loads"), F.concat(state["homes"], F.array(home)).alias("homes"))

    homes = F.aggregate("items", start, place, lambda state: state["homes"])
    return row.select(F.explode(F.arrays_zip("items", homes.alias("homes"))).alias("x")).select("x.items.range", "x.items.atom", F.col("x.homes").alias("shard"))


def placed_rows(rows: DataFrame, shards: int, ranges: int, range_rows: int) -> DataFrame:
    """Adds shard and slot to a stored table of `measured` rows."""
    total, n_rows = rows.agg(F.sum("size"), F.count("*")).head()
    if not total:
        return rows.limit(0).select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    placed, sizes = split_ranges(rows, total, ranges)
    range_rows = min(range_rows, 1 + OVERFULL * n_rows // ranges)
    beyond = F.col("one_key") & (F.col("bytes") * shards > total)
    pieces = F.greatest(F.when(beyond, F.ceil(F.col("bytes") * float(shards * PIECES_A_SHARE) / total)).otherwise(1), F.ceil(F.col("n") / range_rows))
    plan = sizes.select("range", beyond.alias("beyond"), pieces.cast("long").alias("pieces"))
    placed = placed.join(F.broadcast(plan), "range")  # a row for each range
    placed = placed.withColumn("piece", F.pmod(F.xxhash64("place"), F.col("pieces"))).withColumn("atom", F.when(F.col("beyond"), F.col("piece")).otherwise(0)).drop("beyond", "pieces")
    parts = _session.stored(placed.groupBy("range", "piece", "atom").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "parts")
    homes = dealt(parts.groupBy("range", "atom").agg(F.sum("bytes").alias("bytes")), shards)
    before = F.sum("n").over(W.partitionBy("shard").orderBy("range", "piece")) - F.col("n")
    parts = parts.join(homes, ["range", "atom"]).select("range", "piece", "shard", before.alias("before"))
    number = F.row_number().over(W.partitionBy("range", "piece").orderBy("key", F.asc_nulls_first("doc_id"), "place"))
    return placed.withColumn("number", number).join(parts, ["range", "piece"]).select(*rows.columns, F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("number") - 1).alias("slot"))


def assign(docs: DataFrame, *, shards: int = SHARDS, ranges: int = RANGES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of `docs` (doc_id, text)."""
    rows = placed_rows(measured(docs), shards, ranges, range_rows)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, *, shards: int = SHARDS, ranges: int = RANGES, range_rows: int = RANGE_ROWS) -> None:
    """Writes whole rows to folders `shard=0`, `shard=1`, ...: columns slot and doc (a struct of the table's own columns).

    `docs` is read twice and must come in the same order both times, as a table does.
    """
    rows = placed_rows(measured(docs), shards, ranges, range_rows).select("place", "shard", "slot")
    whole = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("place")).join(rows, "place")
    whole.select("shard", "slot", "doc").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(_session.documents(spark, sf_dir))
