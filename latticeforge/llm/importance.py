"""Operator 11: importance resampling towards a target distribution, over hashed word runs.

The corpus becomes a sparse matrix of documents by buckets, persisted as CSR blocks (a Parquet row holds some megabytes of
documents):

    part int, block int           place of the block
    doc_ids array<long>, n_words array<long>
    indptr, indices, data binary  the rows' bounds, buckets and counts (little-endian int64, uint32, uint32)

Column sums of the corpus's and of the target's blocks give both distributions; the gain of a bucket compares them; the
product of the matrix with the gains, divided by the features of each row, gives the weights.  Sums and gains are
one number a bucket, so `buckets` bounds what leaves the tasks, whatever the corpus holds.

Scores add Gumbel noise from a hash of the id, so the highest scores are a weighted sample without replacement.  The cut is
read from the counts of rows a score (scores are integers in a narrow range); only rows from the cut on are sorted, by
ranges of the whole order, and numbered from the sums over ranges.

Defined results: null and empty text, and text without words, has no features and weight 0 (its row is returned, and is never
drawn if `min_words` is positive); null doc_id hashes like an empty one and sorts first; ties in score go to the smaller
doc_id, then to the earlier place in the table, so repeated rows are rows of their own; very long texts are chunks
of their own; a column of a bucket that nothing fills counts 0; an empty corpus gives no rows; an empty target leaves T and all t 0;
further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from . import _session
from ._kernels import LOWER_ASCII, ragged_index, segment_sums, text_chunks

BUCKETS, MAX_RUN, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Rows that one range of the ranking holds on average.
RANGE_ROWS = 500_000
BLOCKS = "part int, block int, doc_ids array<long>, n_words array<long>, indptr binary, indices binary, data binary"
ROWS = "part int, block int, row int, doc_id long, n_words long, n_features long, weight long"

#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` in lower-cased UTF-8 (fixed values of the word definition).
IS_WORD = np.ones(256, bool)
for _first, _last in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    IS_WORD[_first : _last + 1] = False


def _words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(number of the distinct word of each word, the distinct words, words before each document)."""
    low = LOWER_ASCII[raw]
    word = IS_WORD[low]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edge = off[:-1][np.diff(off) > 0]
    begins[edge] = word[edge]
    starts = np.flatnonzero(begins)
    kept = np.concatenate([[0], np.cumsum(word)])
    bounds = np.append(kept[starts], kept[-1])
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(low[word])])
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist(), np.searchsorted(starts, off)


def _hashes(raw: np.ndarray, off: np.ndarray, max_run: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each run length the crc32 of every run, and the runs before each document."""
    code, distinct, at = _words(raw, off)
    first = np.fromiter((zlib.crc32(w) for w in distinct), np.int64, len(distinct))[code] if len(code) else np.zeros(0, np.int64)
    count, run = np.diff(at), first
    yield run, at
    for size in range(2, max_run + 1):
        # A run's hash goes on from that of its beginning; only distinct (beginning, next word) pairs are hashed.
        own = np.maximum(count - size + 1, 0)
        starts = ragged_index(np.cumsum(np.maximum(count - size + 2, 0)) - np.maximum(count - size + 2, 0), own)
        following = ragged_index(at[:-1] + size - 1, own)
        pair, place = np.unique(run[starts] << 31 | code[following], return_inverse=True)
        mask = (1 << 31) - 1
        run = np.fromiter((zlib.crc32(b" " + distinct[p & mask], p >> 31) for p in pair.tolist()), np.int64, len(pair))[place] if len(pair) else np.zeros(0, np.int64)
        yield run, np.concatenate([[0], np.cumsum(own)])


def csr_block(raw: np.ndarray, off: np.ndarray, buckets: int, max_run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n_words, indptr, indices, data) of a chunk of documents."""
    keys, n_words = [], None
    for hashes, at in _hashes(raw, off, max_run):
        n_words = np.diff(at) if n_words is None else n_words
        keys.append(np.repeat(np.arange(len(off) - 1), np.diff(at)) << 32 | hashes % buckets)
    cell, times = np.unique(np.concatenate(keys), return_counts=True)
    indptr = np.searchsorted(cell, np.arange(len(off)) << 32)
    return n_words, indptr, (cell & 0xFFFFFFFF).astype("<u4"), times.astype("<u4")


def count_matrix(docs: DataFrame, *, buckets: int = BUCKETS, max_run: int = MAX_RUN) -> DataFrame:
    """The CSR blocks of `docs` (doc_id, text), persisted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, (batch, raw, off) in enumerate(text_chunks(batches)):
            n_words, indptr, indices, data = csr_block(raw, off, buckets, max_run)
            whole = pa.array([0, batch.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(whole, x) for x in (batch.column(0), pa.array(n_words))]
            cells = [pa.array([x.tobytes()], pa.binary()) for x in (indptr.astype("<i8"), indices, data)]
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([number], pa.int32()), *lists, *cells], names=["part", "block", "doc_ids", "n_words", "indptr", "indices", "data"])

    _session.tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _session.stored(rows.mapInArrow(run, BLOCKS), "csr-blocks")


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of every bucket that the matrix fills; a task sends at most one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for indices, data in zip(batch.column(0), batch.column(1)):
                np.add.at(total, np.frombuffer(indices.as_buffer(), "<u4"), np.frombuffer(data.as_buffer(), "<u4"))
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return blocks.select("indices", "data").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, from the column sums of both matrices: thousandths of the log ratio of smoothed shares."""
    spark = source.sparkSession
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    double = lambda c: c.cast("double")
    sums = W.partitionBy(F.lit(0))  # `buckets` rows
    ratio = (double(F.col("t")) + 1) * (double(F.sum("s").over(sums)) + buckets) / ((double(F.col("s")) + 1) * (double(F.sum("t").over(sums)) + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weights(blocks: DataFrame, gain: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(part, block, row, doc_id, n_words, n_features, weight): the matrix times the gains, by features of the row, rounded down."""
    vector = np.zeros(buckets, np.int64)
    for row in gain.collect():  # `buckets` rows
        vector[row.bucket] = row.gain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, n_words = batch.column(2)[k].values, batch.column(3)[k].values
                indptr, indices, data = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in ((4, "<i8"), (5, "<u4"), (6, "<u4")))
                times = data.astype(np.int64)
                n = segment_sums(times, indptr)
                weight = segment_sums(times * vector[indices], indptr) // np.maximum(n, 1)
                size = len(doc_ids)
                place = [pa.array(np.full(size, batch.column(c)[k].as_py(), np.int32)) for c in (0, 1)]
                yield pa.record_batch([*place, pa.array(np.arange(size, dtype=np.int32)), doc_ids, n_words, pa.array(n), pa.array(weight)], names=[f.split()[0] for f in ROWS.split(", ")])

    return blocks.mapInArrow(run, ROWS)


def with_noise(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds score: the weight and Gumbel noise in thousandths, both decided by content alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")
    return rows.withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame, eligible, percent: int = PERCENT) -> DataFrame:
    """Adds rank to a stored table: the place among the highest `percent` of the eligible rows, null for all others."""
    spark = rows.sparkSession
    histogram = rows.where(eligible).groupBy("score").agg(F.count("*").alias("n"))  # scores lie within some 200 000 integers
    drawn = F.floor(F.sum("n").over(W.partitionBy(F.lit(0))) * percent / 100)
    above = F.sum("n").over(W.partitionBy(F.lit(0)).orderBy(F.desc("score"))) - F.col("n")
    top = histogram.select("score", "n", drawn.alias("drawn"), above.alias("above")).where("above < drawn")
    cut, drawn, held = top.agg(F.min("score"), F.max("drawn"), F.sum("n")).head()
    if not drawn:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    high = eligible & (F.col("score") >= cut)
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("part"), F.asc("block"), F.asc("row")]  # no two rows are alike
    ranges = rows.where(high).repartitionByRange(max(1, -(-held // RANGE_ROWS)), *order).withColumn("range", F.spark_partition_id())
    ranges = _session.stored(ranges, "ranked")
    sizes = ranges.groupBy("range").agg(F.count("*").alias("n"))  # a row for each range
    bases = sizes.select("range", (F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("range")) - F.col("n")).alias("base"))
    place = F.row_number().over(W.partitionBy("range").orderBy(*order)) + F.col("base")
    numbered = ranges.join(bases, "range").withColumn("rank", place)
    numbered = numbered.withColumn("rank", F.when(F.col("rank") <= F.lit(drawn), F.col("rank")).cast("long"))
    rest = rows.where(~high).withColumn("rank", F.lit(None).cast("long"))
    return numbered.select(rest.columns).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, *, buckets: int = BUCKETS, max_run: int = MAX_RUN, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of `docs`; rank tells the rows drawn towards the texts of `target`.

    docs: (doc_id, text); target: (item_id, text).
    """
    source = count_matrix(docs, buckets=buckets, max_run=max_run)
    wanted = count_matrix(target.withColumn("doc_id", F.lit(None).cast("long")), buckets=buckets, max_run=max_run)
    gain = gains(column_sums(source, buckets), column_sums(wanted, buckets), buckets)
    scored = _session.stored(with_noise(weights(source, gain, buckets), seed), "scored")
    return ranked(scored, F.col("n_words") >= min_words, percent).select("doc_id", "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_session.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"""
    SELECT {id}, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM {table}
"""
#: crc32, a byte at a time, eight halvings a byte.
_HALF = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_CRC = f"""
    xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(0, length(hex(encode(w))) // 2), lambda i: ('0x' || substr(hex(encode(w)), 2 * i::BIGINT + 1, 2))::BIGINT)),
        lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), range(0, 8)), lambda c, i: {_HALF})))
"""

ORACLE = f"""
WITH own AS ({_WORDS.format(id="doc_id", table="documents")}), wanted AS ({_WORDS.format(id="item_id", table="benchmark")}),
coded AS MATERIALIZED (SELECT w, {_CRC} % {BUCKETS} AS bucket FROM (SELECT w FROM own UNION SELECT w FROM wanted)),
s AS (SELECT bucket, count(*) AS s FROM own JOIN coded USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM wanted JOIN coded USING (w) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM own)::DOUBLE AS all_s, (SELECT count(*) FROM wanted)::DOUBLE AS all_t),
gain AS (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (all_s + {BUCKETS}) / ((s::DOUBLE + 1) * (all_t + {BUCKETS}))))::BIGINT AS gain
    FROM s LEFT JOIN t USING (bucket), sums),
summed AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS gain FROM own JOIN coded USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
weighed AS (
    SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (summed.gain - (summed.gain % n + n) % n) // n END::BIGINT AS weight,
        ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT AS h
    FROM documents LEFT JOIN summed USING (doc_id)),
scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * {PERCENT} // 100 AS drawn FROM scored WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""
