"""Operator 1: token ids of a corpus as Simple-8b coded blocks.

File format: a Parquet table of self-contained blocks in ascending document order,

    part int          range of documents the block belongs to, ascending
    block int         number of the block in its part
    first long        ids of the part before the block
    doc_ids array<long>, lengths binary (a Simple-8b block: ids of each document)
    offsets array<int>, words binary (the documents' ids: Simple-8b blocks of at most BLOCK_IDS ids,
                      with the byte offset of each, so that any of them decodes alone)

Parquet carries the blocks because Spark's committer makes a lost executor's rewrite harmless and
works on any store; the ids themselves are only in the Simple-8b words.  Documents are range
partitioned by doc_id, so a part is a contiguous range and the global position of an id is a sum
over part totals, one row a part.

Defined results: null text counts as empty (just the end id); null doc_id sorts first; rows that
share a doc_id stay rows of their own in order of their texts; a very long text is a chunk of its own, in as many words as it
needs; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from . import _session, simple8b
from ._kernels import list_column, text_chunks
from .wordwise import TOKENIZE_BYTES, default_vocabulary, word_tokenizer

#: Ids of one Simple-8b block.
BLOCK_IDS = 32_768
SCHEMA = "part int, block int, first long, n_ids long, doc_ids array<long>, lengths binary, offsets array<int>, words binary"


def encode_blocks(vocabulary: str, end_id: int, block_ids: int = BLOCK_IDS):
    """A mapInArrow function from sorted (doc_id, text) rows to the blocks of the file format."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, first = word_tokenizer(vocabulary), TaskContext.get().partitionId(), 0
        for number, (batch, raw, off) in enumerate(text_chunks(batches, size=TOKENIZE_BYTES)):
            ids, at = tokenizer.ids(raw, off)
            n = np.diff(at) + 1
            full = np.full(int(n.sum()), end_id, np.uint32)
            keep = np.ones(len(full), bool)
            keep[np.cumsum(n) - 1] = False
            full[keep] = ids
            coded = [simple8b.encode(full[i : i + block_ids]) for i in range(0, len(full), block_ids)]
            starts = np.cumsum([0] + [len(c) for c in coded][:-1]).astype(np.int32)
            yield pa.record_batch(
                [
                    pa.array([part], pa.int32()),
                    pa.array([number], pa.int32()),
                    pa.array([first], pa.int64()),
                    pa.array([len(full)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0).cast(pa.int64())),
                    pa.array([simple8b.encode(n.astype(np.uint64))], pa.binary()),
                    list_column(starts, np.asarray([0, len(starts)])),
                    pa.array([b"".join(coded)], pa.binary()),
                ],
                names=["part", "block", "first", "n_ids", "doc_ids", "lengths", "offsets", "words"],
            )
            first += len(full)

    return run


def write_token_blocks(docs: DataFrame, path: str, *, vocabulary: str | None = None, end_id: int = 1, partitions: int | None = None) -> None:
    """Tokenises `docs` (doc_id, text; other columns are ignored) into the file format at `path`."""
    spark = docs.sparkSession
    _session.tune(spark)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(encode_blocks(vocabulary or default_vocabulary(), end_id), SCHEMA).write.option("compression", "none").parquet(path)


def decode_document_ids(lengths: bytes, offsets: list[int], words: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a block row, and the offsets of its documents in them."""
    ids = [simple8b.decode(words[a:b]) for a, b in zip(offsets, [*offsets[1:], len(words)])]
    sizes = simple8b.decode(lengths).astype(np.int64)
    return np.concatenate(ids) if ids else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        for part, first, docs, lengths, offsets, words in zip(rows["part"], rows["first"], rows["doc_ids"], rows["lengths"], rows["offsets"], rows["words"]):
            ids, at = decode_document_ids(lengths, offsets, words)
            flat = ids.astype("<u4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.record_batch(
                [pa.array([part] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(at[:-1] + first), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                names=["part", "doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_summaries(docs_path: str, spark) -> DataFrame:
    """Reads the files back: (doc_id, start, n_tokens, ids_crc32) of each document."""
    blocks = spark.read.schema(SCHEMA).parquet(docs_path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each part
    bases = totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    rows = blocks.select("part", "first", "doc_ids", "lengths", "offsets", "words").mapInArrow(_summaries, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(bases, "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_output(spark, sf_dir: str) -> DataFrame:
    path = _session.scratch_path(spark, "token-blocks")
    write_token_blocks(_session.documents(spark, sf_dir), path)
    return read_token_summaries(path, spark)
