"""Operator 4: quality rules and a calibrated n-gram classifier.

Base counts come from exact kernels over whole texts.  The verdict comes from a logistic regression
over hashed word 1- and 2-grams and byte 3- and 5-grams, trained by FTRL on at most `train_rows` labelled
rows, calibrated by temperature and compared with a fixed threshold.

Defined results: null and empty text has zero words and fails the base rule; labels without a
quality, or that contradict each other for a document, are not learned; without labelled rows of
both classes the base rule alone decides; repeated rows are scored alike; a null doc_id has no labels and is scored like any
other; a probability that equals the threshold is kept; a very long text is a chunk of its own and is scored whole; an empty table
gives no rows; further columns are ignored (`keep_good` keeps them, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _session
from ._kernels import IS_SPACE, list_column, mix64, prefix_hash, segment_sums, span_hash, text_chunks, word_bounds
from .linear import LinearModel, SparseRows, fit, softmax

BITS = 18
DIMENSIONS = 1 << BITS
#: Labelled documents that the classifier is fitted on at most.
TRAIN_ROWS = 3000
#: A document whose probability of being good is lower is rejected.
THRESHOLD = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SCALE = 20.0
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_K = tuple(np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its number of occurrences, and for all but one of equal keys True."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    count = np.diff(np.append(np.flatnonzero(new), len(keys)))
    times, earlier = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
    times[order] = np.repeat(count, count)
    earlier[order] = ~new
    return times, earlier


class ChunkStatistics:
    """Word structure of a chunk of documents, shared by the counts and the features."""

    def __init__(self, raw: np.ndarray, off: np.ndarray) -> None:
        self.raw, self.off = raw, off
        self.prefix = prefix_hash(raw)
        self.starts, self.ends, self.first = word_bounds(raw, off)
        self.words = span_hash(self.prefix, self.starts, self.ends)
        self.n_words = np.diff(self.first)
        self.doc_of_word = np.repeat(np.arange(len(off) - 1), self.n_words)

    def base(self) -> dict[str, np.ndarray]:
        raw, off, docs = self.raw, self.off, len(self.off) - 1
        in_word = ~IS_SPACE[raw]
        out = {"n_words": self.n_words, "word_chars": segment_sums(in_word & ((raw & 0xC0) != 0x80), off), "n_symbols": segment_sums(SYMBOLS[raw], off)}
        # Lines: each document's first byte and each byte after a line feed start one; pair starts with ends.
        breaks = np.flatnonzero(raw == 10)
        own = np.concatenate([np.arange(docs), np.searchsorted(off, breaks, "right") - 1])
        line_start = np.concatenate([off[:-1], breaks + 1])
        line_end = np.concatenate([off[1:], breaks])
        first, last = np.lexsort((line_start, own)), np.lexsort((line_end, own))
        line_doc, line_start, line_end = own[first], line_start[first], line_end[last]
        has_word = np.searchsorted(self.starts, line_end) > np.searchsorted(self.starts, line_start)
        line_doc, line_start, line_end = line_doc[has_word], line_start[has_word], line_end[has_word]
        keys = span_hash(self.prefix, line_start, line_end) ^ mix64(line_doc.astype(np.uint64) + _K[0])
        out["n_dup_lines"] = np.bincount(line_doc[_repeats(keys)[1]], minlength=docs)
        # Windows of three words inside one document.
        w, doc = self.words, self.doc_of_word
        at = np.flatnonzero(doc[2:] == doc[:-2]) if len(w) > 2 else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            keys = mix64(w[at] * _K[0] + w[at + 1] * _K[1] + w[at + 2] * _K[2]) ^ mix64(doc[at].astype(np.uint64) + _K[0])
        again = at[_repeats(keys)[0] > 1]
        covered = np.zeros(len(w), bool)
        for k in range(3):
            covered[again + k] = True
        out["n_repeat_words"] = np.bincount(doc[covered], minlength=docs)
        return out

    def features(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(features, offsets by document) of each family; a family's shares sum to 1 in a document."""
        w, doc, top = self.words, self.doc_of_word, np.uint64(64 - BITS)
        pair = np.flatnonzero(doc[1:] == doc[:-1])
        with np.errstate(over="ignore"):
            families = [((mix64(w + _K[0]) >> top).astype(np.int64), self.first), ((mix64(w[pair] * _K[1] + w[pair + 1] * _K[2]) >> top).astype(np.int64), np.searchsorted(pair, self.first))]
            for size, k in ((3, _K[1]), (5, _K[2])):
                n = len(self.raw) - size + 1
                if n <= 0:
                    families.append((np.zeros(0, np.int64), np.zeros(len(self.off), np.int64)))
                    continue
                h = np.zeros(n, np.uint64)
                for j in range(size):
                    h = (h + self.raw[j : j + n]) * k
                inside = np.ones(n, bool)
                for cut in self.off[1:-1].tolist():
                    inside[max(0, cut - size + 1) : min(cut, n)] = False
                at = np.flatnonzero(inside)
                families.append(((mix64(h[at]) >> top).astype(np.int64), np.searchsorted(at, self.off)))
        return families


def _training_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, raw, off in text_chunks(batches):
        families = ChunkStatistics(raw, off).features()
        index, value = [], []
        for d in range(batch.num_rows):
            parts = [f[a[d] : a[d + 1]] for f, a in families]
            flat = np.concatenate(parts)
            share = np.concatenate([np.full(len(p), 1 / max(1, len(p))) for p in parts])
            seen, place = np.unique(flat, return_inverse=True)
            index.append(seen.astype(np.int32))
            value.append(np.bincount(place, share, len(seen)).astype(np.float32))
        size = np.concatenate([[0], np.cumsum([len(f) for f in index])])
        yield pa.record_batch([batch.column(0), batch.column(1), list_column(np.concatenate(index), size), list_column(np.concatenate(value), size)], names=["doc_id", "quality", "features", "shares"])


def train_quality_model(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS) -> LinearModel | None:
    """Classes 0 (bad) and 1 (good) of `labels` (doc_id, quality) for `docs` (doc_id, text)."""
    _session.tune(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("most"))
    known = known.where((F.col("quality") == F.col("most")) & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    sample = known.orderBy(F.xxhash64("doc_id")).limit(train_rows)  # so at most train_rows ids are broadcast
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")
    table = rows.mapInArrow(_training_features, "doc_id long, quality int, features array<int>, shares array<float>").toArrow()
    table = table.sort_by([("doc_id", "ascending")]).combine_chunks()
    answer = np.asarray(table["quality"].to_pylist(), np.int64)
    if len(np.unique(answer)) < 2:
        return None
    features = table["features"].combine_chunks()
    off = np.concatenate([[0], np.cumsum(features.value_lengths().to_numpy())]).astype(np.int64)
    matrix = SparseRows(features.flatten().to_numpy(), table["shares"].combine_chunks().flatten().to_numpy() * np.float32(SCALE), off)
    del table, features
    return fit(matrix, answer, 2, DIMENSIONS)


def good_probability(model: LinearModel, chunk: ChunkStatistics) -> np.ndarray:
    logits = np.zeros((len(chunk.n_words), 2)) + model.bias
    margin = (model.weights[1] - model.weights[0]) * np.float32(SCALE)
    for features, at in chunk.features():
        run = np.concatenate([[0.0], np.cumsum(margin[features], dtype=np.float64)])
        logits[:, 1] += (run[at[1:]] - run[at[:-1]]) / np.maximum(np.diff(at), 1)
    return softmax(np.round(logits, 6) / model.temperature)[:, 1]


def _verdicts(chunk: ChunkStatistics, model: LinearModel | None, threshold: float) -> dict[str, np.ndarray]:
    base = chunk.base()
    failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
    good = np.ones(len(failed)) if model is None else good_probability(model, chunk)
    return {name: base[name].astype(np.int64) for name in BASE} | {"base_failed": failed, "p_good": good, "kept": ~failed & (good >= threshold)}


def score_quality(docs: DataFrame, model: LinearModel | None, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, p_good and kept, for every row of `docs` (doc_id, text)."""
    _session.tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2 x DIMENSIONS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, off in text_chunks(batches):
            found = _verdicts(ChunkStatistics(raw, off), shared.value, threshold)
            yield pa.record_batch({"doc_id": batch.column(0)} | {name: pa.array(x) for name, x in found.items()})

    schema = "doc_id long, " + ", ".join(f"{name} long" for name in BASE) + ", base_failed boolean, p_good double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: LinearModel | None, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose verdict is to keep them, with all their columns."""
    _session.tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, off in text_chunks(batches):
            yield batch.filter(pa.array(_verdicts(ChunkStatistics(raw, off), shared.value, threshold)["kept"]))

    return docs.mapInArrow(run, docs.schema)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = _session.documents(spark, sf_dir)
    return score_quality(docs, train_quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
