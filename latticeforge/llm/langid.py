"""Operator 3: language identification.

Character 1- to 3-grams of case-folded letters, hashed to DIMENSIONS features; the value of a feature is its
relative frequency times its inverse document frequency; a sparse multinomial logistic regression
is trained by FTRL with elastic-net penalties and calibrated by temperature.  Inverse document
frequencies count every training document, and the classes are all languages that any of them has; the
weights are fitted on at most `train_rows` of them, drawn by a hash so that rare languages are not lost: all languages
have the same quota, and one with fewer documents gives all it has.

Defined results: `und` with score 1 for null text or text without letters; a null lang is never
learned; a null doc_id counts as the empty text in the split; of equal probabilities the first
language in text order wins; repeated rows are scored alike; a very long text is a chunk of its own; extra columns
are ignored; without any training row everything is `und` with score 0.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _session
from ._kernels import list_column, segment_sums, text_chunks
from .linear import LinearModel, SparseRows, fit, softmax

BITS = 16
DIMENSIONS = 1 << BITS
#: Documents that the weights are fitted on at most.
TRAIN_ROWS = 2500
#: Brings relative frequencies to the range in which the trainer's step sizes are right.
SCALE = 20.0
UNDETERMINED = "und"
_MIX = tuple(np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _fold_table() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the basic plane: its folded form (a space unless letter or mark); whether it is a letter."""
    fold, letter = np.full(1 << 16, 32, np.uint64), np.zeros(1 << 16, bool)
    for c in range(1 << 16):
        kind = unicodedata.category(chr(c))[0]
        letter[c] = kind == "L"
        if kind in "LM":
            fold[c] = ord(chr(c).lower()[0])
    return fold, letter


_tables: list[np.ndarray] = []


def ngrams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all n-grams in document order, offsets of documents in them, whether a document has letters)."""
    if not _tables:
        _tables.extend(_fold_table())
    fold, letter = _tables
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    ends = segment_sums((raw & 0xC0) != 0x80, off).cumsum()
    off_c = np.concatenate([[0], ends])
    low = np.minimum(points, 0xFFFF)
    folded, is_letter = fold[low], letter[low]
    if (high := points > 0xFFFF).any():
        seen, place = np.unique(points[high], return_inverse=True)
        is_letter[high] = np.asarray([unicodedata.category(chr(c))[0] == "L" for c in seen.tolist()])[place]
        folded[high] = np.where(is_letter[high], points[high], 32)
    n = len(folded)
    doc_end = np.repeat(off_c[1:], np.diff(off_c))
    padded = np.concatenate([folded, np.full(2, 32, np.uint64)])
    grams = np.empty((n, 3), np.int64)
    valid = np.empty((n, 3), bool)
    with np.errstate(over="ignore"):
        h, blank = np.zeros(n, np.uint64), np.ones(n, bool)
        for k in range(3):
            h = (h ^ padded[k : k + n]) * _MIX[k]
            h ^= h >> np.uint64(29)
            blank &= padded[k : k + n] == 32
            grams[:, k] = (h * _MIX[0]) >> np.uint64(64 - BITS)
            valid[:, k] = ~blank & (np.arange(n) + k < doc_end)
    flat = grams.ravel()[valid.ravel()]
    sizes = segment_sums(valid.sum(axis=1), off_c)
    return flat, np.concatenate([[0], np.cumsum(sizes)]), segment_sums(is_letter, off_c) > 0


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a partition: its documents, and in how many of them each feature occurs."""
    total, docs = np.zeros(DIMENSIONS, np.int64), 0
    for batch, raw, off in text_chunks(batches):
        features, at, _ = ngrams(raw, off)
        docs += batch.num_rows
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            seen = np.zeros(DIMENSIONS, bool)
            seen[features[a:b]] = True
            total += seen
    yield pa.record_batch([pa.array([docs], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["docs", "counts"])


def _sum_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for n, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            docs += n
            total += np.frombuffer(counts, np.int64)
    yield pa.record_batch([pa.array([docs], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["docs", "counts"])


def inverse_document_frequencies(training: DataFrame) -> np.ndarray:
    """log((1 + documents) / (1 + documents with the feature)) over all rows.

    A task gives one vector of fixed size; about the square root of that many reach the driver.
    """
    parts = training.select("text").mapInArrow(_document_frequencies, "docs long, counts binary")
    width = max(1, int(parts.rdd.getNumPartitions() ** 0.5))
    docs, total = 0, np.zeros(DIMENSIONS, np.int64)
    for row in parts.repartition(width).mapInArrow(_sum_frequencies, "docs long, counts binary").toLocalIterator():
        docs += row.docs
        total += np.frombuffer(row.counts, np.int64)
    return np.log((1 + docs) / (1 + total)).astype(np.float32)


def _training_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, raw, off in text_chunks(batches):
        features, at, letters = ngrams(raw, off)
        index, value = [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            f, n = np.unique(features[a:b], return_counts=True)
            index.append(f.astype(np.int32))
            value.append((n / max(1, b - a)).astype(np.float32))
        size = np.concatenate([[0], np.cumsum([len(f) for f in index])])
        out = pa.record_batch([batch.column(0), batch.column(1), list_column(np.concatenate(index), size), list_column(np.concatenate(value), size)], names=["doc_id", "lang", "features", "shares"])
        yield out.filter(pa.array(letters))


def _crc_group(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3


def sample_by_language(training: DataFrame, rows: int) -> DataFrame:
    """At most `rows` of (doc_id, lang, text), the same ones whatever the partitioning.

    A first pass counts each language, so a hash of the row keeps about its quota; a tenth of the rows is room
    for chance, and beyond the bound those of least hash for their language stay.
    """
    counts = {r.lang: r.k for r in training.groupBy("lang").agg(F.count("*").alias("k")).collect()}  # one row a language
    quota, left, room = 0, sorted(counts.values()), rows * 9 // 10
    for k, n in enumerate(left):  # the largest quota that all languages together stay within
        quota = max(1, room // (len(left) - k))
        if n >= quota:
            break
        room -= n
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, quota / n)).otherwise(share)
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / float(1 << 53)
    kept = training.where(chance < share).select("doc_id", "lang", "text", F.when(share >= 1.0, 0.0).otherwise(chance / share).alias("rank"))
    return kept.orderBy("rank", "doc_id").limit(rows).drop("rank")


class LanguageModel:
    """Trained weights with the idf folded in: what prediction ships to the workers."""

    def __init__(self, classes: list[str], idf: np.ndarray, model: LinearModel | None) -> None:
        self.classes, self.model = classes, model
        self.table = None if model is None else (model.weights * idf * SCALE).astype(np.float32)

    def predict(self, raw: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
        features, at, letters = ngrams(raw, off)
        if self.model is None:
            return [UNDETERMINED] * len(letters), np.where(letters, 0.0, 1.0)
        n = np.maximum(np.diff(at), 1)
        logits = np.empty((len(n), len(self.classes)))
        for c, weights in enumerate(self.table):
            run = np.concatenate([[0.0], np.cumsum(weights[features], dtype=np.float64)])
            logits[:, c] = (run[at[1:]] - run[at[:-1]]) / n + self.model.bias[c]
        p = softmax(np.round(logits, 6) / self.model.temperature)
        best = p.argmax(axis=1)
        names = np.asarray(self.classes, object)[best]
        names[~letters] = UNDETERMINED
        return names.tolist(), np.where(letters, p[np.arange(len(n)), best], 1.0)


def train_language_model(docs: DataFrame, *, train_rows: int = TRAIN_ROWS) -> LanguageModel:
    """Learns from text and lang of `docs` (doc_id, text, lang); rows without either are left out."""
    _session.tune(docs.sparkSession)
    training = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    idf = inverse_document_frequencies(training)
    sample = sample_by_language(training.select("doc_id", F.col("lang").cast("string").alias("lang"), "text"), train_rows)
    table = sample.mapInArrow(_training_features, "doc_id long, lang string, features array<int>, shares array<float>").toArrow()
    table = table.sort_by([("doc_id", "ascending"), ("lang", "ascending")]).combine_chunks()
    classes = sorted(set(table["lang"].to_pylist()))
    if len(classes) < 2:
        return LanguageModel(classes, idf, LinearModel(np.zeros((1, DIMENSIONS), np.float32), np.zeros(1)) if classes else None)
    features, shares = table["features"].combine_chunks(), table["shares"].combine_chunks()
    index = features.flatten().to_numpy()
    off = np.concatenate([[0], np.cumsum(features.value_lengths().to_numpy())]).astype(np.int64)
    rows = SparseRows(index, shares.flatten().to_numpy() * idf[index] * SCALE, off)
    place = {name: i for i, name in enumerate(classes)}
    labels = np.asarray([place[x] for x in table["lang"].to_pylist()])
    return LanguageModel(classes, idf, fit(rows, labels, len(classes), DIMENSIONS))


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: classes x DIMENSIONS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, off in text_chunks(batches):
            names, score = shared.value.predict(raw, off)
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    _session.tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = _session.documents(spark, sf_dir)
    model = train_language_model(docs.where(_crc_group() != 1).select("doc_id", "text", "lang"))
    return predict_language(docs, model).select("doc_id", (_crc_group() == 1).alias("held_out"), "lang_pred", "score")
