"""Operator 2: removal of repeated byte strings by a logarithmic family of sparse suffix arrays.

Suffixes are sampled at content-defined anchors (see anchors.py), so equal strings of LENGTH bytes
always have sampled suffixes at equal offsets.  A suffix array orders them by the fingerprint of
their first GRAM bytes and then by that of the longest context in which all windows share the
anchor; what equals in that order stands side by side, which is all that finding matches needs.
An array is kept as sorted packed columns, one row for each hash group of keys.

The index is a family of arrays whose sizes double.  A new batch of documents gets its own array,
is merge-scanned against every level for keys that both hold, and then merges with level 0, 1, ...
like a carry in a binary counter; every suffix is merged a logarithmic number of times.

Keys that any scan saw twice are then resolved.  A class of equal entries (same key and context)
with two members is repeated as a whole.  Where a key has several classes, their windows are
compared one offset block at a time: blocks whose common core is unique drop out, the rest meet by
core and equal windows are found by hash.  Every byte of a repeated window goes.

Repeated passages of a number of words go the same way: a text's symbols are then 64-bit codes of its
words instead of bytes, so white space between words does not count.

Defined results: null text is empty; repeated rows repeat each other's bytes; rows sharing a doc_id
are separate documents; a null doc_id is one like any other; shorter texts than LENGTH lose nothing; a very long text
is a chunk of its own (it needs about 20 times its size in a worker); an empty table gives no rows; further
columns may have any names, they travel in a struct of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _session
from ._kernels import IS_SPACE, mix64, prefix_hash, ragged_index, span_hash, text_buffers, text_chunks, word_bounds
from .anchors import BYTE_GRAM, WORD_GRAM, anchor_runs

LENGTH = 400
#: Words of the shortest passage that must not repeat across documents.
PASSAGE_WORDS = 51
#: Batches that a whole corpus is added in.
BATCHES = 4
#: Bytes of text that one group of keys serves; groups follow the corpus, so the packed columns of one stay small.
GROUP_BYTES = 32 << 20
#: Slices that a worker compares at once; a core with more of them is compared by Spark's own aggregation.
CORE_ROWS = 4096
_K = tuple(np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

#: Columns of an array, packed: key, context, members, and where its first member is
#: (document, hash of its text, first window, windows, anchor's distance from the first window).
FIELDS = {"keys": "<u8", "contexts": "<u8", "members": "<i8", "doc": "<i8", "h": "<i8", "at": "<i8", "windows": "<i4", "reach": "<i4"}
ARRAY = "g int, level int, " + ", ".join(f"{name} binary" for name in FIELDS)
NO_DOC = -(2**63)


def _rows(docs: DataFrame) -> DataFrame:
    """Documents under a key that tells rows apart: doc_id (or NO_DOC) and a hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc"), F.xxhash64(text).alias("h"), text.alias("text"))


@dataclass(frozen=True)
class Unit:
    """What strings are made of: how symbols are read from text, and the sizes that fit them."""

    symbol: str  # numpy type
    gram: int
    block: int  # offsets compared at once when a key has several classes
    read: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _word_codes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_bounds(raw, off)
    return span_hash(prefix_hash(raw), starts, ends), first


BYTES = Unit("u1", BYTE_GRAM, 64, lambda raw, off: (raw, off))
WORDS = Unit("<u8", WORD_GRAM, 8, _word_codes)


def _pack(columns: dict[str, np.ndarray]) -> list[pa.Array]:
    return [pa.array([columns[name].astype(kind).tobytes()], pa.binary()) for name, kind in FIELDS.items()]


def _unpack(table: pa.Table) -> dict[str, np.ndarray]:
    return {name: np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()] or [np.zeros(0, kind)]) for name, kind in FIELDS.items()}


def _sorted_classes(c: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Entries in array order with equal ones joined, and how many entries each came from."""
    order = np.lexsort((c["h"], c["doc"], c["contexts"], c["keys"]))
    c = {name: x[order] for name, x in c.items()}
    n = len(order)
    new = np.ones(n, bool)
    new[1:] = (c["keys"][1:] != c["keys"][:-1]) | (c["contexts"][1:] != c["contexts"][:-1])
    head = np.flatnonzero(new)
    out = {name: x[head] for name, x in c.items()}
    if n:
        out["members"] = np.add.reduceat(c["members"], head)
    return out, np.diff(np.append(head, n))


def _emit(length: int, unit: Unit, groups: int):
    """Packed array pieces of each chunk of documents, by group of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, off in text_chunks(batches):
            symbols, off = unit.read(raw, off)
            r = anchor_runs(symbols, off, length, unit.gram)
            if not len(r.p):
                continue
            own = np.searchsorted(off, r.a, "right") - 1
            entry = {"keys": r.key, "contexts": r.fp, "members": np.ones(len(r.p), np.int64), "doc": batch.column(0).to_numpy()[own], "h": batch.column(1).to_numpy()[own], "at": r.a - off[own], "windows": r.b - r.a + 1, "reach": r.p - r.a}
            entry, _ = _sorted_classes(entry)
            group = ((entry["keys"] >> np.uint64(40)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            cut = np.searchsorted(group[order], np.arange(groups + 1))
            used = np.flatnonzero(np.diff(cut))
            columns = [pa.array(used.astype(np.int32)), pa.array(np.full(len(used), -1, np.int32))]
            for name, kind in FIELDS.items():
                x = entry[name][order].astype(kind)
                columns.append(pa.array([x[cut[g] : cut[g + 1]].tobytes() for g in used.tolist()], pa.binary()))
            yield pa.record_batch(columns, names=["g", "level", *FIELDS])

    return run


def _key_runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(head)
    return first, np.diff(np.append(first, len(keys)))


def _merge_scan(carry: int):
    """For one group: the new array of level `carry`, and the keys that a scan found twice (level -2)."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        level = table["level"].to_numpy()
        merged, _ = _sorted_classes(_unpack(table.filter(pa.array(level < carry))))
        fresh, _ = _sorted_classes(_unpack(table.filter(pa.array(level < 0))))
        own, size = _key_runs(fresh["keys"])
        twice = np.add.reduceat(fresh["members"], own) > 1 if len(own) else np.zeros(0, bool)
        shared = [fresh["keys"][own][twice | (size > 1)]]
        for old in np.unique(level[level >= 0]).tolist():  # the levels' arrays are sorted: a merge by binary search
            there = np.frombuffer(table["keys"][int(np.flatnonzero(level == old)[0])].as_buffer(), "<u8")
            mine = fresh["keys"][own]
            at = np.searchsorted(there, mine)
            shared.append(mine[(at < len(there)) & (there[np.minimum(at, len(there) - 1)] == mine)] if len(there) else mine[:0])
        g = key[0].as_py()
        found = {name: np.zeros(0, kind) for name, kind in FIELDS.items()} | {"keys": np.unique(np.concatenate(shared))}
        out = [pa.table([pa.array([g], pa.int32()), pa.array([n], pa.int32()), *_pack(c)], names=["g", "level", *FIELDS]) for n, c in ((carry, merged), (-2, found)) if len(c["keys"])]
        return pa.concat_tables(out) if out else table.slice(0, 0)

    return run


def _resolve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For one group: classes with several members, and classes of keys with several classes."""
    level = table["level"].to_numpy()
    shared = np.unique(_unpack(table.filter(pa.array(level == -2)))["keys"])
    every = _unpack(table.filter(pa.array(level >= 0)))
    if len(shared):
        at = np.minimum(np.searchsorted(shared, every["keys"]), len(shared) - 1)
        every = {name: x[shared[at] == every["keys"]] for name, x in every.items()}
        c, _ = _sorted_classes(every)
        _, size = _key_runs(c["keys"])
        several = np.repeat(size > 1, size)
        take = several | (c["members"] > 1)
    else:
        c, several, take = {name: x[:0] for name, x in every.items()}, np.zeros(0, bool), np.zeros(0, bool)
    return pa.table(
        [pa.array(c["keys"][take].view(np.int64)), pa.array(c["contexts"][take].view(np.int64)), *(pa.array(c[name][take].astype(np.int64)) for name in ("members", "doc", "h", "at", "windows", "reach")), pa.array(several[take])],
        names=["key", "context", "members", "doc", "h", "at", "windows", "reach", "several"],
    )


RESOLVED = "key long, context long, members long, doc long, h long, at long, windows long, reach long, several boolean"


class SuffixIndex:
    """The family of sparse suffix arrays; levels are tables in the shared folder."""

    def __init__(self, spark, *, length: int = LENGTH, unit: Unit = BYTES, text_bytes: int = 0) -> None:
        """`text_bytes`: about the bytes of all texts to come; they set the number of groups."""
        _session.tune(spark)
        self.spark, self.length, self.unit = spark, length, unit
        self.tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.groups = max(self.tasks, -(-text_bytes // GROUP_BYTES))
        self.levels: dict[int, str] = {}
        self.scans: list[str] = []

    def _level(self, number: int) -> DataFrame:
        return self.spark.read.schema(ARRAY).parquet(self.levels[number]).where(F.col("level") == number)

    def add(self, rows: DataFrame) -> None:
        """Adds a batch of rows (doc, h, text): its array, the scans, and the carry."""
        carry = 0
        while carry in self.levels:
            carry += 1
        pieces = rows.mapInArrow(_emit(self.length, self.unit, self.groups), ARRAY)
        for number in self.levels:
            pieces = pieces.unionByName(self._level(number))
        path = _session.scratch_path(self.spark, f"suffixes-{carry}")
        pieces.groupBy("g").applyInArrow(_merge_scan(carry), ARRAY).write.parquet(path)
        self.scans.append(path)
        for number in range(carry):
            del self.levels[number]
        self.levels[carry] = path

    def resolved(self) -> DataFrame:
        arrays = [self._level(number) for number in self.levels]
        arrays += [self.spark.read.schema(ARRAY).parquet(path).where("level = -2") for path in self.scans]
        return reduce(DataFrame.unionByName, arrays).groupBy("g").applyInArrow(_resolve, RESOLVED)

    def drop(self) -> None:
        for path in self.scans:
            _session.drop_path(self.spark, path)


def _cores(length: int, unit: Unit):
    """For each class of a key with several: its symbols, and a row for each block of offsets."""
    width, step = np.dtype(unit.symbol).itemsize, unit.block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, off in text_chunks(batches):
            classes = batch.column(batch.schema.get_field_index("classes")).to_pylist()
            symbols, off = unit.read(raw, off)
            prefix = prefix_hash(symbols)
            out: list[tuple] = []
            for base, held in zip(off[:-1].tolist(), classes):
                for c in held:
                    a, w, reach = base + c["at"], c["windows"], c["reach"]
                    low, high = reach - w + 1, reach  # offsets of the anchor in the windows of this class
                    for block in range(low // step, high // step + 1):
                        first, last = max(low, block * step), min(high, block * step + step - 1)
                        p = a + reach
                        out.append((c["key"], c["context"], block, high - last, p - block * step, p - block * step - step + 1 + length, p - last, p - first + length))
            data = symbols.tobytes()
            for at in range(0, len(out), CORE_ROWS):
                key, context, block, skip, core_a, core_b, slice_a, slice_b = (np.asarray(x) for x in zip(*out[at : at + CORE_ROWS]))
                with np.errstate(over="ignore"):
                    core = mix64(span_hash(prefix, core_a, core_b) ^ mix64(key.astype(np.int64).view(np.uint64) + block.astype(np.uint64) * _K[0]))
                slices = [data[a * width : b * width] for a, b in zip(slice_a.tolist(), slice_b.tolist())]
                yield pa.record_batch(
                    [pa.array(core.view(np.int64)), pa.array(key, pa.int64()), pa.array(context, pa.int64()), pa.array(skip, pa.int64()), pa.array(slices, pa.binary())],
                    names=["core", "key", "context", "skip", "slice"],
                )

    return run


CORES = "core long, key long, context long, skip long, slice binary"


def _window_hashes(batch: pa.RecordBatch, raw: np.ndarray, off: np.ndarray, length: int, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of all slices: hash (with the core's), row, and place in the slice."""
    symbols, off = raw.view(unit.symbol), off // np.dtype(unit.symbol).itemsize
    count = np.diff(off) - length + 1
    start = ragged_index(off[:-1], count).astype(np.int64)
    owner = np.repeat(np.arange(len(count)), count)
    core = batch.column(0).to_numpy().view(np.uint64)
    return span_hash(prefix_hash(symbols), start, start + length) ^ mix64(core)[owner], owner, start - off[owner]


def _whole_cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows in order of core, cut where a core ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        core = batch.column(0).to_numpy()
        if batch.num_rows and sum(b.num_rows for b in held) >= CORE_ROWS:
            same = core == held[-1].column(0)[-1].as_py()
            cut = batch.num_rows if same.all() else int(np.argmin(same))
            if cut < batch.num_rows:
                yield pa.concat_batches([*held, batch.slice(0, cut)])
                held, batch = [], batch.slice(cut)
        if batch.num_rows:
            held.append(batch)
    if held:
        yield pa.concat_batches(held)


def _equal_windows(length: int, unit: Unit):
    """Over rows in order of core: runs of windows that another class of the same core has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_cores(batches):
            raw, off = text_buffers(batch.column(4))
            value, owner, place = _window_hashes(batch, raw, off, length, unit)
            order = np.argsort(value)
            same = value[order][1:] == value[order][:-1]
            again = np.zeros(len(value), bool)
            again[order[1:][same]] = again[order[:-1][same]] = True
            again = np.flatnonzero(again)  # in order of owner and place
            if not len(again):
                continue
            new = np.ones(len(again), bool)
            new[1:] = (owner[again][1:] != owner[again][:-1]) | (place[again][1:] != place[again][:-1] + 1)
            head = np.flatnonzero(new)
            last = np.append(head[1:], len(again)) - 1
            key, context, skip = (batch.column(i).to_numpy()[owner[again[head]]] for i in (1, 2, 3))
            yield pa.record_batch([pa.array(key), pa.array(context), pa.array(skip + place[again[head]]), pa.array(skip + place[again[last]])], names=["key", "context", "s", "e"])

    return run


def _single_windows(length: int, unit: Unit):
    """A row for every window of every slice: for cores that too many classes share to meet in one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, off in text_chunks(batches, "slice"):
            value, owner, place = _window_hashes(batch, raw, off, length, unit)
            key, context, skip = (batch.column(i).to_numpy()[owner] for i in (1, 2, 3))
            yield pa.record_batch([pa.array(value.view(np.int64)), pa.array(key), pa.array(context), pa.array(skip + place)], names=["value", "key", "context", "s"])

    return run


def _met_windows(cores: DataFrame, length: int, unit: Unit, tasks: int) -> DataFrame:
    """(key, context, s, e): runs of windows that several classes of a key share."""
    marks = "key long, context long, s long, e long"
    met = cores.groupBy("core").agg(F.count("*").alias("n")).where("n > 1")
    sliced = lambda kind: cores.join(met.where(kind).select("core"), "core").select("core", "key", "context", "skip", "slice")
    few = sliced(F.col("n") <= CORE_ROWS).repartition(tasks, "core").sortWithinPartitions("core").mapInArrow(_equal_windows(length, unit), marks)
    single = sliced(F.col("n") > CORE_ROWS).mapInArrow(_single_windows(length, unit), "value long, key long, context long, s long")
    again = single.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    return few.unionByName(single.join(again, "value").select("key", "context", "s", F.col("s").alias("e")))


def _runs(length: int, unit: Unit):
    """Every run of windows of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, off in text_chunks(batches):
            symbols, off = unit.read(raw, off)
            r = anchor_runs(symbols, off, length, unit.gram)
            own = np.searchsorted(off, r.a, "right") - 1
            yield pa.record_batch([pa.array(batch.column(0).to_numpy()[own]), pa.array(batch.column(1).to_numpy()[own]), pa.array(r.a - off[own]), pa.array(r.key.view(np.int64)), pa.array(r.fp.view(np.int64))], names=["doc", "h", "at", "key", "context"])

    return run


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, batches: int = BATCHES, unit: Unit = BYTES) -> DataFrame:
    """(doc, h, spans): for each document with repeats, its runs (s, e) of first symbols of repeated strings."""
    spark = docs.sparkSession
    rows = _rows(docs)
    text_bytes = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    index = SuffixIndex(spark, length=length, unit=unit, text_bytes=text_bytes)
    for b in range(batches):
        index.add(rows.where(F.pmod(F.xxhash64("h", "doc"), F.lit(batches)) == b))
    classes = _session.stored(index.resolved(), "suffix-classes")
    index.drop()
    whole = classes.where("members > 1").select("key", "context", F.lit(0).cast("long").alias("s"), (F.col("windows") - 1).alias("e"))
    open_classes = classes.where("several").groupBy("doc", "h").agg(F.collect_list(F.struct("key", "context", "at", "windows", "reach")).alias("classes"))
    holders = rows.join(open_classes.hint("shuffle_hash"), ["doc", "h"]).dropDuplicates(["doc", "h"]).select("text", "classes")
    cores = _session.stored(holders.mapInArrow(_cores(length, unit), CORES), "suffix-cores")
    marks = _session.stored(whole.unionByName(_met_windows(cores, length, unit, index.tasks)), "suffix-marks")
    _session.drop(classes, cores)
    runs = rows.mapInArrow(_runs(length, unit), "doc long, h long, at long, key long, context long")
    found = runs.join(marks, ["key", "context"]).select("doc", "h", (F.col("at") + F.col("s")).alias("s"), (F.col("at") + F.col("e")).alias("e"))
    spans = _session.stored(found.groupBy("doc", "h").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "suffix-spans")
    _session.drop(marks)
    return spans


def covered(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of symbols covered by strings that start in the spans."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"] + length) for x in spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def passage_bytes(raw: np.ndarray, spans: list[dict], words: int) -> list[tuple[int, int]]:
    """Byte runs [start, end) of the passages of one text that start in runs of first words of repeated passages."""
    if not spans:
        return []
    starts, ends, _ = word_bounds(raw, np.asarray([0, len(raw)]))
    return [(int(starts[a]), int(ends[b - 1])) for a, b in covered(spans, words)]


def _with_spans(docs: DataFrame, *spans: DataFrame) -> DataFrame:
    """All rows of `docs` as (row, text, spans_0, spans_1, ...)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc"), F.xxhash64(text).alias("h"), text.alias("text"))
    for k, found in enumerate(spans):
        rows = rows.join(found.withColumnRenamed("spans", f"spans_{k}").hint("shuffle_hash"), ["doc", "h"], "left")
    return rows.select("row", "text", *(f"spans_{k}" for k in range(len(spans))))


def dedup_report(docs: DataFrame, *, length: int = LENGTH, words: int = PASSAGE_WORDS, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words) of every row.

    n_passage_words counts the words in passages of `words` words and more that also stand elsewhere; removal goes by bytes.
    """

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, off in text_chunks(batches_):
            data, removed, spans, digest, passage = raw.tobytes(), [], [], [], []
            for a, b, held, said in zip(off[:-1].tolist(), off[1:].tolist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                gone = covered(held or [], length)
                kept, at = hashlib.sha256(), a
                for s, e in gone:
                    kept.update(data[at : a + s])
                    at = a + e
                kept.update(data[at:b])
                removed.append(sum(e - s for s, e in gone))
                spans.append(len(gone))
                digest.append(kept.hexdigest())
                passage.append(sum(e - s for s, e in covered(said or [], words)))
            yield pa.record_batch([batch.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(passage, pa.int64())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = _with_spans(docs, repeated_spans(docs, length=length, batches=batches), repeated_spans(docs, length=words, batches=batches, unit=WORDS))
    return rows.select("row.doc_id", "text", "spans_0", "spans_1").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long")


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, words: int | None = None, batches: int = BATCHES) -> DataFrame:
    """`docs` without repeated strings; characters cut by a span's edge stay whole, blank rests of a cut text go.

    With `words`, passages of so many words count as strings, however few bytes they have.
    n_chars, where there is one, is counted anew.
    """

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, off in text_chunks(batches_):
            texts, blank = [], []
            for a, b, held in zip(off[:-1].tolist(), off[1:].tolist(), batch.column(2).to_pylist()):
                own, at, parts = raw[a:b], 0, []
                gone = passage_bytes(own, held, words) if words else covered(held or [], length)
                for s, e in gone:
                    while s < e and own[s] & 0xC0 == 0x80:  # inside a character: keep all of it
                        s += 1
                    while e < len(own) and e > s and own[e] & 0xC0 == 0x80:
                        e -= 1
                    parts.append(own[at:s])
                    at = max(at, e)
                parts.append(own[at:])
                rest = np.concatenate(parts)
                texts.append(rest.tobytes().decode("utf-8"))
                blank.append(bool(gone) and bool(IS_SPACE[rest].all()))
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(blank)], names=["row", "kept_text", "blank"])

    rows = _with_spans(docs, repeated_spans(docs, length=words or length, batches=batches, unit=WORDS if words else BYTES))
    schema = rows.select("row").schema.add("kept_text", "string").add("blank", "boolean")
    cut = rows.mapInArrow(run, schema).where("not blank")
    fields = {name: F.col("row")[name] for name in docs.columns} | {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        fields["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return cut.select(*(c.alias(name) for name, c in fields.items()))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_report(_session.documents(spark, sf_dir))
