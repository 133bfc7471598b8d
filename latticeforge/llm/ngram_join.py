"""Operator 7: Jaccard self-join on word n-grams, exact, with component ids.

Sizes are cut into bands so that a linked pair lies in one band or in two neighbouring ones; a tile
is such a pair of bands.  For the sizes of a tile a link allows at most D differing shingles, so if
the shingles are dealt by hash into D + 1 + S parts, linked sets agree in more than S whole parts.  A
document's key for each part of its (at most two) tiles is a hash of all its shingles there, and
only documents that share a key are ever compared: no link is lost, and one common shingle makes no
candidates.  S is well above the parts that hashing leaves empty, so one that two sets agree in is filled and
empty parts need no keys, which all documents of a size would share.  Candidates then face a parity bitmap of 2048 bits: shared shingles cancel out in the
exclusive or, so its bit count bounds the differing shingles from below and the overlap from above.
What is left is decided by exact intersection of the sorted arrays.

Only links between different sets matter, so documents with equal sets are one class.  In a group
of copies, every class is first compared with the pivot it shares most keys with, then with the other
pivots it is not connected to yet (a bucket's pivot is the member that meets the most others); of the pairs of a bucket that are still in different components afterwards, those
whose sizes and signatures allow a link are compared too, so large groups cost about one comparison
a member and connectivity stays exact.

Keys travel as packed arrays and each chunk sends one row for a key it saw more than once (the other
rows are known candidates and skip the meeting), so a hot key's traffic is bounded by the chunks.

Defined results: null, empty or blank text has no shingles and is its own component; fewer words
than n make one shingle; rows that share a doc_id are separate rows; a component's id is its least
non-null doc_id; repeated rows are one class; a very long text is a chunk of its own and compared whole; a similarity that equals the
threshold is a link; an empty table gives no rows; further columns are ignored (`keep_one_each` keeps them, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from . import _session
from ._kernels import LOWER_ASCII, list_column, mix64, prefix_hash, ragged_index, span_hash, text_chunks, word_bounds
from .components import connected_components

#: Bits of the parity signature: about as many differences as half of them can be told apart.
#: Sets of which a link may differ in more carry a wide signature besides.
SIGNATURE_BITS = 2048
WORDS = SIGNATURE_BITS // 64
#: Keys of a class, in their order, that a row of an open bucket carries to tell where a pair met before.
EARLIER_KEYS = 16
_K = tuple(np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@dataclass(frozen=True)
class Threshold:
    """A Jaccard threshold num / den."""

    num: int
    den: int

    def size_bands(self, largest: int) -> np.ndarray:
        """Lower ends of the bands up to `largest`, and one beyond."""
        low = [1]
        while low[-1] <= largest:
            low.append(max(low[-1] + 1, -(-low[-1] * self.den // self.num)))
        return np.asarray(low)

    def parts(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parts, spare ones) of the tile whose smaller sets are in each band.

        Parts are one more than differences, and spares: as many parts may be empty without keys of their own.
        """
        differences = (low[1:] - 1) * (self.den - self.num) // self.num
        spare = 2 + differences // 8
        return differences + 1 + spare, spare

    def reached(self, shared, a, b):
        """den * shared >= num * union."""
        return self.den * shared >= self.num * (a + b - shared)


def shingle_sets(raw: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all documents, offsets of documents in them)."""
    low = LOWER_ASCII[raw]
    prefix = prefix_hash(low)
    starts, ends, first = word_bounds(low, off)
    words = span_hash(prefix, starts, ends)
    count = np.diff(first)
    sets = []
    windows = np.zeros(0, np.uint64)
    if len(words) >= n:
        with np.errstate(over="ignore"):
            windows = np.zeros(len(words) - n + 1, np.uint64)
            for k in range(n):
                windows = mix64(windows * _K[1] + words[k : len(windows) + k] + _K[0])
    for a, c in zip(first[:-1].tolist(), count.tolist()):
        if c >= n:
            sets.append(np.unique(windows[a : a + c - n + 1]))
        elif c:
            h = np.uint64(c)
            with np.errstate(over="ignore"):
                for w in words[a : a + c]:
                    h = mix64(h * _K[2] + w + _K[1])
            sets.append(np.asarray([h], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])


class ChunkSets:
    """Sets, classes, signatures and keys of a chunk of documents."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, n: int, threshold: Threshold) -> None:
        self.values, self.off = shingle_sets(raw, off, n)
        self.size, self.threshold = np.diff(self.off), threshold
        self.owner = np.repeat(np.arange(len(self.size)), self.size)

    @cached_property
    def classes(self) -> np.ndarray:
        """A hash of each whole set."""
        total = np.zeros(len(self.size), np.uint64)
        np.add.at(total, self.owner, mix64(self.values ^ _K[2]))
        with np.errstate(over="ignore"):
            return mix64(total + self.size.astype(np.uint64) * _K[0]).view(np.int64)

    def signatures(self) -> np.ndarray:
        """Parity bitmaps as 64-bit words, WORDS for each document."""
        h = mix64(self.values ^ _K[0])
        word, bit = (h >> np.uint64(6)) % np.uint64(WORDS), np.uint64(1) << (h & np.uint64(63))
        out = np.zeros(len(self.size) * WORDS, np.uint64)
        np.bitwise_xor.at(out, self.owner * WORDS + word.astype(np.int64), bit)
        return out.reshape(-1, WORDS)

    def wide_signatures(self) -> list[bytes | None]:
        """Parity bitmaps of four times the bits that a link may differ in, where SIGNATURE_BITS are fewer."""
        t, out = self.threshold, []
        for a, n in zip(self.off[:-1].tolist(), self.size.tolist()):
            least = 8 * n * (t.den - t.num) // (t.den + t.num)
            if least <= SIGNATURE_BITS:
                out.append(None)
                continue
            words = 1 << (least // 64).bit_length()
            h = mix64(self.values[a : a + n] ^ _K[0])
            own = np.zeros(words, np.uint64)
            np.bitwise_xor.at(own, ((h >> np.uint64(6)) % np.uint64(words)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
            out.append(own.tobytes())
        return out

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, classes) of all parts of all documents."""
        bands = self.threshold.size_bands(int(self.size.max(initial=1)))
        parts, spare = self.threshold.parts(bands)
        band = np.searchsorted(bands, self.size, "right") - 1
        content = mix64(self.values ^ _K[1])
        deal = mix64(self.values) >> np.uint64(11)
        found, owners = [], []
        for shift in (0, 1):  # as the smaller of a tile, and as the larger of the tile below
            docs = np.flatnonzero((self.size > 0) & (band >= shift))
            if not len(docs):
                continue
            tile = band[docs] - shift
            m = parts[tile]
            base = np.cumsum(m) - m
            length = self.size[docs]
            at = ragged_index(self.off[docs], length)
            slot = np.repeat(base, length) + (deal[at] % np.repeat(m, length).astype(np.uint64)).astype(np.int64)
            total = np.zeros(int(m.sum()), np.uint64)
            np.add.at(total, slot, content[at])
            filled = np.zeros(len(total), bool)
            filled[slot] = True
            number = np.arange(len(total)) - np.repeat(base, m)
            empty = m - np.add.reduceat(filled.astype(np.int64), base)
            send = filled | np.repeat(empty > spare[tile], m)
            with np.errstate(over="ignore"):
                key = mix64(total ^ mix64(np.repeat(tile, m).astype(np.uint64) * _K[0] + number.astype(np.uint64) * _K[2]))
            found.append(key[send])
            owners.append(np.repeat(self.classes[docs], m)[send])
        return (np.concatenate(found), np.concatenate(owners)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


_MEETING = "p int, doc_id long, h long, n long, cls long, signature array<long>, wide binary, keys binary, classes binary, shared binary"
_MET = "doc_id long, h long, n long, cls long, signature array<long>, wide binary, key long"


def _emit(n: int, threshold: Threshold, groups: int):
    """Rows of members, and packed key rows by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(p, doc_id=None, h=None, size=None, cls=None, signature=None, wide=None, keys=None, classes=None, shared=None):
            k = len(p)
            none = lambda x, kind: pa.nulls(k, kind) if x is None else pa.array(x, kind)
            return pa.record_batch(
                [pa.array(p, pa.int32()), none(doc_id, pa.int64()), none(h, pa.int64()), none(size, pa.int64()), none(cls, pa.int64()), pa.nulls(k, pa.list_(pa.int64())) if signature is None else signature, none(wide, pa.binary()), none(keys, pa.binary()), none(classes, pa.binary()), none(shared, pa.binary())],
                names=["p", "doc_id", "h", "n", "cls", "signature", "wide", "keys", "classes", "shared"],
            )

        for batch, raw, off in text_chunks(batches):
            chunk = ChunkSets(raw, off, n, threshold)
            cls = chunk.classes
            marks = list_column(chunk.signatures().view(np.int64).ravel(), np.arange(len(cls) + 1) * WORDS)
            yield rows((np.abs(cls) % groups).astype(np.int32), batch.column(0).to_pylist(), batch.column(1).to_pylist(), chunk.size, cls, marks, chunk.wide_signatures())
            keys, owners = chunk.keys()
            order = np.lexsort((owners, keys))
            keys, owners = keys[order], owners[order]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
            keys, owners = keys[fresh], owners[fresh]
            head = np.ones(len(keys), bool)
            head[1:] = keys[1:] != keys[:-1]
            runs = np.diff(np.append(np.flatnonzero(head), len(keys)))
            several = np.repeat(runs > 1, runs)
            # A key with several classes here is a candidate already: its first row goes to the meeting, marked.
            sent = np.flatnonzero(head)
            group = ((keys[sent] >> np.uint64(40)) % np.uint64(groups)).astype(np.int64)
            sent = sent[np.argsort(group, kind="stable")]
            group.sort()
            cut = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]]) if len(group) else np.zeros(1, np.int64)
            pieces = [sent[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            if pieces:
                yield rows(group[cut[:-1]].astype(np.int32), keys=[keys[x].tobytes() for x in pieces], classes=[owners[x].tobytes() for x in pieces], shared=[several[x].tobytes() for x in pieces])
            direct = np.flatnonzero(several & ~head)
            for at in range(0, len(direct), 4096):  # spread over groups: these rows only pass through
                x = direct[at : at + 4096]
                yield rows([int(np.abs(owners[x[0]]) % groups)], keys=[keys[x].tobytes()], classes=[owners[x].tobytes()], shared=[None])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Member rows as they are, and a (key, cls) row for every key that classes share."""
    keys, classes, shared = [], [], []

    def out(key: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
        k = len(key)
        return pa.record_batch([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(cls), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.binary()), pa.array(key.view(np.int64))], names=["doc_id", "h", "n", "cls", "signature", "wide", "key"])

    for batch in batches:
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        member = column["n"].is_valid()
        own = batch.filter(member)
        if own.num_rows:
            yield pa.record_batch([own.column(i) for i in range(1, 7)] + [pa.nulls(own.num_rows, pa.int64())], names=["doc_id", "h", "n", "cls", "signature", "wide", "key"])
        for k, c, s in zip(column["keys"].to_pylist(), column["classes"].to_pylist(), column["shared"].to_pylist()):
            if k is None:
                continue
            if s is None:
                yield out(np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64))
            else:
                keys.append(np.frombuffer(k, np.uint64))
                classes.append(np.frombuffer(c, np.int64))
                shared.append(np.frombuffer(s, bool))
    if not keys:
        return
    key, cls, known = np.concatenate(keys), np.concatenate(classes), np.concatenate(shared)
    order = np.argsort(key)
    key, cls, known = key[order], cls[order], known[order]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(head)
    runs = np.diff(np.append(first, len(key)))
    met = np.repeat((np.minimum.reduceat(cls, first) != np.maximum.reduceat(cls, first)) | np.logical_or.reduceat(known, first), runs)
    at = np.flatnonzero(met)
    for i in range(0, len(at), 65_536):
        yield out(key[at[i : i + 65_536]], cls[at[i : i + 65_536]])


def _text_rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


class NgramJoin:
    """The join over `docs` (doc_id, text): members, links and components."""

    def __init__(self, docs: DataFrame, *, n: int = 3, threshold: Threshold = Threshold(90, 100)) -> None:
        spark = docs.sparkSession
        _session.tune(spark)
        self.rows, self.n, self.threshold = _text_rows(docs), n, threshold
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        met = self.rows.mapInArrow(_emit(n, threshold, 8 * tasks), _MEETING).repartition(tasks, "p").mapInArrow(_meet, _MET)
        met = _session.stored(met, "ngram-keys")
        self.members = met.where("n is not null").drop("key")
        self.shared = met.where("n is null").select("key", "cls")

    def _info(self, name: str) -> DataFrame:
        """(name, name_n, name_s0..): size and signature of each class."""
        info = self.members.groupBy("cls").agg(F.first("n").alias("n"), F.first("signature").alias("signature"))
        words = [F.col("signature")[i].alias(f"{name}_s{i}") for i in range(WORDS)]
        return info.select(F.col("cls").alias(name), F.col("n").alias(f"{name}_n"), *words)

    def _possible(self):
        """Whether sizes and signatures of a and b leave a link possible."""
        differ = sum((F.bit_count(F.col(f"a_s{i}").bitwiseXOR(F.col(f"b_s{i}"))) for i in range(WORDS)), F.lit(0))
        total, t = F.col("a_n") + F.col("b_n"), self.threshold
        return (differ * (t.num + t.den) <= total * (t.den - t.num)) & (F.least("a_n", "b_n") * t.den >= F.greatest("a_n", "b_n") * t.num)

    def _bounded(self, pairs: DataFrame) -> DataFrame:
        both = pairs.join(self._info("a"), "a").join(self._info("b"), "b")
        return both.where(self._possible()).select("a", "b")

    def _wide_bounded(self, pairs: DataFrame) -> DataFrame:
        """The pairs that wide signatures leave possible; the wider of two folds to the other's width."""
        info = self.members.where("wide is not null").groupBy("cls").agg(F.first("n").alias("n"), F.first("wide").alias("wide"))
        side = lambda x: info.select(F.col("cls").alias(x), F.col("n").alias(f"{x}_n"), F.col("wide").alias(f"{x}_wide"))
        both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", "a_n", "b_n", "a_wide", "b_wide")
        t = self.threshold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for m, n, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                    if x is None or y is None:
                        keep.append(True)
                        continue
                    x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
                    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
                    differ = int(np.bitwise_count(x ^ y).sum())
                    keep.append(differ * (t.num + t.den) <= (m + n) * (t.den - t.num))
                mask = pa.array(keep, pa.bool_())
                yield pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

        return both.mapInArrow(run, "a long, b long")

    def _sets(self, classes: DataFrame) -> DataFrame:
        """(cls, items): the sorted shingles of each class in `classes` (cls)."""
        holder = self.members.join(classes, "cls", "left_semi").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "h")).alias("d"))
        holder = holder.select(F.coalesce("d.doc_id", F.lit(0)).alias("k"), F.col("d.null").alias("k_null"), F.col("d.h").alias("h"))
        rows = self.rows.withColumns({"k": F.coalesce("doc_id", F.lit(0)), "k_null": F.col("doc_id").isNull()}).join(holder.distinct(), ["k", "k_null", "h"], "left_semi").select("text")
        n, threshold = self.n, self.threshold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, raw, off in text_chunks(batches):
                chunk = ChunkSets(raw, off, n, threshold)
                items = [chunk.values[a:b].tobytes() for a, b in zip(chunk.off[:-1].tolist(), chunk.off[1:].tolist())]
                yield pa.record_batch([pa.array(chunk.classes), pa.array(items, pa.binary())], names=["cls", "items"])

        return rows.mapInArrow(run, "cls long, items binary").dropDuplicates(["cls"])

    def _linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that reach the threshold: exact intersections of sorted arrays."""
        pairs = _session.stored(self._wide_bounded(self._bounded(pairs)), "ngram-pairs")
        sets = _session.stored(self._sets(pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()), "ngram-sets")
        both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("items").alias("y")), "b")
        threshold = self.threshold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("x"), batch.column("y")):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    at = np.searchsorted(x, y)
                    shared = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                    keep.append(bool(threshold.reached(shared, len(x), len(y))))
                yield pa.record_batch([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

        links = _session.stored(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "ngram-links")
        _session.drop(pairs, sets)
        return links

    def _open_pairs(self, named: DataFrame) -> DataFrame:
        """(a, b): pairs of a bucket in different components that sizes and signatures leave possible.

        named: (key, cls, root) of open buckets.  Long sets share many keys.  A pair whose last EARLIER_KEYS
        keys before this one have one in common met there already; at the first key that it shares it counts in any case.
        """
        earlier = F.collect_list("key").over(W.partitionBy("cls").orderBy("key").rowsBetween(-EARLIER_KEYS, -1))
        named = named.withColumn("earlier", earlier)
        left = named.select("key", F.col("cls").alias("a"), F.col("root").alias("ra"), F.col("earlier").alias("ea")).join(self._info("a"), "a")
        right = named.select(F.col("key").alias("k"), F.col("cls").alias("b"), F.col("root").alias("rb"), F.col("earlier").alias("eb")).join(self._info("b"), "b")
        apart = (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb"))
        return left.join(right, (F.col("key") == F.col("k")) & apart & self._possible() & ~F.arrays_overlap("ea", "eb")).select("a", "b").distinct()

    @staticmethod
    def _named(roots: DataFrame, name: str) -> DataFrame:
        return roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))

    def class_components(self) -> DataFrame:
        """(cls, root) of every class that has a link."""
        met = self.shared.distinct()
        crowd = met.groupBy("key").agg(F.count("*").alias("size"))
        weight = met.join(crowd, "key").groupBy("cls").agg(F.sum("size").alias("weight"))
        weighed = _session.stored(met.join(weight, "cls"), "ngram-buckets")
        pivot = weighed.groupBy("key").agg(F.max(F.struct("weight", "cls")).alias("top"), F.count("*").alias("size"))
        pivot = pivot.where("size > 1").select("key", F.col("top.cls").alias("pivot"), "size")
        buckets = _session.stored(weighed.select("key", "cls").join(pivot, "key"), "ngram-stars")
        _session.drop(weighed)
        # Round one: every class against the pivot that it shares most keys with.
        stars = _session.stored(buckets.where("cls <> pivot").groupBy("cls", "pivot").agg(F.count("*").alias("k")), "ngram-pivots")
        pair = (F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b"))
        nearest = stars.groupBy("cls").agg(F.max(F.struct("k", "pivot")).alias("top")).select("cls", F.col("top.pivot").alias("pivot"))
        links = self._linked(nearest.select(*pair).distinct())
        roots = connected_components(links)
        # Round two: its other pivots, where that left them in different components.
        tested = stars.select(*pair).distinct()
        apart = tested.join(self._named(roots, "a"), "a", "left").join(self._named(roots, "b"), "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b"))
        more = self._linked(apart.select("a", "b").join(nearest.select(*pair), ["a", "b"], "left_anti"))
        if more.limit(1).count():
            links = links.union(more)
            roots = connected_components(links)
        # What the pivots left open: pairs of a bucket in different components.
        named = buckets.where("size > 2").select("key", "cls").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
        split = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        named = _session.stored(named.join(split, "key"), "ngram-open")
        open_pairs = self._open_pairs(named).join(tested, ["a", "b"], "left_anti")
        more = self._linked(open_pairs)
        if more.limit(1).count():
            roots = connected_components(links.union(more))
        return roots.withColumnRenamed("node", "cls")

    def components(self) -> DataFrame:
        """(doc_id, h, n, root, component_id) of every row; h tells apart rows that share a doc_id."""
        roots = self.members.select("doc_id", "h", "n", "cls").join(self.class_components(), "cls", "left")
        group = F.when(F.col("n") > 0, F.coalesce("root", "cls"))
        named = roots.select("doc_id", "h", "n", group.alias("root"))
        least = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
        return named.join(least, "root", "left").select("doc_id", "h", "n", "root", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_each(docs: DataFrame, *, n: int = 5, threshold: Threshold = Threshold(80, 100)) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component, the row of least doc_id stays."""
    found = NgramJoin(docs, n=n, threshold=threshold).components()
    first = found.where("n > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")).alias("d"))
    chosen = first.select(F.col("d.doc_id").alias("id"), F.col("d.h").alias("h")).union(found.where("n = 0").select("doc_id", "h").distinct())
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    kept = rows.join(chosen, rows["id"].eqNullSafe(chosen["id"]) & (rows["h"] == chosen["h"]), "left_semi")
    return kept.dropDuplicates(["id", "h"]).select("row.*")


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    found = NgramJoin(_session.documents(spark, sf_dir)).components()
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
