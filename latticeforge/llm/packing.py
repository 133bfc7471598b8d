"""Operator 8: best-fit packing of token pieces into sequences, improved by local search.

Pieces are hashed into shards of bounded expected size, each packed alone, so one shard's bins fit
in a worker whatever the corpus size; a shard wastes less than one bin against global packing.
Within a shard: best fit decreasing builds the start, then swap-based local search lowers the number
of bins.  It goes over the underfull bins, emptiest first, and empties each into fuller ones by
  * moving one of its documents (or two) into a bin with room,
  * exchanging one of its documents for a shorter one of another bin,
  * exchanging one for two shorter ones of another bin, two for one, or two pairs;
only steps that increase the sum of squared fills are taken, so the search ends, and a bin whose
last document has moved disappears.  It ends when no bin has such a step left, or no bin could be spared.

Defined results: null text is empty (one piece holding only the end id); repeated rows are packed as
rows of their own, in shards that their place in the table deals them to; a null doc_id is one like any other; a very long text is a chunk of
its own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _session
from ._kernels import text_chunks
from .wordwise import TOKENIZE_BYTES, default_vocabulary, word_tokenizer

CAPACITY = 2048
#: Pieces that one shard holds on average.
SHARD_PIECES = 40_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def pieces_of(vocabulary: str, end_id: int, capacity: int):
    """A mapInArrow function from (doc_id, text) to the pieces of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(vocabulary)
        for batch, raw, off in text_chunks(batches, size=TOKENIZE_BYTES):
            ids, at = tokenizer.ids(raw, off)
            n = np.diff(at) + 1
            count = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(n[row] - start, capacity)
            flat, tail = ids.astype("<u4"), np.asarray([end_id], "<u4").tobytes()
            crc = []
            for r, s, k in zip(row.tolist(), start.tolist(), length.tolist()):
                a, b = at[r] + s, min(at[r] + s + k, at[r + 1])
                value = zlib.crc32(flat[a:b])
                crc.append(zlib.crc32(tail, value) if s + k == n[r] else value)
            yield pa.record_batch(
                [batch.column(0).cast(pa.int64()).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers; each item goes to the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if some bin has room r
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            home = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[home].append(item)
        else:
            room, home = capacity, len(bins)
            bins.append([item])
        by_room[room - size].append(home)
        rooms |= 1 << (room - size)
    return bins


class _Search:
    """Local search over the underfull bins of one shard.

    Bins that may receive are indexed by their room and by what they can give back: the size of a member, or the sum of
    two.  So the best exchange for a document is found without looking at bins one by one.
    """

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int) -> None:
        self.size, self.capacity, self.bins = lengths.tolist(), capacity, bins
        self.room = [capacity - sum(self.size[i] for i in b) for b in bins]
        self.at: dict[int, set[int]] = {}  # back * (capacity + 1) + room -> bins; back 0 stands for nothing given back
        self.rooms = [0] * (capacity + 1)  # for each back the rooms of such bins, as bits
        self.ladder = np.arange(capacity + 1)
        self.most = np.full(capacity + 1, -1)  # and the largest of them

    def _backs(self, home: int) -> list[int]:
        """All that a bin can give for one document: nothing, one document, or two."""
        sizes = sorted(self.size[i] for i in self.bins[home])
        singles = pairs = 0
        for s in sizes:
            pairs |= singles << s
            singles |= 1 << s
        backs, bits = [], singles | pairs | 1
        while bits:
            low = bits & -bits
            backs.append(low.bit_length() - 1)
            bits ^= low
        return backs

    def _enter(self, home: int) -> None:
        room = self.room[home]
        for back in self._backs(home):
            self.at.setdefault(back * (self.capacity + 1) + room, set()).add(home)
            self.rooms[back] |= 1 << room
            self.most[back] = max(self.most[back], room)

    def _leave(self, home: int) -> None:
        room = self.room[home]
        for back in self._backs(home):
            key = back * (self.capacity + 1) + room
            self.at[key].discard(home)
            if not self.at[key]:
                del self.at[key]
                self.rooms[back] &= ~(1 << room)
                self.most[back] = self.rooms[back].bit_length() - 1

    def _given(self, home: int, back: int) -> list[int]:
        """The documents of a bin that make up `back`: one if there is such a one, else two."""
        by_size = {self.size[i]: i for i in self.bins[home]}
        if back in by_size or not back:
            return [by_size[back]] if back else []
        for i in self.bins[home]:
            j = by_size.get(back - self.size[i])
            if j is not None and j != i:
                return [i, j]
        return [i for i in self.bins[home] if 2 * self.size[i] == back][:2]

    def _step(self, target: int) -> bool:
        """One move or exchange out of the target, which is no fuller than any indexed bin, so that the squared fill rises."""
        own = sorted(self.bins[target], key=lambda i: (-self.size[i], i))
        by_size = {self.size[i]: (i,) for i in own}
        few = [i for k, i in enumerate(own) if k < 2 or self.size[own[k - 2]] != self.size[i]]  # two of a size are enough
        pairs = {self.size[i] + self.size[j]: (i, j) for i, j in combinations(few, 2)}
        for items in (*by_size.values(), *pairs.values()):
            size = sum(self.size[i] for i in items)
            # The less comes back, the more the other bin gains; it must have room for the difference.
            fits = np.flatnonzero(self.most[:size] >= size - self.ladder[:size])
            if not len(fits):
                continue
            back = int(fits[0])
            fitting = self.rooms[back] >> (size - back)
            room = size - back + (fitting & -fitting).bit_length() - 1
            home = min(self.at[back * (self.capacity + 1) + room])
            self._leave(home)
            given = self._given(home, back)
            for x in given:
                self.bins[home].remove(x)
            for x in items:
                self.bins[target].remove(x)
            self.bins[home] += items
            self.bins[target] += given
            self.room[home] -= size - back
            self.room[target] += size - back
            if self.room[home]:
                self._enter(home)
            return True
        return False

    def run(self) -> list[list[int]]:
        """Passes over all underfull bins, emptiest first, until no step is left or no bin can be spared."""
        changed = True
        while changed and sum(r for b, r in zip(self.bins, self.room) if b) >= self.capacity:
            changed = False
            queue = [(-r, k) for k, r in enumerate(self.room) if r and self.bins[k]]
            heapify(queue)
            for _, k in queue:
                self._enter(k)
            while queue:
                room, target = heappop(queue)
                if self.room[target] != -room:  # it has received since; its turn comes later
                    if self.room[target]:
                        heappush(queue, (-self.room[target], target))
                    continue
                self._leave(target)
                while self.bins[target] and self._step(target):
                    changed = True
        return [b for b in self.bins if b]


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers for lengths of 1 to capacity."""
    return _Search(best_fit_decreasing(lengths, capacity), lengths, capacity).run()


def _pack_shard(capacity: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = table["length"].to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for number, items in enumerate(pack(lengths, capacity)):
            sequence[items] = (key[0].as_py() << 32) + number
            offset[items] = np.cumsum(lengths[items]) - lengths[items]
        out = table.drop_columns(["shard"])
        return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack_documents(docs: DataFrame, *, vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    _session.tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = _session.stored(rows.mapInArrow(pieces_of(vocabulary or default_vocabulary(), end_id, capacity), PIECES), "pieces")
    shards = max(1, -(-pieces.where(F.col("length") < capacity).count() // shard_pieces))
    # A full piece is a sequence of its own: it needs no shard, only a number that no shard uses.
    full = pieces.where(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)).cast("long"))
    return rest.groupBy("shard").applyInArrow(_pack_shard(capacity), PACKED).unionByName(full)


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(_session.documents(spark, sf_dir))
