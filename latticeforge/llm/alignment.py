"""Operator 13: alignment of the tokens of two tokenizers by an event sweep.

Every token of either tokenizer is an event at the byte offset where it ends.  Both tokenizers' events are put together as rows of
(document, side, offset, ids), each with up to EVENT_TOKENS successive events of one side; the rows are repartitioned by document and
sorted by offset, and streamed through a state machine.  It holds the tokens since the last offset where both sides ended
(the open group), running counts and a running hash of each open document, closes a group at every common end, and emits the
document's links: its distinct pairs of ids in a common group with how often each occurs.

The count of a pair is the number of documents that hold it linked; counts are summed in the tasks first.  Links and counts
then meet by the hash of the A id in BUCKETS buckets: tasks read a bucket's counts, then stream blocks of links past them.  A block
holds the links of many documents, which are distinct within a document, so a frequent id is one entry a document; buckets are dealt
to several tasks where there are more tasks than buckets.

Defined results: a text that is null, empty or whose joined tokens differ from a space and the text (U+2581, broken UTF-8) has no
tokens, counts of 0 and the hash ''; null and repeated doc_ids and repeated rows are rows of their own, told apart by their place in
the table; the tokens of a very long text stream through in blocks, and its links are emitted block by block and counted once; a group
without bound stays whole, with its ids counted before they are paired; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _session
from ._kernels import give_back, mix64, ragged_index, segment_sums, text_chunks
from .byte_bpe import ByteTokenizer
from .sentencepiece_codec import SPACE, PieceTokenizer, load_pieces

#: Bytes of text tokenised at once, tokens of one event row, tokens that the sweep takes at once, and links that it unfolds at once.
CHUNK_BYTES, EVENT_TOKENS, SWEEP_TOKENS, UNFOLD = 2 << 20, 1 << 14, 1 << 18, 1 << 20
#: Bytes of the memo of either tokenizer in a worker.
MEMO_BYTES = 64 << 20
#: Beyond so many links, ids of a group are counted before they are paired.
LARGE_GROUP = 1 << 12
#: Buckets of A ids, and distinct pairs that a task counts before it sends them on.
BUCKETS, COUNTED = 32, 1 << 21
SIDE_A, SIDE_B, NO_TOKENS = 0, 1, 2
EVENTS = "uid long, doc_id long, side int, offset long, ids binary"
#: A row of the sweep's output: links of a bucket (docs, pairs, times), or in bucket -1 the documents of a chunk in the lists.
#: Links of a document that spans chunks stand in rows of their own with its uid.
DIGESTS = "uids array<long>, doc_ids array<long>, whole array<boolean>, counts array<long>, sha array<string>"
LINKS = f"chunk long, bucket int, uid long, docs binary, pairs binary, times binary, {DIGESTS}"
NAMES = [f.strip().split()[0] for f in LINKS.split(",")]
OUT = "uid long, doc_id long, whole boolean, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class TokenPair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a = ByteTokenizer(path_a, MEMO_BYTES)
        self.b = PieceTokenizer(load_pieces(path_b), MEMO_BYTES)
        self.bytes_a, self.bytes_b = _TokenBytes(self.a.texts), _TokenBytes(self.b.table.texts)
        codes = np.arange(128, dtype=np.uint32)
        codes[0x20] = ord(SPACE)
        pairs = np.stack(np.meshgrid(codes, codes, indexing="ij"), -1).reshape(-1, 2)
        apart = np.zeros((256, 256), bool)
        apart[:128, :128] = np.reshape([self.b.table.never_joined(p)[0] for p in pairs], (128, 128))
        self.apart = apart.ravel()

    def forget(self) -> None:
        """Empties both memos."""
        if self.a.place:
            self.a._forget()
            self.b._forget()
            give_back()

    def tokens(self, raw: np.ndarray, off: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
        """(ids and offsets of A, the same of B, which documents both give back) for texts that begin with their space."""
        a = self.a.ids(raw, off)
        cut = np.zeros(len(raw) + 1, bool)
        if len(raw) > 1:
            blank = raw == 0x20
            cut[1:-1] = self.apart[raw[:-1].astype(np.uint16) << 8 | raw[1:]] & ~(blank[1:] & blank[:-1])
            for c in self.b.alone:
                cut[:-1] |= raw == c
                cut[1:] |= raw == c
        cut[off] = True
        b = self.b.unit_ids(raw, np.flatnonzero(cut), off)
        good = self.bytes_a.same(*a, raw, off) & self.bytes_b.same(*b, raw, off) & (np.diff(off) > 0)
        return a, b, good


class _TokenBytes:
    def __init__(self, texts: list[bytes]) -> None:
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(texts), np.uint8)

    def same(self, ids: np.ndarray, at: np.ndarray, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Which documents' tokens join to their bytes."""
        good = segment_sums(self.size[ids], at) == np.diff(off)
        if not good.all():  # compare what lines up
            ids, raw = ids[np.repeat(good, np.diff(at))], raw[np.repeat(good, np.diff(off))]
            off = np.concatenate([[0], np.cumsum(np.where(good, np.diff(off), 0))])
        wrong = np.flatnonzero(self.flat[ragged_index(self.start[ids], self.size[ids])] != raw)
        good[np.searchsorted(off, wrong, "right") - 1] = False
        return good


_loaded: dict[tuple[str, str], TokenPair] = {}


def token_pair(path_a: str, path_b: str) -> TokenPair:
    """One for each Python worker, with its memos."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = TokenPair(path_a, path_b)
    return _loaded[path_a, path_b]


def _with_space(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space before each that is not empty."""
    extra = (np.diff(off) > 0).astype(np.int64)
    out = np.full(len(raw) + int(extra.sum()), 0x20, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.cumsum(extra), np.diff(off))] = raw
    return out, np.concatenate([[0], np.cumsum(np.diff(off) + extra)])


def _id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def events_of(path_a: str, path_b: str, event_tokens: int = EVENT_TOKENS):
    """A mapInArrow function from (uid, doc_id, text) to the end events of both tokenizers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = token_pair(path_a, path_b)
        for batch, raw, off in text_chunks(batches, size=CHUNK_BYTES):
            *sides, good = pair.tokens(*_with_space(raw, off))
            empty = np.flatnonzero(~good)
            parts = [(empty, np.full(len(empty), NO_TOKENS), np.zeros(len(empty), np.int64), pa.array([b""] * len(empty), pa.binary()))]
            for side, (ids, at), table in zip((SIDE_A, SIDE_B), sides, (pair.bytes_a, pair.bytes_b)):
                n = np.diff(at)
                blocks = -(-n // event_tokens)
                row = np.repeat(np.arange(len(n)), blocks)
                first = at[row] + (np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * event_tokens
                begun = np.concatenate([[0], np.cumsum(table.size[ids])])
                flat = ids.astype(_id_type(len(table.size)))
                bounds = (np.append(first, len(ids)) * flat.itemsize).astype(np.int32)
                data = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(bounds), pa.py_buffer(flat)])
                keep = good[row]
                parts.append((row[keep], np.full(int(keep.sum()), side), (begun[first] - begun[at[row]])[keep], data.filter(pa.array(keep))))
            rows = pa.array(np.concatenate([p[0] for p in parts]))
            columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate([p[1] for p in parts]).astype(np.int32)), pa.array(np.concatenate([p[2] for p in parts]))]
            yield pa.record_batch([*columns, pa.concat_arrays([p[3] for p in parts])], names=["uid", "doc_id", "side", "offset", "ids"])

    return run


def unfolded(doc: np.ndarray, group: np.ndarray, a: np.ndarray, b_group: np.ndarray, b: np.ndarray, n_groups: int, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, pair) and times of all links between A tokens and the B tokens of their groups; pair is a * shape[1] + b."""
    times_a, times_b = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
    if len(a) and (np.bincount(group, minlength=n_groups) * np.bincount(b_group, minlength=n_groups)).max() > LARGE_GROUP:
        home = np.zeros(n_groups, np.int64)
        home[group] = doc
        key, times_a = np.unique(group << 32 | a, return_counts=True)
        group, a = key >> 32, key & 0xFFFFFFFF
        key, times_b = np.unique(b_group << 32 | b, return_counts=True)
        b_group, b, doc = key >> 32, key & 0xFFFFFFFF, home[group]
    partners = np.bincount(b_group, minlength=n_groups)
    first, own = (np.cumsum(partners) - partners)[group], partners[group]
    room, done, found = np.cumsum(own), 0, []
    while done < len(a):
        end = max(done + 1, int(np.searchsorted(room, (room[done - 1] if done else 0) + UNFOLD, "right")))
        left = np.repeat(np.arange(done, end), own[done:end])
        right = ragged_index(first[done:end], own[done:end])
        found.append(_summed((doc[left] * shape[0] + a[left]) * shape[1] + b[right], times_a[left] * times_b[right]))
        done = end
    if len(found) > 1:
        found = [_summed(*(np.concatenate(x) for x in zip(*found)))]
    key, times = found[0] if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return key // (shape[0] * shape[1]), key % (shape[0] * shape[1]), times


def _summed(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their times."""
    if (times == 1).all():
        return np.unique(key, return_counts=True)
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[new], np.add.reduceat(times, new)


def bucket_of(a: np.ndarray) -> np.ndarray:
    return (mix64(a.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


class _Open:
    """What the machine holds of a document that goes on."""

    def __init__(self, uid: int, doc_id: int | None) -> None:
        self.uid, self.doc_id, self.digest, self.begun = uid, doc_id, hashlib.sha256(), False
        self.a = self.b = np.zeros(0, np.int64)


class Sweep:
    """Streams the sorted event rows of a partition; every call gives one record batch of the LINKS table."""

    def __init__(self, size_a: np.ndarray, size_b: np.ndarray, part: int) -> None:
        self.sizes, self.shape = (size_a, size_b), (len(size_a), len(size_b))
        self.chunk, self.open = part << 32, None
        most = max(self.shape)
        names = [str(i).encode() for i in range(most)]
        self.wide = np.fromiter(map(len, names), np.int64, most) + 1
        letters = b"".join(b" " + n.ljust(int(self.wide.max()) - 1) for n in names)
        self.letters, self.column = np.frombuffer(letters, np.uint8).reshape(most, -1), np.arange(int(self.wide.max()))

    def take(self, table: pa.Table, goes_on: bool) -> pa.RecordBatch:
        """Sweeps rows of whole documents; if `goes_on`, the last one may have more rows to come."""
        uid, side = table["uid"].to_numpy(), table["side"].to_numpy()
        new = np.flatnonzero(np.concatenate([[True], uid[1:] != uid[:-1]]))
        doc_of_row = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(uid))))
        uids, doc_ids = uid[new].tolist(), table["doc_id"].take(pa.array(new)).to_pylist()
        before, n = self.open, len(uids)  # a document that goes on is the first one
        ids, doc, end = zip(*(self._side(table, side, which, doc_of_row, held) for which, held in ((SIDE_A, before and before.a), (SIDE_B, before and before.b))))
        # Ends of both sides on one line of all documents' bytes.
        reach = np.zeros(n, np.int64)
        for d, e in zip(doc, end):
            np.maximum.at(reach, d, e)
        base = np.concatenate([[0], np.cumsum(reach)])
        place = [base[d] + e for d, e in zip(doc, end)]
        marked = np.zeros((2, base[-1] + 1), bool)
        for m, p in zip(marked, place):
            m[p] = True
        both = marked.all(axis=0)
        closes = np.flatnonzero(both)  # where groups end
        bound = np.searchsorted(closes, base, "right")  # groups before each document
        upto = np.cumsum(both, dtype=np.int32)
        group = [upto[p - 1].astype(np.int64) for p in place]
        closed = [g < bound[d + 1] for g, d in zip(group, doc)]
        (a, b), (doc_a, _), (group_a, group_b) = ([x[c] for x, c in zip(xs, closed)] for xs in (ids, doc, group))
        count_a, count_b = (np.bincount(g, minlength=len(closes)) for g in (group_a, group_b))
        counts = np.stack([segment_sums(count_a, bound), segment_sums(count_b, bound), np.diff(bound), segment_sums(count_a * count_b, bound)], axis=1)
        text, text_bound = self._written(a, group_a, count_a, b, group_b, count_b, bound)
        sha, whole = [], np.ones(n, bool)
        after = None
        for k, (s, e) in enumerate(zip(text_bound[:-1].tolist(), text_bound[1:].tolist())):
            held = before if k == 0 and before is not None else None
            last = goes_on and k == n - 1
            if held is None and not last:
                sha.append(hashlib.sha256(text[s + 1 : e]).hexdigest() if e > s else "")
                continue
            held = held or _Open(uids[k], doc_ids[k])
            held.digest.update(text[s + (not held.begun) : e])
            held.begun |= e > s
            whole[k] = False
            sha.append(None if last else held.digest.hexdigest() if held.begun else "")
            if last:
                after, (held.a, held.b) = held, (x[~c & (d == k)] for x, c, d in zip(ids, closed, doc))
        self.open = after
        return self._batch(uids, doc_ids, whole, counts, sha, *unfolded(doc_a, group_a, a, group_b, b, len(closes), self.shape))

    def _side(self, table: pa.Table, side: np.ndarray, which: int, doc_of_row: np.ndarray, held: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, document, end within the swept part of the document) of one side's tokens, those of the open group first."""
        mine = side == which
        data, kind = table["ids"].filter(pa.array(mine)).combine_chunks(), np.dtype(_id_type(self.shape[which]))
        bounds = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int32)
        ids = np.frombuffer(data.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(kind).astype(np.int64) if len(data) else np.zeros(0, np.int64)
        doc = np.repeat(doc_of_row[mine], np.diff(bounds) // kind.itemsize)
        if held is not None:
            ids, doc = np.concatenate([held, ids]), np.concatenate([np.zeros(len(held), np.int64), doc])
        end = np.cumsum(self.sizes[which][ids])
        first = np.searchsorted(doc, np.arange(doc[-1] + 1 if len(doc) else 0))
        return ids, doc, end - np.concatenate([[0], end])[first][doc]

    def _written(self, a: np.ndarray, group_a: np.ndarray, count_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, count_b: np.ndarray, bound: np.ndarray) -> tuple[bytes, np.ndarray]:
        """`;a,a|b,b` of all groups, and the bounds of documents in it."""
        until_a, until_b = np.concatenate([[0], np.cumsum(count_a)]), np.concatenate([[0], np.cumsum(count_b)])
        at_a, at_b = np.arange(len(a)) + until_b[group_a], np.arange(len(b)) + until_a[group_b + 1]
        ids, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = a, b
        mark[until_a[:-1] + until_b[:-1]] = ord(";")
        mark[until_a[1:] + until_b[:-1]] = ord("|")
        rows, wide = self.letters[ids], self.wide[ids]
        rows[:, 0] = mark
        text = rows[self.column < wide[:, None]].tobytes()
        run = np.concatenate([[0], np.cumsum(wide)])
        return text, run[(until_a + until_b)[bound]]

    def _batch(self, uids, doc_ids, whole, counts, sha, doc, pair, times) -> pa.RecordBatch:
        home = bucket_of(pair // self.shape[1])
        rows: list[tuple] = []
        complete = whole[doc]
        for uid, own in [(None, np.flatnonzero(complete)), *((uids[k], np.flatnonzero(doc == k)) for k in np.flatnonzero(~whole).tolist())]:
            own = own[np.argsort(home[own], kind="stable")]
            cut = np.flatnonzero(np.diff(home[own], prepend=-1))
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(own)]):
                part = own[s:e]
                rows.append((int(home[part[0]]), uid, doc[part].astype("<u4").tobytes(), pair[part].astype("<u8" if self.shape[0] * self.shape[1] > 1 << 32 else "<u4").tobytes(), times[part].astype("<u4").tobytes()))
        k = len(rows)
        none, size = [None] * k, len(uids)
        lists = [uids, doc_ids, whole.tolist(), counts.ravel().tolist(), sha]
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string())
        columns = [pa.array([self.chunk] * (k + 1), pa.int64()), pa.array([*(r[0] for r in rows), -1], pa.int32()), pa.array([*(r[1] for r in rows), None], pa.int64())]
        columns += [pa.array([*(r[c] for r in rows), None], pa.binary()) for c in (2, 3, 4)]
        columns += [pa.array([*none, x], pa.list_(kind)) for x, kind in zip(lists, kinds)]
        self.chunk += 1
        return pa.record_batch(columns, names=NAMES)


def swept(path_a: str, path_b: str, sweep_tokens: int = SWEEP_TOKENS):
    """A mapInArrow function from event rows, sorted by (uid, offset), to the LINKS table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held, waiting = token_pair(path_a, path_b), [], 0
        pair.forget()  # this stage needs the tokens' bytes only
        sweep = Sweep(pair.bytes_a.size, pair.bytes_b.size, TaskContext.get().partitionId())
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                waiting += batch.column(4).nbytes
            if waiting > 4 * sweep_tokens:
                table = pa.Table.from_batches(held)
                uid = table["uid"].to_numpy()
                last = int((uid == uid[-1]).argmax())  # of the last document more may come; a row of it stays
                if cut := last or len(uid) - 1:
                    yield sweep.take(table.slice(0, cut), not last)
                held = table.slice(cut).to_batches()
                waiting = sum(b.column(4).nbytes for b in held)
        if held:
            yield sweep.take(pa.Table.from_batches(held), False)

    return run


def _codes(cell: pa.Scalar, wide: bool) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), "<u8" if wide else "<u4")


def pair_counts(links: DataFrame, wide: bool) -> DataFrame:
    """(pair, count): how many documents hold each pair of ids linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for batch in batches:
            waiting += [_codes(x, wide) for x in batch.column(0)]
            if sum(map(len, waiting)) > COUNTED:
                pairs, counts = _merged(pairs, counts, waiting)
                waiting = []
                if len(pairs) > COUNTED:
                    yield pa.record_batch([pa.array(pairs), pa.array(counts)], names=["pair", "n"])
                    pairs, counts = pairs[:0], counts[:0]
        pairs, counts = _merged(pairs, counts, waiting)
        yield pa.record_batch([pa.array(pairs), pa.array(counts)], names=["pair", "n"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                pairs = _codes(cell, wide).astype(np.int64)
                yield pa.record_batch([pa.array(np.full(len(pairs), uid)), pa.array(pairs)], names=["uid", "pair"])

    rows = links.where("bucket >= 0")
    counted = rows.where("uid IS NULL").select("pairs").mapInArrow(run, "pair long, n long")
    # A document that spans chunks may hold a pair in several of them.
    long = rows.where("uid IS NOT NULL").select("uid", "pairs").mapInArrow(each, "uid long, pair long").distinct().select("pair", F.lit(1).cast("long").alias("n"))
    return counted.unionByName(long).groupBy("pair").agg(F.sum("n").alias("count"))


def _merged(pairs: np.ndarray, counts: np.ndarray, waiting: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not waiting:
        return pairs, counts
    new, n = np.unique(np.concatenate(waiting), return_counts=True)
    return _summed(np.concatenate([pairs, new.astype(np.int64)]), np.concatenate([counts, n]))


def _packed_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, pairs, counts, best), the last two named docs and times: rows of many pairs each, from (a, pair, count, best)."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n > UNFOLD:
            yield _packed(held)
            held, n = [], 0
    if n:
        yield _packed(held)


def _packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    a, pair, count, best = (table.column(c).to_numpy() for c in range(4))
    bucket = bucket_of(a)
    order = np.argsort(bucket, kind="stable")
    cuts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
    cells = [pa.array([x[c].astype(kind).tobytes() for c in cuts], pa.binary()) for x, kind in ((pair, "<i8"), (count, "<i8"), (best, "u1"))]
    return pa.record_batch([pa.array([int(bucket[c[0]]) for c in cuts], pa.int32()), *cells], names=["bucket", "pairs", "docs", "times"])


def _looked_up(wide: bool):
    """Reads a bucket's counts, then streams blocks of links past them: (chunk, docs, best, sums) of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, table = None, [], None
        for batch in batches:
            out = []
            for k, (b, is_links, chunk) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if b != bucket:
                    bucket, parts, table = b, [], None
                pairs, docs, times = (batch.column(c)[k] for c in (3, 4, 5))
                if not is_links:
                    parts.append((np.frombuffer(pairs.as_buffer(), "<i8"), np.frombuffer(docs.as_buffer(), "<i8"), np.frombuffer(times.as_buffer(), "u1")))
                    continue
                if table is None:
                    table = [np.concatenate(x) for x in zip(*parts)]
                    order = np.argsort(table[0])
                    table, parts = [x[order] for x in table], []
                doc, n = np.frombuffer(docs.as_buffer(), "<u4"), np.frombuffer(times.as_buffer(), "<u4").astype(np.int64)
                at = np.searchsorted(table[0], _codes(pairs, wide).astype(np.int64))
                new = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                out.append((chunk, doc[new].tobytes(), np.add.reduceat(n * table[2][at], new).tobytes(), np.add.reduceat(n * table[1][at], new).tobytes()))
            yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()), *(pa.array([o[c] for o in out], pa.binary()) for c in (1, 2, 3))], names=["chunk", "docs", "best", "sums"])

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents: a chunk's digests, then the sums of its blocks in all buckets."""
    digest, best, sums = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows() -> pa.RecordBatch:
        uids, doc_ids, whole, counts, sha = digest
        return pa.record_batch([uids, doc_ids, whole, *(pa.array(counts.to_numpy().reshape(-1, 4)[:, c]) for c in range(4)), pa.array(best), pa.array(sums), sha], names=[f.split()[0] for f in OUT.split(", ")])

    for batch in batches:
        for k in range(batch.num_rows):
            if batch.column(1)[k].as_py():
                doc = np.frombuffer(batch.column(2)[k].as_buffer(), "<u4")
                best[doc] += np.frombuffer(batch.column(3)[k].as_buffer(), np.int64)
                sums[doc] += np.frombuffer(batch.column(4)[k].as_buffer(), np.int64)
            else:
                if digest is not None:
                    yield rows()
                digest = [batch.column(c)[k].values for c in range(5, 10)]
                best, sums = np.zeros(len(digest[0]), np.int64), np.zeros(len(digest[0]), np.int64)
    if digest is not None:
        yield rows()


def align(docs: DataFrame, *, model_a: str | None = None, model_b: str | None = None, event_tokens: int = EVENT_TOKENS, sweep_tokens: int = SWEEP_TOKENS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of `docs` (doc_id, text).

    model_a: a byte-level BPE file of `tokenizers`; model_b: a SentencePiece model.  `docs` should come in the same
    order whenever it is read, as a table does.
    """
    spark = docs.sparkSession
    path_a, path_b = model_a or default_models()[0], model_b or default_models()[1]
    _session.tune(spark)
    n_a, n_b = vocabulary_sizes(path_a, path_b)
    wide = n_a * n_b > 1 << 32
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    events = rows.mapInArrow(events_of(path_a, path_b, event_tokens), EVENTS).repartition("uid").sortWithinPartitions("uid", "offset")
    links = _session.stored(events.mapInArrow(swept(path_a, path_b, sweep_tokens), LINKS), "links")

    a_id = F.floor(F.col("pair") / F.lit(n_b)).cast("long")
    counts = _session.stored(pair_counts(links, wide), "pair-counts").withColumn("a", a_id)
    most = counts.groupBy("a").agg(F.max("count").alias("most"))  # a row for each id of a vocabulary
    counts = counts.join(F.broadcast(most), "a").select("a", "pair", "count", (F.col("count") == F.col("most")).alias("best"))
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    salted = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    table = counts.mapInArrow(_packed_counts, "bucket int, pairs binary, docs binary, times binary").select("bucket", salted.alias("salt"), F.lit(False).alias("is_links"), F.lit(0).cast("long").alias("chunk"), "pairs", "docs", "times")
    blocks = links.where("bucket >= 0").select("bucket", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int").alias("salt"), F.lit(True).alias("is_links"), "chunk", "pairs", "docs", "times")
    met = table.unionByName(blocks).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "is_links").select("bucket", "is_links", "chunk", "pairs", "docs", "times", "salt")
    sums = met.mapInArrow(_looked_up(wide), "chunk long, docs binary, best binary, sums binary")

    digests = links.where("bucket < 0").select("chunk", F.lit(False).alias("is_sum"), *(F.lit(None).cast("binary").alias(c) for c in ("docs", "best", "sums")), "uids", "doc_ids", "whole", "counts", "sha")
    sums = sums.select("chunk", F.lit(True).alias("is_sum"), "docs", "best", "sums", *(F.lit(None).cast(digests.schema[c].dataType).alias(c) for c in ("uids", "doc_ids", "whole", "counts", "sha")))
    found = digests.unionByName(sums).repartition("chunk").sortWithinPartitions("chunk", "is_sum").mapInArrow(_gathered, OUT)
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    found = _session.stored(found, "aligned")
    long = found.where(~F.col("whole")).groupBy("uid", "doc_id").agg(*(F.sum(c).alias(c) for c in numbers), F.max("groups_sha256").alias("groups_sha256"))
    columns = ["doc_id", *numbers, "groups_sha256"]
    return found.where("whole").select(columns).unionByName(long.select(columns))


def default_models() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def vocabulary_sizes(path_a: str, path_b: str) -> tuple[int, int]:
    import sentencepiece
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path_a).get_vocab().values()) + 1, sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(_session.documents(spark, sf_dir))
