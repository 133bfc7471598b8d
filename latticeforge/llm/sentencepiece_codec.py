"""Operator 9: SentencePiece encoding and decoding with a batched numpy Viterbi.

Text is cut before runs of spaces into units, and these between characters that stand side by side in no piece, where
no piece can cross; only distinct parts are segmented.  Parts of equal length advance together, position by
position: substring hashes probe the sorted keys of all pieces, every candidate that ends at the
position gets a score, and vectorised maxima store the backpointers.

For a unigram model a candidate's score is the best score of its beginning plus the piece's.  For a
BPE model plain score sums give other segmentations than merging does, so the transition decides
instead: a segmentation is what merging gives exactly if all neighbours in it stay apart when merged
on their own, and for each position there is one last piece of that kind; a candidate scores only if
it stays apart from the last piece at its beginning.  The ids then equal the library's.

A long part of a BPE model is cut into overlapping blocks that advance together like parts of equal length.  Where
two blocks have the same piece in common, one may go on from the other: all neighbours stay apart as before, so
the joined segmentation is the whole part's.  Should blocks never meet, or for a unigram model, the part advances alone.

Characters in no piece fall back to byte pieces.  Defined results: null and empty text has no ids;
decoding gives the library's text (U+2581 in a text comes back as a space); a very long text is a chunk of its own,
with or without spaces; repeated rows and null doc_ids are rows like any other; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _session
from ._kernels import mix64, power_table, text_chunks
from .wordwise import MEMO_BYTES, TOKENIZE_BYTES, PartMemo, _grown

SPACE = "▁"
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Slots of a worker's cache of compared pairs.
PAIR_SLOTS = 1 << 20
#: Characters segmented at once.
BATCH_CHARS = 200_000
#: Characters by which blocks of a long part follow each other; a block is twice as long.
SPAN = 64
#: A code point beyond all characters, in UTF-32: it fills up rows of characters and stands in no piece.
PAD = (0x110000).to_bytes(4, "little")


def _codes(points: np.ndarray) -> np.ndarray:
    return mix64(points.astype(np.uint64) + np.uint64(0x51ED270B))


def _value(text: str) -> int:
    return sum(int(c) * pow(_BASE, k, 1 << 64) for k, c in enumerate(_codes(np.asarray([ord(x) for x in text])))) % (1 << 64)


@dataclass
class PieceTable:
    """The pieces of a model as arrays sorted by key; ranks tell which piece merges first.

    Single characters rank lowest, then the other pieces by falling score.
    """

    kind: str  # "bpe" or "unigram"
    ids: np.ndarray  # model id of each rank
    scores: np.ndarray
    values: np.ndarray  # polynomial hash of each rank
    lengths: np.ndarray
    byte_ids: np.ndarray  # 256 byte pieces, or empty
    unknown_id: int
    texts: list[bytes]  # decoded bytes of each model id
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # the merge that makes each rank
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __post_init__(self) -> None:
        keys = self._key(self.values, self.lengths)
        order = np.argsort(keys)
        self.keys, self.order = keys[order], order
        self.longest = int(self.lengths.max(initial=1))
        names = self._names()
        self.neighbours = np.unique(np.asarray([ord(n[k]) << 32 | ord(n[k + 1]) for n in names for k in range(len(n) - 1)], np.int64))
        if self.kind == "bpe" and not len(self.left):
            self._find_merges()

    def _names(self) -> list[str]:
        return [self.texts[i].decode("utf-8").replace(" ", SPACE) for i in self.ids.tolist()]

    def never_joined(self, points: np.ndarray) -> np.ndarray:
        """For each two characters side by side, whether they are so in no piece."""
        pair = points[:-1].astype(np.int64) << 32 | points[1:]
        at = np.searchsorted(self.neighbours, pair)
        return (at == len(self.neighbours)) | (np.append(self.neighbours, -1)[at] != pair)

    @staticmethod
    def _key(values: np.ndarray, lengths) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64(values + np.asarray(lengths).astype(np.uint64))

    def probe(self, values: np.ndarray, lengths) -> np.ndarray:
        """Ranks of the pieces with these hashes, or -1."""
        keys = self._key(values, lengths)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pieces that read like a followed by b, or -1."""
        with np.errstate(over="ignore"):
            values = self.values[a] + self.values[b] * power_table(_BASE, self.longest + 1)[self.lengths[a]]
        return self.probe(values, self.lengths[a] + self.lengths[b])

    def _find_merges(self) -> None:
        """For each piece the last merge that makes it; a piece that merging never makes keeps -1."""
        n = len(self.ids)
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        single = self.lengths == 1
        self.left[single] = self.right[single] = np.flatnonzero(single)
        names = self._names()
        rank = {name: r for r, name in enumerate(names)}
        for r in np.flatnonzero(~single).tolist():
            symbols = list(names[r])
            made = None
            while len(symbols) > 1:
                best, at = min((rank.get(x + y, n), k) for k, (x, y) in enumerate(zip(symbols, symbols[1:])))
                if best == n:
                    break
                made = (symbols[at], symbols[at + 1])
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            if len(symbols) == 1 and made[0] in rank and made[1] in rank:
                self.left[r], self.right[r] = rank[made[0]], rank[made[1]]


def load_pieces(path: str) -> PieceTable:
    """Reads a SentencePiece model through the library."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    normal = [i for i in range(n) if not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i))]
    names = {i: model.id_to_piece(i) for i in normal}
    scores = np.asarray([model.get_score(i) for i in normal])
    merging = bool((scores == np.round(scores)).all())  # ranks of merges, not log probabilities
    order = sorted(normal, key=lambda i: (len(names[i]) > 1, -model.get_score(i), i))
    for name in names.values():
        if SPACE in name.lstrip(SPACE):
            raise ValueError(f"a piece crosses words: {name!r}")
    known = {c for name in names.values() for c in name}
    if missing := known - set(names.values()):
        raise ValueError(f"characters without a piece of their own: {sorted(missing)[:5]}")
    texts = [b""] * n
    byte_ids = np.zeros(0, np.int64)
    for i, name in names.items():
        texts[i] = name.replace(SPACE, " ").encode()
    if bytes_ := [i for i in range(n) if model.is_byte(i)]:
        byte_ids = np.asarray(bytes_)
        for value, i in enumerate(bytes_):
            texts[i] = bytes([value])
    if model.unk_id() >= 0:
        texts[model.unk_id()] = " ⁇ ".encode()
    return PieceTable(
        "bpe" if merging else "unigram", np.asarray(order), np.asarray([model.get_score(i) for i in order]), np.asarray([_value(names[i]) for i in order], np.uint64), np.asarray([len(names[i]) for i in order]), byte_ids, model.unk_id(), texts
    )


def _blocks(points: np.ndarray) -> np.ndarray:
    """The block that begins at each character of a part, filled up behind the end."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([points, np.frombuffer(PAD * 2 * SPAN, "<u4")]), 2 * SPAN)


def _begins(at: int, n: int, blocks: int) -> np.ndarray:
    """Where at most so many blocks of a part of n characters begin, from a place on."""
    return np.arange(at, max(n - SPAN, at + 1), SPAN)[:blocks]


class PieceTokenizer(PartMemo):
    def __init__(self, table: PieceTable, memo_bytes: int = MEMO_BYTES) -> None:
        self.table = table
        self.pair_key, self.pair_apart = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)
        self.alone = [c for c in (9, 10, 13) if table.probe(_codes(np.asarray([c])), np.asarray([1]))[0] < 0]
        super().__init__(memo_bytes)

    def _stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the texts of a and b together ends in just a and b.

        Undoing the later of both merges step by step shows every pair of symbols that met at the
        border; if one of those would have merged before the step that hid it, a and b do not last.
        """
        t = self.table
        a, b = a.copy(), b.copy()
        out = (t.left[a] >= 0) & (t.left[b] >= 0)
        limit = np.full(len(a), len(t.ids), np.int64)
        live = np.flatnonzero(out)
        while len(live):
            x, y, most = a[live], b[live], limit[live]
            met = t.joined(x, y)
            out[live[(met >= 0) & (met < most)]] = False
            x_last = x > y  # the later merge of the two; on the right, an equal one elsewhere comes after
            can_x, can_y = t.left[x] != x, t.left[y] != y
            undo_x = np.where(x_last, can_x, ~can_y & can_x)
            undo_y = ~undo_x & can_y
            limit[live] = np.where(undo_x, x, np.where(undo_y, y + 1, most))
            a[live] = np.where(undo_x, t.right[x], x)
            b[live] = np.where(undo_y, t.left[y], y)
            live = live[out[live] & (undo_x | undo_y)]
        return out

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_stay_apart through the cache; -1 stands for a character in no piece, which never merges."""
        out = np.ones(len(a), bool)
        ask = np.flatnonzero((a >= 0) & (b >= 0))
        pair = a[ask] << 32 | b[ask]
        slot = (mix64(pair.view(np.uint64)) & np.uint64(PAIR_SLOTS - 1)).astype(np.int64)
        hit = self.pair_key[slot] == pair
        out[ask[hit]] = self.pair_apart[slot[hit]]
        if not hit.all():
            new, place = np.unique(pair[~hit], return_inverse=True)
            found = self._stay_apart(new >> 32, new & 0xFFFFFFFF)
            out[ask[~hit]] = found[place]
            self.pair_key[slot[~hit]], self.pair_apart[slot[~hit]] = pair[~hit], found[place]
        return out

    def segment(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backpointers of words of one length: points is (words, n); ranks and lengths of the last piece at each position."""
        t = self.table
        words, n = points.shape
        prefix = np.zeros((words, n + 1), np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_codes(points) * power_table(_BASE, n), axis=1, out=prefix[:, 1:])
        inverse = power_table(_INVERSE, n + 1)
        found = []
        for size in range(1, min(t.longest, n) + 1):
            with np.errstate(over="ignore"):
                found.append(t.probe((prefix[:, size:] - prefix[:, : n + 1 - size]) * inverse[: n + 1 - size], np.asarray(size)))
        last, length = np.full((words, n + 1), -2), np.zeros((words, n + 1), np.int64)
        best = np.zeros((words, n + 1))
        worst = float(t.scores.min(initial=0.0)) - 10
        for end in range(1, n + 1):
            top = np.full(words, -np.inf)
            for size in range(1, min(t.longest, end) + 1):
                start = end - size
                rank = found[size - 1][:, start]
                known = rank >= 0
                if t.kind == "unigram":
                    score = np.where(known, best[:, start] + t.scores[rank], best[:, start] + worst if size == 1 else -np.inf)
                else:
                    at = np.flatnonzero((known & (t.left[rank] >= 0)) | ((size == 1) & ~known))
                    score = np.full(words, -np.inf)
                    score[at if start == 0 else at[self._apart(last[at, start], rank[at])]] = size
                better = score > top
                top[better] = score[better]
                last[better, end], length[better, end] = np.where(known, rank, -1)[better], size
            best[:, end] = top
        return last, length

    def _learn(self, units: list[bytes]) -> None:
        """Adds the ids of new units to the memo, put together from those of their parts."""
        rows = len(self.place)
        texts = [u.decode("utf-8", "replace").replace(" ", SPACE) for u in units]
        bound = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        cut = np.ones(len(points) + 1, bool)
        cut[1:-1] = self.table.never_joined(points)
        cut[bound] = True
        edge = np.flatnonzero(cut)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer(edge * 4), pa.py_buffer(points)]).dictionary_encode()
        part_rows = self._part_rows(parts.dictionary.to_pylist())[parts.indices.to_numpy(zero_copy_only=False)]
        self._compose(part_rows, np.diff(np.searchsorted(edge, bound)))
        self.place.update(zip(units, range(rows, rows + len(units))))

    def _part_rows(self, parts: list[bytes]) -> np.ndarray:
        """Rows of parts (UTF-32), after segmenting those not met yet."""
        new = [p for p in parts if p not in self.part_place]
        rows = len(self.part_place)
        self.part_start, self.part_size = _grown(self.part_start, rows + len(new)), _grown(self.part_size, rows + len(new))
        sizes = np.fromiter(map(len, new), np.int64, len(new)) // 4
        grid = 1 << np.maximum(np.log2(np.maximum(sizes, 1)).astype(np.int64) - 3, 0)
        widths = -(-sizes // grid) * grid  # parts of nearly equal length are padded to advance together
        order = np.argsort(widths, kind="stable")[: int((sizes <= 2 * SPAN).sum())]
        bounds = np.flatnonzero(np.diff(widths[order], prepend=-1))
        for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(order)]):
            width = int(widths[order[a]])
            step = BATCH_CHARS // width
            for at in range(a, b, step):
                own = order[at : min(b, at + step)]
                size = sizes[own]
                points = np.frombuffer(b"".join(new[i] + PAD * (width - n) for i, n in zip(own.tolist(), size.tolist())), "<u4").reshape(len(own), width)
                marks = self._marks(points)
                word, place = np.nonzero((marks > -2) & (np.arange(width) < size[:, None]))
                self._keep(rows + own, word, marks[word, place], points[word, place])
        long = np.flatnonzero(sizes > 2 * SPAN)
        for own in np.split(long, np.flatnonzero(np.diff(np.cumsum(sizes[long]) // BATCH_CHARS)) + 1) if len(long) else []:
            points = [np.frombuffer(new[i], "<u4") for i in own.tolist()]
            found = self._long(points)
            word = np.repeat(np.arange(len(own)), [len(place) for _, place in found])
            self._keep(rows + own, word, np.concatenate([ranks for ranks, _ in found]), np.concatenate([p[place] for p, (_, place) in zip(points, found)]))
        self.part_place.update(zip(new, range(rows, rows + len(new))))
        self.part_bytes += sum(map(len, new))
        return np.asarray(list(map(self.part_place.__getitem__, parts)), np.int64)

    def _marks(self, points: np.ndarray) -> np.ndarray:
        """Walks the backpointers of words of one length together: the rank of the piece that begins at a character, else -2."""
        last, length = self.segment(points)
        words, n = points.shape
        marks, end, live = np.full((words, n), -2), np.full(words, n), np.arange(words)
        while len(live):
            here = end[live]
            start = here - length[live, here]
            marks[live, start] = last[live, here]
            end[live] = start
            live = live[start > 0]
        return marks

    def _long(self, parts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each long part the ranks of its pieces, and where they begin; the first blocks of all parts advance together."""
        found: list = [None] * len(parts)
        if self.table.kind == "bpe":
            windows = [_blocks(p) for p in parts]
            begins = [_begins(0, len(p), BATCH_CHARS // (2 * SPAN)) for p in parts]
            marks = np.split(self._marks(np.concatenate([w[b] for w, b in zip(windows, begins)])), np.cumsum([len(b) for b in begins])[:-1])
            found = [self._joined_blocks(len(p), *blocks) for p, *blocks in zip(parts, windows, begins, marks)]
        for k in (k for k, x in enumerate(found) if x is None):
            marks = self._marks(parts[k][None])[0]
            place = np.flatnonzero(marks > -2)
            found[k] = marks[place], place
        return found

    def _joined_blocks(self, n: int, windows: np.ndarray, begin: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """One long part by blocks; None where a block that should go on from another has no piece in common with it.

        Blocks that do not meet (in a run of one letter, say) begin anew where a piece of the last good one does.
        """
        width = 2 * SPAN
        column = np.arange(width)
        ranks, place = [], []
        expected = None
        while True:
            if expected is not None and marks[0, 0] != expected:
                return None
            same = (marks[:-1, SPAN:] == marks[1:, :SPAN]) & (marks[1:, :SPAN] > -2)
            met = same.any(axis=1)
            good = len(met) if met.all() else int(met.argmin())
            joint = same.argmax(axis=1)[:good]
            if begin[good] + width >= n:
                stop = n - begin[good]
            else:
                later = np.flatnonzero(marks[good, SPAN:] > -2)
                if not len(later):
                    return None
                stop = SPAN + later[0]
            low, high = np.append(0, joint), np.append(SPAN + joint, stop)
            row, col = np.nonzero((marks[: good + 1] > -2) & (column >= low[:, None]) & (column < high[:, None]))
            ranks.append(marks[row, col])
            place.append(begin[row] + col)
            if begin[good] + width >= n:
                return np.concatenate(ranks), np.concatenate(place)
            expected = marks[good, stop]
            blocks = min(2 * len(begin), BATCH_CHARS // width) if good == len(begin) - 1 else max(1, good)
            begin = _begins(int(begin[good] + stop), n, blocks)
            marks = self._marks(windows[begin])

    def _keep(self, rows: np.ndarray, word: np.ndarray, ranks: np.ndarray, points: np.ndarray) -> None:
        """Stores the ids of pieces, given in order of words; for a character in no piece those of its bytes."""
        t = self.table
        known = ranks >= 0
        rest = [t.byte_ids[list(chr(c).encode("utf-8", "replace"))] if len(t.byte_ids) else [t.unknown_id] for c in points[~known].tolist()]
        count = np.ones(len(ranks), np.int64)
        count[~known] = [len(x) for x in rest]
        at = np.cumsum(count) - count
        ids = np.zeros(int(count.sum()), np.uint32)
        ids[at[known]] = t.ids[ranks[known]]
        for k, x in zip(at[~known].tolist(), rest):
            ids[k : k + len(x)] = x
        size = np.bincount(word, weights=count, minlength=len(rows)).astype(np.int64)
        self.part_start[rows] = self._store(ids) + np.cumsum(size) - size
        self.part_size[rows] = size

    def ids(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a chunk, and offsets of each document in them."""
        data, mark = raw.tobytes(), SPACE.encode()
        if mark in data:  # a space sign in a text is the same symbol as a space
            texts = [data[a:b].replace(mark, b" ") for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            raw, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        size = np.diff(off)
        extra = (size > 0).astype(np.int64)  # the space before a text
        spaced = np.full(len(raw) + int(extra.sum()), 0x20, np.uint8)
        at = np.arange(len(raw)) + np.repeat(np.cumsum(extra), size)
        spaced[at] = raw
        off = np.concatenate([[0], np.cumsum(size + extra)])
        cut = np.zeros(len(spaced) + 1, bool)
        if len(spaced):
            blank = spaced == 0x20
            cut[1:-1] = blank[1:] & ~blank[:-1]
            for c in self.alone:
                cut[:-1] |= spaced == c
                cut[1:] |= spaced == c
        cut[off] = True
        return self.unit_ids(spaced, np.flatnonzero(cut), off)


def decode_ids(table: PieceTable, ids: np.ndarray, off: np.ndarray) -> list[str]:
    """The texts of documents' ids."""
    if not len(ids):
        return [""] * (len(off) - 1)
    _, offsets, text = pa.array(table.texts, pa.binary()).take(pa.array(ids.astype(np.int64))).buffers()
    ends = np.frombuffer(offsets, np.int32)[off].tolist()
    data = memoryview(text)
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        text = str(data[a:b], "utf-8", "replace")
        out.append(text[1:] if text.startswith(" ") else text)
    return out


_loaded: dict[str, PieceTokenizer] = {}


def piece_tokenizer(path: str) -> PieceTokenizer:
    """One for each Python worker, with its memo."""
    if path not in _loaded:
        _loaded[path] = PieceTokenizer(load_pieces(path))
    return _loaded[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, *, model: str | None = None) -> DataFrame:
    """(doc_id, ids): the piece ids of every text."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = piece_tokenizer(path)
        for batch, raw, off in text_chunks(batches, size=TOKENIZE_BYTES):
            ids, at = tokenizer.ids(raw, off)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    _session.tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(coded: DataFrame, *, model: str | None = None) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, text): the texts of piece ids."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_tokenizer(path).table
        for batch in batches:
            lists = batch.column(1)
            ids, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            flat = ids.astype("<u4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.record_batch([batch.column(0), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array(decode_ids(table, ids, at), pa.string())], names=["doc_id", "n_ids", "ids_crc32", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, text string")


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    decoded = decode_documents(encode_documents(_session.documents(spark, sf_dir)))
    return decoded.select("doc_id", "n_ids", "ids_crc32", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


