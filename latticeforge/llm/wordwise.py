"""Whole-text tokenisation through a per-worker memo of units.

The word BPE of the public vocabulary drops white space and never merges across it, so the ids of a
text are the concatenated ids of its white-space separated units.  A batch is cut into units with
numpy, distinct units are found with Arrow's dictionary encoding, and only units that a worker
has not met yet go to the `tokenizers` library; a ragged gather then rebuilds every text's ids.
The memo is bounded by bytes: when it is full, units that came up in one chunk only are forgotten.
Units outside the range where the pre-token pattern is certain go through the library's whole
pipeline one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex

from ._kernels import IS_SPACE, ragged_index

#: The vocabulary's own pre-token pattern (fixed values), for text whose normal form is itself.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Code points where lower-casing, NFC and the classes above need no further thought.
PLAIN = regex.compile("[\t-\r !-~\xa1-į]*")
#: Bytes that a worker's memo may take, as estimated by UNIT_COST and the arrays.
MEMO_BYTES = 144 << 20
#: Bytes that Python takes for a key of a memo besides its text: its object, its number and its slot in the table.
UNIT_COST = 150
#: Text tokenised at once: the more, the fewer distinct units a byte.
TOKENIZE_BYTES = 4 << 20


def pretokens(unit: str) -> list[str] | None:
    """Lower-case pre-tokens of a unit; None where only the library's own normaliser is certain."""
    word = unit.strip(" \t\n\r\v\f").lower()
    if word.isascii():
        if word.isalpha():
            return [word]
        if word[:-1].isalpha() and word[-1] in ".,;:!?":
            return [word[:-1], word[-1]]
    if "<|" in unit or not PLAIN.fullmatch(unit):
        return None
    return [word] if word.isalpha() else PRETOKEN.findall(word)


def _grown(x: np.ndarray, size: int) -> np.ndarray:
    return x if len(x) >= size else np.concatenate([x, np.zeros(max(len(x), size - len(x)), x.dtype)])


class UnitMemo:
    """Ids of units of text, kept for each distinct unit; `_learn` of a subclass adds new units."""

    def __init__(self, memo_bytes: int = MEMO_BYTES) -> None:
        self.memo_bytes = memo_bytes
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}  # unit -> its row in start, size and hits
        self.start, self.size, self.hits = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.uint8)
        self.flat, self.used, self.text_bytes = np.zeros(1 << 16, np.uint32), 0, 0

    def _store(self, ids: np.ndarray) -> int:
        """Appends ids to the flat store and tells where they begin."""
        at = self.used
        self.flat = _grown(self.flat, at + len(ids))
        self.flat[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def held_bytes(self) -> int:
        """About what the memo takes."""
        return len(self.place) * UNIT_COST + self.text_bytes + sum(x.nbytes for x in (self.start, self.size, self.hits, self.flat))

    def _learn(self, units: list[bytes]) -> None:
        raise NotImplementedError

    def _shrink(self) -> None:
        """Keeps the units that came up most often, and in two chunks at least, in a quarter of the memo's bytes."""
        hits = self.hits[: len(self.place)]
        cost = self.size[: len(hits)].astype(np.int64) * 4 + UNIT_COST + 24
        order = np.argsort(-hits.astype(np.int16), kind="stable")
        keep = np.zeros(len(hits), bool)
        keep[order[np.cumsum(cost[order]) <= self.memo_bytes // 4]] = True
        keep &= hits > 1
        units = [u for u, r in self.place.items() if keep[r]]
        rows = np.asarray([self.place[u] for u in units], np.int64)
        size, again = self.size[rows], hits[rows] // 2
        flat = self.flat[ragged_index(self.start[rows], size.astype(np.int64))]
        self._forget()
        start = self._store(flat) + np.cumsum(size) - size
        self.start, self.size, self.hits = (_grown(x, len(rows)) for x in (self.start, self.size, self.hits))
        self.start[: len(rows)], self.size[: len(rows)], self.hits[: len(rows)] = start, size, again
        self.place = dict(zip(units, range(len(rows))))
        self.text_bytes = sum(map(len, units))

    def rows_of(self, units: list[bytes]) -> np.ndarray:
        """The memo's row of each distinct unit."""
        if self.held_bytes() > self.memo_bytes:
            self._shrink()
        found = list(map(self.place.get, units))
        new = [u for u, r in zip(units, found) if r is None]
        if new:
            self._learn(new)
            self.text_bytes += sum(map(len, new))
            self.hits = _grown(self.hits, len(self.place))
            found = list(map(self.place.__getitem__, units))
        rows = np.asarray(found, np.int64)
        self.hits[rows] = np.minimum(self.hits[rows], 254) + 1
        return rows

    def unit_ids(self, raw: np.ndarray, bounds: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units raw[bounds[i]:bounds[i+1]], and the offsets in them of off, a part of bounds."""
        if len(bounds) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        units = pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = units.dictionary_encode()
        rows = self.rows_of(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.size[rows].astype(np.int64)
        run = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[ragged_index(self.start[rows], lengths)], run[np.searchsorted(bounds, off)]


class PartMemo(UnitMemo):
    """A memo that puts new units together from parts, which it keeps as well."""

    def _forget(self) -> None:
        super()._forget()
        self.part_place: dict = {}  # part -> its row in part_start and part_size
        self.part_start, self.part_size, self.part_bytes = self.start.copy(), self.size.copy(), 0

    def held_bytes(self) -> int:
        return super().held_bytes() + len(self.part_place) * (UNIT_COST + 8) + self.part_bytes + self.part_start.nbytes + self.part_size.nbytes

    def _shrink(self) -> None:
        """Units are cheap to put together again, so their parts stay unless these alone fill half of the memo."""
        place, text_bytes = self.part_place, self.part_bytes
        start, size = self.part_start[: len(place)], self.part_size[: len(place)].copy()
        flat = self.flat[ragged_index(start, size.astype(np.int64))]
        super()._shrink()
        if len(place) * (UNIT_COST + 8) + text_bytes + flat.nbytes + 12 * len(place) <= self.memo_bytes // 2:
            self.part_place, self.part_bytes = place, text_bytes
            self.part_start, self.part_size = self._store(flat) + np.cumsum(size) - size, size

    def _compose(self, part_rows: np.ndarray, count: np.ndarray) -> None:
        """Stores new units after those held, each made of `count` parts."""
        rows, end = len(self.place), len(self.place) + len(count)
        self.start, self.size = _grown(self.start, end), _grown(self.size, end)
        lengths = self.part_size[part_rows].astype(np.int64)
        run = np.concatenate([[0], np.cumsum(lengths)])
        bound = np.concatenate([[0], np.cumsum(count)])
        self.size[rows:end] = run[bound[1:]] - run[bound[:-1]]
        self.start[rows:end] = self._store(self.flat[ragged_index(self.part_start[part_rows], lengths)]) + run[bound[:-1]]


class WordTokenizer(PartMemo):
    """ids(texts) of a `tokenizers` word BPE file, equal to encode_batch(add_special_tokens=False)."""

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.full.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.full.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        super().__init__(memo_bytes)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens, sizes of each)."""
        ids = np.asarray(self.bare.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) == len(words):
            return ids, np.diff(cut, prepend=0)
        each = [self.bare.encode(w, add_special_tokens=False).ids for w in words]  # a vocabulary without end marks
        return np.concatenate([np.asarray(x, np.uint32) for x in each]), np.asarray([len(x) for x in each])

    def _word_rows(self, words: list[str]) -> np.ndarray:
        """Rows of pre-tokens, after encoding those not met yet."""
        new = list({w for w in words if w not in self.part_place})
        rows = len(self.part_place)
        self.part_start, self.part_size = _grown(self.part_start, rows + len(new)), _grown(self.part_size, rows + len(new))
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            ids, size = self._encode(part)
            end = rows + at + len(part)
            self.part_start[rows + at : end] = self._store(ids) + np.cumsum(size) - size
            self.part_size[rows + at : end] = size
        self.part_place.update(zip(new, range(rows, rows + len(new))))
        self.part_bytes += sum(map(len, new))
        return np.asarray(list(map(self.part_place.__getitem__, words)), np.int64)

    def _learn(self, units: list[bytes]) -> None:
        """Adds the ids of new units to the memo."""
        rows = len(self.place)
        parts = [pretokens(u.decode("utf-8", "replace")) for u in units]
        word_rows = self._word_rows([w for p in parts if p for w in p])
        self._compose(word_rows, np.asarray([len(p) if p is not None else 0 for p in parts]))
        for i, p in enumerate(parts):
            if p is None:  # the library's whole pipeline
                ids = np.asarray(self.full.encode(units[i].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
                self.start[rows + i], self.size[rows + i] = self._store(ids), len(ids)
        self.place.update(zip(units, range(rows, rows + len(units))))

    def ids(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a chunk, and offsets of each document in them."""
        starts_here = np.zeros(len(raw) + 1, bool)
        if len(raw):
            space = IS_SPACE[raw]
            starts_here[1:-1] = ~space[1:] & space[:-1]
        starts_here[off] = True
        return self.unit_ids(raw, np.flatnonzero(starts_here), off)


_loaded: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker, with its memo."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
