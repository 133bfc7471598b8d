"""Byte-level BPE of a `tokenizers` file over whole columns, through a memo of units as in `wordwise`.

Text is cut only where the pre-token pattern is certain to end a token, whatever stands around; a unit is split by the pattern and
its pre-tokens are kept as parts.  Units with characters where pattern engines might differ go through the library whole.
"""

from __future__ import annotations

import numpy as np
import regex

from .wordwise import PartMemo, _grown

#: The pattern of the vocabulary's byte-level pre-tokenizer (fixed values).
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Characters whose classes are the same in all engines.
PLAIN = regex.compile("[\t\n\r -~\xa1-į]*")
SEPARATOR = "\0"  # not plain

# Classes of bytes for cutting.
LETTER, DIGIT, MARK, QUOTE, SPACE, WHITE, OTHER = range(7)  # the first four are no white space
KIND = np.full(256, OTHER, np.uint8)
KIND[0x21:0x7F] = MARK
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KIND[0x30:0x3A] = DIGIT
KIND[0x27], KIND[0x20] = QUOTE, SPACE
KIND[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = WHITE
#: ENDS[a, b]: a pre-token ends between a byte of class a and a following one of class b.
ENDS = np.zeros((7, 7), bool)
for _a, _next in ((LETTER, (DIGIT, MARK, QUOTE, SPACE, WHITE)), (DIGIT, (LETTER, MARK, QUOTE, SPACE, WHITE)), (MARK, (LETTER, DIGIT, SPACE, WHITE)), (QUOTE, (SPACE, WHITE))):
    ENDS[_a, list(_next)] = True
ENDS = ENDS.ravel()
#: UTF-8 of the white space beyond ASCII (fixed values of Unicode).
WIDE_SPACES = tuple(c.encode() for c in "\x85\xa0                　")


def certain_cuts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places in documents' bytes where a pre-token ends for certain: flags for 0..len(raw)."""
    cut = np.zeros(len(raw) + 1, bool)
    if len(raw) < 3:
        return cut
    kind = KIND[raw]
    cut[1:-1] = ENDS[kind[:-1] * np.uint8(7) + kind[1:]]
    blank = kind == SPACE
    solid = kind < SPACE
    solid[off[:-1][off[:-1] < len(raw)]] = False  # nothing follows the end of a document
    cut[:-2] |= blank[:-1] & solid[1:]  # a space goes with what follows it
    last = np.flatnonzero((kind[1:-1] == WHITE) & solid[2:] & (kind[:-2] != OTHER)) + 1  # other white space stands alone, also from white space before it
    cut[last] = cut[last + 1] = True
    for i in (np.flatnonzero(blank[1:-1] & (kind[:-2] == OTHER) & (kind[2:] == OTHER)) + 1).tolist():
        cut[i] = raw[i - 1] >= 0x80 and not raw[max(0, i - 3) : i].tobytes().endswith(WIDE_SPACES)
    return cut


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes for themselves, the others in order from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteTokenizer(PartMemo):
    """ids of a `tokenizers` byte-level BPE file, equal to encode(add_special_tokens=False) with special tokens' strings as plain text."""

    def __init__(self, path: str, memo_bytes: int) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        self.bare = Tokenizer(self.full.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(SEPARATOR, "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        special = {i for i, t in self.full.get_added_tokens_decoder().items() if t.special}
        letters, vocabulary = byte_of_letter(), self.full.get_vocab()
        self.texts = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.texts[i] = piece.encode() if i in special else bytes(letters[c] for c in piece)
        super().__init__(memo_bytes)

    def _learn(self, units: list[bytes]) -> None:
        rows, whole, parts = len(self.place), {}, []
        for k, unit in enumerate(units):
            text = unit.decode("utf-8", "replace")
            if not PLAIN.fullmatch(text):
                whole[k] = np.asarray(self.full.encode(text, add_special_tokens=False).ids, np.uint32)
                parts.append([])
            else:
                parts.append([text] if text.isascii() and text[1:].isalpha() and (text[0] == " " or text[0].isalpha()) else PATTERN.findall(text))
        self._compose(self._part_rows([p for ps in parts for p in ps]), np.asarray([len(ps) for ps in parts]))
        for k, ids in whole.items():
            self.start[rows + k], self.size[rows + k] = self._store(ids), len(ids)
        self.place.update(zip(units, range(rows, rows + len(units))))

    def _part_rows(self, parts: list[str]) -> np.ndarray:
        """Rows of pre-tokens, after encoding those not met yet."""
        new = list({p for p in parts if p not in self.part_place})
        rows = len(self.part_place)
        self.part_start, self.part_size = _grown(self.part_start, rows + len(new)), _grown(self.part_size, rows + len(new))
        for at in range(0, len(new), 4096):
            own = new[at : at + 4096]
            coded = self.bare.encode(SEPARATOR.join(own), add_special_tokens=False)
            size = np.bincount(np.asarray(coded.word_ids, np.int64), minlength=len(own))
            self.part_start[rows + at : rows + at + len(own)] = self._store(np.asarray(coded.ids, np.uint32)) + np.cumsum(size) - size
            self.part_size[rows + at : rows + at + len(own)] = size
        self.part_place.update(zip(new, range(rows, rows + len(new))))
        self.part_bytes += sum(map(len, new))
        return np.asarray(list(map(self.part_place.__getitem__, parts)), np.int64)

    def ids(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a chunk, and offsets of each document in them."""
        cut = certain_cuts(raw, off)
        cut[off] = True
        return self.unit_ids(raw, np.flatnonzero(cut), off)
