"""Operator 10: secret scans with a recursive decoding worklist.

Base kinds are matched on the text itself.  Then layers are unwrapped: URL and Unicode escapes turn
a whole layer into another one with a position map, and so does text of two or four bytes a
character; base64 runs open layers that map to the run as a whole, and zlib, gzip, bzip2 or xz data
anywhere in a decoded layer open layers that map to the data.  A run is read from each of its first
four characters, so others of the alphabet may stand before it.  Runs that only line breaks separate
are joined; what then lies on several lines maps to all lines wrapped alike.  Every new layer is scanned with the
base patterns and unwrapped in turn until nothing new appears; layers already seen at the same place
are not entered again, so cycles end.  A secret found in a layer is reported at the span of the
original text that holds it.  Base spans always stay, decoding only adds spans.  Where a layer has URL escapes, `+` is also read as a
space.  An escape of an escape of an escape (`%252525...`) beyond DEEP levels is peeled to three levels in one step, so that nesting costs
time in proportion to the text; what lies between looks the same but for the number of levels.

Decoded bytes stay one character each (Latin-1): all patterns are ASCII, so text in UTF-8 or any
other ASCII-based encoding is found, binary fields beside it do no harm and compressed data is kept.

Defined results: null and empty text has no spans; offsets are code points, ends exclusive; of
compressed data that is cut off or damaged, what comes before is scanned; very long texts are chunks of their own; compressed data
that inflates beyond LAYER_BYTES is inflated piece by piece, each a layer of its own that begins with the end of the one
before (OVERLAP, or the base64 run that the piece ends in, up to half a piece), so memory is bounded and nothing is dropped: only
what a further layer holds beyond half a piece, compressed once more, is seen as cut off where a piece ends.  Equal pieces are scanned
once.  Repeated rows and null doc_ids are rows like any other; an empty table gives no rows; further columns are ignored (`redact_secrets` keeps them).
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _session
from ._kernels import LOWER_ASCII, text_chunks

#: Output order of kinds that start at the same place.
KINDS = ("assign", "access", "hex")
#: Bytes of decoded content that are a layer at most, and those that the next piece begins with.
LAYER_BYTES, OVERLAP = 16 << 20, 1 << 16
#: Levels of one nested escape that are peeled one by one.
DEEP = 5
#: The shortest base64 run that can hold a secret: 14 bytes, without padding.
MIN_BASE64 = 19


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
ASSIGN = re.compile(rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
_DEEP_URL = rf"%(?:25){{{DEEP},}}(?=[0-9A-Fa-f]{{2}})"
_DEEP_UNICODE = rf"\\(?:u005[cC]){{{DEEP},}}(?=u[0-9A-Fa-f]{{4}})|\\(?:x5[cC]){{{DEEP},}}(?=x[0-9A-Fa-f]{{2}})"
URL_ESCAPE = re.compile(rf"{_DEEP_URL}|(?:%[0-9A-Fa-f]{{2}}(?<!%25)|%25(?!(?:25){{{DEEP - 1},}}[0-9A-Fa-f]{{2}}))+")
UNICODE_ESCAPE = re.compile(rf"{_DEEP_UNICODE}|(?:\\u[0-9A-Fa-f]{{4}}|\\U[0-9A-Fa-f]{{8}}|\\u\{{[0-9A-Fa-f]{{1,6}}\}}|\\x[0-9A-Fa-f]{{2}})+")
_UNICODE_ITEM = re.compile(r"\\[uUx]\{?([0-9A-Fa-f]+)\}?")
BASE64_RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_BASE64},}}={{0,2}}")
#: ASCII text of two or four bytes a character, in either byte order.
WIDE = re.compile(r"(?:(?:[\t\n\r\x20-\x7e]\0){7,}|(?:[\t\n\r\x20-\x7e]\0{3}){7,})[\t\n\r\x20-\x7e]?")
_ZLIB = "|".join(f"\\x{c:02x}[{''.join(f'\\x{f:02x}' for f in range(256) if (c << 8 | f) % 31 == 0 and not f & 32)}]" for c in range(0x08, 0x80, 0x10))
#: How compressed data starts.
STREAM = re.compile(rf"\x1f\x8b\x08|BZh[1-9](?=1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|{_ZLIB}")
BYTES = re.compile(r"[\0-\xff]*")
#: Bytes of a broken zlib stream that tell it from chance where it does not start a layer.
SURE_BYTES = 64
#: Bytes that go into a decompressor at first, and into and out of one later.
FIRST_PIECE, PIECE = 1 << 10, 1 << 16
_ALPHABET = "A-Za-z0-9+/_-"
BASE64_BLOCK = re.compile(rf"(?<![{_ALPHABET}])[{_ALPHABET}]++(?:[ \t]*+[\r\n]\s*+(?!-----)[{_ALPHABET}]++)+={{0,2}}", re.ASCII)
_AFTER = re.compile(r"[/_-]")
_CLEAN = re.compile(r"[\t\n\r\x20-\x7e]{12}")
_LINE = re.compile(rf"[{_ALPHABET}]+")
_RUN_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-= \t\r\n"

#: What every match of a pattern begins with or holds.
SIGNS = {URL_ESCAPE: "%", UNICODE_ESCAPE: "\\", WIDE: "\0"}

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """All base matches, by start, then kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8] if ":" in text or "=" in text else []
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return ordered(found)


def ordered(spans) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _unescape_url(run: str) -> str:
    if len(run) > 3 and run[3] != "%":  # a deep escape
        return "%252525"
    return bytes.fromhex(run.replace("%", "")).decode("latin-1")


def _unescape_unicode(run: str) -> str:
    if (head := re.match(r"\\(u005[cC]|x5[cC])\1", run, re.IGNORECASE)) is not None:  # a deep escape
        return "\\" + head[1] * 3
    codes = [int(m[1], 16) for m in _UNICODE_ITEM.finditer(run)]
    joined, k = [], 0
    while k < len(codes):
        c = codes[k]
        if 0xD800 <= c < 0xDC00 and k + 1 < len(codes) and 0xDC00 <= codes[k + 1] < 0xE000:
            c, k = 0x10000 + ((c - 0xD800) << 10) + codes[k + 1] - 0xDC00, k + 1
        joined.append(chr(c) if c < 0xD800 or 0xE000 <= c < 0x110000 else "\ufffd")
        k += 1
    return "".join(joined)


def _narrowed(run: str) -> str:
    return run.replace("\0", "")


def _worker(head: str):
    """A decompressor for data that starts like this."""
    if head[:3] == "BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if head[0] == "\xfd" else zlib.decompressobj(47)


def _member(text: str, at: int, careful: int | None = None, skip: int = 0) -> Iterator[bytes]:
    """The content of the compressed data at this place after `skip` bytes; returns (its end, whether it is whole).

    A decompressor that fails keeps back what its last call made, so all is then read again, byte by
    byte from the piece of that call (`careful`) on.
    """
    worker, fed, step, made = _worker(text[at : at + 3]), at, FIRST_PIECE, 0
    while not worker.eof:
        end = BYTES.match(text, fed, fed + (step if careful is None or fed < careful else 1)).end()
        if end == fed:
            return fed, False
        if careful is not None:
            end = min(end, max(careful, fed + 1))
        data = text[fed:end].encode("latin-1")
        try:
            while not worker.eof:
                part = worker.decompress(data, PIECE)
                made += len(part)
                if made > skip and part:
                    yield part[max(0, len(part) - (made - skip)) :]
                data = getattr(worker, "unconsumed_tail", b"")
                if not data and len(part) < PIECE:
                    break
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            if careful is None:
                return (yield from _member(text, at, fed, made))
            return fed, False
        fed, step = end, PIECE
    return fed - len(worker.unused_data), True


class _Inflated:
    """All that starts at this place of a layer and follows it as further members: content, end, whole."""

    def __init__(self, text: str, at: int) -> None:
        self.text, self.end, self.whole = text, at, True

    def __iter__(self) -> Iterator[bytes]:
        while self.whole and STREAM.match(self.text, self.end):
            self.end, self.whole = yield from _member(self.text, self.end)


def _streams(text: str) -> Iterator[tuple[int, int, list[bytes] | None, bool]]:
    """(start, end, content, whether it is whole) of all compressed data in a layer; None for content beyond LAYER_BYTES."""
    at = 0
    while head := STREAM.search(text, at):
        start, size, parts, data = head.start(), 0, [], _Inflated(text, head.start())
        for part in data:
            size += len(part)
            if size <= LAYER_BYTES:
                parts.append(part)
            else:
                parts.clear()
        # Two bytes alone may be chance; then what a broken stream gives is noise, and short.
        sure = data.whole or head[0][0] in "\x1fB\xfd" or data.end - start >= SURE_BYTES or start == 0 and head[0][0] == "x"
        if size and sure:
            yield start, data.end, parts if size <= LAYER_BYTES else None, data.whole
        at = data.end if data.whole and data.end > start else start + 1


def _pieces(text: str, at: int) -> Iterator[str]:
    """The content of compressed data in overlapping pieces."""
    parts, size = [], 0
    for part in _Inflated(text, at):
        parts.append(part)
        size += len(part)
        if size >= LAYER_BYTES:
            piece = b"".join(parts)
            yield piece.decode("latin-1")
            run = len(piece.rstrip(_RUN_BYTES))
            parts = [piece[max(len(piece) // 2, min(len(piece) - OVERLAP, run)) :]]
            size = len(parts[0])
    yield b"".join(parts).decode("latin-1")


def _decoded(body: str) -> str:
    """What base64 characters hold; a last one that fills no byte is left out."""
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4)).decode("latin-1")


def _glued(body: str, shift: int, text: str) -> int | None:
    """The first place after a separator from which what was read from `shift` on is clean text or compressed data."""
    for m in _AFTER.finditer(body):
        at = m.end()
        if at % 4 == shift and (_CLEAN.match(text, k := (at - shift) // 4 * 3) or STREAM.match(text, k)):
            return at
    return None


class _Layer:
    """A text and, for each of its characters, the original span it came from (or one for all)."""

    def __init__(self, text: str, starts, ends) -> None:
        self.text, self.starts, self.ends = text, starts, ends

    @property
    def mapped(self) -> bool:
        """Whether places inside it are places of the original text."""
        return not isinstance(self.starts, int) and type(self) is _Layer

    def place(self, start: int, end: int) -> tuple[int, int] | None:
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return int(self.starts[start]), int(self.ends[end - 1])

    def derived(self, text: str, starts, ends) -> _Layer:
        return _Layer(text, starts, ends)

    def opened(self, run: re.Match) -> Iterator[_Layer]:
        """The layers in a base64 run."""
        if (where := self.place(*run.span())) is None:
            return
        body = run[0].rstrip("=")
        for shift in range(4):
            text = _decoded(body[shift:])
            at = _glued(body, shift, text) if shift and self.mapped else None
            if at is None:
                yield _Layer(text, *where)
            else:
                starts = np.full(len(text), where[0])
                starts[(at - shift) // 4 * 3 :] = self.place(run.start() + at, run.end())[0]
                yield _Layer(text, starts, np.full(len(text), where[1]))

    def joined(self, block: re.Match) -> Iterator[_Layer]:
        """The layers in base64 runs that line breaks separate."""
        lines = list(_LINE.finditer(block[0]))
        body = "".join(m[0] for m in lines)
        if len(body) < MIN_BASE64 or (where := self.place(*block.span())) is None:
            return
        if self.mapped:
            cut = np.cumsum([len(m[0]) for m in lines])
            spans = [self.place(block.start() + m.start(), block.start() + m.end()) for m in lines]
            spans[-1] = (spans[-1][0], where[1])  # with the padding
            gaps = [block[0][a.end() : b.start()] for a, b in zip(lines, lines[1:])]
            wrap = _wrap([len(m[0]) for m in lines], gaps, spans)
        for shift in range(4):
            text = _decoded(body[shift:])
            if not self.mapped:
                yield _Layer(text, *where)
            else:
                k = np.arange(len(text))
                first = shift + k // 3 * 4 + k % 3
                yield _Wrapped(text, np.searchsorted(cut, first, "right"), np.searchsorted(cut, first + 1, "right"), wrap)

    def replaced(self, pattern: re.Pattern, decode, without=()) -> _Layer | None:
        """This layer with every match of the pattern decoded in place, but for those in the spans `without`."""
        if not any(c in self.text for c in SIGNS[pattern]):
            return None
        parts, starts, ends, at, fixed = [], [], [], 0, isinstance(self.starts, int)
        for m in pattern.finditer(self.text):
            if _within(without, m):
                continue
            new = decode(m[0])
            parts += [self.text[at : m.start()], new]
            if not fixed:
                s, e = int(self.starts[m.start()]), int(self.ends[m.end() - 1])
                starts += [self.starts[at : m.start()], np.full(len(new), s)]
                ends += [self.ends[at : m.start()], np.full(len(new), e)]
            at = m.end()
        if not parts:
            return None
        text = "".join([*parts, self.text[at:]])
        if fixed:
            return self.derived(text, self.starts, self.ends)
        return self.derived(text, np.concatenate([*starts, self.starts[at:]]), np.concatenate([*ends, self.ends[at:]]))


def _within(spans: list[tuple[int, int]], m: re.Match) -> bool:
    """Whether a match starts in one of some ordered spans."""
    return bool(spans) and (k := bisect_right(spans, (m.start(), 1 << 62))) > 0 and m.start() < spans[k - 1][1]


def _wrap(sizes: list[int], gaps: list[str], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each line the span of its group: lines of one length and a shorter last one, with the same breaks."""
    out, at = [], 0
    while at < len(sizes):
        end = at + 1
        while end < len(sizes) and sizes[end] == sizes[at] and gaps[end - 1] == gaps[at]:
            end += 1
        end += end < len(sizes) and sizes[end] < sizes[at] and gaps[end - 1] == gaps[at]
        out += [(spans[at][0], spans[end - 1][1])] * (end - at)
        at = end
    return out


class _Wrapped(_Layer):
    """What joined lines hold; `starts` and `ends` are numbers of lines, `wrap` has the span of each line's group."""

    def __init__(self, text: str, starts, ends, wrap: list[tuple[int, int]]) -> None:
        super().__init__(text, starts, ends)
        self.wrap = wrap

    def place(self, start: int, end: int) -> tuple[int, int] | None:
        """None for what lies on one line: the line itself is a run that shows it."""
        first, last = int(self.starts[start]), int(self.ends[end - 1])
        return (self.wrap[first][0], self.wrap[last][1]) if first < last else None

    def derived(self, text: str, starts, ends) -> _Layer:
        return _Wrapped(text, starts, ends, self.wrap)


def _widest(found: set[Span], wrapped: set[tuple[int, int]]) -> set[Span]:
    """Without what a single line showed inside a span over several lines."""
    out = set()
    for kind in KINDS:
        reach = -1
        for s, e in sorted(((s, e) for k, s, e in found if k == kind), key=lambda x: (x[0], -x[1])):
            if (s, e) in wrapped:
                reach = max(reach, e)
            if (s, e) in wrapped or e > reach:
                out.add((kind, s, e))
    return out


def _unwrapped(layer: _Layer, root: bool) -> Iterator[_Layer]:
    """The layers one step below a layer, one at a time."""
    packed = []
    for start, end, content, whole in () if root else _streams(layer.text):
        if whole:
            packed.append((start, end))
        if (where := layer.place(start, end)) is not None:
            for piece in [b"".join(content).decode("latin-1")] if content is not None else _pieces(layer.text, start):
                yield _Layer(piece, *where)
    steps = [(layer, URL_ESCAPE, _unescape_url), (layer, UNICODE_ESCAPE, _unescape_unicode)]
    if "+" in layer.text and "%" in layer.text:
        steps.append((layer.derived(layer.text.replace("+", " "), layer.starts, layer.ends), URL_ESCAPE, _unescape_url))
    if not root:
        steps.append((layer, WIDE, _narrowed))
    for source, pattern, decode in steps:
        if (new := source.replaced(pattern, decode, packed)) is not None:
            yield new
    for m in BASE64_RUN.finditer(layer.text):
        if not _within(packed, m):
            yield from layer.opened(m)
    for m in BASE64_BLOCK.finditer(layer.text):
        if not _within(packed, m):
            yield from layer.joined(m)


def added_spans(text: str, base: list[Span]) -> set[Span]:
    """Spans of secrets that only decoding shows."""
    place = np.arange(len(text))
    root = _Layer(text, place, place + 1)
    work = [(root, _unwrapped(root, True))]
    seen, found, wrapped, known = set(), set(), set(), set(base)
    while work:
        layer, below = work[-1]
        new = next(below, None)
        if new is None:
            work.pop()
            continue
        if not new.text:
            continue
        where = (new.starts, new.ends) if isinstance(new.starts, int) else (*new.wrap[0], *new.wrap[-1]) if isinstance(new, _Wrapped) else (int(new.starts[0]), int(new.starts[-1]), int(new.ends[0]), int(new.ends[-1]))
        key = (hashlib.blake2b(new.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), where)
        if key in seen:
            continue
        seen.add(key)
        work.append((new, _unwrapped(new, False)))
        spans = {(kind, *at) for kind, s, e in base_spans(new.text) if (at := new.place(s, e)) is not None}
        found |= spans
        if isinstance(new, _Wrapped):
            wrapped.update(span[1:] for span in spans)
        elif isinstance(layer, _Wrapped):
            wrapped.add(where)
    return (_widest(found, wrapped) if wrapped else found) - known


def scan_text(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), both in output order."""
    base = base_spans(text)
    return base, ordered({*base, *added_spans(text, base)})


_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[ord(c) for c in "0123456789abcdef"]] = True
_BASE64_BYTE = np.zeros(256, bool)
_BASE64_BYTE[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True
_ESCAPED = re.compile(rb"%[0-9A-Fa-f]{2}|\\[uUx]")


def _with_runs(member: np.ndarray, off: np.ndarray, least: int) -> np.ndarray:
    """Which documents hold a run of at least `least` member bytes."""
    outside = np.flatnonzero(~member)
    cut = np.unique(np.concatenate([outside, off - 1, [-1, len(member)]]))
    long = np.flatnonzero(np.diff(cut) > least)
    out = np.zeros(len(off) - 1, bool)
    out[np.searchsorted(off, cut[long] + 1, "right") - 1] = True
    return out


def _line_breaks(raw: np.ndarray) -> np.ndarray:
    """Which bytes are in white space that holds a line break."""
    space, ends = (raw == 32) | ((raw >= 9) & (raw <= 13)), (raw == 10) | (raw == 13)
    head = np.flatnonzero(np.concatenate([[True], space[1:] != space[:-1]]))[: len(raw)]
    return np.repeat(space[head] & np.logical_or.reduceat(ends, head), np.diff(np.append(head, len(raw)))) if len(raw) else ends


def candidates(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which documents can hold anything to report: all others have no secret in any layer."""
    out = _with_runs(_HEX_BYTE[raw], off, 32)
    maybe = _with_runs(_BASE64_BYTE[raw] | _line_breaks(raw), off, MIN_BASE64)
    data, low = raw.tobytes(), LOWER_ASCII[raw].tobytes()
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        if not out[i]:
            out[i] = maybe[i] or any(low.find(w, a, b) >= 0 for w in (b"passw", b"secret", b"token", b"api")) or data.find(b"AKIA", a, b) >= 0 or _ESCAPED.search(data, a, b) is not None
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for batch, raw, off in text_chunks(batches):
        n = batch.num_rows
        counts, digest, spans = np.zeros((3, n), np.int64), [nothing] * n, [""] * n
        for i in np.flatnonzero(candidates(raw, off)).tolist():
            base, every = scan_text(raw[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
            for k, kind in enumerate(KINDS):
                counts[k, i] = sum(s[0] == kind for s in base)
            digest[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
            spans[i] = _joined(every)
        yield pa.record_batch(
            [batch.column(0), *(pa.array(c) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    _session.tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan_batches, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str) -> str:
    """The text with every found span replaced by a mark of its kind; overlapping spans become one."""
    out, at = [], 0
    for kind, start, end in scan_text(text)[1]:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """`docs` with secrets masked in text (and n_chars, where there is one, counted anew)."""
    _session.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, off in text_chunks(batches):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            for i in np.flatnonzero(candidates(raw, off)).tolist():
                texts[i] = redacted(texts[i])
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(_session.documents(spark, sf_dir))
