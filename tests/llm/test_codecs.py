"""Simple-8b, the tokenizer memos and WAV payloads: exact round trips and equality with the libraries."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from latticeforge.llm import media, simple8b
from latticeforge.llm import sentencepiece_codec as pieces
from latticeforge.llm._kernels import text_buffers, text_chunks
from latticeforge.llm.wordwise import WordTokenizer, default_vocabulary

TEXTS = [
    None, "", " ", "\n\t ", "Hello World", "don't we'll I'M", "a<|endoftext|>b <|startoftext|>", "x" * 3000, "İstanbul ﬁ ½ ² 1234 é é ñ", "汉字 かな 한국어", "a\u00a0b\u2003c\x1cd\x85e", "price: 3,50€!!", "😀‍👩 ok", "тест ТЕСТ",
    "\x01 \x7f", "word " * 400, "the the\nthe. The", "▁ lower▁one ▁▁", "tab\tand\r\nlines\n\n", "   three", "end   ",
]


@pytest.mark.parametrize("values", [[], [0], [2**64 - 1], [1, 2**64 - 1, 0, 15 << 60, 5], [0] * 61, list(range(300)), [1 << k for k in range(64)]])
def test_simple8b_round_trip(values):
    x = np.asarray(values, np.uint64)
    assert simple8b.decode(simple8b.encode(x)).tolist() == x.tolist()


def test_simple8b_random_and_size():
    rng = np.random.default_rng(3)
    for high in (1, 2, 7, 49_408, 2**20, 2**33, 2**63):
        x = rng.integers(0, high, 5000).astype(np.uint64)
        assert (simple8b.decode(simple8b.encode(x)) == x).all()
    assert len(simple8b.encode(np.ones(6000, np.uint64))) == 12 + 8 * 100
    with pytest.raises(ValueError):
        simple8b.decode(b"nope")


@pytest.mark.parametrize("limit", [64 << 20, 8])
def test_word_tokenizer_equals_library(limit):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_vocabulary())
    own = WordTokenizer(default_vocabulary(), memo_bytes=limit)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abCé .,'1<|>\n汉ß") for _ in range(rng.randrange(80))) for _ in range(300)]
    for _ in range(2):
        ids, at = own.ids(*text_buffers(pa.array(texts)))
        want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want


def test_sentencepiece_equals_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    table = pieces.load_pieces(pieces.default_model())
    own = pieces.PieceTokenizer(table)
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("abcdeéß ▁\n\t<0x1汉😀then  ing") for _ in range(rng.randrange(60))) for _ in range(500)]
    texts += ["".join(rng.choice("thersnaiodlc") for _ in range(rng.randrange(1, 30))) for _ in range(2000)]
    ids, at = own.ids(*text_buffers(pa.array(texts)))
    want = [library.encode(t or "") for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
    assert pieces.decode_ids(table, ids, at) == [library.decode(w) for w in want]


def test_sentencepiece_long_texts_without_spaces():
    """Parts longer than a block: joined blocks, blocks that never meet, and padded last blocks."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    own = pieces.PieceTokenizer(pieces.load_pieces(pieces.default_model()))
    rng = random.Random(4)
    words = "the of and training corpora language repeated holiday ization".split()
    texts = ["a" * 5000, "ab" * 2000 + "c" * 999, "".join(rng.choice(words) for _ in range(150_000))]
    texts += ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (126, 127, 128, 129, 191, 192, 193, 255, 256, 257, 20_000)]
    texts += ["".join(rng.choice("aab") for _ in range(rng.randrange(100, 3000))) for _ in range(20)]
    texts += ["".join(rng.choice("abcé汉_/=01") for _ in range(5000)), "x" * 300 + "汉" + "x" * 300]
    ids, at = own.ids(*text_buffers(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [library.encode(t) for t in texts]


def test_unigram_scores_add_up():
    """A made-up unigram table against a plain dynamic program."""
    names = ["a", "b", "c", "ab", "bc", "abc", "ca", "▁", "▁a"]
    scores = [-3.0, -3.1, -3.3, -4.0, -4.1, -6.9, -5.0, -2.0, -4.6]
    texts = [n.replace("▁", " ").encode() for n in names]
    table = pieces.PieceTable("unigram", np.arange(len(names)), np.asarray(scores), np.asarray([pieces._value(n) for n in names], np.uint64), np.asarray([len(n) for n in names]), np.zeros(0, np.int64), 99, texts)
    own = pieces.PieceTokenizer(table)
    rng = random.Random(3)
    for _ in range(200):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
        ids, _ = own.ids(*text_buffers(pa.array([word])))
        full = "▁" + word
        best = [0.0] + [-1e9] * len(full)
        for i in range(1, len(full) + 1):
            for n, s in zip(names, scores):
                if full[:i].endswith(n):
                    best[i] = max(best[i], best[i - len(n)] + s)
        assert abs(sum(scores[i] for i in ids) - best[-1]) < 1e-9 and "".join(names[i] for i in ids) == full


@pytest.mark.parametrize("text", [b"", b"a", b"x" * 64, b"y" * 65, bytes(range(256)) * 40])
def test_wav_payloads(text):
    payload = media.padded(text)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(text) and not payload[len(text) :].strip(b"\0")
    stored = media.to_wav(payload)
    assert stored[:4] == b"RIFF" and media.from_wav(stored) == payload
    samples = np.frombuffer(payload, np.uint8)
    prints = media.fingerprints(samples)
    assert (prints == media.fingerprints(samples.copy())).all() and (np.diff(prints) >= 0).all()


def test_fingerprints_follow_the_sound():
    t = np.arange(20_000)
    tone = lambda f, amp: amp * np.sin(2 * np.pi * f * t / media.RATE)
    beat = 1 + 0.5 * np.sin(2 * np.pi * t / 3000)
    low, high = (np.clip(128 + beat * tone(f, 50), 0, 255).astype(np.uint8) for f in (440, 1800))
    frames, bins = media.peaks(low)
    assert len(frames) and (np.abs(bins[bins >= 16] - 440 / media.RATE * media.FRAME) < 2).any()
    assert set(media.fingerprints(low).tolist()) != set(media.fingerprints(high).tolist())
    assert len(media.fingerprints(np.full(5000, 128, np.uint8))) == 0


def test_chunks_hold_whole_documents():
    texts = ["a" * 10, None, "b" * 100, "", "c" * 5] * 20
    batch = pa.record_batch({"text": pa.array(texts)})
    parts = [(b.num_rows, bytes(raw), off) for b, raw, off in text_chunks(iter([batch.slice(0, 40), batch.slice(40)]), size=64)]
    assert sum(n for n, *_ in parts) == 100 and b"".join(r for _, r, _ in parts) == "".join(t or "" for t in texts).encode()
    assert all(off[-1] == len(raw) and len(off) == n + 1 for n, raw, off in parts)
    assert zlib.crc32(b"") == 0


def test_memo_is_bounded_by_bytes():
    """However many units come, the memo stays near its bytes, keeps what comes often, and ids stay the library's."""
    rng = random.Random(2)
    own = WordTokenizer(default_vocabulary(), memo_bytes=3 << 20)
    often = " ".join("".join(rng.choices("etaoinsh", k=5)) for _ in range(300))
    kept = []
    for _ in range(12):
        text = often + " " + " ".join("".join(rng.choices("etaoinshrdlu", k=9)) for _ in range(4000))
        raw, off = text_buffers(pa.array([text]))
        ids, _ = own.ids(raw, off)
        assert ids.tolist() == own.full.encode(text, add_special_tokens=False).ids
        kept.append(own.held_bytes())
    assert max(kept) < 8 << 20 and sum(kept[k] > kept[k + 1] for k in range(11)) >= 2
    assert sum(u in own.place for u in (w.encode() + b" " for w in often.split())) > 200
