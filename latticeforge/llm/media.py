"""Operator 5: text payloads as WAV media columns with spectral-peak fingerprints.

A payload is stored losslessly as the 8-bit mono samples of a WAV file made by the `wave` module;
features are computed from the bytes read back from that file.  A short-time Fourier transform gives
magnitudes; the strongest bin of each band that also tops its neighbours in time is a peak; each
peak is paired with the next few peaks nearby, and a pair becomes one number: the anchor's frame in
the high 32 bits (the time code), and both bins and their distance in time in the low ones.

Defined results: null text is empty, its payload is 64 zero bytes; a silent payload has no pairs;
equal texts give equal values, also under repeated or null doc_ids; a very long text is a chunk and a file of its own; of peaks
or bins of one height the lowest counts; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _session
from ._kernels import list_column, text_chunks

UNIT = 64
RATE = 8000
FRAME, HOP = 512, 256
#: Frequency bands: [first bin, end) of each; bin 0 is left out.
BANDS = ((1, 16), (16, 48), (48, 112), (112, 257))
#: Later peaks that a peak is paired with, and how many frames away they may be.
FAN, REACH = 3, 31
#: Frames transformed at once, so a long payload needs no more memory than a short one.
FRAMES_AT_ONCE = 4096
_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes) -> bytes:
    target = io.BytesIO()
    with wave.open(target, "wb") as out:
        out.setnchannels(1)
        out.setsampwidth(1)
        out.setframerate(RATE)
        out.writeframes(payload)
    return target.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as source:
        return source.readframes(source.getnframes())


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, bins) of the spectral peaks, in order of time, then frequency."""
    x = samples.astype(np.float32) - 128
    frames = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    x = np.concatenate([x, np.zeros((frames - 1) * HOP + FRAME - len(x), np.float32)])
    views = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    top, where = np.empty((len(BANDS), frames), np.float32), np.empty((len(BANDS), frames), np.int64)
    for at in range(0, frames, FRAMES_AT_ONCE):
        size = np.abs(np.fft.rfft(views[at : at + FRAMES_AT_ONCE] * _WINDOW, axis=1))
        for b, (low, high) in enumerate(BANDS):
            best = size[:, low:high].argmax(axis=1)
            where[b, at : at + len(size)] = best + low
            top[b, at : at + len(size)] = size[np.arange(len(size)), best + low]
    edge = np.full((len(BANDS), 1), -1, np.float32)
    is_peak = (top > np.concatenate([edge, top[:, :-1]], axis=1)) & (top >= np.concatenate([top[:, 1:], edge], axis=1)) & (top > 1e-3)
    frame, band = np.nonzero(is_peak.T)
    return frame, where[band, frame]


def fingerprints(samples: np.ndarray) -> np.ndarray:
    """Time-coded pairs of peaks as int64, ascending."""
    frame, bins = peaks(samples)
    found = []
    for k in range(1, FAN + 1):
        gap = frame[k:] - frame[:-k]
        near = gap <= REACH
        found.append((frame[:-k][near] << 32) | (bins[:-k][near] << 16) | (bins[k:][near] << 5) | gap[near])
    return np.sort(np.concatenate(found))


def wav_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's payload as WAV bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, off in text_chunks(batches):
            data = raw.tobytes()
            media = [to_wav(padded(data[a:b])) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.record_batch([batch.column(0), pa.array(np.diff(off)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    _session.tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


MEDIA_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fingerprints array<long>"


def media_features(media: DataFrame) -> DataFrame:
    """Digests and fingerprints of WAV media (doc_id, n_bytes, media), read back from its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, off in text_chunks(batches, "media"):
            rows, prints = [], []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                stored = raw[a:b].tobytes()
                payload = from_wav(stored)
                own = fingerprints(np.frombuffer(payload, np.uint8))
                prints.append(own)
                feature = f"{len(own)}:{hashlib.sha256(own.astype('<i8').tobytes()).hexdigest()}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            size, sha, tail, stored_size, stored_sha, feature = map(list, zip(*rows))
            at = np.concatenate([[0], np.cumsum([len(p) for p in prints])])
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(sha), pa.array(tail, pa.int64()), pa.array(stored_size, pa.int64()), pa.array(stored_sha), pa.array(feature), list_column(np.concatenate(prints).astype(np.int64), at)],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "fingerprints"],
            )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, MEDIA_SCHEMA)


def op5_media_columns(spark, sf_dir: str) -> DataFrame:
    return media_features(wav_column(_session.documents(spark, sf_dir)))
