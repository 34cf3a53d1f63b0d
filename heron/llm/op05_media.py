"""Media columns: WAV bytes written and read by the wave module, short-time Fourier transforms, and fingerprints of pairs of spectral peaks."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.llm.common import small_batches, table, with_fields

RATE = 8000
#: Samples of a frame and between frames; peaks a frame may give; later peaks that one is paired with, and within how many frames.
FRAME, HOP, PEAKS, FAN, REACH = 256, 128, 3, 3, 16
UNIT = 64
#: Frames transformed at once.
CHUNK = 4096
_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file with the bytes as 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def padded(text: str | None) -> bytes:
    """UTF-8 with bytes 0 up to a positive multiple of 64."""
    data = (text or "").encode()
    return data + bytes(-len(data) % UNIT if data else UNIT)


def framed(samples: np.ndarray) -> np.ndarray:
    """Overlapping frames of all samples: HOP of silence before them and, up to a whole frame, at least HOP after them, as the window is 0 at a frame's ends."""
    x = samples.astype(np.float32) - 128
    after = HOP + -len(x) % HOP
    x = np.concatenate([np.zeros(HOP, np.float32), x, np.zeros(after, np.float32)])
    return np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]


def spectral_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of up to PEAKS strongest local maxima of each frame of the power spectrogram that exceed its mean, in order of time."""
    frames = framed(samples)
    times, bins = [], []
    for i in range(0, len(frames), CHUNK):
        spectrum = np.fft.rfft(frames[i : i + CHUNK] * _WINDOW, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        inner = power[:, 1:-1]
        held = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]) & (inner > 1.0 + inner.mean(axis=1, keepdims=True)), inner, 0)
        top = np.argpartition(held, -PEAKS, axis=1)[:, -PEAKS:]
        row = np.repeat(np.arange(len(held)), PEAKS).reshape(top.shape)
        ok = held[row, top] > 0
        t, b = row[ok] + i, top[ok] + 1
        order = np.lexsort((b, t))
        times.append(t[order]), bins.append(b[order])
    return np.concatenate(times), np.concatenate(bins)


def landmarks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded fingerprints: for each pair of a peak and one of the next FAN peaks up to REACH frames later, its frame and (bin, bin, frames between) as one number."""
    t, b = spectral_peaks(samples)
    times, codes = [], []
    for step in range(1, FAN + 1):
        if len(t) > step:
            gap = t[step:] - t[:-step]
            ok = gap <= REACH
            times.append(t[:-step][ok]), codes.append((b[:-step] << 16 | b[step:] << 8 | gap)[ok])
    if not times:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order], c[order]


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the text's bytes as a WAV file; null is empty and is stored as 64 samples of 0."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([to_wav(padded(t)) for t in texts], pa.binary())], names=["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, with_fields(docs.select(F.col(id_col).alias("id")), "n_bytes long, media binary"))


def media_features(media: DataFrame, keep_landmarks: bool = True) -> DataFrame:
    """The rows of (id, n_bytes, media) with what the stored bytes say when read back.

    payload_bytes, payload_sha256, tail_crc32 (of the last 64 samples), media_bytes, media_sha256, n_landmarks, feature
    (a digest of the landmarks), and with keep_landmarks the landmark arrays landmark_at (frames) and landmark (codes).
    Null media gives nulls; equal media, equal values, so repeated rows repeat theirs. The spectrum of a very long text
    is made CHUNK frames at a time; its landmarks (up to 9 for each 128 samples) are one row. An empty table gives no
    rows. Other columns are ignored.
    """
    small_batches(media.sparkSession)
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_landmarks", "feature", "landmark_at", "landmark"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    kinds = ["long", "string", "long", "long", "string", "long", "string", "array<int>", "array<int>"]
    if not keep_landmarks:
        names, types, kinds = names[:-2], types[:-2], kinds[:-2]

    def values(stored: bytes | None) -> list:
        if stored is None:
            return [None] * len(names)
        payload = from_wav(stored)
        at, codes = landmarks(np.frombuffer(payload, np.uint8))
        digest = hashlib.sha256(at.astype("<i4").tobytes() + codes.astype("<i4").tobytes()).hexdigest()
        out = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), len(at), f"{len(at)}:{digest}"]
        return out + [at.astype(np.int32), codes.astype(np.int32)] * keep_landmarks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [values(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=["id", "n_bytes", *names])

    schema = with_fields(media.select("id", "n_bytes"), ", ".join(map(" ".join, zip(names, kinds))))
    return media.select("id", "n_bytes", "media").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 5, with the time-coded arrays."""
    return media_features(with_media(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")
