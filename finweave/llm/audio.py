"""Media columns for audio: lossless 8-bit WAV storage, resampling, log-mel tensors, segments.

A payload is stored as the samples of an unsigned 8-bit mono WAV file in a binary column.  Features
come from the stored bytes: samples are centred, brought from ``STORED_RATE`` to ``RATE`` by a
polyphase filter (one matrix product gives all phases), cut into overlapping frames, and turned into
log-mel energies in steps of ``STEP_DB``.  A segment opens when a frame's energy rises above the high
mark and closes when it falls below the low mark (hysteresis).  Log-mels are stored in patches of
fixed shape ``PATCH_FRAMES x MELS`` as an Arrow fixed-shape tensor array with a time span for each.

Each document is computed alone, block by block of frames with the samples that they overlap, so equal
payloads give equal features whatever batch they are in.  Beside a text's own bytes and its features
(about one byte each for a byte of text) memory is bounded: no resampled signal is ever held whole, and
batches are cut into pieces of bounded bytes, of one text at least.

Edge cases: null text is an empty payload, 64 zero bytes long after padding; repeated rows get equal
values; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finweave.llm.common import PIECE_BYTES, clean_text, give_back_memory, materialize, text_pieces

BLOCK = 64
STORED_RATE, UP, DOWN = 16_000, 3, 4
RATE = STORED_RATE * UP // DOWN
TAPS = 8  # input samples on each side of an output sample
FRAME, HOP, FFT = 300, 120, 512
MELS, PATCH_FRAMES = 24, 32
STEP_DB = 0.5
HIGH_DB, LOW_DB = 1.0, -1.0
#: Frames computed at once.
FRAMES_AT_ONCE = 1024
WAV_HEAD = 44


def pad_payload(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of ``BLOCK``."""
    size = max(BLOCK, -(-len(data) // BLOCK) * BLOCK)
    return data + bytes(size - len(data))


def to_wav(payload: bytes) -> bytes:
    """An 8-bit mono PCM file; the header has no dates or names, so equal payloads give equal files."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, STORED_RATE, STORED_RATE, 1, 8, b"data", len(payload))
    return head + payload


def from_wav(media: bytes) -> bytes:
    """The samples of a stored file, through the standard reader."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not an 8-bit mono file")
        return w.readframes(w.getnframes())


@lru_cache(maxsize=1)
def polyphase() -> np.ndarray:
    """(window, UP) filters: windowed sinc at the lower of both bands, one column for each phase."""
    width = 2 * TAPS + DOWN
    cut = min(1.0, UP / DOWN)
    out = np.zeros((width, UP), np.float32)
    for phase in range(UP):
        centre = TAPS + phase * DOWN / UP
        x = np.arange(width) - centre
        h = cut * np.sinc(cut * x) * np.where(np.abs(x) <= TAPS, 0.5 + 0.5 * np.cos(np.pi * x / TAPS), 0.0)
        out[:, phase] = h / h.sum()
    return out


def resample_range(samples: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Outputs ``begin`` to ``end - 1`` at ``RATE``, 0 outside: output ``UP * k + phase`` stands at input ``DOWN * k + phase * DOWN / UP``."""
    first, last = begin // UP, -(-end // UP)
    width = 2 * TAPS + DOWN
    # Inputs from TAPS before the first step's to the end of the last one's window.
    low, high = first * DOWN - TAPS, (last - 1) * DOWN - TAPS + width
    padded = np.zeros(high - low, np.float32)
    inside = samples[max(low, 0) : max(high, 0)]
    padded[max(low, 0) - low : max(low, 0) - low + len(inside)] = to_signal(inside)
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)[::DOWN]
    out = (windows @ polyphase()).ravel()[begin - first * UP : end - first * UP]
    places = np.arange(begin, end)
    out[(places < 0) | (places >= n_resampled(len(samples)))] = 0
    return out


def to_signal(samples: np.ndarray) -> np.ndarray:
    """Centred 8-bit samples."""
    return (samples.astype(np.float32) - 128) / 128 if samples.dtype == np.uint8 else samples.astype(np.float32)


def n_resampled(n: int) -> int:
    return -(-n * UP // DOWN)


def resample(samples: np.ndarray) -> np.ndarray:
    """All samples at ``RATE``."""
    return resample_range(samples, 0, n_resampled(len(samples)))


@lru_cache(maxsize=1)
def mel_filters() -> np.ndarray:
    """(FFT bins, MELS) triangles, evenly spaced in mel from 60 Hz to half the rate."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(mel(60.0), mel(RATE / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FFT, 1 / RATE)[:, None]
    rise = (f - points[:-2]) / (points[1:-1] - points[:-2])
    fall = (points[2:] - f) / (points[2:] - points[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


@lru_cache(maxsize=1)
def hann() -> np.ndarray:
    return np.hanning(FRAME).astype(np.float32)


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames, MELS) of stored samples in whole steps of ``STEP_DB``, and each frame's energy in dB.

    Frame ``i`` is centred at resampled sample ``i * HOP``.
    """
    n = n_resampled(len(samples)) // HOP + 1
    mels, power = np.empty((n, MELS), np.int16), np.empty(n)
    for a in range(0, n, FRAMES_AT_ONCE):
        b = min(n, a + FRAMES_AT_ONCE)
        signal = resample_range(samples, a * HOP - FRAME // 2, (b - 1) * HOP + FRAME // 2)
        part = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP] * hann()
        spectrum = np.fft.rfft(part, FFT, axis=1)
        energy = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mels[a:b] = np.rint(10 * np.log10(energy @ mel_filters() + 1e-6) / STEP_DB)
        power[a:b] = np.rint(10 * np.log10(np.einsum("ij,ij->i", part, part) + 1e-6) / STEP_DB) * STEP_DB
    return mels, power


def segments(power: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges that open above the median + ``HIGH_DB`` and close below the median + ``LOW_DB``."""
    middle = float(np.median(power))
    state = np.where(power > middle + HIGH_DB, 1, np.where(power < middle + LOW_DB, -1, 0))
    marks = np.flatnonzero(state)
    if not len(marks):
        return []
    at = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    active = np.where(at >= 0, state[np.maximum(at, 0)] == 1, False)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], active.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]


def patches(mels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mels in dB in patches of fixed shape, the last one filled with its floor, and time spans in ms."""
    n = -(-len(mels) // PATCH_FRAMES)
    out = np.full((n * PATCH_FRAMES, MELS), round(10 * np.log10(1e-6) / STEP_DB), np.int16)
    out[: len(mels)] = mels
    start = np.arange(n) * PATCH_FRAMES * HOP * 1000 // RATE
    end = np.minimum((np.arange(n) + 1) * PATCH_FRAMES, len(mels)) * HOP * 1000 // RATE
    return out.reshape(n, PATCH_FRAMES, MELS).astype(np.float32) * np.float32(STEP_DB), np.column_stack([start, end])


def to_tensor_ipc(values: np.ndarray, spans: np.ndarray) -> bytes:
    """Arrow IPC stream of a fixed-shape tensor column with its time spans."""
    kind = pa.fixed_shape_tensor(pa.float32(), values.shape[1:])
    flat = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), int(np.prod(values.shape[1:])))
    batch = pa.record_batch([pa.ExtensionArray.from_storage(kind, flat), pa.array(spans[:, 0], pa.int64()), pa.array(spans[:, 1], pa.int64())], names=["log_mel", "start_ms", "end_ms"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def features(payload: bytes) -> tuple[list[tuple[int, int]], bytes]:
    """Segments as spans in ms, and the tensors."""
    mels, power = log_mel(np.frombuffer(payload, np.uint8))
    ms = lambda frame: frame * HOP * 1000 // RATE
    return [(ms(a), ms(b)) for a, b in segments(power)], to_tensor_ipc(*patches(mels))


MEDIA_SCHEMA = "doc_id {id}, n_bytes long, media binary"
FEATURE_SCHEMA = "doc_id {id}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, segments array<struct<start_ms:long,end_ms:long>>, tensors binary"


def store_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, column in text_pieces(batch.column("doc_id"), batch.column("text")):
            texts = [t.encode("utf-8") for t in column.to_pylist()]
            media = pa.array([to_wav(pad_payload(t)) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, pa.array(map(len, texts), pa.int64()), media], names=["doc_id", "n_bytes", "media"])


def media_pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of a bounded number of stored bytes, of one file at least."""
    ends = np.cumsum(pc.binary_length(batch.column("media")).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, done + PIECE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at, done = to, int(ends[to - 1])
    give_back_memory()


def feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), span, pa.binary()]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "segments", "tensors"]
    for piece in (p for batch in batches for p in media_pieces(batch)):
        rows: list[list] = [[] for _ in names]
        for media in piece.column("media"):
            stored = media.as_py()
            payload = from_wav(stored)
            found, tensors = features(payload)
            row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), [{"start_ms": a, "end_ms": b} for a, b in found], tensors)
            for column, value in zip(rows, row):
                column.append(value)
        arrays = [pa.array(c, k) for c, k in zip(rows, kinds)]
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("n_bytes"), *arrays], names=["doc_id", "n_bytes", *names])


def store_audio(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a WAV file) of every row of ``docs`` (doc_id, text), written to the shared folder and read back."""
    kind = dict(docs.dtypes)["doc_id"]
    media = docs.select("doc_id", clean_text().alias("text")).mapInArrow(store_batches, MEDIA_SCHEMA.format(id=kind))
    return materialize(media, "audio")


def audio_features(media: DataFrame) -> DataFrame:
    """Digests, segments and tensors of stored audio, written to the shared folder and read back."""
    schema = FEATURE_SCHEMA.format(id=dict(media.dtypes)["doc_id"])
    return materialize(media.mapInArrow(feature_batches, schema), "audio-features")


def audio_report(docs: DataFrame) -> DataFrame:
    """The digests of every document's stored audio, with ``feature``: the segments and the SHA-256 of the stored tensors."""
    found = audio_features(store_audio(docs))
    spans = F.array_join(F.transform("segments", lambda s: F.concat_ws("-", s["start_ms"], s["end_ms"])), ",")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat_ws(";", F.lit("logmel24x32"), spans, F.sha2("tensors", 256)).alias("feature"))
