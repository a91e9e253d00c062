"""Media columns: 8-bit audio, its log-mel tensors and its active segments."""

from __future__ import annotations

import functools
import io
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common

#: Nominal rate of stored samples, and resampling by UP / DOWN.
RATE, UP, DOWN = 16_000, 1, 2
WINDOW, HOP, MELS = 256, 128, 32
#: Frames of one tensor.
FRAMES = 16
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """Mono WAV of unsigned 8-bit samples."""
    odd = b"\0" * (len(samples) % 2)
    return HEADER.pack(b"RIFF", 36 + len(samples) + len(odd), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + odd


def from_wav(media: bytes) -> bytes:
    """The samples of ``to_wav``'s form."""
    riff, _, wave, fmt, _, kind, channels, _, _, _, bits, data, n = HEADER.unpack_from(media)
    if (riff, wave, fmt, kind, channels, bits, data) != (b"RIFF", b"WAVE", b"fmt ", 1, 1, 8, b"data"):
        raise ValueError("not a mono 8-bit WAV")
    return media[HEADER.size : HEADER.size + n]


@functools.lru_cache(maxsize=8)
def lowpass(up: int, down: int, half: int = 8) -> np.ndarray:
    """A Hann-windowed sinc of 2 * half * max(up, down) + 1 taps, of gain ``up``."""
    wide = max(up, down)
    t = np.arange(-half * wide, half * wide + 1)
    return (np.sinc(t / wide) * np.hanning(len(t) + 2)[1:-1] * up / wide).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling by up / down; only the outputs that are kept are computed."""
    h = lowpass(up, down)
    middle = len(h) // 2
    n = -(-len(x) * up // down)
    y = np.zeros(n, np.float32)
    for r in range(min(up, n)):  # outputs r, r + up, r + 2 up, ... share a phase of the filter
        shift, phase = divmod(r * down + middle, up)
        g = h[phase::up]
        count = -(-(n - r) // up)
        for i in range(min(down, len(g))):  # y[q] = sum over j of g[j] x[q down + shift - j], taps j = i mod down
            taps = g[i::down]
            lead, first = divmod(shift - i, down)
            stream = x[first::down]
            if len(stream):
                full = np.convolve(stream, taps)
                part = full[lead : lead + count] if lead >= 0 else np.concatenate((np.zeros(-lead, np.float32), full[: max(0, count + lead)]))
                y[r : r + up * len(part) : up] += part
    return y


@functools.lru_cache(maxsize=8)
def mel_filters(rate: float, window: int = WINDOW, mels: int = MELS) -> np.ndarray:
    """Overlapping triangles, evenly spaced on the mel scale, as (window / 2 + 1, mels)."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), mels + 2)
    edge = 700 * (10 ** (mel / 2595) - 1)
    f = np.linspace(0, rate / 2, window // 2 + 1)[:, None]
    return np.maximum(0, np.minimum((f - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - f) / (edge[2:] - edge[1:-1]))).astype(np.float32)


@functools.lru_cache(maxsize=8)
def hann(window: int) -> np.ndarray:
    return np.hanning(window + 1)[:-1].astype(np.float32)


def log_mel(y: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS log energies, frame energies in dB) of overlapped frames; the last one is padded with silence."""
    n = 1 + max(0, -(-(len(y) - WINDOW) // HOP))
    padded = np.zeros((n - 1) * HOP + WINDOW, np.float32)
    padded[: len(y)] = y
    frames = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HOP]
    mel, db = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for a in range(0, n, 4096):
        part = frames[a : a + 4096] * hann(WINDOW)
        spectrum = np.fft.rfft(part, axis=1)
        mel[a : a + 4096] = np.log((spectrum.real**2 + spectrum.imag**2) @ mel_filters(rate) + 1e-6)
        db[a : a + 4096] = 10 * np.log10(np.einsum("ij,ij->i", part, part) + 1e-9)
    return mel, db


def active_segments(db: np.ndarray, on_db: float = 1.5, off_db: float = -1.0) -> np.ndarray:
    """(first, end) frames of segments: one begins above median + on_db and lasts while above median + off_db."""
    middle = np.median(db)
    alive = np.concatenate(([False], db > middle + off_db, [False]))
    edge = np.flatnonzero(alive[1:] != alive[:-1])
    spans = edge.reshape(-1, 2)
    loud = np.concatenate(([0], np.cumsum(db > middle + on_db)))
    heard = spans[loud[spans[:, 1]] > loud[spans[:, 0]]]
    first_loud = np.searchsorted(loud, loud[heard[:, 0]], side="right") - 1
    return np.stack((first_loud, heard[:, 1]), axis=1)


def tensor_stream(mel: np.ndarray, rate: float) -> bytes:
    """Arrow IPC stream of (tensor FRAMES x MELS, start_s, end_s); the last tensor is padded with zeros."""
    n = -(-len(mel) // FRAMES)
    filled = np.zeros((n * FRAMES, MELS), np.float32)
    filled[: len(mel)] = mel
    kind = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS), dim_names=["frame", "mel"])
    storage = pa.FixedSizeListArray.from_arrays(pa.array(filled.ravel()), FRAMES * MELS)
    start = np.arange(n) * FRAMES * HOP / rate
    end = np.minimum(start + FRAMES * HOP / rate, len(mel) * HOP / rate)
    batch = pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(kind, storage), pa.array(start), pa.array(end)], names=["tensor", "start_s", "end_s"])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue()


def read_tensors(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


def store_text_media(docs: DataFrame, unit: int = 576, pad: int = 255) -> DataFrame:
    """Add ``media``: each text's UTF-8 bytes, padded to a positive multiple of ``unit``, as the samples of a WAV.

    Null and empty texts become one unit of padding. Other columns stay; a column ``media`` is replaced.
    """
    docs = docs.drop("media")
    names = docs.columns

    def store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices([batch]):
                raw = [(t or "").encode() for t in part.column("text").to_pylist()]
                media = [to_wav(x + bytes([pad]) * (max(unit, -(-len(x) // unit) * unit) - len(x))) for x in raw]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(media, pa.binary())], names=[*names, "media"])

    return docs.mapInArrow(store, common.plus(docs, "media binary"))


def audio_features(media: DataFrame) -> DataFrame:
    """Read ``media`` back and add payload, n_frames, tensors and segments.

    ``payload`` (binary): the stored samples. ``tensors`` (binary): an Arrow IPC stream of fixed-shape log-mel tensors
    with their time spans (see read_tensors). ``segments``: array of (start_s, end_s) where the energy is above the
    document's own level with hysteresis. All are functions of one row's media alone, computed apart from other rows,
    so equal media have equal values. Null media gives nulls; clashing columns are replaced; an empty table gives an
    empty result.
    """
    added = ["payload", "n_frames", "tensors", "segments"]
    media = media.drop(*added)
    names = media.columns
    span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = RATE * UP / DOWN
        for batch in batches:
            for part in common.slices([batch], "media"):
                rows = []
                for wav in part.column("media").to_pylist():
                    if wav is None:
                        rows.append((None,) * 4)
                        continue
                    payload = from_wav(wav)
                    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
                    mel, db = log_mel(resample(x), rate)
                    spans = (active_segments(db) * HOP / rate).tolist()
                    rows.append((payload, len(mel), tensor_stream(mel, rate), [{"start_s": s, "end_s": e} for s, e in spans]))
                kinds = [pa.binary(), pa.int64(), pa.binary(), span]
                made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*names, *added])

    schema = common.plus(media, "payload binary, n_frames long, tensors binary, segments array<struct<start_s: double, end_s: double>>")
    return media.mapInArrow(features, schema)


def feature_digest() -> Column:
    """A short text for a document's features: frames, segments, and a digest of tensors and spans."""
    spans = F.concat_ws(",", F.transform("segments", lambda s: F.format_string("%.3f-%.3f", s["start_s"], s["end_s"])))
    return F.concat_ws(":", F.col("n_frames").cast("string"), F.size("segments").cast("string"), F.sha2(F.concat(F.col("tensors"), F.encode(spans, "UTF-8")), 256))
