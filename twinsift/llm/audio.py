"""Audio columns: 8-bit sound kept as WAV bytes, with features as fixed-shape Arrow tensors and time spans.

Sound is resampled by a polyphase filter, cut into overlapped frames, turned into log-mel energies and segmented by energy
with hysteresis: a segment opens at the upper threshold and closes below the lower one. Features are kept as an Arrow IPC
stream with one ``fixed_shape_tensor`` of (frames, mels) a row and its span in seconds; the last tensor is padded with zeros.

Text stands in for recordings here: its UTF-8 bytes, padded with bytes 0 to a positive multiple of 64, are the samples. Null and
empty texts are 64 samples of 0, and equal texts give equal bytes, since each row is computed alone by the same steps. Long
sounds are framed in blocks, so that memory stays near the size of the sound itself. An empty table gives an empty result.
Columns other than id and text aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts


@dataclass(frozen=True)
class AudioSpec:
    rate: int = 16_000
    target_rate: int = 8_000
    frame: int = 256
    hop: int = 128
    mels: int = 20
    tensor_frames: int = 32
    open_db: float = -6.0  # of the loudest frame
    close_db: float = -12.0
    half_width: int = 8  # zero crossings of the filter on each side


def pack_wav(samples: bytes, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def unpack_wav(media: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes()), r.getframerate()


@lru_cache(maxsize=8)
def polyphase_bank(up: int, down: int, half_width: int) -> tuple[np.ndarray, int]:
    """Filter taps for each of the ``up`` output phases over one block of ``down`` inputs, and the inputs before the block."""
    reach = int(np.ceil(half_width * max(1.0, down / up)))
    cut = min(1.0, up / down)
    at = np.arange(up)[:, None] * down / up  # where outputs lie, in inputs of the block
    tap = np.arange(-reach, down + reach)[None, :]
    x = tap - at
    window = np.where(np.abs(x) <= reach, 0.5 + 0.5 * np.cos(np.pi * x / reach), 0.0)
    bank = cut * np.sinc(cut * x) * window
    return (bank / bank.sum(1, keepdims=True)).astype(np.float32).T.copy(), reach


def resample(x: np.ndarray, rate: int, target: int, half_width: int) -> np.ndarray:
    """x at another rate: every block of ``down`` inputs gives ``up`` outputs, one for each phase of the filter."""
    g = gcd(rate, target)
    up, down = target // g, rate // g
    if up == down:
        return x
    bank, reach = polyphase_bank(up, down, half_width)
    blocks = -(-len(x) // down)
    padded = np.zeros(blocks * down + 2 * reach, np.float32)
    padded[reach : reach + len(x)] = x
    seen = np.lib.stride_tricks.sliding_window_view(padded, len(bank))[::down]
    return (seen[:blocks] @ bank).ravel()[: -(-len(x) * up // down)]


@lru_cache(maxsize=8)
def mel_bank(rate: int, frame: int, mels: int) -> np.ndarray:
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, to_mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))).astype(np.float32)


@lru_cache(maxsize=8)
def _hann(n: int) -> np.ndarray:
    return np.hanning(n + 1)[:-1].astype(np.float32)


def log_mel(x: np.ndarray, spec: AudioSpec) -> tuple[np.ndarray, np.ndarray]:
    """(frames, mels) log energies and each frame's energy in dB; at least one frame."""
    n = max(1, -(-(len(x) - spec.frame) // spec.hop) + 1)
    padded = np.zeros((n - 1) * spec.hop + spec.frame, np.float32)
    padded[: len(x)] = x
    frames = np.lib.stride_tricks.sliding_window_view(padded, spec.frame)[:: spec.hop]
    bank, window = mel_bank(spec.target_rate, spec.frame, spec.mels), _hann(spec.frame)
    out, energy = np.empty((n, spec.mels), np.float32), np.empty(n, np.float32)
    for at in range(0, n, 4096):
        part = frames[at : at + 4096] * window
        spectrum = np.fft.rfft(part, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        out[at : at + 4096] = np.log(power @ bank + 1e-6)
        energy[at : at + 4096] = 10 * np.log10((part * part).mean(1) + 1e-9)
    return out, energy


def segments(energy: np.ndarray, open_db: float, close_db: float) -> list[tuple[int, int]]:
    """Runs of frames that reach the upper threshold somewhere and never fall below the lower one, in frames, end exclusive."""
    top = energy.max()
    loud = np.concatenate(([False], energy >= top + close_db, [False]))
    starts, ends = np.flatnonzero(~loud[:-1] & loud[1:]), np.flatnonzero(loud[:-1] & ~loud[1:])
    peak = np.maximum.reduceat(energy, starts)
    return [(int(s), int(e)) for s, e, p in zip(starts, ends, peak) if p >= top + open_db]


def features(samples: bytes, rate: int, spec: AudioSpec) -> tuple[np.ndarray, np.ndarray, list[tuple[float, float]], int]:
    """Tensors (n, frames, mels), their spans in seconds (n, 2), the segments' spans and the number of frames."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel, energy = log_mel(resample(x, rate, spec.target_rate, spec.half_width), spec)
    n, per = len(mel), spec.tensor_frames
    tensors = np.zeros((-(-n // per), per, spec.mels), np.float32)
    tensors.reshape(-1, spec.mels)[:n] = mel
    first = np.arange(len(tensors)) * per
    last = np.minimum(first + per, n) - 1
    at = lambda f: f * spec.hop / spec.target_rate
    tail = spec.frame / spec.target_rate
    spans = np.stack([at(first), at(last) + tail], 1)
    return tensors, spans, [(at(s), at(e - 1) + tail) for s, e in segments(energy, spec.open_db, spec.close_db)], n


def pack_tensors(tensors: np.ndarray, spans: np.ndarray) -> bytes:
    """An Arrow IPC stream of tensor, start_s and end_s."""
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(tensors)
    batch = pa.RecordBatch.from_arrays([column, pa.array(spans[:, 0]), pa.array(spans[:, 1])], ["tensor", "start_s", "end_s"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpack_tensors(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    t = pa.ipc.open_stream(stream).read_all().combine_chunks()
    spans = np.stack([t["start_s"].to_numpy(), t["end_s"].to_numpy()], 1)
    return t["tensor"].chunk(0).to_numpy_ndarray(), spans


def text_payload(text: str) -> tuple[bytes, int]:
    """UTF-8 bytes padded to a positive multiple of 64, and their number before that."""
    raw = text.encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64)), len(raw)


def blocks(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches: media and tensors of few rows are in memory at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def store_audio(docs: DataFrame, spec: AudioSpec = AudioSpec(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and media (WAV bytes), one row per document."""
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            made = [text_payload(t) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([pack_wav(p, spec.rate) for p, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return slim.mapInArrow(store, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def audio_features(stored: DataFrame, spec: AudioSpec = AudioSpec()) -> DataFrame:
    """Adds tensors (an Arrow IPC stream), segments, n_frames and what the media holds: payload bytes, hash and checksum."""
    kind = stored.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, tensors binary, segments array<struct<start_s:double,end_s:double>>, n_frames int"

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
        for b in blocks(batches):
            cols: list[list] = [[] for _ in range(6)]
            for media in b.column(2).to_pylist():
                payload, rate = unpack_wav(media)
                tensors, spans, found, n = features(payload, rate, spec)
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), pack_tensors(tensors, spans), [{"start_s": s, "end_s": e} for s, e in found], n)
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), seg, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "tensors", "segments", "n_frames"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(compute, schema)
