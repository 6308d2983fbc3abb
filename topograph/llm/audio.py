"""Media columns: audio features of 8-bit sound.

A payload is stored as a mono 8-bit WAV file, read back, resampled by a polyphase filter, cut into overlapped
frames, turned into log-mel energies, and segmented by energy with hysteresis. The log-mel frames of a medium
are stored as an Arrow stream of fixed-shape tensors [TENSOR_FRAMES, MELS], each with its time span; the last
tensor is filled up with the floor value and its span says how much of it is sound.

Null text is empty text; an empty text is one block of padding. All work is per medium and in blocks, so equal
texts give equal values and a very long text needs memory for its bytes and a block. Extra columns are ignored,
repeated rows are computed each, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from topograph.workers import thrifty

UNIT = 576
RATE = 8000
UP, DOWN, TAPS = 3, 4, 16
FRAME, HOP, MELS = 256, 128, 24
TENSOR_FRAMES = 32
FLOOR_DB = -80.0
ON_DB, OFF_DB = 3.0, -3.0
BLOCK = 1 << 14


def payload(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text without padding, and the text padded with 255 to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * ((-len(raw)) % UNIT if raw else UNIT)


def write_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono RIFF/WAVE file of unsigned 8-bit PCM; an odd number of samples gets RIFF's pad byte."""
    pad = len(samples) % 2
    return (
        struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
        + samples
        + b"\0" * pad
    )


def read_wav(data: bytes) -> tuple[int, bytes]:
    """(rate, samples) of a mono 8-bit PCM file; other chunks are skipped."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(data):
        name, n = struct.unpack_from("<4sI", data, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif name == b"data":
            return rate, data[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no samples")


@cache
def _filter() -> np.ndarray:
    """Low-pass filter for UP/DOWN in polyphase form [UP, TAPS]: row p holds the taps of output phase p."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    h = np.sinc(n / max(UP, DOWN)) * np.hanning(UP * TAPS + 2)[1:-1]
    h *= UP / h.sum()
    return np.stack([h[p::UP][::-1] for p in range(UP)]).astype(np.float32)


def resample(samples: np.ndarray) -> np.ndarray:
    """Polyphase resampling by UP/DOWN: each output is a dot product with one phase of the filter."""
    n_out = -(-len(samples) * UP // DOWN)
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), samples, np.zeros(TAPS + DOWN, np.float32)])
    views = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(-(-n_out // UP) * UP, np.float32)
    for p in range(UP):
        first, phase = divmod(p * DOWN, UP)
        taps, rows = _filter()[phase], views[first::DOWN]
        for lo in range(0, len(out) // UP, BLOCK):
            hi = min(lo + BLOCK, len(out) // UP)
            out[p + lo * UP : p + (hi - 1) * UP + 1 : UP] = rows[lo:hi] @ taps
    return out[:n_out]


@cache
def _mel() -> np.ndarray:
    """Triangular filters [FRAME // 2 + 1, MELS], evenly spaced in mel up to half the new rate."""
    top = 2595 * np.log10(1 + RATE * UP / DOWN / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, DOWN / UP / RATE)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(sound: np.ndarray) -> np.ndarray:
    """Log-mel energies in dB [frames, MELS] of frames that overlap by FRAME - HOP; the end is filled with zeros."""
    n = max(1, -(-(len(sound) - FRAME) // HOP) + 1)
    sound = np.concatenate([sound, np.zeros((n - 1) * HOP + FRAME - len(sound), np.float32)])
    frames, window = np.lib.stride_tricks.sliding_window_view(sound, FRAME)[::HOP], np.hanning(FRAME).astype(np.float32)
    out = np.empty((n, MELS), np.float32)
    for lo in range(0, n, 4096):
        power = np.abs(np.fft.rfft(frames[lo : lo + 4096] * window, axis=1)) ** 2
        out[lo : lo + 4096] = 10 * np.log10(power.astype(np.float32) @ _mel() + 10 ** (FLOOR_DB / 10))
    return out


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans that begin at or over ON_DB and last while the energy is at or over OFF_DB."""
    on, off = energy >= ON_DB, energy < OFF_DB
    event = np.where(on, 1, np.where(off, -1, 0))
    marks = np.flatnonzero(event)
    if not len(marks):
        return []
    turns = marks[np.concatenate([[True], np.diff(event[marks]) != 0])]
    state = event[turns]
    ends = np.append(turns[1:], len(energy))
    return [(int(a), int(b)) for a, b, s in zip(turns, ends, state, strict=True) if s > 0]


def tensors(logs: np.ndarray) -> bytes:
    """An Arrow stream of fixed-shape tensors with the columns start_s, end_s and log_mel."""
    n = -(-len(logs) // TENSOR_FRAMES)
    full = np.full((n * TENSOR_FRAMES, MELS), FLOOR_DB, np.float32)
    full[: len(logs)] = logs
    step = HOP * DOWN / UP / RATE
    start = np.arange(n) * TENSOR_FRAMES
    tensor = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, TENSOR_FRAMES, MELS))
    batch = pa.RecordBatch.from_arrays([pa.array(start * step), pa.array(np.minimum(start + TENSOR_FRAMES, len(logs)) * step), tensor], ["start_s", "end_s", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start_s, end_s and the tensors [n, TENSOR_FRAMES, MELS] of what tensors() stored."""
    t = pa.ipc.open_stream(data).read_all()
    return t["start_s"].to_numpy(), t["end_s"].to_numpy(), t["log_mel"].combine_chunks().to_numpy_ndarray()


def analyse(wav: bytes) -> dict:
    """Samples read back from a stored medium, its log-mel frames and its loud spans in seconds."""
    _, samples = read_wav(wav)
    sound = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    logs = log_mel(resample(sound - sound.mean()))
    level = logs.mean(1)
    step = HOP * DOWN / UP / RATE
    return {"samples": samples, "logs": logs, "segments": [(a * step, b * step) for a, b in segments(level - np.median(level))]}


def describe(text: str | None) -> dict:
    """The digest row of one text."""
    n, raw = payload(text)
    wav = write_wav(raw)
    x = analyse(wav)
    stored = np.round(read_tensors(tensors(x["logs"]))[2] * 4).astype(np.int16)
    return {
        "n_bytes": n,
        "payload_bytes": len(x["samples"]),
        "payload_sha256": hashlib.sha256(x["samples"]).hexdigest(),
        "tail_crc32": zlib.crc32(x["samples"][-32:]),
        "media_bytes": len(wav),
        "media_sha256": hashlib.sha256(wav).hexdigest(),
        "feature": f"{len(x['logs'])}x{MELS} mean={x['logs'].mean():.2f} loud={len(x['segments'])}/{sum(b - a for a, b in x['segments']):.3f}s crc={zlib.crc32(stored.tobytes()):08x}",
    }


DIGEST = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the digest columns of every text's medium."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGEST.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in DIGEST.split(", ")]
        for b in batches:
            rows = [describe(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in zip(names, kinds, strict=True))], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(thrifty(run), f"doc_id bigint, {DIGEST}")


def media(docs: DataFrame) -> DataFrame:
    """doc_id, the stored WAV file, its tensors as an Arrow stream, and its loud spans in seconds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                wavs = [write_wav(payload(t.as_py())[1]) for t in part.column("text")]
                found = [analyse(w) for w in wavs]
                spans = [[{"start_s": a, "end_s": z} for a, z in x["segments"]] for x in found]
                kind = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(wavs, pa.binary()), pa.array([tensors(x["logs"]) for x in found], pa.binary()), pa.array(spans, kind)], ["doc_id", "media", "tensors", "loud"])

    return docs.select("doc_id", "text").mapInArrow(thrifty(run), "doc_id bigint, media binary, tensors binary, loud array<struct<start_s: double, end_s: double>>")
