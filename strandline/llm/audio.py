"""Operator 8: audio features of payloads stored as 8-bit samples.

A payload (bytes, padded with zeros to a positive multiple of 64) is stored without loss as a WAV file
of unsigned 8-bit samples, one channel, RATE per second. Features come from the stored bytes, read back:

* resampling by UP / DOWN with a polyphase filter (a windowed sinc, each phase applied alone);
* log-mel energies of overlapped, Hann-weighted frames;
* segments by hysteresis: one opens when a frame's energy reaches the upper threshold and closes when
  it falls under the lower one; both are ranks of the file's own energies.

Log-mel energies are stored in steps of STEP as Arrow fixed-shape tensors of TILE frames by MELS bands
(padded with the lowest step), each with its time span, in an Arrow stream for each file. The query
derives its feature from these streams, read back. Everything depends on the payload only, so equal
texts have equal values. Memory is bounded by one payload, as its frames are made in blocks.

Defined results: null counts as empty, whose payload is 64 zeros; silence has one energy, no segment
opens before the upper threshold; repeated rows are all kept; further columns play no part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import common

RATE, UP, DOWN, TAPS = 16_000, 3, 4, 16
FRAME, HOP, FFT, MELS = 200, 80, 256, 32
UPPER, LOWER = 0.8, 0.5
TILE = 64
_FLOOR = 1e-6
#: Steps in which log-mel energies are stored, and the lowest.
STEP, LOWEST = 0.1, -14.0
_BLOCK = 4096


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def wav(samples: bytes) -> bytes:
    """A WAV file of unsigned 8-bit samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples


def samples_of(media: bytes) -> bytes:
    """The samples of such a file, found through its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without samples")


@lru_cache(maxsize=1)
def _phases() -> np.ndarray:
    """The filter's UP phases of TAPS taps each."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    cut = min(1 / UP, 1 / DOWN)
    h = np.sinc(t * cut / 1) * cut * np.hamming(n) * UP
    return h.reshape(TAPS, UP).T.astype(np.float32)


def resampled(x: np.ndarray) -> np.ndarray:
    """x at RATE * UP / DOWN. Output k is phase (k * DOWN) % UP over the inputs before k * DOWN / UP."""
    n = -(-len(x) * UP // DOWN)
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x])
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(n, np.float32)
    for r in range(UP):
        k = np.arange(r, n, UP)  # outputs of one phase: inputs DOWN apart
        first, phase = (r * DOWN) // UP, (r * DOWN) % UP
        out[k] = windows[first :: DOWN][: len(k)] @ _phases()[phase][::-1]
    return out


@lru_cache(maxsize=1)
def _mel() -> np.ndarray:
    """Triangles, evenly spaced in mel, over the bins of the spectrum."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + np.asarray(f) / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, FFT // 2 + 1)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))).astype(np.float32)


def logmel(x: np.ndarray) -> np.ndarray:
    """Frames by MELS, in steps of STEP above LOWEST (0 to 255)."""
    n = 1 + max(0, -(-(len(x) - FRAME) // HOP))
    x = np.concatenate([x, np.zeros((n - 1) * HOP + FRAME - min(len(x), (n - 1) * HOP + FRAME), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n]
    window, out = np.hanning(FRAME).astype(np.float32), np.empty((n, MELS), np.uint8)
    for s in range(0, n, _BLOCK):
        spectrum = np.fft.rfft(frames[s : s + _BLOCK] * window, FFT)
        power = spectrum.real.astype(np.float32) ** 2 + spectrum.imag.astype(np.float32) ** 2
        out[s : s + _BLOCK] = np.clip(np.round((np.log(power @ _mel() + _FLOOR) - LOWEST) / STEP), 0, 255)
    return out


def segments(mels: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges [start, end) by hysteresis over the frames' mean energy."""
    energy = mels.sum(1, dtype=np.int64)
    ranked = np.sort(energy)
    high, low = (ranked[min(len(ranked) - 1, int(p * len(ranked)))] for p in (UPPER, LOWER))
    if high <= ranked[0]:
        return []
    # the state after each frame: 1 open, 0 closed, as the last frame outside the band says
    said = np.where(energy >= high, 1, np.where(energy < low, 0, -1))
    last = np.maximum.accumulate(np.where(said >= 0, np.arange(len(said)), -1))
    state = np.where(last >= 0, said[np.maximum(last, 0)], 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], state, [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def spans(n: int) -> list[tuple[float, float, int]]:
    """Start, end and frames of the tiles of n frames."""
    step = HOP * DOWN / (RATE * UP)
    return [(k * step, min(n, k + TILE) * step, min(n, k + TILE) - k) for k in range(0, n, TILE)]


def tensors(mels: np.ndarray) -> bytes:
    """An Arrow stream of start_s, end_s, frames and logmel, a fixed-shape tensor, a row a tile."""
    rows = spans(len(mels))
    full = np.zeros((len(rows) * TILE, MELS), np.uint8)
    full[: len(mels)] = mels
    batch = pa.RecordBatch.from_arrays([*[pa.array(c) for c in zip(*rows)], pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(-1, TILE, MELS))], ["start_s", "end_s", "frames", "logmel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def opened(stream: bytes) -> tuple[np.ndarray, list[tuple[float, float, int]]]:
    """Log-mel energies and tiles of such a stream; raises where shape or spans are not as they should be."""
    batch = pa.ipc.open_stream(stream).read_next_batch()
    column = batch.column("logmel")
    rows = list(zip(*(batch.column(c).to_pylist() for c in ("start_s", "end_s", "frames"))))
    n = sum(f for _, _, f in rows)
    if list(column.type.shape) != [TILE, MELS] or rows != spans(n):
        raise ValueError("not the tensors of one file")
    return column.to_numpy_ndarray().reshape(-1, MELS)[:n], rows


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (the WAV file) of every row; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                raw = [t or b"" for t in b.column("raw").slice(k, 1000).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(k, 1000), pa.array([len(r) for r in raw], pa.int64()), pa.array([wav(payload(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col(text), "UTF-8").alias("raw"))
    return common.written(rows.mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media")


_STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tensors binary"
_DIGEST = _STORED.replace("tensors binary", "feature string")


def _mapped(rows: DataFrame, schema: str, make) -> DataFrame:
    """A row of schema for each row, by make(row as a dict)."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                cols = list(zip(*map(make, b.slice(k, 500).to_pylist())))
                if cols:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return rows.mapInArrow(run, schema)


def analysed(media: DataFrame) -> DataFrame:
    """Of each stored file what was read back of it and its log-mel tensors: _STORED; written."""

    def make(r: dict) -> tuple:
        file = r["media"]
        data = samples_of(file)
        mels = logmel(resampled((np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128))
        return r["doc_id"], r["n_bytes"], len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(file), hashlib.sha256(file).hexdigest(), tensors(mels)

    return common.written(_mapped(media, _STORED, make), "tensors")


def summary(mels: np.ndarray, tiles: list[tuple[float, float, int]]) -> str:
    """frames and tiles; mean band energies; segments and seconds in them; a digest of all energies and spans."""
    step, found = HOP * DOWN / (RATE * UP), segments(mels)
    times = ",".join(f"{a * step:.4f}-{b * step:.4f}" for a, b in found)
    digest = hashlib.sha256(mels.tobytes() + times.encode()).hexdigest()[:16]
    means = ",".join(f"{v * STEP + LOWEST:.2f}" for v in mels.mean(0))
    return f"frames={len(mels)};tiles={len(tiles)};end={tiles[-1][1]:.4f};mel={means};segments={len(found)};active={sum(b - a for a, b in found) * step:.4f};digest={digest}"


def digests(stored: DataFrame) -> DataFrame:
    """A row for each stored file: what was read back, and the features that its tensors give."""
    return _mapped(stored, _DIGEST, lambda r: (*list(r.values())[:-1], summary(*opened(r["tensors"]))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every text as a stored payload and its stored tensors, read back, with its features."""
    return digests(analysed(store(common.table(spark, sf_dir, "documents"))))
