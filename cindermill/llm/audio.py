"""Operator 9: media columns with audio features.

A payload is stored losslessly as 8-bit mono PCM in a WAV container. The stored bytes are read back, resampled by a
polyphase filter with integer taps (exact sums), cut into overlapping frames, and turned into log-mel energies; a
two-threshold (hysteresis) rule on frame energy marks segments. The frames are stored as Arrow tensors of a fixed shape
with time spans: a row's ``tensors`` column is an Arrow stream with one record per window of ``WINDOW_FRAMES`` frames
(start_ms, end_ms, n_frames, log_mel in whole decibels, voiced marks). The feature text is computed from the tensors read
back. Each row is computed alone, so equal payloads give equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_path, map_rows, not_replaced, shared_path, table

UNIT = 192
RATE = 16_000
UP, DOWN = 5, 8
TAPS = 16
FRAME, HOP, FFT, MELS = 250, 100, 256, 40
WINDOW_FRAMES = 64
#: Frames that are computed at a time, which bounds the memory of a long payload.
BLOCK = 4096
FLOOR_DB = -20


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """Append spaces up to the next positive multiple of ``unit``."""
    return data.ljust(max(unit, -(-len(data) // unit) * unit), b" ")


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    odd = len(payload) % 2
    head = b"RIFF" + struct.pack("<I", 36 + len(payload) + odd) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return head + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * odd


def from_wav(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of 8-bit mono PCM; other chunks are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data in the WAV file")


@lru_cache(maxsize=8)
def polyphase_taps(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Windowed-sinc low-pass as integers, one row of ``taps`` for each of the ``up`` phases, newest sample first."""
    n = np.arange(up * taps)
    x = (n - (up * taps - 1) / 2) / max(up, down)
    h = np.sinc(x) * np.hamming(up * taps)
    phases = h.reshape(taps, up).T
    return np.rint(phases / phases.sum(axis=1, keepdims=True) * (1 << 14)).astype(np.int64)


def resample(samples: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """``samples`` (integers) at up/down of their rate. Output k takes the phase (k*down) mod up at input (k*down) div up."""
    bank = polyphase_taps(up, down)
    taps = bank.shape[1]
    n_out = -(-len(samples) * up // down)
    history = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(taps - 1, np.int64), samples.astype(np.int64)]), taps)
    out = np.zeros(n_out, dtype=np.int64)
    for first in range(min(up, n_out)):
        k = np.arange(first, n_out, up)
        at, phase = first * down // up, first * down % up
        out[k] = history[at :: down][: len(k)] @ bank[phase][::-1]
    return out


@lru_cache(maxsize=8)
def mel_bank(rate: float, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale from 0 to half the rate: (fft/2+1, mels)."""
    edges = 700.0 * (10.0 ** (np.linspace(0.0, 2595.0 * np.log10(1.0 + rate / 2 / 700.0), mels + 2) / 2595.0) - 1.0)
    f = np.arange(fft // 2 + 1)[:, None] * rate / fft
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0.0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid)))


def log_mel(samples: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(frames x mels log-mel in dB, frame energy in dB) with overlapping Hann frames; the last frame is padded with silence."""
    n = max(1, -(-max(len(samples) - FRAME, 0) // HOP) + 1)
    padded = np.zeros((n - 1) * HOP + FRAME, dtype=np.int64)
    padded[: len(samples)] = samples[: len(padded)]
    views = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    mel, energy = [], []
    for at in range(0, n, BLOCK):
        frames = views[at : at + BLOCK] / (128.0 * (1 << 14))
        frames -= frames.mean(axis=1, keepdims=True)
        power = np.abs(np.fft.rfft(frames * np.hanning(FRAME), FFT)) ** 2
        mel.append(10.0 * np.log10(np.maximum(power @ mel_bank(rate), 10.0 ** (FLOOR_DB * 0.1 - 6))))
        energy.append(10.0 * np.log10(np.maximum((frames**2).mean(axis=1), 1e-8)))
    return np.concatenate(mel), np.concatenate(energy)


def hysteresis(energy: np.ndarray, rise_db: float = 1.5, fall_db: float = 0.5) -> list[tuple[int, int]]:
    """Segments (first frame, frame after the last): one starts where energy is ``rise_db`` over the low tenth of all frames and lasts until it is under ``fall_db`` over it."""
    base = np.sort(energy)[len(energy) // 10]
    mark = np.where(energy >= base + rise_db, 1, np.where(energy < base + fall_db, 0, -1))
    mark[0] = max(mark[0], 0)
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), 0))
    on = np.concatenate([[0], mark[last], [0]])
    turns = np.flatnonzero(np.diff(on))
    return [(int(a), int(b)) for a, b in zip(turns[::2], turns[1::2], strict=True)]


def features(media: bytes) -> tuple[np.ndarray, list[tuple[int, int]], float]:
    """(log-mel, segments in frames, seconds of a hop) of a stored file."""
    payload, rate = from_wav(media)
    resampled = resample(np.frombuffer(payload, np.uint8).astype(np.int64) - 128)
    rate = rate * UP / DOWN
    mel, energy = log_mel(resampled, rate)
    return mel, hysteresis(energy), HOP / rate


def _encode(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), to_wav(pad(data))


def store_audio(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_bytes (of the text's UTF-8) and media (a WAV file). A null text counts as empty and gives one unit of padding; repeated rows stay; other columns are ignored, and kept ones that have the name of a result give way to it."""
    return map_rows(docs, _encode, [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())], list(keep), ["text"])


#: Types of the stored tensors: whole decibels of each frame and filter, and whether a frame is inside a segment.
LOG_MEL = pa.fixed_shape_tensor(pa.int8(), [WINDOW_FRAMES, MELS], dim_names=["frame", "mel"])
VOICED = pa.fixed_shape_tensor(pa.int8(), [WINDOW_FRAMES], dim_names=["frame"])
QUIET = FLOOR_DB - 60


def to_tensors(media: bytes) -> bytes:
    """The windows of a stored file as an Arrow stream; frames that a last window lacks are silence."""
    mel, segments, hop = features(media)
    n = len(mel)
    count = -(-n // WINDOW_FRAMES)
    steps = np.full((count * WINDOW_FRAMES, MELS), QUIET, dtype=np.int8)
    steps[:n] = np.clip(np.rint(mel), -128, 127)
    voiced = np.zeros(count * WINDOW_FRAMES, dtype=np.int8)
    for a, b in segments:
        voiced[a:b] = 1
    first = np.arange(count) * WINDOW_FRAMES
    frames = np.minimum(n - first, WINDOW_FRAMES)
    spans = [pa.array(np.rint(at * hop * 1000).astype(np.int64)) for at in (first, first + frames)]
    tensors = [pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.size // count)) for kind, v in ((LOG_MEL, steps), (VOICED, voiced))]
    schema = pa.schema([("start_ms", pa.int64()), ("end_ms", pa.int64()), ("n_frames", pa.int32()), ("log_mel", LOG_MEL), ("voiced", VOICED)], {"hop_ms": f"{hop * 1000:g}"})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, schema) as stream:
        stream.write_batch(pa.RecordBatch.from_arrays([*spans, pa.array(frames, pa.int32()), *tensors], schema=schema))
    return out.getvalue().to_pybytes()


def from_tensors(stored: bytes) -> pa.RecordBatch:
    """The windows of a row, with their tensor columns."""
    return pa.ipc.open_stream(stored).read_next_batch()


def feature_text(stored: bytes | None) -> tuple[str | None]:
    """Frames, segments, voiced frames, mean spectrum and a checksum of all steps, from stored tensors."""
    if stored is None:
        return (None,)
    windows = from_tensors(stored)
    n = sum(windows.column("n_frames").to_pylist())
    steps = windows.column("log_mel").to_numpy_ndarray().reshape(-1, MELS)[:n].astype(np.int16)
    voiced = windows.column("voiced").to_numpy_ndarray().reshape(-1)[:n]
    segments = int((np.diff(np.concatenate([[0], voiced])) == 1).sum())
    mean = np.rint(steps.mean(axis=0)).astype(int)
    return (f"frames={n};segments={segments};voiced={int(voiced.sum())};hop_ms={windows.schema.metadata[b'hop_ms'].decode()};mel={','.join(map(str, mean))};crc={zlib.crc32(steps.tobytes()):08x}",)


def _windows(media: bytes | None) -> tuple[list[dict] | None]:
    if media is None:
        return (None,)
    windows = from_tensors(to_tensors(media))
    mel, voiced = windows.column("log_mel").to_numpy_ndarray(), windows.column("voiced").to_numpy_ndarray()
    plain = windows.select(["start_ms", "end_ms", "n_frames"]).to_pylist()
    return ([w | {"voiced_frames": int(v.sum()), "log_mel": m.ravel().astype(np.float32)} for w, m, v in zip(plain, mel, voiced, strict=True)],)


WINDOW_TYPE = T.StructType(
    [
        T.StructField("start_ms", T.LongType()),
        T.StructField("end_ms", T.LongType()),
        T.StructField("n_frames", T.IntegerType()),
        T.StructField("voiced_frames", T.IntegerType()),
        T.StructField("log_mel", T.ArrayType(T.FloatType())),
    ]
)


def log_mel_windows(stored: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per window of ``WINDOW_FRAMES`` frames: ``keep`` columns, start_ms, end_ms, n_frames, voiced_frames and log_mel, always WINDOW_FRAMES x MELS values, row by row (see ``as_tensors``). A null media has no windows; repeated rows have theirs each."""
    rows = map_rows(stored, _windows, [T.StructField("windows", T.ArrayType(WINDOW_TYPE))], list(keep), ["media"])
    names = not_replaced(keep, ["windows", *WINDOW_TYPE.names])
    return rows.select(*names, F.explode("windows").alias("w")).select(*names, "w.*")


def as_tensors(column: pa.Array) -> pa.FixedShapeTensorArray:
    """An Arrow column of ``log_mel`` lists as a fixed-shape tensor array."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    kind = pa.fixed_shape_tensor(pa.float32(), [WINDOW_FRAMES, MELS])
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat.flatten(), WINDOW_FRAMES * MELS))


def _facts(media: bytes | None) -> tuple:
    if media is None:
        return (None,) * 6
    payload, _ = from_wav(media)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), to_tensors(media)


FACT_FIELDS = [
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
]


def store_features(stored: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """``keep`` columns, digests of the media, and ``tensors``: the log-mel windows as an Arrow stream. A null media gives nulls; repeated rows stay; kept columns that have the name of a result give way to it; an empty table stays empty."""
    return map_rows(stored, _facts, [*FACT_FIELDS, T.StructField("tensors", T.BinaryType())], list(keep), ["media"])


def media_digest(with_features: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """Digest columns of stored media, and the feature text, from what ``store_features`` gave (or, given ``media`` only, from that). Nulls, repeated rows and clashing names as there."""
    rows = with_features if "tensors" in with_features.columns else store_features(with_features, keep)
    names = [f.name for f in FACT_FIELDS]
    return map_rows(rows, feature_text, [T.StructField("feature", T.StringType())], [*not_replaced(keep, [*names, "feature"]), *names], ["tensors"])


def op9_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    media, tensors = shared_path(spark, "audio"), shared_path(spark, "audio-tensors")
    store_audio(table(spark, sf_dir, "documents")).write.option("compression", "zstd").parquet(media)
    store_features(spark.read.parquet(media)).write.option("compression", "zstd").parquet(tensors)
    drop_path(spark, media)
    return media_digest(spark.read.parquet(tensors))
