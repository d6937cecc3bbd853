"""Audio columns: lossless 8-bit WAV, polyphase resampling, log-mel filterbanks, energy segments.

A byte string becomes the samples of a mono 8-bit WAV file of 8,000 Hz. Features are
computed from the samples read back from the file: a polyphase filter (3 phases, every
4th of the interpolated samples) brings them to 6,000 Hz; overlapping Hann frames give
log energies of 24 mel bands; a segment opens where a frame's energy rises above the
upper threshold and closes where it falls under the lower one. Features are kept as an
Arrow array of fixed-shape tensors (FRAMES x BANDS, the last one padded with the floor),
each with its time span in milliseconds, written as an Arrow IPC stream.

One pass, no shuffle; a text's features depend on the text alone.
Defined cases: a null or empty text is 64 zero bytes.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

RATE, UP, DOWN, TAPS = 8000, 3, 4, 16
FRAME, HOP, BANDS, FRAMES = 256, 128, 24, 32
UNIT = 64
#: dB above a file's median frame energy at which a segment opens and closes.
OPEN_DB, CLOSE_DB = 0.5, -0.5
FLOOR = 1e-10


def phases() -> np.ndarray:
    """The low-pass filter's coefficients by phase: UP rows of TAPS."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    h = np.sinc(n / max(UP, DOWN)) * np.hamming(UP * TAPS)
    return (h / h.sum() * UP).reshape(TAPS, UP).T[:, ::-1].astype(np.float32).copy()


def mel_bank() -> np.ndarray:
    """Triangular filters from the power spectrum of a frame to mel bands."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(50), mel(rate / 2), BANDS + 2) / 2595) - 1)
    f = np.arange(FRAME // 2 + 1) * rate / FRAME
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


PHASES, MEL, WINDOW = phases(), mel_bank(), np.hanning(FRAME).astype(np.float32)


def wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1), f.setsampwidth(1), f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def read_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored)) as f:
        return f.readframes(f.getnframes())


def resample(x: np.ndarray) -> np.ndarray:
    """x times UP / DOWN samples, by one short filter a phase."""
    n = len(x) * UP // DOWN
    padded = np.concatenate((np.zeros(TAPS - 1, np.float32), x, np.zeros(DOWN, np.float32)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.zeros(-(-n // UP) * UP, np.float32)
    for k in range(UP):  # output m = k, k + UP, ...: m * DOWN = base * UP + phase
        base, phase = divmod(k * DOWN, UP)
        own = windows[base::DOWN][: len(out) // UP]
        out[k : k + UP * len(own) : UP] = own @ PHASES[phase]
    return out[:n]


def log_mel(y: np.ndarray, step: int = 2048) -> np.ndarray:
    """Rows of BANDS log energies, one for each frame."""
    if len(y) < FRAME:
        y = np.concatenate((y, np.zeros(FRAME - len(y), np.float32)))
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    out = np.empty((len(frames), BANDS), np.float32)
    for a in range(0, len(frames), step):
        spectrum = np.fft.rfft(frames[a : a + step] * WINDOW)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out[a : a + step] = np.log(np.maximum(power @ MEL, FLOOR))
    return out


def segments(mel: np.ndarray) -> np.ndarray:
    """(first frame, end) of stretches of high energy, with hysteresis."""
    energy = 10 / np.log(10) * np.log(np.exp(mel.astype(np.float64)).mean(axis=1))
    energy -= np.median(energy)
    event = np.where(energy > OPEN_DB, 1, np.where(energy < CLOSE_DB, 0, -1))
    last = np.maximum.accumulate(np.where(event >= 0, np.arange(len(event)), -1))
    state = np.where(last >= 0, event[last], 0)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], state, [0]))))
    return edge.reshape(-1, 2)


def frame_ms(frame: np.ndarray) -> np.ndarray:
    return frame * HOP * 1000.0 * DOWN / (RATE * UP)


TENSOR = pa.fixed_shape_tensor(pa.float32(), (FRAMES, BANDS), dim_names=("frame", "band"))


def tensors(mel: np.ndarray) -> bytes:
    """An Arrow IPC stream of fixed-shape tensors with their time spans."""
    n = -(-len(mel) // FRAMES)
    whole = np.full((n * FRAMES, BANDS), np.log(FLOOR), np.float32)
    whole[: len(mel)] = mel
    start = np.arange(n) * FRAMES
    end = np.minimum(start + FRAMES, len(mel)) - 1
    storage = pa.FixedSizeListArray.from_arrays(pa.array(whole.ravel()), FRAMES * BANDS)
    batch = pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(TENSOR, storage), pa.array(frame_ms(start)), pa.array(frame_ms(end) + FRAME * 1000.0 * DOWN / (RATE * UP))], names=["log_mel", "start_ms", "end_ms"])
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue()


def features(payload: bytes) -> tuple[bytes, np.ndarray, str]:
    """The tensors, the segments in milliseconds and a line that sums them up."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x))
    found = segments(mel)
    spans = np.stack([frame_ms(found[:, 0]), frame_ms(found[:, 1])], axis=1)
    active = float((spans[:, 1] - spans[:, 0]).sum())
    line = f"frames={len(mel)};segments={len(spans)};active_ms={active:.1f};mel=" + ",".join(f"{v:.2f}" for v in mel.mean(axis=0, dtype=np.float64))
    return tensors(mel), spans, line


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, tensors binary, spans array<struct<start_ms: double, end_ms: double>>, feature string"


def encode(docs: DataFrame, step: int = 200) -> DataFrame:
    """Each text as a WAV file with its features; digests are of what was read back from the file."""

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, step):
                batch = whole.slice(k, step)
                data, starts, ends = C.strings(batch.column("text"))
                rows = []
                for doc, a, b in zip(batch.column("doc_id").to_pylist(), starts.tolist(), ends.tolist(), strict=True):
                    size = max(UNIT, -(-(b - a) // UNIT) * UNIT)
                    stored = wav(bytes(data[a:b]).ljust(size, b"\0"))
                    back = read_wav(stored)
                    tensor, spans, line = features(back)
                    rows.append((doc, b - a, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), stored, tensor, [{"start_ms": s, "end_ms": e} for s, e in spans.tolist()], line))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())])), pa.string())
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media", "tensors", "spans", "feature"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
