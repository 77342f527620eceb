"""Audio features of 8-bit sample payloads: polyphase resampling, log-mel filterbanks, energy segments.

A document's bytes are the samples of an 8 kHz, 8-bit mono WAV file, which is lossless. From the stored
bytes the samples are read again, resampled 3:4 to 6 kHz by a polyphase filter, cut into overlapped
frames, and turned into log-mel rows. Rows are stored in fixed windows of WINDOW frames as an Arrow
fixed-shape tensor column (zeros after the last frame), beside each window's time span; the hysteresis
segmentation opens a segment above HIGH and closes it below LOW.

Null and empty texts are 192 blanks. Equal texts give equal values. Repeated rows each get a row; an
empty table gives an empty result. Only the id and text columns are read. Long payloads are worked on
in blocks of frames.
"""

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts
from .parts import chunks

RATE, UP, DOWN, UNIT = 8000, 3, 4, 192
FRAME, HOP, MELS, WINDOW, BLOCK = 256, 128, 20, 32, 1 << 18
HIGH, LOW = 1.0, 0.5
COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, spans array<struct<start_s:double,end_s:double>>, tensor_shape string, tensor binary"


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes())


def _filter(taps: int = 48) -> np.ndarray:
    """Windowed sinc at the lower of both band limits, dealt over UP phases."""
    n = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(n / DOWN) / DOWN * np.hamming(taps) * UP
    return h.reshape(-1, UP).T.astype(np.float32)


def _mel() -> np.ndarray:
    top = RATE * UP / DOWN / 2
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + top / 700), MELS + 2) / 2595) - 1)
    f = np.linspace(0, top, FRAME // 2 + 1)
    rise, fall = (f - edges[:-2, None]) / np.diff(edges)[:-1, None], (edges[2:, None] - f) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32).T


PHASES, MEL, HANN = _filter(), _mel(), np.hanning(FRAME).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """y[m] = sum over k of h[phase + k UP] x[n - k], with m DOWN = n UP + phase; a strided product for each phase of a block."""
    k = PHASES.shape[1]
    views = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(k - 1, np.float32), x]), k)
    y = np.empty((len(x) * UP + DOWN - 1) // DOWN, np.float32)
    for first in range(0, len(y), BLOCK * UP // k):
        last = min(len(y), first + BLOCK * UP // k)
        for r in range(first, min(first + UP, last)):
            at = np.arange(r, last, UP) * DOWN
            y[r:last:UP] = views[at // UP] @ PHASES[at[0] % UP][::-1]
    return y


def log_mel(y: np.ndarray) -> np.ndarray:
    y = np.pad(y, (0, max(0, FRAME - len(y))))
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    step = BLOCK // FRAME
    return np.concatenate([np.log(np.square(np.abs(np.fft.rfft(frames[i : i + step] * HANN))).astype(np.float32) @ MEL + 1e-6) for i in range(0, len(frames), step)])


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans: open where energy goes over mean + HIGH deviations, closed where it falls below mean + LOW."""
    mean, dev = energy.mean(), energy.std() + 1e-6
    state = np.where(energy > mean + HIGH * dev, 1, np.where(energy < mean + LOW * dev, -1, 0))
    known = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    on = np.concatenate(([0], np.where(known >= 0, state[known] > 0, False), [0])).astype(np.int8)
    return list(zip(np.flatnonzero(np.diff(on) > 0).tolist(), np.flatnonzero(np.diff(on) < 0).tolist()))


def tensor_bytes(mel: np.ndarray) -> bytes:
    """An Arrow stream of (start_s, end_s, log_mel fixed-shape tensor WINDOW x MELS), a row per window."""
    n = -(-len(mel) // WINDOW)
    full = np.zeros((n * WINDOW, MELS), np.float32)
    full[: len(mel)] = mel
    hop = HOP * DOWN / (UP * RATE)
    start = np.arange(n) * WINDOW * hop
    end = (np.minimum((np.arange(n) + 1) * WINDOW, len(mel)) - 1) * hop + FRAME * DOWN / (UP * RATE)
    t = pa.table({"start_s": start, "end_s": end, "log_mel": pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, WINDOW, MELS))})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t)
    return out.getvalue().to_pybytes()


def audio_row(text: str) -> tuple:
    raw = text.encode()
    payload = raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")
    media = to_wav(payload)
    back = from_wav(media)
    mel = log_mel(resample((np.frombuffer(back, np.uint8).astype(np.float32) - 128) / 128))
    energy = mel.mean(1)
    hop, length = HOP * DOWN / (UP * RATE), FRAME * DOWN / (UP * RATE)
    spans = segments(energy)
    times = [{"start_s": a * hop, "end_s": (b - 1) * hop + length} for a, b in spans]
    shape, tensor = f"{-(-len(mel) // WINDOW)}x{WINDOW}x{MELS}", tensor_bytes(mel)
    feature = f"{len(mel)}x{MELS};mean={energy.mean():.2f};dev={energy.std():.2f};bands=" + ",".join(f"{v:.1f}" for v in mel.mean(0)) + f";segments={len(spans)};active={sum(b - a for a, b in spans)}"
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, times, shape, tensor


def _features(batches):
    spans = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "spans", "tensor_shape", "tensor"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), spans, pa.string(), pa.binary()]
    for b in batches:
        for at, some in chunks(b.column(1), 1 << 20):
            cols = list(zip(*map(audio_row, some.to_pylist())))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(some)), *[pa.array(c, t) for c, t in zip(cols, types)]], ["doc_id", *names])


def audio_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digests of payload and stored file, a feature summary, spans of loud segments in seconds, and the tensor stream."""
    rows = texts(docs, id_col, text_col)
    return rows.mapInArrow(_features, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")


def read_tensor(stream: bytes) -> pa.Table:
    """start_s, end_s, log_mel of each window, from a document's tensor stream."""
    return pa.ipc.open_stream(stream).read_all()


def op6_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests, the spans as text in milliseconds, and shape and checksum of the tensor stream."""
    found = audio_features(table(spark, sf_dir, "documents"))
    span = lambda s: F.concat_ws("-", *[F.round(s[c] * 1000).cast("long").cast("string") for c in ("start_s", "end_s")])
    return found.select(*found.columns[:8], F.array_join(F.transform("spans", span), ",").alias("spans_ms"), "tensor_shape", F.sha2("tensor", 256).alias("tensor_sha256"))
