"""Media columns: bytes as WAV audio, and spectral-peak pair fingerprints.

A payload becomes the 8-bit samples of a mono WAV held in a binary column. Fingerprints read the
stored bytes back with the ``wave`` module, take a short-time Fourier transform (Hann windows of
FRAME samples, half overlapping), keep each frame's strongest local maxima in log-spaced bands and pair
every peak with the next few: a pair's hash is (band bin, later bin, frames between), kept with the
time code of its first peak, in time order.
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

from gridloom.session import lean, ship

RATE, FRAME, HOP = 8000, 256, 128
#: Edges (in bins) of the bands that give one peak a frame each, and how many later peaks one is paired with.
BANDS, FAN = (2, 8, 20, 48, 128), 3
#: Samples transformed at once, so memory does not follow a text's length.
SPAN = 1 << 18
BLOCK = 192

_WINDOW = np.hanning(FRAME).astype(np.float32)


def encode_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def decode_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a mono 8-bit WAV; anything else raises ``wave.Error`` or ``ValueError``."""
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("not mono 8-bit audio")
        return r.readframes(r.getnframes()), r.getframerate()


def frame_count(n: int) -> int:
    """Frames that cover ``n`` samples, one at least."""
    return 1 + max(0, -(-(n - FRAME) // HOP))


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the strongest bin of each band in each frame that beats its band's neighbours in time."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.float32) - 128.0
    n = frame_count(len(x))
    x = np.pad(x, (0, FRAME + (n - 1) * HOP - len(x)))  # the last hop is filled up, so every sample is in a frame
    best, level = np.empty((n, len(BANDS) - 1), dtype=np.int64), np.empty((n, len(BANDS) - 1), dtype=np.float32)
    step = max(1, SPAN // HOP)
    for a in range(0, n, step):
        b = min(n, a + step)
        part = np.lib.stride_tricks.sliding_window_view(x[a * HOP : (b - 1) * HOP + FRAME], FRAME)[::HOP]
        power = np.abs(np.fft.rfft(part * _WINDOW, axis=1)).astype(np.float32)
        for k in range(len(BANDS) - 1):
            band = power[:, BANDS[k] : BANDS[k + 1]]
            best[a:b, k] = band.argmax(axis=1) + BANDS[k]
            level[a:b, k] = band.max(axis=1)
    before = np.vstack((np.zeros_like(level[:1]), level[:-1]))
    after = np.vstack((level[1:], np.zeros_like(level[:1])))
    frame, k = np.nonzero((level >= before) & (level > after))
    return frame, best[frame, k]


def pair_codes(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(time code, hash) of the peak pairs, by time and then by hash order within the peak's fan."""
    frame, bin_ = peaks(samples)
    times, codes = [], []
    for d in range(1, FAN + 1):
        gap = np.minimum(frame[d:] - frame[:-d], 4095)
        codes.append((bin_[:-d] << 20) | (bin_[d:] << 12) | gap)
        times.append(frame[:-d])
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.argsort(t, kind="stable")
    return t[order].astype(np.int32), c[order].astype(np.int32)


def _payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b" ")


def store(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, ``n_bytes`` (of the UTF-8 text, null as empty) and ``media``, a WAV of the padded text.

    n_bytes and media replace columns of that name. Repeated rows have each their own copy, an empty table gives none. A text
    is one value of a row and a WAV holds at most 4 GB, beyond which ``wave`` raises.
    """
    ship(docs.sparkSession)
    docs = docs.drop("n_bytes", "media")

    @F.arrow_udf("binary")
    def wav(texts: pa.Array) -> pa.Array:
        return pa.array([encode_wav(_payload(t)) for t in texts.to_pylist()], pa.binary())

    return docs.withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long")).withColumn("media", wav("text"))


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, rate int, frames int, feature string, times array<int>, codes array<int>"
_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
#: Stored bytes whose features one batch of results holds, about.
EMIT_BYTES = 8 << 20


def _read_back(raw: bytes | None) -> tuple:
    if raw is None:
        return (None,) * 8 + ([], [])
    samples, rate = decode_wav(raw)
    t, c = pair_codes(samples)
    digest = f"{len(t)}:" + hashlib.sha256(t.astype("<i4").tobytes() + c.astype("<i4").tobytes()).hexdigest()
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), rate, frame_count(len(samples)), digest, t, c


def fingerprint(media: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, what the stored bytes hold, their peak pairs as time-coded arrays, and ``feature``: how many pairs there are and the arrays' SHA-256.

    Null media gives nulls and empty arrays. Equal media have equal results, so repeated rows do. An empty table gives none.
    """
    ship(media.sparkSession)
    kept = media.select(*keep).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields) + ", " + FEATURES
    names = [*keep, *(c.split()[0] for c in FEATURES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, start = [], 0, 0
            for k, x in enumerate(batch.column("media")):
                raw = x.as_py()
                held.append(_read_back(raw))
                size += len(raw or b"")
                if size >= EMIT_BYTES or k == len(batch) - 1:
                    part = batch.slice(start, k + 1 - start)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(c, kind) for c, kind in zip(zip(*held), _KINDS))], names=names)
                    held, size, start = [], 0, k + 1

    return media.select(*keep, "media").mapInArrow(lean(run), schema)
