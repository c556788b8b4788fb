"""Words as 64-bit hashes, straight from UTF-8 bytes, and documents in bounded chunks.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Its hash is a polynomial over a fixed random
byte table, taken from prefix sums, so that no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gridloom.session import lean, ship

BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True

_SEGMENT = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_TABLE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_SEGMENT, 1 << (n - 1).bit_length())
    if size not in _powers:
        inverse = pow(int(_BASE), -1, 2**64)
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, np.uint64(inverse), dtype=np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _powers[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[size]


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array."""
    solid = np.zeros(len(buf) + 2, dtype=np.int8)
    solid[1:-1] = ~BLANK[buf]
    d = np.diff(solid)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """uint64 per word; long inputs go in segments cut between words, so memory follows the segment."""
    out = np.empty(len(starts), dtype=np.uint64)
    k = 0
    while k < len(starts):
        lo = int(starts[k])
        stop = max(k + 1, int(np.searchsorted(ends, lo + _SEGMENT, side="right")))
        hi = int(ends[stop - 1])
        up, down = _power_tables(hi - lo)
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_TABLE[buf[lo:hi]] * up[: hi - lo], out=total[1:])
        a, b = starts[k:stop] - lo, ends[k:stop] - lo
        out[k:stop] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        k = stop
    return out


def grams(h: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of every run of ``n`` consecutive entries of ``h`` (len(h) - n + 1 of them)."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    g, b = np.zeros(len(h) - n + 1, dtype=np.uint64), np.uint64(base | 1)
    for j in range(n):
        g *= b
        g += h[j : len(h) - n + 1 + j]
    for k in range(0, len(g), _SEGMENT):
        g[k : k + _SEGMENT] = mix(g[k : k + _SEGMENT])
    return g


class Bag:
    """The words of several texts laid end to end, a line feed after each text."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b"\n".join([*texts, b""]) or b"\n", dtype=np.uint8)
        sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.text_end = np.cumsum(sizes + 1)  # past the line feed
        self.text_start = self.text_end - sizes - 1
        self.starts, self.ends = spans(self.buf)
        self.first = np.searchsorted(self.starts, self.text_start)  # first word of each text
        self.n_words = np.diff(np.append(self.first, len(self.starts)))
        self.text_of = np.repeat(np.arange(len(texts)), self.n_words)
        self.hashes = word_hashes(self.buf, self.starts, self.ends)

    def windows(self, n: int) -> np.ndarray:
        """Positions in the word stream at which ``n`` words of one text start."""
        left = np.repeat(self.first + self.n_words, self.n_words) - np.arange(len(self.starts))
        return np.flatnonzero(left >= n)


CHUNK_SCHEMA = "chunk long, n_bytes long, payload binary"


def chunked(docs: DataFrame, target: int = 1 << 20) -> DataFrame:
    """Whole rows in chunks of about ``target`` text bytes, each one compressed Arrow stream.

    A chunk has several rows or one long one. Its number comes from the task and is the same when
    the task runs again.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        held: list[pa.RecordBatch] = []
        size = 0

        def packed() -> pa.RecordBatch:
            nonlocal number, held, size
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=options) as w:
                for b in held:
                    w.write_batch(b)
            out = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "n_bytes", "payload"])
            number, held, size = number + 1, [], 0
            return out

        for batch in batches:
            k = batch.schema.get_field_index("text")
            lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            total, at = np.cumsum(lengths + 1), 0
            while at < len(lengths):
                before = int(total[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(total, before + target - size, side="right")))
                if held and int(total[stop - 1]) - before + size > target:
                    yield packed()
                    continue
                held.append(batch.slice(at, stop - at))
                size += int(total[stop - 1]) - before
                at = stop
                if size >= target:
                    yield packed()
        if held:
            yield packed()

    return docs.mapInArrow(lean(run), CHUNK_SCHEMA)


def unpack(payload: bytes | pa.Buffer) -> pa.Table:
    with pa.ipc.open_stream(payload) as r:
        return r.read_all()


def texts_of(table: pa.Table) -> list[bytes]:
    """UTF-8 texts, null as empty."""
    return [x or b"" for x in table.column("text").cast(pa.binary()).to_pylist()]
