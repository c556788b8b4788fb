"""Document fingerprints by winnowing.

Hashes of all runs of K code points roll over the text; of every window of W hashes the smallest is
chosen, the rightmost of equals, and kept with its position. Any run of K + W - 1 code points that two
texts share has a chosen hash in both, at the same place in the run. Texts shorter than K have one
hash of the whole; texts of fewer than W hashes one window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from gridloom.session import lean, ship

K, W = 8, 16
#: Text bytes that one range of doc_id holds, about, and those whose fingerprints one batch of results holds.
RANGE_BYTES, EMIT_BYTES = 32 << 20, 8 << 20
_BASE = np.uint32(0x9E3779B1)


def winnow(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the chosen hashes of a uint32 array of code points, in text order."""
    n = len(points)
    if n == 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint32)
    h = points * np.uint32(0x85EBCA6B) ^ (points >> np.uint32(7))
    if n < K:
        h = np.asarray([sum(int(x) * pow(int(_BASE), n - 1 - k, 1 << 32) for k, x in enumerate(h)) & 0xFFFFFFFF], dtype=np.uint32)
    else:
        # K = 8 is three doublings: the hash of 2m points is hash(first m) * base**m + hash(next m)
        base, m = _BASE, 1
        while m < K:
            h = h[:-m] * base + h[m:]
            base = np.uint32((int(base) * int(base)) & 0xFFFFFFFF)
            m *= 2
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)
    h ^= h >> np.uint32(16)
    # the smallest key of a window is its smallest hash, of equals the one furthest right
    key = (h.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    w, m = min(W, len(h)), 1
    while 2 * m <= w:
        key = np.minimum(key[:-m], key[m:])
        m *= 2
    if m < w:
        key = np.minimum(key[: len(key) - (w - m)], key[w - m :])
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return (np.uint64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF))).astype(np.int64), (key >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the distinct hashes of either that both have; 1 for two empty fingerprints. Sorted distinct input."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def fingerprint(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, ``positions`` and ``hashes`` of its text's winnowed hashes (null text: empty)."""
    ship(docs.sparkSession)
    docs = docs.drop("positions", "hashes")
    kind = T.StructType([T.StructField("positions", T.ArrayType(T.LongType())), T.StructField("hashes", T.ArrayType(T.LongType()))])

    @F.arrow_udf(kind)
    def chosen(texts: pa.Array) -> pa.Array:
        out = [winnow(_points(t or "")) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([p for p, _ in out], pa.list_(pa.int64())), pa.array([h.astype(np.int64) for _, h in out], pa.list_(pa.int64()))], names=["positions", "hashes"])

    return docs.withColumn("__chosen", chosen("text")).select(*docs.columns, "__chosen.positions", "__chosen.hashes")


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class _Printed:
    def __init__(self, text: str):
        self.text = text
        self.positions, self.hashes = winnow(_points(text))
        self.digest = hashlib.sha1(self.positions.astype("<i8").tobytes() + self.hashes.astype("<u4").tobytes()).hexdigest()
        self.distinct = np.unique(self.hashes)


COLUMNS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_hashes long, next_doc_id long, "
    "positions array<int>, hashes array<long>"
)
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))


def _ranges(down: np.ndarray, tie: np.ndarray, cut_down: np.ndarray, cut_tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range (the last cut not above it) of each key (down, tie), and whether the key is a cut itself."""
    low, high = np.searchsorted(cut_down, down, side="left"), np.searchsorted(cut_down, down, side="right")
    at, is_cut = low - 1, np.zeros(len(down), dtype=bool)
    for k in np.flatnonzero(high > low).tolist():  # ids that a cut has
        a, b = low[k], high[k]
        at[k] = a - 1 + np.searchsorted(cut_tie[a:b], tie[k], side="right")
        is_cut[k] = at[k] >= a and cut_tie[at[k]] == tie[k]
    return at, is_cut


def neighbours(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Each text, its edited text and the next document's, by their fingerprints.

    Next is the next smaller doc_id, after the last the first (null ids come last; rows of one doc_id
    by the hash of their text). The edited text has the last third of the code points replaced by as many of
    the next document's first (or all). A fingerprint is its positions and hashes; its string is their SHA-1.
    A null text is empty; two empty fingerprints have likeness 1. A single row is its own next, repeated rows follow each
    other. An empty table gives no row. Other columns are ignored. A text is one row of a task, however long.

    Rows are cut into ranges of (doc_id, hash of the text); each range also gets the first row of the range after it, so
    neighbours meet although no task holds more than a range, row by row. Only rows alike in both are never parted.
    The cuts are two numbers for each ``range_bytes`` of text, broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    last = -(1 << 63)
    rows = docs.select(F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(last))).alias("down"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), F.col("doc_id").isNull().alias("nameless"), F.coalesce("text", F.lit("")).alias("text"))
    n_bytes, n = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], COLUMNS)
    parts = int(max(1, -(-n_bytes // range_bytes)))
    keys = rows.select("down", "tie").repartitionByRange(parts, "down", "tie").groupBy(F.spark_partition_id()).agg(F.min(F.struct("down", "tie")).alias("head"))
    heads = sorted((r["head"]["down"], r["head"]["tie"]) for r in keys.collect())
    cuts = spark.sparkContext.broadcast((np.asarray([d for d, _ in heads], dtype=np.int64), np.asarray([t for _, t in heads], dtype=np.int64)))
    count = len(heads)

    @F.arrow_udf("struct<range:int,tail:int>")
    def place(down: pa.Array, tie: pa.Array) -> pa.Array:
        at, is_cut = _ranges(down.to_numpy(zero_copy_only=False), tie.to_numpy(zero_copy_only=False), *cuts.value)
        tail = pa.array((at - 1) % count, pa.int32(), mask=~is_cut)  # a range's first row also goes to the one before, the very first to the last
        return pa.StructArray.from_arrays([pa.array(at, pa.int32()), tail], names=["range", "tail"])

    placed = rows.withColumn("at", place("down", "tie"))
    # rows that share a range's first key may be many; the smallest stands for them
    tails = placed.where("at.tail IS NOT NULL").groupBy("at.tail").agg(F.min(F.struct("text", "nameless", "down", "tie")).alias("r"))
    tails = tails.select(F.col("tail").alias("range"), F.lit(1).alias("tail"), "r.down", "r.tie", "r.nameless", "r.text")
    both = placed.select("at.range", F.lit(0).alias("tail"), "down", "tie", "nameless", "text").unionByName(tails)
    laid = both.repartitionById(count, F.col("range")).sortWithinPartitions("range", "tail", "down", "tie", "text")

    def rowed(prints: _Printed, name: int, nameless: bool, then: _Printed, then_name: int, then_nameless: bool) -> tuple:
        n_chars = len(prints.text)
        third = n_chars // 3
        edited = _Printed(prints.text[: n_chars - third] + then.text[:third])
        return (
            None if nameless else name, n_chars, hashlib.sha256(edited.text.encode()).hexdigest(), prints.digest, edited.digest,
            likeness(prints.distinct, edited.distinct), likeness(prints.distinct, then.distinct), len(prints.distinct), None if then_nameless else then_name,
            prints.positions.astype(np.int32), prints.hashes.astype(np.int64),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        held, out, size = None, [], 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), _KINDS)], names=names)

        for batch in batches:
            for k, text, down, nameless, tail in zip(*(batch.column(c).to_pylist() for c in ("range", "text", "down", "nameless", "tail"))):
                now, name = held[1] if held and held[1].text == text else _Printed(text), ~down
                if held and held[0] == k:
                    out.append(rowed(held[1], held[2], held[3], now, name, nameless))
                    size += len(held[1].text)
                    if size >= EMIT_BYTES:
                        yield packed()
                        out, size = [], 0
                held = None if tail else (k, now, name, nameless)
        if out:
            yield packed()

    return laid.select("range", "text", "down", "nameless", "tail").mapInArrow(lean(run), COLUMNS)
