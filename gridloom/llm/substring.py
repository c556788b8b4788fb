"""Substring dedup by fixed-block anchors: repeats of at least 13 words that an earlier document has.

Any run of 13 words holds a whole aligned block of 7, so indexing only the non-overlapping blocks
(word 0, 7, 14, ... of each document) and probing them with every rolling window of 7 words finds
every repeat. A hit is then extended: all 13-word windows around it are keyed by a 96-bit hash, the
smallest doc_id of each key is found, and runs of windows that an earlier document also has are the
maximal exact repeats, which are cut out.

Scale: documents travel as chunks of a few MB. A chunk sends each *distinct* hash once to the hash's
bucket and gets back the places that matter, so a passage that a third of all rows share costs one
entry per chunk, and no pair of occurrences is ever made. Buckets grow in number with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from gridloom.llm.words import Bag, chunked, grams, texts_of, unpack
from gridloom.session import Scratch, lean, lean_group, ship, trim

BLOCK, WINDOW = 7, 13
KEY_BITS = 32
#: Text bytes per bucket of the anchor index, and per chunk. A chunk sends each bucket one message, so there are
#: input**2 / (BUCKET_BYTES * CHUNK_BYTES) of them as long as that is less than one for each distinct hash.
BUCKET_BYTES, CHUNK_BYTES = 16 << 20, 4 << 20
_LAST = np.iinfo(np.int64).max


def _doc_ids(table: pa.Table) -> np.ndarray:
    """A null doc_id counts as larger than every other."""
    return np.asarray(table.column("doc_id").cast(pa.int64()).fill_null(_LAST).to_numpy(), dtype=np.int64)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a stable order, and where each value's group starts in it."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.empty(0, dtype=np.int64)
    return v[first], order, first


def _anchors(bag: Bag) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that hold a window: places of the rolling 7-word windows, and their distinct hashes."""
    at = bag.windows(BLOCK)
    at = at[bag.n_words[bag.text_of[at]] >= WINDOW]
    values, order, first = _distinct(grams(bag.hashes, BLOCK)[at])
    return at, values, order, first


def _bounds(buckets: int) -> np.ndarray:
    return np.asarray([(k << 64) // buckets for k in range(buckets)], dtype=np.uint64)


def _split(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.append(np.searchsorted(values, bounds), len(values))


def _key_shift(buckets: int) -> np.uint64:
    """Bits to drop from a hash's place in its bucket so that KEY_BITS are left."""
    return np.uint64(max(0, ((1 << 64) // buckets + 1).bit_length() - KEY_BITS))


def _squeeze(*columns: np.ndarray) -> bytes:
    """Columns of equal length as compressed byte planes."""
    return pa.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns), codec="zstd", asbytes=True)


def _unsqueeze(data: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    raw, out, at = np.frombuffer(pa.decompress(data, decompressed_size=n * sum(sizes), codec="zstd", asbytes=True), dtype=np.uint8), [], 0
    for kind, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def _one_by_one(work: Callable[..., list[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: ``work`` on the columns of one row (one chunk) at a time, whose memory is given back before the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from work(*(column[k] for column in batch.columns))
                trim()

    return lean(run)


def _send_anchors(chunks: DataFrame, buckets: int) -> DataFrame:
    """Per chunk and bucket: 32 bits of each distinct hash, whether it is a block, whether several texts have it.

    Two hashes that agree in those bits only make more candidates; windows are compared by 96 bits.
    """
    bounds, shift = _bounds(buckets), _key_shift(buckets)

    def send(chunk: pa.Scalar, payload: pa.Scalar) -> list[pa.RecordBatch]:
        bag = Bag(texts_of(unpack(payload.as_buffer())))
        at, values, order, first = _anchors(bag)
        if not len(values):
            return []
        aligned = ((at - bag.first[bag.text_of[at]]) % BLOCK == 0)[order]
        flags = np.logical_or.reduceat(aligned, first).astype(np.uint8) << 1
        last = np.append(first[1:], len(order)) - 1
        flags |= bag.text_of[at[order[first]]] != bag.text_of[at[order[last]]]
        del bag, at, order, first, last, aligned
        cut = _split(values, bounds)
        full = np.flatnonzero(cut[1:] > cut[:-1])
        keys = [_squeeze(_steps(((values[cut[k] : cut[k + 1]] - bounds[k]) >> shift).astype(np.uint32)), flags[cut[k] : cut[k + 1]]) for k in full]
        return [pa.record_batch({
            "bucket": pa.array(full, pa.int32()), "chunk": pa.array([chunk.as_py()] * len(full), pa.int64()), "base": pa.array(cut[full], pa.int32()), "n": pa.array(cut[full + 1] - cut[full], pa.int32()), "keys": pa.array(keys, pa.binary()),
        })]

    return chunks.select("chunk", "payload").mapInArrow(_one_by_one(send), "bucket int, chunk long, base int, n int, keys binary")


def _meet_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: hashes that are some document's block and occur in another document, back to their chunks."""
    n = pdf["n"].tolist()
    parts = [_unsqueeze(x, m, "<u4", "u1") for x, m in zip(pdf["keys"], n)]
    keys, every = np.concatenate([np.cumsum(x[0], dtype=np.uint32) for x in parts]), np.concatenate([x[1] for x in parts])
    del parts
    packed = keys.astype(np.uint64)
    packed <<= np.uint64(32)
    packed |= np.arange(len(keys), dtype=np.uint32)
    packed.sort()
    order, key = packed.astype(np.uint32), (packed >> np.uint64(32)).astype(np.uint32)
    del packed
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, len(key)))
    any_flag = np.bitwise_or.reduceat(every[order], first)
    good = ((any_flag & 2) > 0) & ((size > 1) | ((any_flag & 1) > 0))
    hit = np.zeros(len(keys), dtype=bool)
    hit[order] = np.repeat(good, size)
    out, start = [], 0
    for chunk, base, m in zip(pdf["chunk"], pdf["base"], n):
        places = np.flatnonzero(hit[start : start + m]) + base
        if len(places):
            out.append((chunk, len(places), _squeeze(_steps(places.astype(np.uint32)))))
        start += m
    return pd.DataFrame(out, columns=["chunk", "n", "places"])


def _groups(bag: Bag, ids: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 96-bit keys (in two parts, ascending), the group of each window, and each group's smallest doc_id."""
    low = grams(bag.hashes, WINDOW)[windows]
    high = grams(bag.hashes, WINDOW, 0xA0761D6478BD642F)[windows].astype(np.uint32)
    order = np.lexsort((high, low))
    a, b = low[order], high[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    return a[first], b[first], group, np.minimum.reduceat(ids[bag.text_of[windows]][order], first)


def _extend(joined: DataFrame, buckets: int) -> DataFrame:
    """Per chunk: places of its candidate windows (kind 0), and their distinct keys with the smallest doc_id (kind 1)."""
    bounds = _bounds(buckets)

    def candidates(bag: Bag, places: list[dict]) -> np.ndarray:
        at, values, order, first = _anchors(bag)
        shared = np.zeros(len(values), dtype=bool)
        for x in places:
            shared[np.cumsum(_unsqueeze(x["places"], x["n"], "<u4")[0], dtype=np.int64)] = True
        hit = np.zeros(len(bag.starts) + 1, dtype=bool)
        hit[at[order[np.repeat(shared, np.diff(np.append(first, len(order))))]]] = True
        del at, values, order, first
        # a repeat has the window's own aligned block too, so that block was hit
        windows = bag.windows(WINDOW)
        return windows[hit[windows + (bag.first[bag.text_of[windows]] - windows) % BLOCK]]

    def extend(chunk: pa.Scalar, payload: pa.Scalar, places: pa.Scalar) -> list[pa.RecordBatch]:
        table = unpack(payload.as_buffer())
        bag, ids = Bag(texts_of(table)), _doc_ids(table)
        windows = candidates(bag, places.as_py())
        if not len(windows):
            return []
        a, b, _, least = _groups(bag, ids, windows)
        del table, bag
        cut = _split(a, bounds)
        full = np.flatnonzero(cut[1:] > cut[:-1])
        parts = [slice(cut[k], cut[k + 1]) for k in full]
        data = [_squeeze(_steps(windows.astype(np.uint32))), *(_squeeze(_steps(a[x]), b[x], least[x]) for x in parts)]
        return [pa.record_batch({
            "kind": pa.array([0] + [1] * len(full), pa.int32()), "bucket": pa.array([-1, *full], pa.int32()), "chunk": pa.array([chunk.as_py()] * len(data), pa.int64()),
            "base": pa.array([0, *cut[full]], pa.int32()), "n": pa.array([len(windows), *(cut[full + 1] - cut[full])], pa.int32()), "data": pa.array(data, pa.binary()),
        })]

    return joined.select("chunk", "payload", "places").mapInArrow(_one_by_one(extend), "kind int, bucket int, chunk long, base int, n int, data binary")


def _meet_windows(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: the smallest doc_id of each window, back to the chunks whose own is larger."""
    n = pdf["n"].tolist()
    parts = [_unsqueeze(x, m, "<u8", "<u4", "<i8") for x, m in zip(pdf["data"], n)]
    a, b, docs = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in parts]), np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts])
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    first = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
    least = np.empty(len(a), dtype=np.int64)
    least[order] = np.repeat(np.minimum.reduceat(docs[order], first), np.diff(np.append(first, len(order))))
    out, start = [], 0
    for chunk, base, m in zip(pdf["chunk"], pdf["base"], n):
        mine = slice(start, start + m)
        smaller = np.flatnonzero(least[mine] < docs[mine])
        if len(smaller):
            out.append((chunk, len(smaller), _squeeze(_steps((smaller + base).astype(np.uint32)), least[mine][smaller])))
        start += m
    return pd.DataFrame(out, columns=["chunk", "n", "data"])


def _cut(bag: Bag, removed: np.ndarray) -> list[bytes]:
    """Each text without its removed words and the blanks after them; other blanks stay."""
    gone = np.flatnonzero(removed)
    until = np.minimum(np.append(bag.starts[1:], len(bag.buf))[gone], bag.text_end[bag.text_of[gone]] - 1)
    edge = np.zeros(len(bag.buf) + 1, dtype=np.int8)  # spans do not overlap, so sums are 0 or 1
    edge[bag.starts[gone]] += 1
    edge[until] -= 1
    left = bag.buf[np.cumsum(edge[:-1], dtype=np.int8) == 0].tobytes()
    lost = np.zeros(len(bag.text_start) + 1, dtype=np.int64)
    np.add.at(lost, bag.text_of[gone] + 1, until - bag.starts[gone])
    lost = np.cumsum(lost)
    return [left[a:b] for a, b in zip((bag.text_start - lost[:-1]).tolist(), (bag.text_end - 1 - lost[1:]).tolist())]


def dedup(docs: DataFrame, scratch: Scratch | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns of ``docs``, ``text`` without repeats of 13 words or more, and n_words, n_removed.

    A word goes if a window of 13 words over it also starts in a document with a smaller doc_id,
    judged on the input. Null text stays null and has no words. A null doc_id counts as the largest.
    Rows with one doc_id never remove each other. n_words and n_removed replace columns of that name.
    An empty table gives an empty one. A very long text is a chunk of its own, which must fit a task.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "substring")
    docs = docs.drop("n_words", "n_removed")
    chunks = scratch.save(chunked(docs, CHUNK_BYTES), "chunks", codec="uncompressed")  # the payload is compressed
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    hits = _send_anchors(chunks, buckets).groupBy("bucket").applyInPandas(lean_group(_meet_anchors), "chunk long, n int, places binary")
    per_chunk = hits.groupBy("chunk").agg(F.collect_list(F.struct("n", "places")).alias("places"))  # at most a chunk's own distinct hashes
    found = scratch.save(_extend(chunks.select("chunk", "payload").join(per_chunk, "chunk"), buckets), "windows")
    smaller = found.where("kind = 1").groupBy("bucket").applyInPandas(lean_group(_meet_windows), "chunk long, n int, data binary")
    notes = (
        found.where("kind = 0").select("chunk", "kind", "n", "data").unionByName(smaller.select("chunk", F.lit(1).alias("kind"), "n", "data"))
        .groupBy("chunk").agg(F.collect_list(F.struct("kind", "n", "data")).alias("notes"))
    )
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def covered(bag: Bag, ids: np.ndarray, rows: list[dict]) -> np.ndarray:
        """Whether each word is removed."""
        windows = np.cumsum(_unsqueeze(rows[0]["data"], rows[0]["n"], "<u4")[0], dtype=np.int64)
        _, _, group, least = _groups(bag, ids, windows)
        for x in rows[1:]:
            steps, smallest = _unsqueeze(x["data"], x["n"], "<u4", "<i8")
            least[np.cumsum(steps, dtype=np.int64)] = smallest
        gone = windows[least[group] < ids[bag.text_of[windows]]]
        edge = np.zeros(len(bag.starts) + WINDOW + 1, dtype=np.int8)
        edge[gone] += 1
        edge[gone + WINDOW] -= 1
        return np.cumsum(edge[: len(bag.starts)], dtype=np.int8) > 0  # at most WINDOW windows lie over a word

    def cut(payload: pa.Scalar, given: pa.Scalar) -> list[pa.RecordBatch]:
        table = unpack(payload.as_buffer())
        bag, ids = Bag(texts_of(table)), _doc_ids(table)
        rows = sorted(given.as_py() or [], key=lambda x: x["kind"])
        removed = covered(bag, ids, rows) if rows else np.zeros(len(bag.starts), dtype=bool)
        n_words, n_removed = bag.n_words, np.bincount(bag.text_of[removed], minlength=len(ids))
        texts = _cut(bag, removed)
        del bag, rows, removed
        k = table.schema.get_field_index("text")
        texts = [None if null else t for t, null in zip(texts, table.column(k).is_null().to_pylist())]
        field = table.schema.field(k)
        table = table.set_column(k, field, pa.array(texts, pa.binary()).cast(field.type))
        table = table.append_column("n_words", pa.array(n_words, pa.int64())).append_column("n_removed", pa.array(n_removed, pa.int64()))
        return table.combine_chunks().to_batches()

    return chunks.select("chunk", "payload").join(notes, "chunk", "left").select("payload", "notes").mapInArrow(_one_by_one(cut), schema)


def digest(deduped: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return deduped.select("doc_id", "n_words", "n_removed", F.sha2(words.cast("binary"), 256).alias("kept_sha256"))
