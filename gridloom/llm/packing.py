"""Lexical retrieval packing: documents into fixed windows, each filled with its seed's nearest neighbours.

The corpus is laid out by a lexical signature (commonest subword, then the smallest and
largest hash of subword pairs), so alike documents lie side by side, and cut into shards of bounded size. Each shard holds a
BM25 inverted index over subword ids; its weights come from counts over *all* documents. A seed takes
its window, then its best-scoring unused neighbours fill it, whole while they fit; the last is cut so
that the window is exactly full and its rest becomes the next seed. Only a shard's last tokens cannot
fill a window: they go to sequences whose lengths are powers of two, which need no padding.

Hot groups: equal signatures are told apart by doc_id in the range exchange, so a group of copies of
any size spreads over many shards. A shard never holds more than ``shard_tokens`` and one document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gridloom.llm.tokens import encoder, vocabulary_size
from gridloom.session import Scratch, lean, ship, tidy

#: BM25's usual parameters.
K1, B = 1.2, 0.75
#: Tokens that one shard's index holds, about 1,000 windows.
SHARD_TOKENS = 4_000_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, seed_doc_id long, bm25 double"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signatures(ids: np.ndarray, edge: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Per document: its commonest id, and the smallest and largest hash of neighbouring ids. Documents under
    three ids have -1, 0 and 0."""
    n = np.diff(edge)
    long = np.flatnonzero(n >= 3)
    top, low, high = [-1] * len(n), np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
    for at in range(0, len(long), 32):  # what fits the processor's cache
        some = long[at : at + 32]
        a, b = int(edge[some[0]]), int(edge[some[-1] + 1])
        h = _mix(ids[a : b - 1].astype(np.uint64) * np.uint64(1_000_003) + ids[a + 1 : b])
        pairs = np.stack((edge[some], edge[some + 1] - 2), axis=1).ravel() - a
        low[some] = (np.minimum.reduceat(h, pairs)[::2] >> np.uint64(1)).astype(np.int64)
        high[some] = (np.maximum.reduceat(h, pairs)[::2] >> np.uint64(1)).astype(np.int64)
    for k, a, b in zip(long.tolist(), edge[long].tolist(), edge[long + 1].tolist()):
        some = np.sort(ids[a : b - 1])
        runs = np.flatnonzero(np.concatenate(([True], some[1:] != some[:-1], [True])))
        top[k] = int(some[runs[(runs[1:] - runs[:-1]).argmax()]])
    return top, low, high


def tokenize(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """doc_id, ids (little-endian, two or four bytes each, ended by ``end_id``), n_tokens and the signature.

    A null or empty text has only ``end_id``. Repeated rows stay repeated.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(vocabulary)
        end = np.asarray([end_id], dtype=e.dtype).tobytes()
        for pdf in batches:
            raw = [x + end for x in e.encode_all(pdf["text"])]
            edge = np.concatenate(([0], np.cumsum([len(x) // e.dtype.itemsize for x in raw], dtype=np.int64)))
            top, k1, k2 = _signatures(np.frombuffer(b"".join(raw), dtype=e.dtype), edge)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": raw, "n_tokens": np.diff(edge), "top": top, "k1": k1, "k2": k2})

    return docs.select("doc_id", "text").mapInPandas(lean(run, "tokens"), "doc_id long, ids binary, n_tokens long, top long, k1 long, k2 long")


def corpus_counts(tokens: DataFrame, size: int, dtype: str) -> tuple[np.ndarray, int, float]:
    """(documents holding each id, documents, mean length) over all documents.

    Each task adds its documents up before anything is sent; the driver gets one row per id in use.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(size, dtype=np.int64)
        for pdf in batches:
            for a in range(0, len(pdf), 500):
                df += np.bincount(_counts([np.frombuffer(raw, dtype=dtype) for raw in pdf["ids"].iloc[a : a + 500]])[1], minlength=size)
        used = np.flatnonzero(df)
        yield pd.DataFrame({"id": used, "df": df[used]})

    n, total = tokens.agg(F.count("*"), F.sum("n_tokens")).first()
    out = np.zeros(size, dtype=np.int64)
    with tidy(tokens.sparkSession):
        for r in tokens.select("ids").mapInPandas(lean(run), "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).collect():  # at most the vocabulary
            out[r.id] = r.df
    return out, n, total / n if n else 1.0


def _counts(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id, times) of every distinct id of every document, by document and id."""
    flat = np.concatenate(ids)
    small = flat.dtype.itemsize == 2 and len(ids) <= 1 << 16
    kind, bits = (np.uint32, 16) if small else (np.uint64, 32)
    key = np.repeat(np.arange(len(ids), dtype=kind) << kind(bits), [len(x) for x in ids])
    key |= flat.astype(kind)
    del flat
    key.sort()
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1])))
    found = key[first]
    times = np.diff(np.append(first, len(key))).astype(np.int32)
    return (found >> kind(bits)).astype(np.int32), (found & kind((1 << bits) - 1)).astype(np.int32), times


class Shard:
    """BM25 inverted index over one shard's documents."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        length = np.asarray([len(x) for x in ids])
        d, t, tf = _counts([x[:-1] for x in ids])
        # idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[d] / mean)), in place
        below = B * length[d]
        below /= mean
        below += 1 - B
        below *= K1
        below += tf
        w = idf[t]
        w *= tf
        w *= K1 + 1
        w /= below
        del below, tf
        edge = np.searchsorted(d, np.arange(len(ids) + 1, dtype=d.dtype))
        self.terms = [t[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
        order = np.argsort(t, kind="stable")
        self.docs, self.weights = d[order].astype(np.int64), w[order]
        self.start = np.searchsorted(t[order], np.arange(len(idf) + 1, dtype=t.dtype))
        del order
        self.n = len(ids)
        # ids in a quarter of the documents or more have a dense row each, at most four times their postings
        common = np.flatnonzero(np.diff(self.start) * 4 >= max(1, self.n))
        self.row = np.full(len(idf), -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n))
        at = self.row[t] >= 0
        self.dense[self.row[t[at]], d[at]] = w[at]

    def scores(self, k: int) -> np.ndarray:
        """BM25 of every document in the shard against document ``k`` as a bag of distinct ids."""
        t = self.terms[k]
        if not len(t):
            return np.zeros(self.n)
        row = self.row[t]
        t = t[row < 0]
        a, n = self.start[t], self.start[t + 1] - self.start[t]
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out = np.bincount(self.docs[at], weights=self.weights[at], minlength=self.n).astype(np.float64, copy=False)  # without postings it is of integers
        for k in row[row >= 0].tolist():
            out += self.dense[k]
        return out

    def keep(self, docs: np.ndarray) -> None:
        """Leaves only these documents (ascending) to be scored; they are numbered anew, terms keep their documents' first numbers."""
        new = np.full(self.n, -1)
        new[docs] = np.arange(len(docs))
        number = new[self.docs]
        at = np.flatnonzero(number >= 0)
        self.docs, self.weights, self.start = number[at], self.weights[at], np.searchsorted(at, self.start)
        self.dense, self.n = np.take(self.dense, docs, axis=1), len(docs)


def fill(shard: Shard, lengths: list[int], window: int) -> Iterator[list[tuple[int, int, int, int, float]]]:
    """Sequences as lists of (document, start, length, seed, score), each of ``window`` tokens but the last ones."""
    n, free = shard.n, shard.n
    unused = np.ones(n, dtype=bool)
    names = np.arange(n)  # of the documents that the shard scores
    ahead, carry, row, room = 0, None, [], window
    while True:
        # a seed: what is left of a cut document, else the next unused one in the layout's order
        if carry is None:
            while ahead < n and not unused[ahead]:
                ahead += 1
            if ahead == n:
                break
            seed, at = ahead, 0
            unused[seed] = False
            free -= 1
        else:
            seed, at = carry
            carry = None
        while lengths[seed] - at >= window:  # whole windows of a long document need no neighbours
            yield [(seed, at, window, seed, 0.0)]
            at += window
        if lengths[seed] == at:
            continue
        row, room = [(seed, at, lengths[seed] - at, seed, 0.0)], window - (lengths[seed] - at)
        if 5 * free < 4 * len(names):  # the rest of the shard is no longer searched
            some = np.flatnonzero(unused[names])
            shard.keep(some)
            names = names[some]
        score = shard.scores(seed)
        score[~unused[names]] = -1.0
        ranked, k = np.argsort(-score, kind="stable"), 0
        while room and k < len(names) and score[ranked[k]] >= 0:
            d = int(names[ranked[k]])
            unused[d] = False
            free -= 1
            take = min(room, lengths[d])
            row.append((d, 0, take, seed, float(score[ranked[k]])))
            k += 1
            room -= take
            if take < lengths[d]:
                carry = (d, take)
        if room:
            break  # nothing is left in the shard
        yield row
        row = []
    # the shard's last tokens, in powers of two
    left = list(row)
    total = sum(x[2] for x in left)
    while total:
        size = 1 << (total.bit_length() - 1)
        part, total = [], total - size
        while size:
            d, s, n, seed, score = left.pop(0)
            take = min(n, size)
            part.append((d, s, take, seed, score))
            size -= take
            if take < n:
                left.insert(0, (d, s + take, n - take, seed, score))
        yield part


def pack(docs: DataFrame, vocabulary: str, window: int = 4096, end_id: int = 2, shard_tokens: int = SHARD_TOKENS, scratch: Scratch | None = None) -> DataFrame:
    """One row per piece: where a run of a document's ids lies, in which sequence and at which offset.

    docs needs doc_id and text; further columns are ignored. Null or empty texts are one end token.
    Repeated rows are packed each for itself. An empty table gives no row. ``sequence_tokens`` is the
    sequence's content (``window``, or a power of two), ``seed_doc_id`` the seed of the piece's window
    and ``bm25`` its score against it (0 for the seed itself).
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "packing")
    size = vocabulary_size(vocabulary)
    dtype = "<u2" if size <= 65535 else "<u4"
    tokens = scratch.save(tokenize(docs, vocabulary, end_id), "tokens", codec="lz4_raw")
    df, n, mean = corpus_counts(tokens, size, dtype)
    idf = spark.sparkContext.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)))  # one number per vocabulary entry
    parts = max(1, int(-(-n * mean // (2 * shard_tokens))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 40
        weights = idf.value

        def packed(ids: list[np.ndarray], names: list) -> pd.DataFrame:
            nonlocal number
            lengths, rows = [len(x) for x in ids], []
            for sequence in fill(Shard(ids, weights, mean), lengths, window):
                offset, content = 0, sum(x[2] for x in sequence)
                for d, start, length, seed, score in sequence:
                    crc = zlib.crc32(ids[d][start : start + length].astype("<u4").tobytes())
                    rows.append((names[d], start, length, crc, lengths[d], number, offset, content, names[seed], score))
                    offset += length
                number += 1
            columns = list(zip(*rows))
            out = pd.DataFrame({c.split()[0]: list(v) for c, v in zip(PIECES.split(", "), columns)})
            return out.astype({"doc_id": "Int64", "seed_doc_id": "Int64"})

        ids, names, held = [], [], 0
        for pdf in batches:
            for name, raw in zip(pdf["doc_id"].astype("Int64").tolist(), pdf["ids"]):
                x = np.frombuffer(raw, dtype=dtype)
                if ids and held + len(x) > shard_tokens:
                    yield packed(ids, names)
                    ids, names, held = [], [], 0
                ids.append(x)
                names.append(name)
                held += len(x)
        if ids:
            yield packed(ids, names)

    # doc_id splits equal signatures, and n_tokens and the ids' hash make the order of repeated ids stable
    keys = ["top", "k1", "k2", "doc_id", "n_tokens"]
    laid = tokens.repartitionByRange(parts, *keys).sortWithinPartitions(*keys, F.xxhash64("ids"))
    return laid.select("doc_id", "ids").mapInPandas(lean(run), PIECES)
