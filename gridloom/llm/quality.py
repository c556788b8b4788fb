"""Quality classifier: a byte-level convolutional network in numpy.

Filters of four bytes, learned from labels, run over every byte of a document. Their rectified
responses are max-pooled over overlapping chunks of 256 bytes (a new one every 128), a logistic layer
gives each chunk a logit, and the mean over all chunks is the document's: the whole text counts,
however long it is. A filter is four tables of 256 rows, so one-hot bytes need no product.

Only the fit is bounded, by whole documents: FIT_DOCS labelled ones (smallest hash of doc_id first), and of these
the ones that fit FIT_BYTES of text together. All their chunks are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from gridloom.session import lean, ship

WIDTH, FILTERS, HALF = 4, 16, 128
CHUNK = 2 * HALF
#: Labelled documents, and bytes of their whole texts, that the fit may use.
FIT_DOCS, FIT_BYTES = 6000, 12 << 20
EPOCHS, BATCH, SEED = 3, 512, 11
#: Chunks whose responses are held at once.
SLICE = 512
#: Few labelled documents are gone over more often, for at least so many steps.
STEPS = 400


def _chunk_count(n: int) -> int:
    """Chunks that cover ``n`` bytes: one at least, each half after the first opens another."""
    return max(1, -(-n // HALF) - 1)


def _halves(raw: bytes) -> np.ndarray:
    """Bytes padded by zeros to whole halves (two at least) and the filters' overhang."""
    halves = _chunk_count(len(raw)) + 1
    out = np.zeros(halves * HALF + WIDTH - 1, dtype=np.uint8)
    out[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return out


class Network:
    """tables [WIDTH, 256, FILTERS], filter bias, and the chunk layer's weights and bias."""

    def __init__(self, tables: np.ndarray, shift: np.ndarray, weights: np.ndarray, bias: float):
        self.tables, self.shift, self.weights, self.bias = tables, shift, weights, bias

    def pooled(self, data: np.ndarray, size: int) -> np.ndarray:
        """Largest response of each filter in each run of ``size`` positions."""
        n = len(data) - WIDTH + 1
        out = np.empty((n // size, FILTERS), dtype=np.float32)
        step = max(1, (1 << 15) // size)
        for a in range(0, n // size, step):
            b = min(n // size, a + step)
            part = data[a * size : b * size + WIDTH - 1]
            r = self.tables[0][part[: (b - a) * size]]
            for j in range(1, WIDTH):
                r += self.tables[j][part[j : j + (b - a) * size]]
            out[a:b] = r.reshape(b - a, size, FILTERS).max(axis=1)
        return out

    def logit(self, raw: bytes) -> float:
        half = self.pooled(_halves(raw), HALF)
        chunk = np.maximum(np.maximum(half[:-1], half[1:]) + self.shift, 0)
        return float((chunk @ self.weights).mean() + self.bias)


def fit(texts: list[bytes], label: np.ndarray) -> Network:
    """Adam on the log loss of documents' mean chunk logits, over all chunks of all texts.

    label: 0 or 1 per text. A batch is as many whole texts as have BATCH chunks together (one at least). A label that
    no text has, or no text at all, gives the constant network of the base rate.
    """
    rng = np.random.default_rng(SEED)
    p = {
        "t": rng.normal(0, 0.08, (WIDTH, 256, FILTERS)).astype(np.float32), "s": np.zeros(FILTERS, np.float32),
        "w": (rng.choice([-1.0, 1.0], FILTERS) * 0.3).astype(np.float32), "b": np.zeros(1, np.float32),
    }
    if not len(label) or label.min() == label.max():
        rate = (label.sum() + 1) / (len(label) + 2)
        return Network(p["t"], p["s"], np.zeros(FILTERS, np.float32), float(np.log(rate / (1 - rate))))
    p["b"][0] = np.log(label.mean() / (1 - label.mean()))
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    laid = [_halves(x) for x in texts]
    data, begin = np.concatenate(laid), np.cumsum([0] + [len(x) for x in laid])
    count = np.asarray([_chunk_count(len(x)) for x in texts])
    usual = max(1.0, BATCH * len(label) / count.sum())  # documents in a batch, on average
    epochs = max(EPOCHS, -(-STEPS // max(1, int(count.sum() // BATCH))))
    window = np.arange(CHUNK + WIDTH - 1)
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(label))
        for docs in np.split(order, np.flatnonzero(np.diff(np.cumsum(count[order]) // BATCH)) + 1):
            n = count[docs]
            own = np.repeat(np.arange(len(docs)), n)
            at = np.repeat(begin[docs], n) + HALF * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            best, top = np.empty((len(at), FILTERS), dtype=np.int64), np.empty((len(at), FILTERS), dtype=np.float32)
            for a in range(0, len(at), SLICE):
                x = data[at[a : a + SLICE, None] + window]
                r = p["t"][0][x[:, :CHUNK]]
                for j in range(1, WIDTH):
                    r += p["t"][j][x[:, j : j + CHUNK]]
                best[a : a + SLICE] = r.argmax(axis=1)
                top[a : a + SLICE] = r.max(axis=1)
            top += p["s"]
            act = np.maximum(top, 0)
            z = np.bincount(own, weights=act @ p["w"], minlength=len(docs)) / n + p["b"][0]
            g = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - label[docs]) / usual).astype(np.float32)
            each = (g / n)[own].astype(np.float32)
            back = each[:, None] * p["w"] * (top > 0)
            grad = {"w": act.T @ each, "b": np.asarray([g.sum()], np.float32), "s": back.sum(axis=0), "t": np.zeros_like(p["t"])}
            for j in range(WIDTH):
                flat = data[at[:, None] + best + j].astype(np.int64) * FILTERS + np.arange(FILTERS)
                grad["t"][j] = np.bincount(flat.ravel(), weights=back.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
            grad["t"] += 1e-5 * p["t"]
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.99 * v[k] + 0.01 * grad[k] ** 2
                p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return Network(p["t"], p["s"], p["w"], float(p["b"][0]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_docs: int = FIT_DOCS, fit_bytes: int = FIT_BYTES) -> Network:
    """Fits on labelled rows with crc32(doc_id as text) mod 3 other than 1; null ids and labels are left out.

    Of ``fit_docs`` ids, smallest hash first, those are taken whose rows together keep within ``fit_bytes``; a null text is
    empty, repeated rows of an id all count. The driver receives these whole texts. An id with two labels has the larger.
    """
    ship(docs.sparkSession)
    own = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (own % 3 != 1))
        .groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    )
    text = F.coalesce("text", F.lit(""))
    sizes = docs.select("doc_id", F.octet_length(text).alias("n")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    taken, total = {}, 0
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # at most fit_docs
        cost = r["n"] + CHUNK * r["rows"]
        if total + cost <= fit_bytes:
            taken[r["doc_id"]], total = r["y"], total + cost
    if not taken:
        return fit([], np.empty(0))
    ids = docs.sparkSession.createDataFrame([(d,) for d in sorted(taken)], "doc_id long")
    rows = docs.select("doc_id", text.cast("binary").alias("raw")).join(F.broadcast(ids), "doc_id").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["raw"]))
    return fit([bytes(r["raw"]) for r in rows], np.asarray([taken[r["doc_id"]] for r in rows], dtype=np.float64))


def score(docs: DataFrame, network: Network) -> DataFrame:
    """All rows and columns of ``docs`` and ``score``, the probability of label 1 (replacing a column of that name).

    A null text is scored as an empty one. Equal texts have equal scores, so repeated rows do. Every byte is read, in pieces, so a very
    long text costs no more memory than itself. An empty table gives no row.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("score")
    held = spark.sparkContext.broadcast((network.tables, network.shift, network.weights, network.bias))  # 64 KB

    @F.pandas_udf(T.DoubleType())
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from lean(judged)(batches)

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = Network(*held.value)
        for texts in batches:
            z = np.asarray([net.logit((t or "").encode()) for t in texts], dtype=np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    return docs.withColumn("score", probability("text"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, as ``score``; at a score of exactly 0.5 predicted is 1. A null id is not held out."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
