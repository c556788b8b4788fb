"""Nearest-neighbour recall: exact by blocks, by lattice cell, and by voting projections.

Results are long: qid, rank (from 1), rid, d2. Ties go to the smaller rid. A query without candidates
has no row; ``padded`` adds them back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from gridloom.functions.vec import distance2
from gridloom.operators import leech
from gridloom.session import ship

ROW_BLOCK, QUERY_BLOCK = 8192, 2048


def _blocks(df: DataFrame, name: str, size: int) -> DataFrame:
    """Rows packed ``size`` at a time: ids and a float64 matrix as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[np.ndarray] = []
        vs: list[np.ndarray] = []
        held = 0

        def packed() -> pd.DataFrame:
            return pd.DataFrame({f"{name}_ids": [np.concatenate(ids).astype("<i8").tobytes()], f"{name}_m": [np.concatenate(vs).astype("<f8").tobytes()]})

        for pdf in batches:
            for a in range(0, len(pdf), size):
                part = pdf.iloc[a : a + size]
                ids.append(part["id"].to_numpy(dtype=np.int64))
                vs.append(np.stack(part["v"].to_numpy()))
                held += len(part)
                if held >= size:
                    yield packed()
                    ids, vs, held = [], [], 0
        if held:
            yield packed()

    return df.select("id", "v").where("v IS NOT NULL").mapInPandas(run, f"{name}_ids binary, {name}_m binary")


def exact(rows: DataFrame, queries: DataFrame, k: int = 10, metric: str = "d2") -> DataFrame:
    """k nearest rows (id, v) of each query (id, v): squared distance, or 1 - cosine for metric "cosine".

    Blocks of rows meet blocks of queries: one matrix product each, whose k best per query are all that
    is sent on. d2 is then taken again from the differences, so it is exact near zero.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rid, rm, qid, qm in zip(pdf["r_ids"], pdf["r_m"], pdf["q_ids"], pdf["q_m"]):
                r, q = np.frombuffer(rid, "<i8"), np.frombuffer(qid, "<i8")
                x, y = np.frombuffer(rm, "<f8").reshape(len(r), -1), np.frombuffer(qm, "<f8").reshape(len(q), -1)
                if metric == "cosine":
                    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
                    near = 1 - (y @ x.T) / np.maximum(ny[:, None] * nx[None, :], 1e-300) * ((ny[:, None] >= 1e-10) & (nx[None, :] >= 1e-10))
                else:
                    near = (x * x).sum(axis=1)[None, :] - 2 * (y @ x.T) + (y * y).sum(axis=1)[:, None]
                m = min(k, len(r))
                # all rows that rounding could have brought in or out of the first k
                edge = np.partition(near, m - 1, axis=1)[:, m - 1]
                slack = 1e-9 * (1 + np.abs(edge))
                a, b = np.nonzero(near <= (edge + slack)[:, None])
                d = near[a, b] if metric == "cosine" else ((x[b] - y[a]) ** 2).sum(axis=1)
                order = np.lexsort((r[b], d, a))
                a, b, d = a[order], b[order], d[order]
                first = np.searchsorted(a, np.arange(len(q)))
                keep = np.arange(len(a)) - first[a] < k
                yield pd.DataFrame({"qid": q[a[keep]], "rid": r[b[keep]], "d2": d[keep]})

    near = _blocks(rows, "r", ROW_BLOCK).crossJoin(_blocks(queries, "q", QUERY_BLOCK)).mapInPandas(run, "qid long, rid long, d2 double")
    return top_k(near, k)


def top_k(candidates: DataFrame, k: int) -> DataFrame:
    """The k smallest (d2, rid) of each qid; Spark cuts each task's candidates before the exchange."""
    order = Window.partitionBy("qid").orderBy("d2", "rid")
    return candidates.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("qid", "rank", "rid", "d2")


def _rerank(pairs: DataFrame, rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    r = rows.select(F.col("id").alias("rid"), F.col("v").alias("rv"))
    q = queries.select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    return top_k(pairs.join(r, "rid").join(q, "qid").select("qid", "rid", distance2(F.col("rv"), F.col("qv")).alias("d2")), k)


def by_cell(rows: DataFrame, queries: DataFrame, k: int = 10, scales: tuple[float, ...] = (0.5, 0.25, 0.125)) -> DataFrame:
    """Candidates share the query's lattice cell at the finest scale that gives k of them, then all scales finer than it.

    One equi-join on (scale, cell); each candidate keeps its finest scale, counts per scale add up.
    """
    def cells(df: DataFrame, name: str) -> DataFrame:
        parts = [leech.quantize(df.select("id", "v"), "v", s).select(F.col("id").alias(name), F.lit(n).alias("scale"), "g", "c", "z") for n, s in enumerate(scales)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    met = cells(queries, "qid").join(cells(rows, "rid"), ["scale", "g", "c", "z"]).groupBy("qid", "rid").agg(F.min("scale").alias("scale"))
    counts = met.groupBy("qid", "scale").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("qid").orderBy("scale"))
    stop = counts.withColumn("so_far", so_far).groupBy("qid").agg(F.coalesce(F.min(F.when(F.col("so_far") >= k, F.col("scale"))), F.lit(len(scales) - 1)).alias("stop"))
    return _rerank(met.join(stop, "qid").where("scale <= stop").select("qid", "rid"), rows, queries, k)


def projections(n: int = 4, seed: int = 7) -> list[np.ndarray]:
    """Seeded orthonormal 24 -> 3 matrices times sqrt(8), so projected distances estimate true ones."""
    rng = np.random.default_rng(seed)
    return [np.linalg.qr(rng.normal(size=(24, 3)))[0] * np.sqrt(8.0) for _ in range(n)]


def by_projection(rows: DataFrame, queries: DataFrame, k: int = 10, n: int = 4, votes: int = 2, radius: float = 1.0, seed: int = 7) -> DataFrame:
    """Candidates lie within ``radius`` of the query in at least ``votes`` of ``n`` 3-d projections.

    Rows and queries are put in grid cells of edge ``radius``; each query probes its 27 neighbouring
    cells per projection by an equi-join, so only the query side is multiplied.
    """
    matrices = projections(n, seed)

    def low(df: DataFrame, name: str) -> DataFrame:
        each = F.array(*(
            F.struct(F.lit(p).alias("p"), *(_dot(m[:, j]).alias("xyz"[j]) for j in range(3))) for p, m in enumerate(matrices)
        ))
        return df.select(F.col("id").alias(name), F.explode(each).alias("e")).select(name, "e.p", *(F.col(f"e.{c}").alias(f"{name}_{c}") for c in "xyz"))

    def _dot(m: np.ndarray):
        return F.aggregate(F.zip_with(F.col("v"), F.array(*(F.lit(float(x)) for x in m)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    cell = lambda c: F.floor(F.col(c) / radius)
    grid = low(rows, "rid").select("rid", "p", "rid_x", "rid_y", "rid_z", cell("rid_x").alias("cx"), cell("rid_y").alias("cy"), cell("rid_z").alias("cz"))
    steps = F.array(*(F.struct(*(F.lit(s).alias(n) for n, s in zip(("dx", "dy", "dz"), (x, y, z)))) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)))
    probe = low(queries, "qid").withColumn("s", F.explode(steps))
    probe = probe.select("qid", "p", "qid_x", "qid_y", "qid_z", *((cell(f"qid_{c}") + F.col(f"s.d{c}")).alias(f"c{c}") for c in "xyz"))
    d2 = sum((F.col(f"rid_{c}") - F.col(f"qid_{c}")) * (F.col(f"rid_{c}") - F.col(f"qid_{c}")) for c in "xyz")
    hits = probe.join(grid, ["p", "cx", "cy", "cz"]).where(d2 <= radius * radius)
    passed = hits.groupBy("qid", "rid").agg(F.count("*").alias("votes")).where(F.col("votes") >= votes)
    return _rerank(passed.select("qid", "rid"), rows, queries, k)


def recall_at(approximate: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: share of the true (qid, rid) pairs that were found."""
    found = truth.select("qid", "rid").join(approximate.select("qid", "rid").withColumn("hit", F.lit(1)), ["qid", "rid"], "left")
    return found.agg(F.count("hit").alias("hits"), F.count("*").alias("truth"), (F.count("hit") / F.count("*")).alias("recall"))


def padded(result: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """k rows per query; ranks that were not reached have rid -1 and infinite d2."""
    want = queries.select(F.col("id").alias("qid"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))).alias("rank"))
    full = want.join(result, ["qid", "rank"], "left")
    return full.select("qid", "rank", F.coalesce("rid", F.lit(-1).cast("long")).alias("rid"), F.coalesce("d2", F.lit(float("inf"))).alias("d2"))
