"""Absorbing aggregates: a set of vectors as one scrambled state with a mass, and what follows from it."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridloom.functions.vec import apply_matrix, clean, norm, num


def scrambling(n: int, seed: int = 42) -> np.ndarray:
    """Orthogonal factor of a seeded normal matrix."""
    return np.linalg.qr(np.random.RandomState(seed).randn(n, n))[0]


def boundary(bulk: int = 24, edge: int = 23, seed: int = 123) -> np.ndarray:
    """Rows of unit norm that project ``bulk`` dimensions onto ``edge``."""
    m = np.random.RandomState(seed).randn(edge, bulk)
    return m / np.linalg.norm(m, axis=1)[:, None]


def absorb(rows: DataFrame, keys: list[str], n: int, column: str = "v", initial_mass: float = 1.0) -> DataFrame:
    """keys, absorbed, energy, mass = initial + energy / 100 and state = Q times the sum of the vectors.

    Plain sums per dimension, so a key of any size is aggregated in every task first.
    """
    clean_ = rows.withColumn("__v", clean(F.col(column)))
    sums = [F.sum(F.col("__v")[i]).alias(f"__{i}") for i in range(n)]
    out = clean_.groupBy(*keys).agg(F.count("*").alias("absorbed"), F.sum(norm(F.col("__v"))).alias("energy"), *sums)
    state = apply_matrix(scrambling(n).tolist(), F.array(*(F.col(f"__{i}") for i in range(n))))
    return out.withColumn("mass", num(initial_mass) + F.col("energy") * 0.01).withColumn("state", state).drop(*(f"__{i}" for i in range(n)))


def derived(absorbed: DataFrame, n: int) -> DataFrame:
    """Adds radius = mass^(1/(n-3)), area = radius^(n-2), entropy, temperature and capacity."""
    radius = F.pow("mass", num(1 / max(n - 3.0, 1.0)))
    area = F.when(F.col("radius") > 1e10, num(1e300)).otherwise(F.least(F.pow("radius", num(n - 2)), num(1e300)))
    out = absorbed.withColumn("radius", radius).withColumn("area", area).withColumn("entropy", F.col("area") / 4)
    cold = F.when(F.col("radius") < 1e-9, num(float("inf"))).otherwise(1 / (4 * math.pi * F.col("radius")))
    return out.withColumn("temperature", cold).withColumn("capacity", F.col("entropy") * math.log(2))


def horizon_state(derived_: DataFrame) -> DataFrame:
    """Adds encoded (state on the sphere of the radius) and its checksum, of the float64 bytes that SQL cannot give."""
    @F.pandas_udf(T.StringType())
    def checksum(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else hashlib.sha256(np.asarray(x, dtype="<f8").tobytes()).hexdigest()[:16])

    n = norm(F.col("state"))
    encoded = F.when(n > 1e-9, F.transform("state", lambda x: x / n * F.col("radius"))).otherwise(F.transform("state", lambda x: num(0)))
    return derived_.withColumn("encoded", encoded).withColumn("checksum", checksum("encoded"))


def decode_mass(radius: Column, n: int) -> Column:
    """Inverse of the radius."""
    return F.pow(radius, num(max(n - 3.0, 1.0)))


def noise(keys: list[str], n: int, seed: int = 0) -> Column:
    """``n`` normal numbers per key, by Box and Muller from the MD5 of seed, keys and position: alike on every run, other for every key."""

    def of(i: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(seed), *(F.col(k).cast("string") for k in keys), i))
        u, w = ((F.conv(F.substring(digest, at, 8), 16, 10).cast("double") + 1) / num(2.0**32 + 1) for at in (1, 9))
        return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * w)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), of)


def evaporate(derived_: DataFrame, keys: list[str], n: int, fraction: float = 0.1, seed: int = 0) -> DataFrame:
    """Adds mass_left (at least 0.1), entanglement and radiation: a fraction of the state plus the key's normal noise at the temperature of the mass left."""
    left = F.greatest(F.col("mass") * (1 - fraction), num(0.1))
    radius = F.pow(left, num(1 / max(n - 3.0, 1.0)))
    cold = 1 / (4 * math.pi * radius)
    radiation = F.zip_with("state", noise(keys, n, seed), lambda x, e: x * fraction + e * cold)
    entropy = F.least(F.pow(radius, num(n - 2)), num(1e300)) / 4
    return derived_.withColumn("mass_left", left).withColumn("entanglement", entropy * fraction).withColumn("radiation", radiation)


def holographic(v: Column) -> Column:
    """24 dimensions onto 23."""
    return apply_matrix(boundary().tolist(), v)


def holographic_decode(v: Column) -> Column:
    return apply_matrix(np.linalg.pinv(boundary()).tolist(), v)


def packing_energy(rows: DataFrame, power: float = 2.0, weighted: bool = True) -> DataFrame:
    """One row: total, pairs, mean energy, smallest and largest distance over all pairs (id, v) once.

    All pairs are the definition; both sides are packed into blocks whose pairs are one matrix product each.
    """
    from collections.abc import Iterator

    from gridloom.functions.golden import PHI
    from gridloom.operators.recall import ROW_BLOCK, _blocks
    from gridloom.session import ship

    ship(rows.sparkSession)
    size = ROW_BLOCK // 8

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ai, am, bi, bm in zip(pdf["a_ids"], pdf["a_m"], pdf["b_ids"], pdf["b_m"]):
                p, q = np.frombuffer(ai, "<i8"), np.frombuffer(bi, "<i8")
                x, y = np.frombuffer(am, "<f8").reshape(len(p), -1), np.frombuffer(bm, "<f8").reshape(len(q), -1)
                total, n, low, high = 0.0, 0, math.inf, 0.0
                for k in range(len(p)):
                    d = np.sqrt(((y[q > p[k]] - x[k]) ** 2).sum(axis=1))
                    n += len(d)
                    d = d[d >= 1e-10]
                    if len(d):
                        total += float(((PHI**-d if weighted else 1.0) / d**power).sum())
                        low, high = min(low, float(d.min())), max(high, float(d.max()))
                yield pd.DataFrame({"total": [total], "pairs": [n], "low": [low], "high": [high]})

    parts = _blocks(rows, "a", size).crossJoin(_blocks(rows, "b", size)).mapInPandas(run, "total double, pairs long, low double, high double")
    out = parts.agg(F.sum("total").alias("total_energy"), F.sum("pairs").alias("pairs"), F.min("low").alias("min_distance"), F.max("high").alias("max_distance"))
    return out.withColumn("normalized_energy", F.when(F.col("pairs") > 0, F.col("total_energy") / F.col("pairs")).otherwise(num(0)))


def spread(vectors: np.ndarray, steps: int = 20, rate: float = 0.01, power: float = 2.0, block: int = 256) -> np.ndarray:
    """Gradient steps that lower the packing energy of the vectors (in memory, ``block`` of them against all at a time)."""
    from gridloom.functions.golden import PHI

    x = np.array(vectors, dtype=np.float64)
    for _ in range(steps):
        push = np.empty_like(x)
        for at in range(0, len(x), block):
            some = x[at : at + block]
            d = np.sqrt(((some[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
            d[np.arange(len(some)), at + np.arange(len(some))] = 1.0
            d = np.maximum(d, 1e-10)
            force = PHI**-d / d**power * (math.log(PHI) + power / d) / d
            force[np.arange(len(some)), at + np.arange(len(some))] = 0.0
            push[at : at + block] = force.sum(axis=1)[:, None] * some - force @ x
        x = x + rate * push
    return x


def spread_groups(rows: DataFrame, key: str, steps: int = 20, rate: float = 0.01) -> DataFrame:
    """key, id, v after ``spread`` within each key's vectors."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pd.DataFrame({key: pdf[key], "id": pdf["id"], "v": list(spread(np.stack(pdf["v"].to_numpy()), steps, rate))})

    return rows.groupBy(key).applyInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, id long, v array<double>")


def hyperbolic_centroids(rows: DataFrame, key: str, dim: int) -> DataFrame:
    """key, centroid, n: Fréchet mean in the Poincaré ball by up to 100 steps of 0.1 times the mean log map."""
    eps, edge = 1e-10, 1 - 1e-10

    def inside(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=-1, keepdims=True)
        return np.where(n >= edge, x / np.maximum(n, eps) * edge, x)

    def plus(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        u, v = inside(u), inside(v)
        uv, uu, vv = ((a * b).sum(axis=-1, keepdims=True) for a, b in ((u, v), (u, u), (v, v)))
        low = 1 + 2 * uv + uu * vv
        return inside(((1 + 2 * uv + vv) * u + (1 - uu) * v) / np.where(np.abs(low) < eps, eps, low))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = inside(np.stack(pdf["v"].to_numpy()).astype(float))
        mean = inside(p.mean(axis=0))
        for _ in range(100 if len(p) > 1 else 0):
            d = plus(-mean[None, :], p)
            n = np.linalg.norm(d, axis=1, keepdims=True)
            room = 1.0 / (1 - (mean * mean).sum() + eps)
            logs = np.where(n < eps, 0.0, d * np.arctanh(np.clip(n, -1 + eps, 1 - eps)) / (room * n + eps))
            g = logs.mean(axis=0)
            if np.linalg.norm(g) < 1e-6:
                break
            v = 0.1 * g
            size = np.linalg.norm(v)
            mean = plus(mean, v * np.tanh(np.clip(room * size, -10, 10)) / (size + eps))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "centroid": [mean], "n": [len(p)]})

    return rows.select(key, "v").groupBy(key).applyInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, centroid array<double>, n long")
