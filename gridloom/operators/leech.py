"""The 24-d lattice: exact nearest points by an Arrow kernel, and indices in SQL.

With y = sqrt(8) v, a lattice point is y = 2g + case + 4z for a Golay codeword g, case 0 or 1 and
integers z, where sum(y) is 4 case mod 8. Per coordinate let a <= 2 be the distance to the nearest
integer that is ``case`` mod 4; where the codeword has a one, the nearest that is case + 2 mod 4 lies
2 - a away on the other side. So a codeword costs sum a^2 + sum over its ones of (4 - 4a), and
mending the parity costs the least of 16 - 8a (zeros) and 8a (ones).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.functions.vec import num
from gridloom.operators import golay
from gridloom.session import ship

ROOT8 = math.sqrt(8.0)
_ROWS = 128


@lru_cache(maxsize=1)
def codebook() -> np.ndarray:
    """4096 x 24 bits; row = message."""
    words = np.asarray([m | golay._parity(m) << 12 for m in range(4096)])
    return ((words[:, None] >> np.arange(24)) & 1).astype(np.float64)


def nearest(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(y as integers [n, 24], squared distance in units of v) of the nearest lattice points of rows of ``v``."""
    v = np.asarray(v, dtype=np.float64).reshape(-1, 24)
    out, dist = np.empty(v.shape, dtype=np.int64), np.empty(len(v))
    for at in range(0, len(v), _ROWS):
        out[at : at + _ROWS], dist[at : at + _ROWS] = _nearest(v[at : at + _ROWS] * ROOT8)
    return out, dist / 8.0


def _nearest(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = codebook()
    ones = g.astype(bool)
    best, found = np.full(len(y), np.inf), np.empty(y.shape, dtype=np.int64)
    rows = np.arange(len(y))
    for case in (0, 1):
        base = 4 * np.round((y - case) / 4) + case
        a = np.abs(y - base)
        toward = np.where(y >= base, 1.0, -1.0)
        cost = (a * a).sum(axis=1)[:, None] + (4 - 4 * a) @ g.T
        parity = (base.sum(axis=1)[:, None] + 2 * (toward @ g.T)) % 8
        mend = np.full(cost.shape, np.inf)
        for i in range(24):  # the cheapest coordinate to move by four
            np.minimum(mend, np.where(ones[None, :, i], 8 * a[:, i : i + 1], 16 - 8 * a[:, i : i + 1]), out=mend)
        wrong = parity != 4 * case
        cost += np.where(wrong, mend, 0.0)
        k = cost.argmin(axis=1)
        least = cost[rows, k]
        better = least < best
        bit, way = ones[k], toward
        point = base + 2 * way * bit
        moves = np.where(bit, 8 * a, 16 - 8 * a)
        i = moves.argmin(axis=1)
        step = np.where(bit[rows, i], -4.0, 4.0) * way[rows, i]
        fix = wrong[rows, k]
        point[rows[fix], i[fix]] += step[fix]
        best[better] = least[better]
        found[better] = np.rint(point[better]).astype(np.int64)
    return found, best


def decompose(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(g, case, z) of integer points; ValueError off the lattice."""
    case = (y.sum(axis=1) % 8) // 4
    bits = ((y - case[:, None]) // 2) % 2
    z = y - 2 * bits - case[:, None]
    if (z % 4).any():
        raise ValueError("not a lattice point")
    return bits[:, :12] @ (1 << np.arange(12)), case, z // 4


def reconstruct(g: np.ndarray, case: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Points in the units of v."""
    return (2 * codebook()[np.asarray(g)] + np.asarray(case)[:, None] + 4 * np.asarray(z)) / ROOT8


def quantize(df: DataFrame, column: str = "v", scale: float = 1.0) -> DataFrame:
    """All columns of ``df`` and those of the nearest point of scale * v: y (integers), point, shell, dist, g, c and z.

    One Arrow pass without a shuffle. A null vector gives nulls.
    """
    ship(df.sparkSession)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = pdf[column].notna().to_numpy()
            v = np.stack(pdf[column][known].to_numpy()) * scale if known.any() else np.empty((0, 24))
            y, d2 = nearest(v)
            g, c, z = decompose(y)
            shell = np.rint((y * y).sum(axis=1) / 16.0).astype(int)
            columns = {"y": list(y), "point": list(y / ROOT8), "shell": shell, "dist": np.sqrt(d2), "g": g, "c": c, "z": list(z)}
            out = pdf.copy()
            for name, values in columns.items():
                full = pd.Series([None] * len(pdf), dtype=object)
                full[np.flatnonzero(known)] = pd.Series(list(values), index=np.flatnonzero(known), dtype=object)
                out[name] = full.array
            yield out

    return df.mapInPandas(run, f"{kept}, y array<int>, point array<double>, shell int, dist double, g int, c int, z array<int>")


def index_of(y: Column) -> Column:
    """struct(g, c, z) of an integer point, in SQL."""
    s = F.aggregate(y, F.lit(0), lambda a, b: a + b)
    case = (F.pmod(s, F.lit(8)) / 4).cast("int")
    bits = F.transform(y, lambda x: F.pmod(((x - case) / 2).cast("int"), F.lit(2)))
    z = F.zip_with(y, bits, lambda x, b: ((x - 2 * b - case) / 4).cast("int"))
    g = F.aggregate(F.reverse(F.slice(bits, 1, 12)), F.lit(0), lambda a, b: a * 2 + b)
    return F.struct(g.alias("g"), case.alias("c"), z.alias("z"))


def point_of(g: Column, c: Column, z: Column) -> Column:
    """Integer point of an index, in SQL: the codeword is computed, not looked up."""
    word = golay.encode(g.cast("long"))
    return F.transform(z, lambda x, i: (2 * F.call_function("getbit", word, i) + c + 4 * x).cast("int"))


def theta(n: int) -> list[int]:
    """Lattice points of squared norm 0, 2, 4, ..., 2(n - 1), exactly.

    The series is 65520/691 (sigma_11(m) - tau(m)); tau comes from the 24th power of Euler's product.
    """
    power = [1] + [0] * n
    for m in range(1, n + 1):
        for _ in range(24):
            for k in range(n, m - 1, -1):
                power[k] -= power[k - m]
    out = [1]
    for m in range(1, n):
        sigma = sum(d**11 for d in range(1, m + 1) if m % d == 0)
        out.append(65520 * (sigma - power[m - 1]) // 691)
    return out[:n]


def shell_prior(n: int, sigma: float) -> list[float]:
    """Shares of N(2m) exp(-m / sigma^2)."""
    counts = theta(n)
    logs = [math.log(c) - m / sigma**2 if c else -math.inf for m, c in enumerate(counts)]
    top = max(logs)
    weights = [math.exp(x - top) for x in logs]
    return [w / sum(weights) for w in weights]


def theta_table(spark: SparkSession, n: int) -> DataFrame:
    """shell, points (as decimal(38,0), exact)."""
    from decimal import Decimal

    return spark.createDataFrame([(k, Decimal(c)) for k, c in enumerate(theta(n))], "shell int, points decimal(38,0)")


#: First entry (from 1) of each 8-d layer of a 24-d vector.
LAYERS = {"first": 1, "second": 9, "third": 17}


def layer(v: Column, name: str = "first") -> Column:
    """8 of the 24 entries; an unknown name gives the first layer."""
    return F.slice(v, LAYERS.get(name, 1), 8)


def embed(v8: Column, name: str = "first") -> Column:
    before = LAYERS.get(name, 1) - 1
    zeros = lambda n: F.array_repeat(num(0), n)
    return F.concat(zeros(before), v8, zeros(16 - before))


def combine(a: Column, b: Column, c: Column) -> Column:
    return F.concat(a, b, c)
