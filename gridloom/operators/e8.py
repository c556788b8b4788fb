"""The 8-d lattice: roots, nearest root, nearest lattice point, and what is built on them.

A lattice point is an array<double> of eight multiples of one half. ``parity`` is the rule of the
half-integer coset: "odd" (default) flips a coordinate where the sum of (y - 1/2) is even, "even"
where it is odd.
"""

from __future__ import annotations

import itertools
import struct

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.functions.vec import apply_matrix, clean, distance2, norm, num, sub, total, vector


def roots() -> list[list[float]]:
    """The 240 roots: 112 with two entries of +-1, by positions and then signs, then 128 of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((-1.0, 1.0), repeat=2):
            out.append([a if k == i else b if k == j else 0.0 for k in range(8)])
    halves = itertools.product((-0.5, 0.5), repeat=8)
    return out + [list(s) for s in halves if sum(x < 0 for x in s) % 2 == 0]


def roots_table(spark: SparkSession) -> DataFrame:
    """root_id, root. 240 rows."""
    return spark.createDataFrame([(k, r) for k, r in enumerate(roots())], "root_id int, root array<double>")


def nearest_root(v: Column) -> Column:
    """struct(dist, root_id) of the nearest root, the lowest id among equals (NaN counts as 0).

    All roots have norm sqrt(2), so the nearest one has the largest product with v, and that has a closed form.
    Of the integer roots it is the sum of the two largest magnitudes. Of the half-integer roots it is half the sum of
    all magnitudes, less the smallest one if an odd number of entries is negative. The id follows from the positions and
    signs, in the order of ``roots``: a zero counts as negative, which is the lower id, and of equal magnitudes the positions
    with the lower id are taken.
    """
    x = clean(v)
    zero, one = num(0), F.lit(1)
    mag = F.transform(x, lambda a: F.abs(a))
    by_size = F.array_sort(F.transform(mag, lambda a, i: F.struct((-a).alias("m"), i.cast("int").alias("i"))))
    p, q = by_size[0]["i"], by_size[1]["i"]
    i, j = F.least(p, q), F.greatest(p, q)
    pairs_before = (i * (15 - i) / 2).cast("int") + (j - i - 1)  # pairs are ordered by i, then j
    plus = lambda a: F.when(a > 0, 1).otherwise(0)
    whole_id = 4 * pairs_before + 2 * plus(F.get(x, i)) + plus(F.get(x, j))
    whole = F.get(mag, i) + F.get(mag, j)
    # half roots: bits are 1 where the root is positive, the first entry highest; an even number of them is 0
    bits = F.transform(x, plus)
    odd = F.aggregate(bits, F.lit(0), lambda s, b: s + b) % 2 == 1
    least = F.array_min(mag)
    # of the smallest entries flip the one that leaves the lowest id: a positive first one, else the last
    first_up = F.array_position(F.zip_with(mag, bits, lambda m, b: (m == least) & (b == 1)), F.lit(True))
    last_any = 9 - F.array_position(F.reverse(F.transform(mag, lambda m: m == least)), F.lit(True))
    flip = F.when(first_up > 0, first_up).otherwise(last_any)
    mended = F.transform(bits, lambda b, k: F.when(odd & (k + 1 == flip), 1 - b).otherwise(b))
    number = F.aggregate(mended, F.lit(0), lambda s, b: 2 * s + b)
    half_id = 112 + (number / 2).cast("int")  # of two neighbours in the order of signs exactly one has an even number of minus signs
    half = (total(mag) - F.when(odd, 2 * least).otherwise(zero)) / 2
    # at equal distance the integer root has the lower id
    best = F.when(whole >= half - 1e-12, F.struct(whole.alias("dot"), whole_id.alias("root_id"))).otherwise(F.struct(half.alias("dot"), half_id.alias("root_id")))
    d2 = F.aggregate(x, zero, lambda s, a: s + a * a) + 2 - 2 * best["dot"]
    return F.struct(F.sqrt(F.greatest(d2, zero)).alias("dist"), best["root_id"].cast("int").alias("root_id"))


def snap_rows(v: np.ndarray) -> np.ndarray:
    """Nearest 8-d lattice points of rows (numpy, for blobs; ``nearest_point`` is the column form)."""
    def even(x: np.ndarray) -> np.ndarray:
        y = np.rint(x)
        j = np.abs(x - y).argmax(axis=1)
        at = np.flatnonzero(y.sum(axis=1) % 2)
        y[at, j[at]] += np.where(x[at, j[at]] > y[at, j[at]], 1.0, -1.0)
        return y

    whole, half = even(v), even(v - 0.5) + 0.5
    return np.where((((v - whole) ** 2).sum(axis=1) <= ((v - half) ** 2).sum(axis=1))[:, None], whole, half)


def nearest_root_rows(v: np.ndarray) -> np.ndarray:
    """Ids of the roots nearest to rows: as all have one norm, those of the largest products."""
    table = np.asarray(roots()).T
    return np.concatenate([(v[a : a + 4096] @ table).argmax(axis=1) for a in range(0, len(v), 4096)])


def is_root(point: Column) -> Column:
    """Whether a vector is one of the 240 roots: a lattice point of squared norm 2."""
    near = nearest_point(point)
    return (F.abs(norm(point) - num(2**0.5)) < 1e-9) & (near["d2"] < 1e-18)


def _snap(v: Column, flip_if_odd: bool) -> Column:
    """Nearest integers, with the coordinate furthest off moved to its next nearest where the sum's parity asks for it."""
    y = F.transform(v, lambda x: F.rint(x) + num(0))
    off = F.zip_with(v, y, lambda a, b: F.abs(a - b))
    j = F.array_position(off, F.array_max(off))
    odd = F.pmod(total(y), num(2)) != 0
    flip = odd if flip_if_odd else ~odd
    moved = F.zip_with(y, v, lambda b, a: F.struct(b.alias("b"), F.when(a > b, b + 1).otherwise(b - 1).alias("m")))
    return F.when(flip, F.transform(moved, lambda s, i: F.when(i + 1 == j, s["m"]).otherwise(s["b"]))).otherwise(y)


def nearest_point(v: Column, parity: str = "odd") -> Column:
    """struct(d2, point): the nearer of the two cosets' points, the integer one if equal; d2 is squared."""
    x = clean(v)
    whole = _snap(x, True)
    half = F.transform(_snap(F.transform(x, lambda a: a - 0.5), parity == "even"), lambda a: a + 0.5)
    d0, d1 = F.least(distance2(x, whole), num(1e12)), F.least(distance2(x, half), num(1e12))
    return F.when(d0 <= d1, F.struct(d0.alias("d2"), whole.alias("point"))).otherwise(F.struct(d1.alias("d2"), half.alias("point")))


def snapped(df: DataFrame, column: str = "v", parity: str = "odd") -> DataFrame:
    """``df`` with point, d2 and point_key (twice the point as integers, a join and group key)."""
    out = df.withColumn("__near", nearest_point(F.col(column), parity)).withColumn("point", F.col("__near.point")).withColumn("d2", F.col("__near.d2"))
    return out.drop("__near").withColumn("point_key", F.transform("point", lambda x: (2 * x).cast("int")))


def point_id(point: Column) -> Column:
    """First 8 hex digits of the MD5 of the point as little-endian doubles (coordinates are few halves, so their bytes are known)."""
    halves = F.array(*(F.lit(struct.pack("<d", k / 2).hex()) for k in range(-64, 65)))
    word = F.array_join(F.transform(point, lambda x: F.element_at(halves, (2 * x).cast("int") + 65)), "")
    return F.substring(F.md5(F.unhex(word)), 1, 8)


def projection(n: int) -> list[list[float]]:
    """Seeded normal 8 x n matrix over the root of n, for vectors of more than eight entries."""
    return (np.random.RandomState(42).randn(8, n) / np.sqrt(n)).tolist()


def project(v: Column, n: int) -> Column:
    """``n`` dimensions onto eight; up to eight are padded with zeros."""
    return vector(v, 8) if n <= 8 else apply_matrix(projection(n), v)


def triples(df: DataFrame, key: str, pos: str, column: str = "v") -> DataFrame:
    """key, block, v: three consecutive 8-d vectors as one of 24; the last is padded with zeros."""
    block = F.floor(F.col(pos) / 3)
    rows = df.groupBy(key, block.alias("block")).agg(F.array_sort(F.collect_list(F.struct(pos, F.col(column).alias("v")))).alias("vs"))
    return rows.select(key, "block", vector(F.flatten(F.transform("vs", lambda s: s["v"])), 24).alias("v"))


def at_temperature(v: Column, point: Column, t: float) -> Column:
    """(1 - t) v + t point."""
    return F.zip_with(v, point, lambda a, b: (1 - t) * a + t * b)


def healed(v: Column, near: Column, threshold: float = 0.5) -> Column:
    """The lattice point where the strain (squared distance) exceeds the threshold, else v."""
    return F.when(near["d2"] > threshold, near["point"]).otherwise(v)


def residual(v: Column, point: Column) -> Column:
    return sub(v, point)


def invariants(v: Column, near: Column) -> Column:
    return F.struct(norm(v).alias("norm"), total(v).alias("projection"), near["point"].alias("point"), near["d2"].alias("error"))


def adaptive_temperature(df: DataFrame, column: str = "v", target: float = 5.0) -> DataFrame:
    """One row: clip(ln(target) / ln(100) / 2 + ln(1 + variance) / 10, 0, 1) over all entries of all vectors."""
    spread = df.select(F.explode(column).alias("x")).agg(F.var_pop("x").alias("variance"))
    value = num(0.5) * F.log(num(target)) / F.log(num(100)) + F.log1p("variance") / 10
    return spread.select("variance", F.greatest(num(0), F.least(num(1), value)).alias("temperature"))
