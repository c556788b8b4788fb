"""Vectors as array<double> columns. Everything is a higher-order function, so it stays in the JVM.

A null vector gives null. Where a function is about unit vectors, norms under EPS count as zero.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, functions as F

EPS = 1e-10


def num(x: float) -> Column:
    return F.lit(float(x))


def vector(column: str | Column, n: int, scale: float = 1.0) -> Column:
    """First ``n`` entries as doubles times ``scale``, zero-padded."""
    c = F.col(column) if isinstance(column, str) else column
    head = F.transform(F.slice(c, 1, n), lambda x: x.cast("double") * num(scale))
    return F.concat(head, F.array_repeat(num(0), F.greatest(F.lit(0), F.lit(n) - F.size(c))))


def total(v: Column) -> Column:
    return F.aggregate(v, num(0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def times(v: Column, k: Column) -> Column:
    return F.transform(v, lambda x: x * k)


def norm2(v: Column) -> Column:
    return total(F.transform(v, lambda x: x * x))


def norm(v: Column) -> Column:
    """Euclidean norm, scaled by the largest entry so that squares cannot overflow."""
    top = F.array_max(F.transform(v, F.abs))
    return F.when(top == 0, num(0)).otherwise(top * F.sqrt(norm2(times(v, 1 / top))))


def distance2(a: Column, b: Column) -> Column:
    return norm2(sub(a, b))


def normalize(v: Column) -> Column:
    """Unit vector; a vector of norm under EPS stays."""
    n = norm(v)
    return F.when(n < EPS, v).otherwise(times(v, 1 / n))


def project_to_sphere(v: Column, radius: float = 1.0) -> Column:
    n = norm(v)
    return F.when(n < EPS, v).otherwise(times(v, num(radius) / n))


def project_to_ball(v: Column, radius: float = 1.0) -> Column:
    n = norm(v)
    return F.when(n > radius, times(v, num(radius) / n)).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 if either norm is under EPS."""
    na, nb = norm(a), norm(b)
    return F.when((na < EPS) | (nb < EPS), num(0)).otherwise(dot(a, b) / (na * nb))


def angle(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(num(-1), F.least(num(1), cosine(a, b))))


def lerp(a: Column, b: Column, t: float | Column) -> Column:
    k = num(t) if isinstance(t, (int, float)) else t
    return F.zip_with(a, b, lambda x, y: (1 - k) * x + k * y)


def slerp(a: Column, b: Column, t: float) -> Column:
    """Between the directions of a and b; nearly parallel ones give a's direction."""
    ua, ub = normalize(a), normalize(b)
    w = F.acos(F.greatest(num(-1), F.least(num(1), dot(ua, ub))))
    mixed = F.zip_with(times(ua, F.sin((1 - t) * w)), times(ub, F.sin(t * w)), lambda x, y: (x + y) / F.sin(w))
    return F.when(F.abs(w) < EPS, ua).otherwise(mixed)


def pad_or_truncate(v: Column, n: int) -> Column:
    return vector(v, n)


def apply_matrix(rows: list[list[float]], v: Column) -> Column:
    """Matrix (a literal) times vector."""
    return F.array(*(dot(F.array(*map(num, r)), v) for r in rows))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with ``value`` evaluated once: a one-element array, transformed. Keeps nested expressions from growing as powers."""
    return F.transform(F.array(value), body)[0]


def variance(v: Column) -> Column:
    """Population variance of the entries."""
    m = total(v) / F.size(v)
    return norm2(F.transform(v, lambda x: x - m)) / F.size(v)


def entropy_bits(v: Column) -> Column:
    """Shannon bits of |x| / sum |x|."""
    s = total(F.transform(v, F.abs))
    return total(F.transform(v, lambda x: F.when(x == 0, num(0)).otherwise(-(F.abs(x) / s) * F.log2(F.abs(x) / s))))


def incoherence(v: Column) -> Column:
    """Norm over largest entry over the root of the length; 1 for a flat vector."""
    return norm(v) / (F.array_max(F.transform(v, F.abs)) + EPS) / F.sqrt(F.size(v).cast("double"))


def hadamard(v: Column, n: int) -> Column:
    """Orthonormal Walsh-Hadamard transform of length ``n``: entry (i, j) has the sign of the parity of i & j."""
    k = 1 / n**0.5
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: total(F.transform(v, lambda x, j: F.when(F.bit_count(i.bitwiseAND(j)) % 2 == 0, x).otherwise(-x))) * num(k),
    )


def clean(v: Column, limit: float = 1e6) -> Column:
    """NaN to 0, everything else into [-limit, limit]."""
    return F.transform(v, lambda x: F.when(F.isnan(x), num(0)).otherwise(F.greatest(num(-limit), F.least(num(limit), x))))


def fibonacci_sphere(i: Column, n: int) -> Column:
    """Point ``i`` of ``n`` spread over the unit sphere by the golden angle; a single point is the pole."""
    golden = math.pi * (3 - math.sqrt(5))
    y = 1 - 2 * i / max(n - 1, 1)
    r = F.sqrt(F.greatest(num(0), 1 - y * y))
    return F.array(F.cos(golden * i) * r, y.cast("double"), F.sin(golden * i) * r)


def random_unit(n: int, seed: int) -> list[float]:
    v = np.random.default_rng(seed).normal(size=n)
    return (v / np.linalg.norm(v)).tolist()


def random_orthogonal(n: int, seed: int) -> list[list[float]]:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))
    return (q * np.sign(np.diag(r))).tolist()
