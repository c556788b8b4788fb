"""Poincaré ball and Lorentz model over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.vec import dot, let, norm, norm2, num, sub, times

EPS = 1e-10
EDGE = 1 - 1e-10


def into_ball(x: Column) -> Column:
    return let(x, lambda y: let(norm(y), lambda n: F.when(n >= EDGE, times(y, num(EDGE) / n)).otherwise(y)))


def distance(u: Column, v: Column, c: float = 1.0) -> Column:
    def between(x: Column, y: Column) -> Column:
        room = F.greatest((1 - c * norm2(x)) * (1 - c * norm2(y)), num(EPS))
        return F.acosh(F.greatest(num(1), 1 + 2 * c * norm2(sub(x, y)) / room)) / num(c**0.5)

    return let(into_ball(u), lambda x: let(into_ball(v), lambda y: between(x, y)))


def mobius_add(u: Column, v: Column, c: float = 1.0) -> Column:
    def plus(x: Column, y: Column) -> Column:
        dots = F.struct(dot(x, y).alias("xy"), norm2(x).alias("xx"), norm2(y).alias("yy"))

        def of(d: Column) -> Column:
            below = 1 + 2 * c * d["xy"] + c * c * d["xx"] * d["yy"]
            below = F.when(F.abs(below) < EPS, num(EPS)).otherwise(below)
            return F.zip_with(x, y, lambda a, b: ((1 + 2 * c * d["xy"] + c * d["yy"]) * a + (1 - c * d["xx"]) * b) / below)

        return let(dots, of)

    return into_ball(let(into_ball(u), lambda x: let(into_ball(v), lambda y: plus(x, y))))


def exp_map(x: Column, v: Column, c: float = 1.0) -> Column:
    """From x along v. The conformal factor is 1 / (1 - c|x|^2), its argument at most 10."""
    root = c**0.5

    def go(p: Column, w: Column, n: Column) -> Column:
        arg = F.greatest(num(-10), F.least(num(10), root * n / (1 - c * norm2(p) + EPS)))
        return F.when(n < EPS, p).otherwise(mobius_add(p, let(F.tanh(arg) / (root * n + EPS), lambda k: times(w, k)), c))

    return let(into_ball(x), lambda p: let(v, lambda w: let(norm(w), lambda n: go(p, w, n))))


def log_map(x: Column, y: Column, c: float = 1.0) -> Column:
    root = c**0.5

    def go(p: Column, d: Column, n: Column) -> Column:
        arg = F.greatest(num(-1 + EPS), F.least(num(1 - EPS), root * n))
        factor = F.atanh(arg) / (root * n / (1 - c * norm2(p) + EPS) + EPS)
        return F.when(n < EPS, times(p, num(0))).otherwise(let(factor, lambda k: times(d, k)))

    return let(into_ball(x), lambda p: let(mobius_add(times(p, num(-1)), y, c), lambda d: let(norm(d), lambda n: go(p, d, n))))


def along(df: DataFrame, u: str, v: str, t: Column, to: str) -> DataFrame:
    """``df`` with the point at t on the geodesic from u (0) to v (1): the exponential of t times the Möbius difference.

    In two projections, since one expression of this depth is more than the analyzer takes.
    """
    start, end = into_ball(F.col(u)), into_ball(F.col(v))
    step = df.withColumn("__d", mobius_add(times(start, num(-1)), end)).withColumn("__n", norm(F.col("__d")))
    moved = step.withColumn("__e", exp_map(F.col(u), times(F.col("__d"), t)))
    point = F.when((t <= 0) | (F.col("__n") < EPS), start).when(t >= 1, end).otherwise(F.col("__e"))
    return moved.withColumn(to, point).drop("__d", "__n", "__e")


def to_lorentz(p: Column) -> Column:
    n2 = norm2(p)
    inside = F.when(n2 >= 1 - EPS, times(p, num(1 - EPS) / F.sqrt(n2))).otherwise(p)
    m2 = norm2(inside)
    return F.concat(F.array((1 + m2) / (1 - m2)), times(inside, 2 / (1 - m2)))


def to_poincare(x: Column) -> Column:
    return F.transform(F.slice(x, 2, F.size(x) - 1), lambda y: y / (1 + F.element_at(x, 1)))


def minkowski(x: Column, y: Column) -> Column:
    return dot(x, y) - 2 * F.element_at(x, 1) * F.element_at(y, 1)


def lorentz_distance(x: Column, y: Column) -> Column:
    """acosh of minus the inner product, which is at most -1 on the hyperboloid."""
    return F.acosh(-F.least(minkowski(x, y), num(-1)))
