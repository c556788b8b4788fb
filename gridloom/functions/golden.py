"""Golden-ratio weights and Fibonacci quantisation."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from gridloom.functions.vec import num, total

PHI = (1 + math.sqrt(5)) / 2


def fibonacci(n: int) -> list[int]:
    out = [1, 1]
    while len(out) < n:
        out.append(out[-1] + out[-2])
    return out[:n]


def phi_weight(d: Column, power: float = 1.0) -> Column:
    return F.pow(num(PHI), -d * power)


def inverse_phi_weight(d: Column) -> Column:
    return 1 - F.pow(num(PHI), -d)


def log_periodic(k: Column, amplitude: float = 0.02, k_star: float = 0.05, phase: float = 0.0) -> Column:
    """1 + A cos(2 pi / ln(phi) * ln(k / k_star) + phase)."""
    omega = 2 * math.pi / math.log(PHI)
    return 1 + amplitude * F.cos(omega * F.log(F.greatest(k, num(1e-12)) / k_star) + phase)


def fibonacci_level(x: Column, levels: int = 15) -> Column:
    """Index of the Fibonacci number nearest to |x| (the first of equals)."""
    numbers = F.array(*map(num, fibonacci(levels)))
    off = F.transform(numbers, lambda f: F.abs(F.abs(x) - f))
    return (F.array_position(off, F.array_min(off)) - 1).cast("int")


def fibonacci_residual(x: Column, levels: int = 15) -> Column:
    sign = F.when(x < 0, num(-1)).otherwise(num(1))
    return x - sign * F.element_at(F.array(*map(num, fibonacci(levels))), fibonacci_level(x, levels) + 1)


def golden_angle_sector(x: Column, bits: int = 8) -> Column:
    return F.floor((x * PHI) % (2**bits)).cast("int")


def weighted_distance(a: Column, b: Column, n: int) -> Column:
    """Euclidean distance with normalised Fibonacci weights per dimension."""
    terms = fibonacci(20)
    w = [terms[i % 20] for i in range(n)]
    d = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(total(F.zip_with(d, F.array(*(num(x / sum(w)) for x in w)), lambda x, k: x * k)))


def greedy_fibonacci(x: Column, precision: int = 10) -> Column:
    """struct(indices, residual): from the largest term down, each term that still fits is taken once."""
    numbers = fibonacci(20)
    steps = F.array(*(F.struct(F.lit(i).alias("i"), num(numbers[i]).alias("f")) for i in range(min(precision, 19), -1, -1)))
    start = F.struct(F.expr("cast(array() as array<int>)").alias("indices"), F.abs(x).alias("left"))
    fold = F.aggregate(
        steps, start,
        lambda s, t: F.when(t["f"] <= s["left"], F.struct(F.array_append(s["indices"], t["i"]).alias("indices"), (s["left"] - t["f"]).alias("left"))).otherwise(s),
    )
    return F.struct(fold["indices"].alias("indices"), (fold["left"] * F.when(x < 0, num(-1)).otherwise(num(1))).alias("residual"))


def greedy_value(indices: Column, residual: Column) -> Column:
    """Inverse of ``greedy_fibonacci``; the residual carries the sign."""
    numbers = F.array(*map(num, fibonacci(20)))
    whole = total(F.transform(indices, lambda i: F.element_at(numbers, i + 1)))
    return F.when((residual < 0) | F.isnan(residual), -whole + residual).otherwise(whole + residual)
