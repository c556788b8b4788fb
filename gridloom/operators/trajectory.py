"""Trajectories: ordered 8-d vectors as a straight (or hyperbolic) path between two lattice points, plus deviations.

Input is long: key, pos (any order column), v. Rows are numbered per key; a key is one partition of a
window, so a key's rows meet in one sorted run that streams through, as the fold needs their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.functions import hyperbolic
from gridloom.functions.vec import add, norm, num, sub
from gridloom.operators import e8


def deviations(points: DataFrame, curved: bool = False) -> DataFrame:
    """key, idx (from 0), length, start, end, v, expected, deviation and its norm for every row.

    The path runs from the lattice point nearest to the first vector to that of the last. Rows of one pos go by v.
    """
    order = Window.partitionBy("key").orderBy("pos", "v")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = points.select("key", (F.row_number().over(order) - 1).alias("idx"), F.count("*").over(Window.partitionBy("key")).alias("length"), F.first("v").over(whole).alias("a"), F.last("v").over(whole).alias("b"), "v")
    rows = rows.withColumn("start", e8.nearest_point(F.col("a"))["point"]).withColumn("end", e8.nearest_point(F.col("b"))["point"]).drop("a", "b")
    t = F.when(F.col("length") > 1, F.col("idx") / (F.col("length") - 1)).otherwise(num(0))
    rows = rows.withColumn("t", t.cast("double"))
    if curved:
        rows = hyperbolic.along(rows, "start", "end", F.col("t"), "expected")
    else:
        rows = rows.withColumn("expected", F.zip_with("start", "end", lambda x, y: (1 - F.col("t")) * x + F.col("t") * y))
    out = rows.withColumn("deviation", sub(F.col("v"), F.col("expected")))
    inner = (F.col("idx") > 0) & (F.col("idx") < F.col("length") - 1)
    return out.withColumn("dev_norm", F.when(inner, norm(F.col("deviation"))).otherwise(num(0))).withColumn("inner", inner)


def summarize(dev: DataFrame, tolerance: float | Column = 0.1) -> DataFrame:
    """key, length, perturbations, ratio = 64 n / (128 + 68 p), fidelity = 1 / (1 + p tolerance)."""
    tol = num(tolerance) if isinstance(tolerance, (int, float)) else tolerance
    n = F.sum(F.when(F.col("inner") & (F.col("dev_norm") > tol), 1).otherwise(0)).alias("perturbations")
    out = dev.groupBy("key").agg(F.max("length").alias("length"), n, F.max(tol).alias("tolerance"))
    p = F.col("perturbations")
    return out.withColumn("ratio", 64 * F.col("length") / (128 + 68 * p + 1e-10)).withColumn("fidelity", 1 / (1 + p * F.col("tolerance")))


def compress(dev: DataFrame, tolerance: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(heads: key, length, start, end; perturbations: key, idx, deviation), both long tables."""
    heads = dev.where("idx = 0").select("key", "length", "start", "end")
    return heads, dev.where(F.col("inner") & (F.col("dev_norm") > tolerance)).select("key", "idx", "deviation")


def decompress(heads: DataFrame, perturbations: DataFrame) -> DataFrame:
    """key, idx, v: positions from the length, the path, and the perturbations joined on (key, idx)."""
    rows = heads.withColumn("idx", F.explode(F.sequence(F.lit(0), (F.col("length") - 1).cast("int"))))
    t = F.when(F.col("length") > 1, F.col("idx") / (F.col("length") - 1)).otherwise(num(0)).cast("double")
    base = rows.withColumn("t", t).withColumn("base", F.zip_with("start", "end", lambda x, y: (1 - F.col("t")) * x + F.col("t") * y))
    out = base.join(perturbations, ["key", "idx"], "left")
    return out.select("key", "idx", F.when(F.col("deviation").isNull(), F.col("base")).otherwise(add(F.col("base"), F.col("deviation"))).alias("v"))


def reconstruction_error(original: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """key, error: mean norm of the differences; infinite where the lengths differ. Both are key, idx, v."""
    both = original.select("key", "idx", F.col("v").alias("a")).join(rebuilt.select("key", "idx", F.col("v").alias("b")), ["key", "idx"], "full")
    gap = F.col("a").isNull() | F.col("b").isNull()
    return both.groupBy("key").agg(F.when(F.max(gap), num(float("inf"))).otherwise(F.avg(norm(sub(F.col("a"), F.col("b"))))).alias("error"))


def search_tolerance(dev: DataFrame, target: float, by: str = "ratio", steps: int = 10) -> DataFrame:
    """key, tolerance, ratio, fidelity: ten bisection steps per key.

    By ratio, the first result and then those at or above the target that come closer; by fidelity the best
    ratio at or above the target, else the result at 0.01. Deviations are sorted once per key, then
    each step only counts those above its tolerance.
    """
    norms = dev.groupBy("key").agg(F.max("length").alias("length"), F.sort_array(F.collect_list(F.when(F.col("inner"), F.col("dev_norm")))).alias("norms"))
    low, high = (0.01, 1.0) if by == "ratio" else (0.001, 2.0)

    def result(tol: Column) -> Column:
        p = F.size(F.filter("norms", lambda x: x > tol))
        return F.struct(tol.alias("tolerance"), (64 * F.col("length") / (128 + 68 * p + 1e-10)).alias("ratio"), (1 / (1 + p * tol)).alias("fidelity"))

    df = norms.withColumn("low", num(low)).withColumn("high", num(high)).withColumn("best", F.lit(None).cast("struct<tolerance:double,ratio:double,fidelity:double>"))
    for _ in range(steps):
        df = df.withColumn("now", result((F.col("low") + F.col("high")) / 2))
        now, best = F.col("now"), F.col("best")
        if by == "ratio":
            short = now["ratio"] < target
            closer = best.isNull() | (~short & (F.abs(now["ratio"] - target) < F.abs(best["ratio"] - target)))
            up = short
        else:
            up = now["fidelity"] >= target
            closer = up & (best.isNull() | (now["ratio"] > best["ratio"]))
        df = df.withColumn("best", F.when(closer, now).otherwise(best)).withColumn("low", F.when(up, now["tolerance"]).otherwise(F.col("low"))).withColumn("high", F.when(up, F.col("high")).otherwise(now["tolerance"])).drop("now")
    best = F.coalesce("best", result(num(0.01)))
    return df.select("key", best["tolerance"].alias("tolerance"), best["ratio"].alias("ratio"), best["fidelity"].alias("fidelity"))
