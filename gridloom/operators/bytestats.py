"""Byte statistics: histograms, entropies by context order, hashes, chunk plans and archive offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.session import ship


def byte_runs(df: DataFrame, column: str, order: int) -> DataFrame:
    """code, n: runs of ``order`` + 1 consecutive bytes of a value (up to 7, as one integer, oldest byte highest) and how often they occur.

    A numpy histogram per Arrow batch: what leaves Python is one row per distinct run and batch, so counting
    happens before any exchange and no row is made per byte.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes = []
            for value in pdf["b"]:
                x = np.frombuffer(value or b"", dtype=np.uint8).astype(np.int64)
                if len(x) > order:
                    code = np.zeros(len(x) - order, dtype=np.int64)
                    for k in range(order + 1):
                        code = code << 8 | x[k : len(x) - order + k]
                    codes.append(code)
            if codes:
                found, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pd.DataFrame({"code": found, "n": n})

    counted = df.select(F.col(column).cast("binary").alias("b")).mapInPandas(run, "code long, n long")
    return counted.groupBy("code").agg(F.sum("n").alias("n"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """sym (two hex digits), n."""
    return byte_runs(df, column, 0).select(F.lpad(F.hex("code"), 2, "0").alias("sym"), "n")


def conditional_entropy(df: DataFrame, column: str, order: int) -> DataFrame:
    """One row: bytes with a full context, contexts, and bits per byte given the ``order`` bytes before."""
    cells = byte_runs(df, column, order).withColumn("ctx", F.shiftright("code", 8))
    per = cells.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("part"))
    out = per.agg(F.sum("total").alias("n_bytes"), F.count("*").alias("contexts"), F.sum(F.col("total") * F.log2("total") - F.col("part")).alias("bits"))
    return out.select("n_bytes", "contexts", (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"))


def chunk_plan(df: DataFrame, key: str, size: Column, chunk: int) -> DataFrame:
    """key, chunk, offset, length of every chunk of a blob."""
    n = F.greatest(F.ceil(size / chunk), F.lit(1)).cast("long")
    rows = df.select(key, size.cast("long").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk"))
    return rows.select(key, "chunk", (F.col("chunk") * chunk).alias("offset"), F.least(F.lit(chunk).cast("long"), F.col("size") - F.col("chunk") * chunk).alias("length"))


def recommended_chunk(size: Column, memory_mb: int = 256, least: int = 64 << 10, most: int = 64 << 20) -> Column:
    """A quarter of the memory between 64 KiB and 64 MiB, but no more than the file."""
    return F.least(size, F.lit(max(least, min(most, memory_mb * (1 << 20) // 4)))).cast("long")


def memory_estimate(chunk: Column) -> Column:
    """Input, output and work space of a chunk, its vectors (64 bytes for every eight) and the root table."""
    return (chunk * 3 + F.floor(chunk / 8) * 64 + 240 * 8 * 8).cast("long")


def offsets(df: DataFrame, archive: str, order: str, size: str) -> DataFrame:
    """``df`` with offset: the running sum of sizes before the row, within its archive."""
    w = Window.partitionBy(archive).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("offset", (F.sum(size).over(w) - F.col(size)).cast("long"))
