"""Consolidation: rows that snap to the same 24-d site collapse into one representative.

The sum of squared norms (mass) moves to the sites; a representative is rescaled so that its group's
energy is the mass. A lossy collapse needs member addresses, so they are always carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridloom.functions.vec import norm2
from gridloom.operators import leech
from gridloom.session import ship


def member_id(column: str = "v") -> Column:
    """First 16 hex digits of the SHA-256 of the row as float32 bytes."""

    @F.pandas_udf(T.StringType())
    def address(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else hashlib.sha256(np.asarray(x, dtype="<f4").tobytes()).hexdigest()[:16])

    return address(column)


def assign(rows: DataFrame, scale: float = 1.0) -> DataFrame:
    """rows (id, v) with their site (g, c, z), the site's point and the row's energy. Rows must have 24 entries."""
    ship(rows.sparkSession)
    checked = rows.withColumn("v", F.when(F.size("v") == 24, F.col("v")).otherwise(F.raise_error(F.lit("rows of 24 entries are needed"))))
    return leech.quantize(checked.select("id", "v"), "v", scale).select("id", "v", "g", "c", "z", "point", norm2(F.col("v")).alias("energy"))


def sites(assigned: DataFrame, members: bool = False) -> DataFrame:
    """g, c, z, point, n, mass and first_id (with ``members`` also their ids) of every site.

    Aggregated by partial sums, so a site with any share of the rows is no hot spot; member lists are
    only collected on request, since a site's list can be as long as the table.
    """
    what = [F.first("point").alias("point"), F.count("*").alias("n"), F.sum("energy").alias("mass"), F.min("id").alias("first_id")]
    if members:
        what.append(F.sort_array(F.collect_list("id")).alias("members"))
    return assigned.groupBy("g", "c", "z").agg(*what)


def alpha(site_table: DataFrame, scale: float = 1.0) -> DataFrame:
    """Sites with alpha = sqrt(mass / (n |point / scale|^2)), the representative ``recon`` and ``origin_mass``, lost at the origin."""
    base = norm2(F.col("point")) / (scale * scale)
    out = site_table.withColumn("base", base).withColumn("alpha", F.sqrt(F.col("mass") / F.greatest(F.col("n") * F.col("base"), F.lit(1e-30))))
    out = out.withColumn("recon", F.transform("point", lambda x: x / scale * F.col("alpha")))
    return out.withColumn("origin_mass", F.when(F.col("base") == 0, F.col("mass")).otherwise(0.0)).drop("base")


def reconstruct(assigned: DataFrame, site_table: DataFrame) -> DataFrame:
    """id, v, recon: every row with its site's representative, by a join on the site."""
    return assigned.select("id", "v", "g", "c", "z").join(site_table.select("g", "c", "z", "recon"), ["g", "c", "z"]).select("id", "v", "recon")


def audit(assigned: DataFrame, site_table: DataFrame) -> DataFrame:
    """One row: rows, sites, collapse, mass in, mass out, origin mass and drift (relative, beyond the origin's mass)."""
    a = assigned.agg(F.count("*").alias("n"), F.sum("energy").alias("mass_in"))
    s = site_table.agg(F.count("*").alias("sites"), F.sum(F.col("n") * norm2(F.col("recon"))).alias("mass_out"), F.sum("origin_mass").alias("origin_mass"))
    return a.crossJoin(s).select(
        "n", "sites", (F.col("n") / F.col("sites")).alias("collapse"), "mass_in", "mass_out", "origin_mass",
        (F.abs(F.col("mass_in") - F.col("mass_out") - F.col("origin_mass")) / F.col("mass_in")).alias("drift"),
    )


def _bits(column: pd.Series) -> np.ndarray:
    """A column of equally long vectors as one matrix of float32 bits."""
    return np.stack(column.to_numpy()).astype("<f4").view("<u4")


def residuals(reconstructed: DataFrame) -> DataFrame:
    """id, recon and the XOR of the row's and its representative's float32 bits, as bytes: an exact residual."""
    ship(reconstructed.sparkSession)

    @F.pandas_udf(T.BinaryType())
    def xor(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([x.tobytes() for x in _bits(a) ^ _bits(b)]) if len(a) else pd.Series([], dtype=object)

    return reconstructed.select("id", "recon", xor("v", "recon").alias("residual"))


def restore(reconstructed: DataFrame, residual: DataFrame | None = None) -> DataFrame:
    """id, v as float32: the representative XOR the residual gives every bit back.

    The residuals come by id from a table of their own, or lie beside ``recon`` already.
    """
    coded = reconstructed if residual is None else reconstructed.select("id", "recon").join(residual.select("id", "residual"), "id")

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def back(a: pd.Series, r: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=object)
        return pd.Series(list((_bits(a) ^ np.frombuffer(b"".join(r), "<u4").reshape(len(a), -1)).view("<f4")))

    return coded.select("id", back("recon", "residual").alias("v"))
