"""The extended binary Golay code as column functions and tables. Words are 24-bit longs, messages their low 12 bits."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The parity matrix's rows (it is symmetric) as 12-bit integers.
PARITY_ROWS = (2619, 3357, 3726, 2887, 3491, 3793, 3944, 2996, 2522, 2285, 3190, 2047)


def times_parity(v: Column) -> Column:
    """12-bit vector times the parity matrix over GF(2)."""
    bits = [F.shiftleft(F.bit_count(v.bitwiseAND(F.lit(row))).bitwiseAND(F.lit(1)), i) for i, row in enumerate(PARITY_ROWS)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long")


def encode(message: Column) -> Column:
    return message.bitwiseOR(F.shiftleft(times_parity(message), 12))


def message_of(word: Column) -> Column:
    return word.bitwiseAND(F.lit(4095))


def syndrome(word: Column) -> Column:
    return times_parity(message_of(word)).bitwiseXOR(F.shiftright(word, 12).bitwiseAND(F.lit(4095)))


def codebook(spark: SparkSession) -> DataFrame:
    """message, codeword, weight: 4,096 rows."""
    word = encode(F.col("id"))
    return spark.range(4096).select(F.col("id").alias("message"), word.alias("codeword"), F.bit_count(word).alias("weight"))


def _parity(message: int) -> int:
    out = 0
    for i, row in enumerate(PARITY_ROWS):
        out |= ((message & row).bit_count() & 1) << i
    return out


def correctable(spark: SparkSession) -> DataFrame:
    """syndrome, error of every pattern of up to three wrong bits: 2,325 rows, one per syndrome."""
    rows = []
    for n in range(4):
        for bits in combinations(range(24), n):
            error = sum(1 << b for b in bits)
            rows.append((_parity(error & 4095) ^ (error >> 12), error))
    return spark.createDataFrame(rows, "syndrome long, error long")


def decode(words: DataFrame, column: str = "word") -> DataFrame:
    """``words`` with codeword, message and errors; nulls where four or more bits are wrong.

    The table of correctable syndromes has 2,325 rows, so the join is a broadcast.
    """
    table = correctable(words.sparkSession).withColumnRenamed("syndrome", "__s")
    known = words.join(F.broadcast(table), syndrome(F.col(column).bitwiseAND(F.lit((1 << 24) - 1))) == F.col("__s"), "left")
    word = F.col(column).bitwiseAND(F.lit((1 << 24) - 1)).bitwiseXOR(F.col("error"))
    return known.withColumn("codeword", word).withColumn("message", message_of(word)).withColumn("errors", F.bit_count("error").cast("int")).drop("__s", "error")


def bits_to_word(bits: Column) -> Column:
    """Array of 24 zeros and ones, first entry the lowest bit."""
    return F.aggregate(F.reverse(bits), F.lit(0).cast("long"), lambda s, b: s * 2 + b)
