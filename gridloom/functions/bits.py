"""Integer and byte helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def zigzag(z: Column) -> Column:
    return F.when(z >= 0, 2 * z).otherwise(-2 * z - 1)


def unzigzag(u: Column) -> Column:
    return F.when(u % 2 == 0, (u / 2).cast("long")).otherwise((-(u + 1) / 2).cast("long"))


def shell_bucket(shell: Column, symbols: int) -> Column:
    """One of 16 buckets of equal width."""
    return F.least(F.floor(shell / max(1, (symbols + 15) // 16)), F.lit(15)).cast("int")


def bit_string(data: Column) -> Column:
    """Bytes as '0' and '1', most significant bit first."""
    return F.array_join(F.transform(F.split(F.hex(data), ""), lambda c: F.when(c == "", "").otherwise(F.lpad(F.conv(c, 16, 2), 4, "0"))), "")


def format_size(n: Column) -> Column:
    """Bytes as B, KB, MB (one decimal) or GB (two)."""
    k = 1024.0
    return (
        F.when(n < k, F.concat(n.cast("string"), F.lit(" B"))).when(n < k**2, F.format_string("%.1f KB", n / k))
        .when(n < k**3, F.format_string("%.1f MB", n / k**2)).otherwise(F.format_string("%.2f GB", n / k**3))
    )


def suffix(path: Column) -> Column:
    """Lower-cased extension with its dot, or empty."""
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]*)$", 1))


def from_bit_string(text: Column) -> Column:
    """Inverse of ``bit_string``; the text's length is a multiple of eight."""
    pieces = F.transform(F.sequence(F.lit(1), F.greatest((F.length(text) / 8).cast("int"), F.lit(1))), lambda i: F.lpad(F.conv(F.substring(text, i * 8 - 7, F.lit(8)), 2, 16), 2, "0"))
    return F.when(F.length(text) == 0, F.lit(b"")).otherwise(F.unhex(F.array_join(pieces, "")))
