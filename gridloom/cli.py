"""Command line: compress, decompress, info, list and test archives of files, as Spark jobs."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession, functions as F


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("gridloom").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def compress(spark: SparkSession, source: str, target: str, mode: str) -> int:
    """A file or folder into a table of archives."""
    from gridloom.sources.archive import compress_directory

    began = time.time()
    done = compress_directory(spark, source, target, mode).agg(F.count("*"), F.sum("original_size"), F.sum("compressed_size")).first()
    n, before, after = done[0], done[1] or 0, done[2] or 0
    print(f"{n} files, {before} -> {after} bytes, ratio {before / max(after, 1):.2f}, {time.time() - began:.1f} s")
    return 0


def decompress(spark: SparkSession, source: str, target: str) -> int:
    """Archives back into a table of name and data; damage is an error."""
    from gridloom.operators.codec import decompress_column

    decompress_column(spark.read.parquet(source)).select("name", "data").write.mode("overwrite").parquet(target)
    return 0


def info(spark: SparkSession, source: str) -> int:
    from gridloom.operators.codec import inspect

    inspect(spark.read.parquet(source)).drop("archive").show(1000, truncate=False)
    return 0


def listing(spark: SparkSession, source: str) -> int:
    spark.read.parquet(source).select("name", "original_size", "compressed_size").orderBy("name").show(100000, truncate=False)
    return 0


def test(spark: SparkSession, source: str) -> int:
    """Decodes every archive and compares its SHA-256 with the header's."""
    from gridloom.operators.codec import decompress_column, inspect

    rows = decompress_column(inspect(spark.read.parquet(source)))
    bad = rows.where(F.sha2("data", 256) != F.col("source_sha256")).count()
    print("damaged: %d" % bad)
    return int(bad > 0)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, aliases, two in (("compress", ["c"], True), ("decompress", ["d", "x"], True), ("info", ["i"], False), ("list", ["l"], False), ("test", ["t"], False)):
        p = commands.add_parser(name, aliases=aliases)
        p.add_argument("source")
        if two:
            p.add_argument("-o", "--output", required=True)
        if name == "compress":
            p.add_argument("-m", "--mode", default="fast")
    got = parser.parse_args(args)
    spark, kind = _session(), got.command[0]
    if kind == "c":
        return compress(spark, got.source, got.output, got.mode)
    if kind in "dx":
        return decompress(spark, got.source, got.output)
    return {"i": info, "l": listing, "t": test}[kind](spark, got.source)


if __name__ == "__main__":
    sys.exit(main())
