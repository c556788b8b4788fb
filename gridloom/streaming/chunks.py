"""Streams: chunks compressed as they come, sites consolidated as they come, events by window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.operators import codec, consolidate
from gridloom.session import ship


def clamp_chunk(n: int) -> int:
    """Chunk sizes lie between 64 KiB and 64 MiB."""
    return max(64 << 10, min(64 << 20, n))


def split(blobs: DataFrame, key: str, column: str, chunk: int = 4 << 20) -> DataFrame:
    """key, chunk, data, crc32: pieces of a binary column, in SQL."""
    data = F.col(column).cast("binary")
    last = F.greatest(F.ceil(F.octet_length(data) / chunk), F.lit(1)) - 1
    rows = blobs.select(key, data.alias("d"), F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("chunk"))
    piece = F.substring(F.col("d"), (F.col("chunk") * chunk + 1).cast("int"), F.lit(chunk))
    return rows.select(key, "chunk", piece.alias("data")).withColumn("crc32", F.crc32("data"))


def compress_stream(chunks: DataFrame, target: str, checkpoint: str, mode: str = "fast") -> StreamingQuery:
    """Compresses each chunk of a stream (with ``data``) into an append-only Parquet table; stateless, so any chunk order works."""
    ship(chunks.sparkSession)
    packed = codec.compress_column(chunks, "data", "archive", mode).withColumn("size", F.octet_length("data")).withColumn("compressed", F.octet_length("archive")).drop("data")
    return packed.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def decompress_table(spark: SparkSession, target: str) -> DataFrame:
    """The chunks back, each checked against its SHA-256 and, where it has one, its CRC-32; damage raises."""
    rows = codec.decompress_column(spark.read.parquet(target), "archive", "data")
    if "crc32" in rows.columns:
        rows = rows.withColumn("data", F.when(F.crc32("data").eqNullSafe(F.col("crc32")), F.col("data")).otherwise(F.raise_error(F.lit("CRC-32 does not match")).cast("binary")))
    return rows.drop("archive")


def statistics(table: DataFrame) -> DataFrame:
    """One row: chunks, bytes, compressed bytes and ratio of a compressed table."""
    return table.agg(F.count("*").alias("chunks"), F.sum("size").alias("total"), F.sum("compressed").alias("compressed")).withColumn("ratio", F.col("total") / F.col("compressed"))


def running_sites(rows: DataFrame, scale: float = 1.0) -> DataFrame:
    """site, n, mass after each micro-batch of rows (id, v): state is two numbers per site."""
    assigned = consolidate.assign(rows, scale).withColumn("site", F.concat_ws(":", "g", "c", F.array_join(F.transform("z", lambda x: x.cast("string")), ",")))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mass = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, mass = n + len(pdf), mass + float(pdf["energy"].sum())
        state.update((n, mass))
        yield pd.DataFrame({"site": [key[0]], "n": [n], "mass": [mass]})

    return assigned.select("site", "energy").groupBy("site").applyInPandasWithState(update, "site string, n long, mass double", "n long, mass double", "update", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts and sums of event values per window and type, with a watermark for late events."""
    keyed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return keyed.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
