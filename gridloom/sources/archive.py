"""Multi-file archives and chunk streams, as Python data sources.

A multi-file archive is magic, the length of a zlib JSON index, the index and the members' bytes.
Format ``gridloom_archive`` reads its members, or with option ``index`` only the index, without their bytes.
A chunk stream is magic and then chunks, each with original size, stored size and CRC-32;
``gridloom_chunks`` reads one in batch or as a stream.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from gridloom.session import ship

MAGIC, STREAM = b"GLOOM100", b"GLSTRM10"


def pack(names: list[str], blobs: list[bytes], sizes: list[int]) -> bytes:
    """One archive; offsets are running sums of the stored sizes."""
    index, at = [], 0
    for name, blob, size in zip(names, blobs, sizes):
        index.append({"name": name, "original_size": int(size), "compressed_size": len(blob), "offset": at})
        at += len(blob)
    head = zlib.compress(json.dumps(index).encode(), 6)
    return MAGIC + struct.pack("<Q", len(head)) + head + b"".join(blobs)


def read_index(data: bytes) -> tuple[list[dict], int]:
    """(members, where their bytes start); ValueError for other files."""
    if data[:8] != MAGIC:
        raise ValueError("not an archive of files")
    (n,) = struct.unpack_from("<Q", data, 8)
    return json.loads(zlib.decompress(data[16 : 16 + n])), 16 + n


def bundle(files: DataFrame, archive: str = "archive") -> DataFrame:
    """archive, data: one archive for each value of ``archive`` from its files (name, content), by name.

    An archive is one value, so its files must fit a task, as in any such container.
    """
    ship(files.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name")
        stored = [zlib.compress(bytes(c), 6) for c in pdf["content"]]
        return pd.DataFrame({archive: [pdf[archive].iloc[0]], "data": [pack(list(pdf["name"]), stored, [len(c) for c in pdf["content"]])]})

    kind = files.schema[archive].dataType.simpleString()
    return files.select(archive, "name", "content").groupBy(archive).applyInPandas(run, f"{archive} {kind}, data binary")


def members(archives: DataFrame, archive: str = "archive") -> DataFrame:
    """archive, name, original_size, compressed_size, offset, content of every member."""
    ship(archives.sparkSession)
    kind = archives.schema[archive].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, data in zip(pdf[archive], pdf["data"]):
                index, at = read_index(bytes(data))
                rows += [(name, m["name"], m["original_size"], m["compressed_size"], m["offset"], zlib.decompress(data[at + m["offset"] : at + m["offset"] + m["compressed_size"]])) for m in index]
            yield pd.DataFrame(rows, columns=[archive, "name", "original_size", "compressed_size", "offset", "content"])

    return archives.select(archive, "data").mapInPandas(run, f"{archive} {kind}, name string, original_size long, compressed_size long, offset long, content binary")


def write_stream(blob: bytes, chunk: int = 4 << 20) -> bytes:
    """A chunk stream of zlib chunks."""
    out = [STREAM]
    for a in range(0, max(len(blob), 1), chunk):
        part = blob[a : a + chunk]
        stored = zlib.compress(part, 6)
        out.append(struct.pack("<III", len(part), len(stored), zlib.crc32(part)) + stored)
    return b"".join(out)


def read_stream(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(chunk, original size, CRC-32, bytes) in order; ValueError where a CRC does not match."""
    if data[:8] != STREAM:
        raise ValueError("not a chunk stream")
    at, k = 8, 0
    while at < len(data):
        size, stored, crc = struct.unpack_from("<III", data, at)
        part = zlib.decompress(data[at + 12 : at + 12 + stored])
        if len(part) != size or zlib.crc32(part) != crc:
            raise ValueError(f"chunk {k} is damaged")
        yield k, size, crc, part
        at, k = at + 12 + stored, k + 1


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _paths(path: str) -> list[str]:
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    info = store.get_file_info(inside)
    if info.type == fs.FileType.Directory:
        found = [f.path for f in store.get_file_info(fs.FileSelector(inside, recursive=True)) if f.type == fs.FileType.File]
        return sorted(found)
    return [inside]


def _read(root: str, path: str, index_only: bool = False) -> bytes:
    """A file's bytes, or those up to the end of its archive index."""
    from pyarrow import fs

    store, _ = fs.FileSystem.from_uri(root if "://" in root else "file://" + root)
    with store.open_input_file(path) as f:
        if not index_only:
            return f.read()
        head = f.read(16)
        return head + f.read(struct.unpack_from("<Q", head, 8)[0]) if head[:8] == MAGIC else head


class ArchiveSource(DataSource):
    """spark.read.format("gridloom_archive").load(path): one partition per archive file.

    With option index=true only the index of each file is read, and content is null.
    """

    @classmethod
    def name(cls) -> str:
        return "gridloom_archive"

    def schema(self) -> str:
        return "archive string, name string, original_size long, compressed_size long, offset long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self.options["path"], self.options.get("index", "false").lower() == "true")


class _ArchiveReader(DataSourceReader):
    def __init__(self, root: str, index_only: bool):
        self.root, self.index_only = root, index_only

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _paths(self.root)]

    def read(self, partition: _File) -> Iterator[tuple]:
        data = _read(self.root, partition.path, index_only=self.index_only)
        index, at = read_index(data)
        for m in index:
            if self.index_only:
                yield partition.path, m["name"], m["original_size"], m["compressed_size"], m["offset"], None
                continue
            start = at + m["offset"]
            yield partition.path, m["name"], m["original_size"], m["compressed_size"], m["offset"], zlib.decompress(data[start : start + m["compressed_size"]])


class ChunkSource(DataSource):
    """Format "gridloom_chunks": chunks of stream files, in batch or as they arrive."""

    @classmethod
    def name(cls) -> str:
        return "gridloom_chunks"

    def schema(self) -> str:
        return "file string, chunk long, size long, crc32 long, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _ChunkReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _ChunkStream(self.options["path"])


class _ChunkReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _paths(self.root)]

    def read(self, partition: _File) -> Iterator[tuple]:
        for k, size, crc, part in read_stream(_read(self.root, partition.path)):
            yield partition.path, k, size, crc, part


class _ChunkStream(DataSourceStreamReader):
    """The offset is how many of the sorted files were taken; each new file is one partition, read by an executor."""

    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(_paths(self.root))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_File(p) for p in _paths(self.root)[start["files"] : end["files"]]]

    def read(self, partition: _File) -> Iterator[tuple]:
        for k, size, crc, part in read_stream(_read(self.root, partition.path)):
            yield partition.path, k, size, crc, part


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    spark.dataSource.register(ChunkSource)


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Whole files of a folder and its subfolders: path, modificationTime, length, content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def compress_directory(spark: SparkSession, source: str, target: str, mode: str = "fast") -> DataFrame:
    """Every file as a row of a Parquet table: name, original and compressed size, archive."""
    from gridloom.operators.codec import compress_column

    rows = compress_column(files(spark, source), "content", "archive", mode)
    rows.select(F.col("path").alias("name"), F.col("length").alias("original_size"), F.octet_length("archive").alias("compressed_size"), "archive").write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
