"""WARC archives with a two-level capture index.

Writing: one WARC/1.1 record per page. A record ends in two line breaks, so Spark's text writer with
that line separator writes it byte for byte, on any file system, committed per task. Of pages with
equal payloads the one with the largest page_id is a response, the others are revisits that refer to it.

Index: captures are sorted by reversed-host URL key (and page_id), cut into blocks of CAPTURES lines
and compressed; the sparse directory holds each block's first key. A lookup binary-searches the
directory for the block, the block for the line, and reads the record by its byte range.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.session import Scratch, ship, tidy

END = "\r\n\r\n"
#: Payload bytes per archive file, captures per index block, and captures per index part.
FILE_BYTES, CAPTURES, PART = 16 << 20, 1000, 50_000
DATE = "2020-01-01T00:00:00Z"


def digest(payload: Column) -> Column:
    """Upper-case base32 of the payload's SHA-1: 40 bits at a time, in base 32 digits."""
    sha = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(sha, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def surt(url: Column) -> Column:
    """Reversed-host key: ``http://www.Example.com:80/a?b`` becomes ``com,example,www:80)/a?b``; else the URL as it is."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)(.*)$", 1)
    tail = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)(.*)$", 2)
    name, port = F.lower(F.substring_index(rest, ":", 1)), F.regexp_extract(rest, r"(:[0-9]+)$", 1)
    return F.when(rest != "", F.concat(F.array_join(F.reverse(F.split(name, r"\.")), ","), port, F.lit(")"), tail)).otherwise(F.coalesce(url, F.lit("")))


#: Bits of the filter of repeated payloads: 4 MB, whatever the table's size.
FILTER_BITS = 1 << 25


def plan(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload. Payloads are equal if their lengths and SHA-1 are. Digests alone tell which
    repeat (an aggregate that every task prepares); a filter of FILTER_BITS bits of those is broadcast. Rows that
    it rules out are responses and stay where they are; only the others are exchanged, payload and all, to
    meet their group's largest page_id. A fuller filter exchanges more rows, and the result is the same.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), digest(payload.cast("binary")).alias("payload_digest"))
    keys = ["payload_digest", "payload_bytes"]
    slot = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))
    repeated = scratch.save(rows.groupBy(*keys).agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").select(*keys, "largest"), "repeated")
    marks = repeated.select(F.shiftright(slot, 15).alias("word"), slot.bitwiseAND(F.lit(32767)).alias("at")).groupBy("word").agg(F.expr("bitmap_construct_agg(at)").alias("bits"))
    marked = rows.withColumn("word", F.shiftright(slot, 15)).join(F.broadcast(marks), "word", "left")
    byte = F.conv(F.hex(F.substring(F.col("bits"), (slot.bitwiseAND(F.lit(32767)) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("getbit", byte, (slot % 8).cast("int")) == 1, F.lit(False))
    marked = marked.withColumn("hit", hit).drop("word", "bits")
    met = marked.where("hit").join(repeated, keys, "left").select(*rows.columns, "largest")
    told = marked.where("NOT hit").select(*rows.columns, F.lit(None).cast(rows.schema["page_id"].dataType).alias("largest")).unionByName(met)
    revisit = F.coalesce(F.col("page_id") < F.col("largest"), F.lit(False))
    return told.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("largest")).alias("refers_to"),
    )


def record(planned: DataFrame) -> DataFrame:
    """One WARC record per row as text, without its closing line breaks; line breaks in a URL are escaped.

    A response's block is an HTTP response whose body is the payload; a revisit has no block.
    """
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "%20")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    response = F.col("record_type") == "response"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit(END))
    body = F.when(response, F.concat(http, F.col("payload"))).otherwise(F.lit(""))
    lines = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.col("record_type")), F.concat(F.lit("WARC-Record-ID: <urn:page:"), page, F.lit(">")),
        F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), url), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to"), F.lit(">"))), F.when(~response, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes")), F.concat(F.lit("X-URL-Key: "), F.regexp_replace(surt(F.col("url")), r"[\x00-\x20]", "%20")),
        F.lit("Content-Type: application/http;msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(body)),
    )
    return planned.select(F.concat(lines, F.lit(END), body).alias("value"))


def write(pages: DataFrame, scratch: Scratch, file_bytes: int = FILE_BYTES) -> str:
    """Writes the archives (files of about ``file_bytes`` where pages are alike in size) and returns their folder."""
    n, total = pages.agg(F.count("*"), F.sum(F.octet_length(F.coalesce("html", F.lit(""))) + 700)).first()
    planned = plan(pages, scratch)
    target = scratch.path("archives")
    per_file = max(1, file_bytes * n // max(1, total or 0)) if n else 1
    with tidy(pages.sparkSession):
        record(planned).write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(target)
    return target


def parse(data: bytes | BinaryIO) -> Iterator[tuple[int, int, dict[str, str], int, int]]:
    """(offset, length, headers, block start, block length) of every record of an uncompressed archive.

    Reads headers and passes over blocks, so memory does not follow the archive's size or a record's.
    """
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    at = 0
    while line := stream.readline(1 << 16):
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        size, headers = len(line), {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name] = value
            size += len(line)
        start, length = at + size + len(line), int(headers["Content-Length"])
        stream.seek(start + length)
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        end = start + length + 4
        yield at, end - at, headers, start, length
        at = end


LINE = "url_key string, page_id long, file string, offset long, length long"


def captures(spark: SparkSession, archives: str, direct: bool | None = None) -> DataFrame:
    """One row per record of the archives: key, page_id, file and byte range. Bodies are not kept.

    Workers stream each file where they can open it (``direct``, by default as its scheme says); else Spark reads it whole.
    """
    ship(spark)
    direct = _direct(archives) if direct is None else direct

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, name in enumerate(pdf["path"]):
                with io.BufferedReader(_open(name), 1 << 18) if direct else io.BytesIO(pdf["content"].iloc[k]) as stream:
                    rows = []
                    for at, n, h, _, _ in parse(stream):
                        rows.append((h["X-URL-Key"], _page(h["WARC-Record-ID"]), name, at, n))
                        if len(rows) == PART:
                            yield _lines(rows)
                            rows = []
                    yield _lines(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(archives)
    return files.select("path", *([] if direct else ["content"])).mapInPandas(run, LINE)


def _lines(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["url_key", "page_id", "file", "offset", "length"]).astype({"page_id": "Int64"})


def _page(record_id: str) -> int | None:
    name = record_id.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "-" else int(name)


def build_index(lines: DataFrame, scratch: Scratch, parts: int | None = None) -> DataFrame:
    """Blocks of the capture index: part, block, first_key, first_page, n, data (zlib of tab-separated lines in key order).

    A range exchange on (key, page_id) makes the parts, so a host or URL with any share of the captures spreads over several.
    """
    n = lines.count() if parts is None else 0
    parts = parts or max(1, -(-n // PART))
    ordered = lines.select(F.coalesce("page_id", F.lit(-1)).alias("page_id"), "url_key", "file", "offset", "length")
    ordered = ordered.repartitionByRange(parts, "url_key", "page_id", "file", "offset").sortWithinPartitions("url_key", "page_id", "file", "offset").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held = 0, None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf])
            while len(held) >= CAPTURES:
                yield _block(held.iloc[:CAPTURES], block)
                held, block = held.iloc[CAPTURES:], block + 1
        if held is not None and len(held):
            yield _block(held, block)

    blocks = ordered.mapInPandas(run, "part int, block int, first_key string, first_page long, n int, data binary")
    return scratch.save(blocks, "index", codec="uncompressed")


def _block(rows: pd.DataFrame, number: int) -> pd.DataFrame:
    lines = "\n".join(f"{k}\t{p}\t{f}\t{o}\t{n}" for k, p, f, o, n in zip(rows["url_key"], rows["page_id"], rows["file"], rows["offset"], rows["length"]))
    head = rows.iloc[0]
    return pd.DataFrame({"part": [head["part"]], "block": [number], "first_key": [head["url_key"]], "first_page": [head["page_id"]], "n": [len(rows)], "data": [zlib.compress(lines.encode(), 6)]})


class Directory:
    """Sparse directory of some blocks and lookups in them; a block is opened at most once in a row."""

    def __init__(self, keys: list[tuple[str, int]], blocks: list[bytes]):
        order = sorted(range(len(keys)), key=lambda k: (keys[k][0].encode(), keys[k][1]))
        self.keys = [(keys[k][0].encode(), keys[k][1]) for k in order]
        self.blocks = [blocks[k] for k in order]
        self.open: tuple[int, list, list] = (-1, [], [])

    def find(self, key: str, page_id: int) -> tuple[str, int, int] | None:
        """(file, offset, length) of a capture."""
        want = (key.encode(), page_id)
        at = bisect.bisect_right(self.keys, want) - 1
        if at < 0:
            return None
        if self.open[0] != at:
            lines = [x.rsplit("\t", 4) for x in zlib.decompress(self.blocks[at]).decode().split("\n")]
            self.open = at, [(x[0].encode(), int(x[1])) for x in lines], lines
        _, keys, lines = self.open
        k = bisect.bisect_left(keys, want)
        return (lines[k][2], int(lines[k][3]), int(lines[k][4])) if k < len(keys) and keys[k] == want else None


def locate(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """wanted (url_key, page_id) with file, offset and length from the index; those it lacks have nulls.

    The parts' first keys (one per PART captures) route queries; each part's blocks meet its queries in one group.
    """
    heads = sorted(((r.part, r.head.first_key, r.head.first_page) for r in index.groupBy("part").agg(F.min(F.struct("first_key", "first_page")).alias("head")).collect()), key=lambda x: (x[1].encode(), x[2]))
    bounds, names = [(k.encode(), p) for _, k, p in heads], [part for part, _, _ in heads]

    @F.pandas_udf("int")
    def part_of(keys: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series([names[max(0, bisect.bisect_right(bounds, (k.encode(), p)) - 1)] for k, p in zip(keys, pages)], dtype="int32")

    def run(queries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        book = Directory(list(zip(blocks["first_key"], blocks["first_page"])), list(blocks["data"]))
        queries = queries.sort_values(["url_key", "page_id"])
        found = [book.find(k, p) or (None, None, None) for k, p in zip(queries["url_key"], queries["page_id"])]
        out = pd.DataFrame(found, columns=["file", "offset", "length"], index=queries.index).astype({"offset": "Int64", "length": "Int64"})
        return pd.concat([queries[["url_key", "page_id"]], out], axis=1)

    routed = wanted.select("url_key", "page_id").withColumn("part", part_of("url_key", "page_id")) if names else wanted.select("url_key", "page_id", F.lit(0).alias("part"))
    return routed.groupBy("part").cogroup(index.groupBy("part")).applyInPandas(run, LINE)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, body_bytes long"


#: File systems whose byte ranges the workers read themselves; on others, whole files come through Spark.
DIRECT = ("file", "hdfs", "s3", "gs")


def _direct(archives: str) -> bool:
    return archives.partition(":")[0] in DIRECT


def _open(uri: str):
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    store, path = fs.FileSystem.from_uri(f"file:///{rest.lstrip('/')}" if scheme == "file" else uri)
    return store.open_input_file(path)


def _told(data: bytes) -> tuple:
    """READ's columns of one record as it says. ValueError if a response's payload has not the length and digest that its headers name."""
    _, _, headers, start, size = next(parse(data))
    named = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    body = b""
    if headers["WARC-Type"] == "response":
        body = data[data.index(b"\r\n\r\n", start) + 4 : start + size]
        if base64.b32encode(hashlib.sha1(body).digest()).decode() != named or int(headers["X-Payload-Length"]) != len(body):
            raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
    refers = headers.get("WARC-Refers-To")
    return _page(headers["WARC-Record-ID"]), int(headers["X-Payload-Length"]), named, headers["WARC-Type"], _page(refers) if refers else None, headers["WARC-Target-URI"], len(body)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})


def read_ranges(spark: SparkSession, located: DataFrame, archives: str, direct: bool | None = None) -> DataFrame:
    """The records at located byte ranges: what their headers say, checked against the payload read.

    Only ranges are exchanged, in file order; each task reads its own ranges' bytes. Where the workers
    cannot open the file system, a file's ranges meet the file, read by Spark, in one group.
    """
    wanted = located.where("file IS NOT NULL").select("file", "offset", "length")
    if _direct(archives) if direct is None else direct:

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            name, f = None, None
            for pdf in batches:
                rows = []
                for file, at, n in zip(pdf["file"], pdf["offset"], pdf["length"]):
                    if file != name:
                        if f is not None:
                            f.close()
                        name, f = file, _open(file)
                    rows.append(_told(f.read_at(n, at)))
                yield _frame(rows)
            if f is not None:
                f.close()

        return wanted.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInPandas(read, READ)

    def grouped(ranges: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        data = files["content"].iloc[0] if len(files) else b""
        return _frame([_told(data[at : at + n]) for at, n in sorted(zip(ranges["offset"], ranges["length"]))])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(archives).select(F.col("path").alias("file"), "content")
    return wanted.groupBy("file").cogroup(files.groupBy("file")).applyInPandas(grouped, READ)


def round_trip(pages: DataFrame, scratch: Scratch | None = None, direct: bool | None = None) -> DataFrame:
    """Archives ``pages``, indexes the archives, looks every capture up and reads it back; one row per row of ``pages``.

    Null page_id is written as ``-``, null html as an empty payload, a null URL as an empty one. Extra columns are
    ignored. An empty table gives no row. Of equal payloads (ties too), all rows of the largest page_id are responses and the
    others revisits; a row without page_id is a response. Rows of one page_id share their record id: the index finds one of them,
    so they are read by their own ranges. A page of any length is streamed over while indexing and must fit a task when it is read.
    """
    spark = pages.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "warc")
    archives = write(pages.select("page_id", "url", "html"), scratch)
    lines = scratch.save(captures(spark, archives, direct), "captures")
    index = build_index(lines, scratch)
    named = lines.withColumn("page_id", F.coalesce("page_id", F.lit(-1)))
    located = locate(named.select("url_key", "page_id").distinct(), index)
    # a key that several records share (repeated rows) brings all of them
    shared = named.groupBy("url_key", "page_id").agg(F.count("*").alias("n")).where("n > 1").select("url_key", "page_id")
    again = named.join(shared, ["url_key", "page_id"], "left_semi")
    rest = again.join(located, ["url_key", "page_id", "file", "offset", "length"], "left_anti")
    return read_ranges(spark, located.select("file", "offset", "length").unionByName(rest.select("file", "offset", "length")), archives, direct)


def fetch(spark: SparkSession, index: DataFrame, url_key: str, page_id: int) -> bytes | None:
    """One record by key, through the directory and a range read of the archive; None if there is none.

    The directory and the block are filtered in Spark, so the driver holds one block.
    """
    before = index.where((F.col("first_key") < url_key) | ((F.col("first_key") == url_key) & (F.col("first_page") <= page_id)))
    block = before.orderBy(F.desc("first_key"), F.desc("first_page")).limit(1).collect()
    found = Directory([(b.first_key, b.first_page) for b in block], [bytes(b.data) for b in block]).find(url_key, page_id)
    if not found:
        return None
    name, offset, length = found
    jvm = spark._jvm
    file = jvm.org.apache.hadoop.fs.Path(name)
    stream = file.getFileSystem(spark._jsc.hadoopConfiguration()).open(file)
    try:
        stream.seek(offset)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()
