"""Session helpers: shipping this package to executors, and tables in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that functions pickled by reference resolve."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="gridloom-")
    target = os.path.join(folder, "gridloom_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    spark.sparkContext.addPyFile(target)
    _shipped[app] = target


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the setting is absent, a local master gets one of its own; a cluster is refused, as its machines share none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("gridloom.shared.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gridloom-shared-")
        spark.conf.set("gridloom.shared.dir", folder)
    return folder.rstrip("/")


#: While a step is written: shuffle files go when it ends, and rows reach Python in batches of some MB (64 MB else), which the
#: JVM's buffers and the worker hold several times over.
_TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go as soon as the query has ended (what it wrote is read instead), and Python gets small batches."""
    before = {k: spark.conf.get(k, None) for k in _TIDY}
    for k, v in _TIDY.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


class Scratch:
    """Tables written to the shared folder to cut lineage; ``drop`` deletes what this scratch wrote."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/gridloom-{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def path(self, tag: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:02d}-{tag}"

    def save(self, df: DataFrame, tag: str, codec: str = "zstd", small: bool = False) -> DataFrame:
        """Writes ``df`` as Parquet (committed per task, so it outlives lost executors) and reads it back.

        A ``small`` result of many tasks is exchanged into an eighth as many files (two per core at least); the
        tasks that compute it stay as many as they are.
        """
        path = self.path(tag)
        if small:
            df = df.repartition(max(8, 2 * self.spark.sparkContext.defaultParallelism, shuffle_width(self.spark) // 8))
        with tidy(self.spark):
            df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        delete(self.spark, self.root)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, whatever its scheme."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system; workers live on after their tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library's


#: What steps of one kind keep in a worker from task to task, by the kind.
kept: dict[str, dict] = {}


def begin(kind: str) -> None:
    """A step of this kind begins in this worker: what other kinds keep there goes, as their steps have mostly ended."""
    others = [held for name, held in kept.items() if name != kind and held]
    for held in others:
        held.clear()
    if others:
        gc.collect()
        trim()


def lean(run: Callable[[Iterator], Iterator], kind: str = "") -> Callable[[Iterator], Iterator]:
    """A function for mapInPandas, mapInArrow or an iterator's pandas_udf that holds, of what is ``kept``, only its kind's and trims its worker when a task ends."""

    def wrapped(batches: Iterator) -> Iterator:
        begin(kind)
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def lean_group(run: Callable) -> Callable:
    """The same for applyInPandas: its worker is trimmed after each group."""

    def wrapped(pdf):  # noqa: ANN001, ANN202  Spark reads type hints here
        begin("")
        try:
            return run(pdf)
        finally:
            trim()

    return wrapped
