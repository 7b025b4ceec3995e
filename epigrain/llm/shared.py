"""Shared storage for intermediate tables and files: everything lies below the folder in spark.checkpoint.dir."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epigrain.session import checkpoint_dir


def new_folder(spark: SparkSession, label: str) -> str:
    """A path for new output below the shared folder; it is removed when the application ends."""
    root = checkpoint_dir(spark)
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, label: str = "stage", compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, and any executor can read it again."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs) or plain path, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, attempt: str, fill) -> None:
    """Write a file under a name of its own and move it into place once complete, so that a repeated task is harmless."""
    system, path = open_filesystem(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    partial = f"{folder}/_partial-{attempt}-{name}"
    with system.open_output_stream(partial, compression=None) as out:
        fill(out)
    system.move(partial, path)


def bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bit per ``hash`` modulo ``bits`` (a power of two): at most bits / 64 rows come to the driver, whatever the number of hashes."""
    place = f"pmod(hash, {bits}L)"
    words = hashes.groupBy(F.expr(f"{place} DIV 64").cast("int").alias("at")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast(pmod({place}, 64L) AS int)))").alias("bits")
    )
    got = words.toArrow()
    table = np.zeros(bits // 64, dtype=np.int64)
    table[got["at"].to_numpy()] = got["bits"].to_numpy()
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


#: Bits of the table by which rows are told from unwanted ones; with 64 to a row of 16 bytes it is broadcast at 4 MB at most.
MOST_ROW_BITS = 1 << 24

_CACHES: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """A table that a worker keeps from task to task; tasks that name another one empty it (``tidy``)."""
    return _CACHES.setdefault(name, {})


def release(keeps: str = "") -> None:
    """Empty the other caches of this worker and give freed memory back, for workers serve one stage after the other."""
    for name, held in _CACHES.items():
        if name != keeps:
            held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def tidy(run: Callable[[Iterator], Iterator], keeps: str = "") -> Callable[[Iterator], Iterator]:
    """A task function that begins and ends with ``release``."""

    def task(batches: Iterator) -> Iterator:
        release(keeps)
        yield from run(batches)
        release(keeps)

    return task


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``docs`` does not have."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(docs: DataFrame, key: Column, unwanted: DataFrame) -> DataFrame:
    """The rows whose key is not in the only column of ``unwanted``; a null key never is.

    A bit table of fixed size tells the rows that can be unwanted, and only those are moved to be joined: while few rows go, few are
    moved, and once the table is full this is a plain anti-join.
    """
    unwanted = written(unwanted.toDF("value").where("value IS NOT NULL").distinct(), "unwanted")
    n = unwanted.count()
    if not n:
        return docs
    bits = 1 << 16
    while bits < min(16 * n, MOST_ROW_BITS):
        bits *= 2
    place, value, at, word = fresh(docs, "place", "value", "at", "word")
    table = unwanted.select(F.expr(f"pmod(xxhash64(value), {bits}L)").alias(place)).groupBy(F.expr(f"{place} DIV 64").alias(at))
    table = table.agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod({place}, 64L) AS int)))").alias(word))
    marked = docs.withColumn(value, key).withColumn(place, F.expr(f"pmod(xxhash64({value}), {bits}L)"))
    marked = marked.join(F.broadcast(table), F.expr(f"{place} DIV 64") == F.col(at), "left")
    hit = F.coalesce(F.expr(f"shiftrightunsigned({word}, cast(pmod({place}, 64L) AS int)) & 1L") == 1, F.lit(False))
    other = unwanted.withColumnRenamed("value", at + "_")
    rest = marked.where(hit).drop(at, word, place).join(other, F.col(value) == F.col(at + "_"), "left_anti")
    return marked.where(~hit).select(*docs.columns).union(rest.select(*docs.columns))
