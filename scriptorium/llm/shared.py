"""Shared folders and small helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word and gap classes of the contracts (ASCII white space only).
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Used only where the session names no shared folder and runs on one machine.
LOCAL_SHARED = "/tmp/checkpoints"

#: Bits of the maps of hashes that are broadcast: a fixed size, 1 MB.
MAP_BITS = 1 << 23

#: With this setting the shuffle files of a job go with its end: a written table needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scope: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, only a session on one machine has a folder of its own;
    a cluster has no folder that all its machines see, and is refused.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        return f"file://{LOCAL_SHARED}"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the application's scratch folder.

    It goes when the innermost :func:`scratch_scope` ends; without a scope it
    stays, because lazy results may read it, until the application ends.
    """
    root = f"{shared_dir(spark)}/scratch/{spark.sparkContext.applicationId}"
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    if (mine := _scope.get()) is not None:
        mine.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, the scratch tables that were written inside.

    Results made inside have to be written inside; those of other code are not touched.
    """
    mine: list[str] = []
    before = _scope.set(mine)
    try:
        yield
    finally:
        _scope.reset(before)
        for path in mine:
            delete_path(spark, path)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder, with ``options`` of the writer, and read it back.

    While the write runs the session lets the shuffle files of ended jobs go.  A
    query that another thread runs in the same session meanwhile stays right; if
    it reads a shuffle of an ended job again, it makes that anew.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP) if spark.conf.isModifiable(CLEANUP) else None
    if before is not None:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(compression="zstd", **options).parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores where the input has fewer splits than cores.

    Only for costly work by row: a small input is then worth a shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def release_memory() -> None:
    """Give the memory of freed arrays back to the machine: the driver keeps little between stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def hex_fraction(text: Column, digits: int = 8) -> Column:
    """The first hex digits of md5 as a long: the same number in any SQL engine."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Rows that labels are never learnt from; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def bitmap(rows: DataFrame, key: Column) -> np.ndarray:
    """A map of ``MAP_BITS`` bits with the bit of every long ``key`` set.

    It tells which rows of a large table may have one of the keys: some others
    pass as well, none that has one is missed.
    """
    bit = F.pmod(key, F.lit(MAP_BITS))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
    words = rows.select((bit / 64).cast("long").alias("w"), one.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(MAP_BITS // 64, np.int64)
    for batch in words.toArrow().to_batches():
        out[batch["w"].to_numpy()] = batch["b"].to_numpy()
    return out.view(np.uint8)


def has_bits(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
