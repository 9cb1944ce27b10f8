"""Shared helpers: reading tables, the shared work folder, and written intermediate tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.ship import ship

#: Rows in an Arrow batch given to Python. Texts may be long, so batches stay small.
BATCH_ROWS = 1000


_MEMO: dict = {"owner": None, "clear": None}


def claim_memo(owner: str, clear: Callable[[], None]) -> None:
    """Name what a Python worker's task keeps, and how it is freed; task_memo frees it."""
    if _MEMO["owner"] not in (owner, None):
        _MEMO["clear"]()
    _MEMO.update(owner=owner, clear=clear)


def task_memo(run: Callable) -> Callable:
    """A function of a task's batches whose memo goes when the task ends: workers wait idle in numbers
    that are not ours to set, and should hold little meanwhile."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            release_memo()

    return task


def release_memo() -> None:
    """Workers import this function, and so see the module's own memo; a closure would carry a copy."""
    if _MEMO["clear"]:
        _MEMO["clear"]()
    _MEMO.update(owner=None, clear=None)
    give_back()


def give_back() -> None:
    """Free memory goes back to the system: Python's, Arrow's and, where the C library can, its own."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def prepare(spark: SparkSession) -> None:
    """Bound the memory of one Arrow batch in a Python worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's spark.checkpoint.dir.

    Only where it is unset (single-machine tests) a temporary folder is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        if not current and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that driver and executors share")
        folder = current or tempfile.mkdtemp(prefix="lattica-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: later steps neither recompute it
    nor lose it with an executor."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


HOT_ROWS, HOT_KEYS = 10_000, 4096


def join_counted(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined with right(key, n, ...), which has each key once and how many rows of left have it. Keys of
    more than HOT_ROWS rows and of more than a HOT_KEYS-th of all rows, so at most HOT_KEYS of them, are joined by
    broadcast: their rows stay where they are and no task gets all rows of one."""
    total, most = right.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).head()
    limit = max(HOT_ROWS, total // HOT_KEYS)
    if most <= limit:
        return left.join(right, key)
    hot = written(right.where(F.col("n") > limit), "hot-keys")
    known = F.broadcast(hot)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col("n") <= limit), key)
    return left.join(known, key).unionByName(rest)


SIEVE_BITS = 20


def sieve(members: DataFrame, column: str) -> Callable[[Column], Column]:
    """A filter that every value of members' column passes, and few others while these are few
    against 2**SIEVE_BITS. It is a bit set of fixed size (at most 128 KB reach the tasks), so it only thins what a join would shuffle; the join stays exact whatever passes."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << SIEVE_BITS))
    at_byte = members.select(place(F.col(column)).alias("at")).select(F.expr("at div 8").alias("byte"), F.expr("shiftleft(1, cast(at % 8 as int))").alias("bit"))
    table = bytearray(1 << (SIEVE_BITS - 3))
    found = at_byte.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    for i, bits in zip(found["byte"].to_pylist(), found["bits"].to_pylist()):
        table[i] = bits
    # a scalar subquery, not a literal: plans print their literals
    bits = members.sparkSession.createDataFrame([(table,)], "bits binary").scalar()

    def passes(c: Column) -> Column:
        at = place(c)
        byte = F.substring(bits, (F.floor(at / 8) + 1).cast("int"), 1)
        return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (at % 8).cast("int")) == 1

    return passes
