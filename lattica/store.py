"""Tables written between rounds, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A base relation of more bytes than this, as written, stands in buckets of its join key, each of about as many.
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 4096


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, on one machine, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Store:
    """The written tables of one evaluation. A table survives the loss of executors and has no
    lineage, so a later round neither recomputes it nor plans through it."""

    def __init__(self, spark: SparkSession, label: str = "fixpoint"):
        self.spark, self.folder, self.number = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}", 0
        self.passing: list[str] = []
        self.rows: dict[str, int] = {}

    def put(self, df: DataFrame) -> str:
        """Write df; its rows are counted on the way (`rows`)."""
        path = f"{self.folder}/{self.number}"
        self.number += 1
        counted = Observation()
        df.observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(path)
        self.rows[path] = counted.get["n"]
        return path

    def count(self, *paths: str) -> int:
        return sum(self.rows[p] for p in paths)

    def get(self, schema, *paths: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths)

    def written(self, df: DataFrame) -> DataFrame:
        path = self.put(df)
        self.passing.append(path)
        return self.get(df.schema, path)

    def base(self, df: DataFrame, *keys: str) -> DataFrame:
        """A relation that every round joins on keys, written once. A large one is written again in buckets of
        the keys, so that no round moves it: only what it is joined with is exchanged."""
        path = self.put(df)
        plain, size = self.get(df.schema, path), self._bytes(path)
        if not keys or size <= BUCKET_BYTES:
            return plain
        name = f"lattica_{uuid.uuid4().hex}"
        buckets = min(MOST_BUCKETS, max(8, -(-size // BUCKET_BYTES)))
        plain.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{self.folder}/{name}").saveAsTable(name)
        self.drop(path)
        return self.spark.table(name)

    def _bytes(self, path: str) -> int:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()

    def sweep(self, *more: str) -> None:
        """Remove the tables of written() so far, and more, when no plan to come reads them."""
        self.drop(*self.passing, *more)
        self.passing.clear()

    def drop(self, *paths: str) -> None:
        """Remove superseded tables that no live plan reads."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in paths:
            p = hadoop(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
