"""Where intermediate tables are cut off from what made them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A session on one machine may go
    without; it gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def _remove_at_end(spark: SparkSession, path: str) -> None:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, removed when Spark ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _remove_at_end(spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in the shared folder, removed when Spark ends."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
        _remove_at_end(df.sparkSession, sc.getCheckpointDir())
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as compressed columns and read back; for large tables, whose checkpoints
    would hold whole rows without compression. Removed when Spark ends."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt to all cores by its keys: the scan of a small file is one task, whatever is worked out from its rows."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


#: A table of at most this many counted narrow rows may be broadcast.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if its rows are few (counted, so it should be written), else for a shuffle join."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df.hint("merge")


#: Rows that one task holds while it seeks equal ones.
UNIQUE_ROWS = 500_000


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """One row of each that keys tell apart. Rows (counted, so ``df`` should be written or read with few steps) are dealt by
    their keys to as many tasks as UNIQUE_ROWS asks for, so that what a task holds doesn't grow with the table."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // UNIQUE_ROWS))
    return df.repartition(tasks, *keys).dropDuplicates(list(keys))


class Levels:
    """Tables of one schema written one after another and read as one, each with its number as ``level``. A level is
    written once and never again; its rows are counted as they are written."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema, self.sizes = spark, schema, []
        self.path = scratch(spark, "levels")

    def add(self, df: DataFrame) -> int:
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/level={len(self.sizes)}")
        self.sizes.append(seen.get["n"])
        return self.sizes[-1]

    def read(self, level: int | None = None) -> DataFrame:
        """All levels, or one (without its number)."""
        if level is not None:
            return self.spark.read.schema(self.schema).parquet(f"{self.path}/level={level}")
        return self.spark.read.schema(f"{self.schema}, level int").option("basePath", self.path).parquet(self.path)

