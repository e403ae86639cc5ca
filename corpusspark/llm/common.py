"""Helpers shared by the training-data operators: shared scratch tables and skew-safe joins."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusspark.llm.textops import give_back
from corpusspark.operators.lineage import shared_dir

#: White space of the word and normalisation rules, as a Java and RE2 character class body.
SPACE = r"\x20\x09-\x0D"
#: At most this many keys of a join are sent to every executor as heavy keys.
HEAVY_KEYS = 10_000
#: A table of at most this many narrow rows may be broadcast.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share."""
    return f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}"


#: Share of its greatest heap that the driver may hold before it collects garbage, which also makes the heap smaller.
HEAP_SHARE = 0.5


def trim_native(spark: SparkSession) -> bool:
    """Whether the driver's JVM handed its allocator's free pages back, as ``jcmd PID System.trim_native_heap`` does;
    a JVM without that command keeps them."""
    jvm = spark.sparkContext._jvm
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()  # of a class that only its interface opens
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    given = spark.sparkContext._gateway.new_array(jvm.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        invoke.invoke(server, given)
    except Py4JJavaError:
        return False
    return True


def hand_back(spark: SparkSession, collect: bool = False) -> None:
    """Hands memory that the driver no longer needs back to the system. Plans, events of tasks and compiled code are
    short-lived, but a heap that grew for them stays, and so do the allocator's pages of each thread; over hundreds of
    jobs both add up. ``collect`` collects garbage however small the heap is."""
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if collect or runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        jvm.System.gc()
    trim_native(spark)
    give_back()  # the driver's Python


def materialise(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, sizes are known,
    and a lost executor costs no recomputation of what came before. Removed when Spark ends.
    ``free`` lets Spark drop the shuffle files behind it now: it does so when the driver collects garbage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    hand_back(spark, collect=free)
    return spark.read.parquet(path)


#: Texts that cross to a Python worker at once.
TEXT_ROWS = 2000


def text_batches(spark: SparkSession) -> None:
    """From now on at most TEXT_ROWS rows of the session cross to a Python worker at once: Arrow's buffers of 10,000
    texts, which the JVM's and the worker's allocators keep, would be tens of MB for each task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > TEXT_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, TEXT_ROWS)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it lasts, so many rows cross to a Python worker at once: for rows that may be large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def join_per_key(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, which has one row per key and, in ``weight``, the number of
    left rows of that key. Keys with over 1/HEAVY_KEYS of the total weight, which are at most
    HEAVY_KEYS, are broadcast; the others are joined by a shuffle. ``left`` is read twice, so it
    should be a written table. ``how`` is inner or left; null keys never match."""
    total = right.agg(F.sum(weight)).first()[0] or 0
    heavy = right.filter(F.col(weight) > max(total / HEAVY_KEYS, 1000))
    light = right.filter(F.col(weight) <= max(total / HEAVY_KEYS, 1000))
    hot = left.join(F.broadcast(heavy), keys, "inner")
    rest = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light.hint("merge"), keys, how)
    return hot.unionByName(rest)


def small_or_hinted(df: DataFrame, rows: int, hint: str = "merge", most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are few, else for a shuffle join."""
    return F.broadcast(df) if rows <= most else df.hint(hint)


def fresh(columns: list[str], name: str) -> str:
    """A column name that clashes with none of ``columns``, compared as Spark does."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
