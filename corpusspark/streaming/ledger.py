"""A ledger of deliveries that a stream appends to once each, whatever is delivered or processed again.

The ledger is a folder of Parquet files by batch and by the first characters (two) of the key, a hash in hexadecimal:
``<path>/batch=<id>/prefix=<xx>/``. A batch's new keys are those that earlier batches haven't; it writes its own folder
whole, so a batch that is processed again replaces what it wrote and adds nothing. Keys are never forgotten."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Batches with at most so many keys look their keys up by a broadcast, others by a shuffle.
BROADCAST_KEYS = 1_000_000


def ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The ledger's rows: dedupe_key and the columns of ``schema``, batch and prefix. Empty if nothing was written."""
    kind = f"dedupe_key string, {schema}, batch long, prefix string"
    try:
        return spark.read.schema(kind).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], kind)


def append_once(batch: DataFrame, number: int, path: str, seq: str, digits: int = 2) -> DataFrame:
    """Appends a batch's deliveries (dedupe_key and others; the first of each key by ``seq``) that earlier batches haven't,
    and returns what it wrote. Only the prefixes that the batch has are read of the ledger."""
    spark = batch.sparkSession
    rest = [(c, kind) for c, kind in batch.dtypes if c != "dedupe_key"]
    first = batch.groupBy("dedupe_key").agg(F.min_by(F.struct(*[c for c, _ in rest]), seq).alias("r")).select("dedupe_key", "r.*")
    first = first.withColumn("prefix", F.substring("dedupe_key", 1, digits)).persist()
    schema = ", ".join(f"{c} {kind}" for c, kind in rest)
    try:
        counts = {r["prefix"]: r["count"] for r in first.groupBy("prefix").count().collect()}  # at most 16 ** digits
        known = ledger(spark, path, schema).filter((F.col("batch") < number) & F.col("prefix").isin(list(counts))).select("prefix", "dedupe_key")
        keys = first.select("prefix", "dedupe_key")
        if sum(counts.values()) <= BROADCAST_KEYS:
            # The ledger is read where it lies: the batch's keys go to it, and those found come back.
            known = known.join(F.broadcast(keys), ["prefix", "dedupe_key"], "left_semi").distinct()
        new = first.join(known.hint("merge"), ["prefix", "dedupe_key"], "left_anti")
        new.repartition(F.col("prefix")).sortWithinPartitions("dedupe_key").write.mode("overwrite").partitionBy("prefix").parquet(f"{path}/batch={number}")
    finally:
        first.unpersist()
    return ledger(spark, path, schema).filter(F.col("batch") == number)


def ledger_sink(path: str, seq: str, then: Callable[[DataFrame, int], None] | None = None, digits: int = 2) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``. ``then`` gets what was new, and the batch's number: again, if the batch is."""

    def sink(batch: DataFrame, number: int) -> None:
        new = append_once(batch, number, path, seq, digits)
        if then:
            then(new, number)

    return sink
