"""Running maxima of sorted rows in two levels, so that one key's rows may lie in any number of tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusspark.operators.lineage import cut


def running(rows: DataFrame, keys: list[str], order: str, including: bool = False, **values: Column) -> DataFrame:
    """rows with a column for each of ``values``: its greatest value among the key's rows before, by ``order`` (and the
    row itself, if ``including``); null if there is none. Equal orders go in no certain order.

    Rows are dealt to ranges of keys and order, as many as there are shuffle partitions, so that a key with all rows
    has all of them. Each range works out its own running maximum. What it hands on is its maximum of the keys that
    other ranges have too, at most two, its first and its last: these carries are put together by key and joined."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.withColumns({f"_v_{k}": v for k, v in values.items()})
    own = cut(own.repartitionByRange(n, *keys, order).withColumn("_range", F.spark_partition_id()))
    most = own.groupBy("_range", *keys).agg(*[F.max(f"_v_{v}").alias(v) for v in values])
    shared = most.withColumn("_of", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("_of > 1")
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carries = cut(shared.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k_{k}") for k in keys], *[F.max(v).over(earlier).alias(f"_c_{v}") for v in values]))
    inside = Window.partitionBy("_range", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow if including else -1)
    met = own.select(*rows.columns, "_range", *[F.max(f"_v_{v}").over(inside).alias(f"_i_{v}") for v in values])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_range") == F.col("_r"))
    # At most two rows a range.
    return met.join(F.broadcast(carries), same, "left").select(*rows.columns, *[_greater(F.col(f"_i_{v}"), F.col(f"_c_{v}")).alias(v) for v in values])


def _greater(a: Column, b: Column) -> Column:
    """The greater of two columns, structs too; null only if both are."""
    return F.array_max(F.array(a, b))
