"""Decisions about a hot key's leases in as many tasks as there are.

A key's requests fall into stretches. One begins with the first request to acquire, and with each later completion,
failure or release; before the first acquisition there is no lease. In a stretch after a completion or failure nothing
is acquired. In the others the lease of the first row runs out a fixed time later, and the next row that is that late
has it then, and so on. Only rows later than all before them in their stretch can ever have it, so those are in order of
time, and each one's successor, the first that is a lease later, is found by a sorted search. Which rows are reached from
a stretch's first one is found by doubling the successors: in round k everything up to 2 ** k steps away."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusspark.operators.lineage import cut
from corpusspark.streaming.prefix import running

ENDS = {"complete": "completed", "fail": "failed", "release": "released"}


def decisions(rows: DataFrame, micros: int) -> DataFrame:
    """k, o, decision. rows: k, o, t (microseconds) and kind (acquire, complete, fail or release; null: acquire)."""
    rows = rows.withColumn("kind", F.coalesce("kind", F.lit("acquire")))
    rows = cut(rows.withColumn("id", F.monotonically_increasing_id())).withColumn("at", F.struct("o", "id"))
    acquire = F.col("kind") == "acquire"
    rows = running(rows, ["k"], "at", there=F.when(acquire, F.lit(1)))
    begins = acquire == F.col("there").isNull()  # the first acquisition, or an end of a lease that is there
    first = F.struct("at", "id", "kind")
    rows = cut(running(rows, ["k"], "at", including=True, stretch=F.when(begins, first)))
    ends = F.create_map(*[F.lit(x) for kv in ENDS.items() for x in kv])[F.col("kind")]
    told = F.when(~acquire, F.when(F.col("there").isNull(), "unknown").otherwise(ends)).otherwise("replay")
    root = F.col("id") == F.col("stretch.id")
    open_ = F.col("stretch.kind").isin("acquire", "release") & (root | acquire)
    chain = rows.filter(open_).select(F.col("stretch.id").alias("s"), "id", "at", "t", root.alias("root"))
    late = running(chain, ["s"], "at", most=F.col("t"))
    late = cut(late.filter(F.col("most").isNull() | (F.col("t") > F.col("most"))).select("s", "id", "t", "root"))
    # By falling time: a search stands behind the rows that are at least as late as what it looks for.
    both = late.select("s", "id", F.struct((-F.col("t")).alias("x"), F.lit(0).alias("search"), "id").alias("x"), F.struct((-F.col("t")).alias("t"), "id").alias("row")).unionByName(
        late.select("s", "id", F.struct((-F.col("t") - micros).alias("x"), F.lit(1).alias("search"), "id").alias("x"), F.lit(None).cast("struct<t:bigint,id:bigint>").alias("row"))
    )
    found = running(both, ["s"], "x", next=F.col("row")).filter("x.search = 1 and next is not null").select("id", F.col("next.id").alias("next"))
    reached, step = cut(late.filter("root").select("id")), cut(found)
    while step.head(1):
        reached = cut(reached.union(reached.join(step.hint("merge"), "id").select("next")).distinct())
        step = cut(step.join(step.select(F.col("id").alias("next"), F.col("next").alias("after")).hint("merge"), "next").select("id", F.col("after").alias("next")))
    has = reached.withColumn("has", F.lit(True))
    got = F.when(F.col("has") & acquire, F.when(F.col("there").isNull(), "acquired").otherwise("reacquired"))
    return rows.join(has.hint("merge"), "id", "left").select("k", "o", F.coalesce(got, told).alias("decision"))
