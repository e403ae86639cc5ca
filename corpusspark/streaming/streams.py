"""Structured Streaming operators, each with a batch twin over a finite table in arrival order."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def stream_dedupe(events: DataFrame, key: str = "dedupe_key", ts: str = "ts", horizon: str = "7 days") -> DataFrame:
    """First delivery of each key within the horizon, for a stream or a table."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([key])


def first_deliveries(events: DataFrame, key: str, order: str) -> DataFrame:
    """Batch twin of stream_dedupe: of each key the first by arrival."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


#: Rows of one key that one task works through in order; a key with more is worked out by all tasks.
HOT_KEY = 1_000_000


def _apart(rows: DataFrame, keys: list[str]) -> tuple[DataFrame | None, DataFrame]:
    """(the rows of keys with over HOT_KEY rows, None if there are none; the others)."""
    from corpusspark.operators.lineage import cut, sized

    hot = cut(rows.groupBy(*[F.col(k).alias(f"_hot_{k}") for k in keys]).count().filter(F.col("count") > HOT_KEY).drop("count"))
    if not hot.head(1):
        return None, rows
    same, hot = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]), sized(hot)
    return rows.join(hot, same, "left_semi"), rows.join(hot, same, "left_anti")


def high_water(events: DataFrame, keys: list[str], ts: str, order: str) -> DataFrame:
    """Batch twin of stream_high_water: events later than all that arrived before them under their keys. A hot key's
    events are in as many tasks as there are (see ``prefix``)."""
    from corpusspark.streaming.prefix import running

    hot, rest = _apart(events, keys)
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = rest.withColumn("_mark", F.max(ts).over(before))
    out = out if hot is None else out.unionByName(running(hot, keys, order, _mark=F.col(ts)))
    return out.filter(F.col("_mark").isNull() | (F.col(ts) > F.col("_mark"))).drop("_mark")


def _expiring(events: DataFrame, ts: str, forget: str | None):
    """The stream with a watermark, the kind of timeout, and what keeps a key's state until ``forget`` after its
    last event; without it state is kept for ever."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    if forget is None:
        return events, GroupStateTimeout.NoTimeout, lambda state, micros: None
    span = int(pd.Timedelta(forget).total_seconds() * 1000)

    def keep(state, micros: int) -> None:
        state.setTimeoutTimestamp(max(micros // 1000, state.getCurrentWatermarkMs()) + span)

    return events.withWatermark(ts, forget), GroupStateTimeout.EventTimeTimeout, keep


def stream_high_water(events: DataFrame, keys: list[str], ts: str, order: str, forget: str | None = None) -> DataFrame:
    """A stream's events that are later than the last accepted one under their keys (late and equal ones go). A
    key without events for ``forget`` of event time begins anew."""
    from pyspark.sql.streaming.state import GroupState

    columns = events.columns
    events, timeout, keep = _expiring(events, ts, forget)

    def accept(key: tuple, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        mark = state.get[0] if state.exists else -1
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")  # one trigger's
        micros = rows[ts].astype("datetime64[us]").astype("int64")
        ahead = micros.cummax().shift(fill_value=mark).clip(lower=mark)
        good = rows[micros > ahead]
        if len(rows):
            state.update((int(max(mark, micros.max())),))
            keep(state, int(max(mark, micros.max())))
        yield good[columns]

    return events.groupBy(*keys).applyInPandasWithState(accept, events.schema, "mark long", "append", timeout)


class Lease:
    """A key's row in the ledger: its status, and when a pending one runs out (None: never)."""

    def __init__(self, status: str | None = None, until: int | None = None):
        self.status, self.until = status, until

    def request(self, kind: str | None, at: int, micros: int) -> str:
        """What becomes of a request, and the row after it. acquire: a key that is new is acquired, one whose pending
        lease ran out is reacquired, others replay. complete and fail end a lease; release makes it pending again.
        These three change nothing for a key that isn't there."""
        if kind in (None, "acquire"):
            if self.status is None or (self.status == "pending" and self.until is not None and at >= self.until):
                was, self.status, self.until = self.status, "pending", at + micros
                return "acquired" if was is None else "reacquired"
            return "replay"
        if self.status is None:
            return "unknown"
        self.status = {"complete": "completed", "fail": "failed", "release": "pending"}[kind]
        self.until = at + micros if kind == "release" else self.until
        return {"complete": "completed", "fail": "failed", "release": "released"}[kind]


def lease_decisions(requests: DataFrame, key: str, at: str, order: str, seconds: int, kind: str | None = None) -> DataFrame:
    """Batch twin of stream_lease: key, order, decision. Requests come sorted by key and order to a task, which
    reads them batch by batch and carries one lease along. Those of keys with over HOT_KEY requests are decided about in
    many tasks (see ``leases``), with the same results."""
    from corpusspark.streaming.leases import decisions

    kinds = dict(requests.dtypes)
    rows = requests.select(F.col(key).alias("k"), F.col(order).alias("o"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), (F.col(kind) if kind else F.lit(None).cast("string")).alias("kind"))
    hot, rows = _apart(rows, ["k"])
    split = None if hot is None else decisions(hot, seconds * 1_000_000).select(F.col("k").alias(key), F.col("o").alias(order), "decision")
    rows = rows.repartition("k").sortWithinPartitions("k", "o")

    def run(batches):
        last, lease = None, Lease()
        for pdf in batches:
            out = []
            for k, t, what in zip(pdf["k"].tolist(), pdf["t"].tolist(), pdf["kind"].tolist(), strict=True):
                if last is None or k != last[0]:
                    last, lease = (k,), Lease()
                out.append(lease.request(what, t, seconds * 1_000_000))
            yield pd.DataFrame({key: pdf["k"], order: pdf["o"], "decision": out})

    out = rows.mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, decision string")
    return out if split is None else out.unionByName(split)


def stream_lease(requests: DataFrame, key: str, at: str, order: str, seconds: int, kind: str | None = None, forget: str | None = None) -> DataFrame:
    """A decision for each request on a stream; see ``Lease``. A key without requests for ``forget`` of event time
    is forgotten."""
    from pyspark.sql.streaming.state import GroupState

    requests, timeout, keep = _expiring(requests, at, forget)

    def decide(k: tuple, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        lease = Lease(*state.get) if state.exists else Lease()
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")  # one trigger's
        times = rows[at].astype("datetime64[us]").astype("int64").tolist()
        whats = rows[kind].tolist() if kind else [None] * len(rows)
        out = [lease.request(what, t, seconds * 1_000_000) for what, t in zip(whats, times, strict=True)]
        if lease.status is not None:
            state.update((lease.status, lease.until))
            keep(state, max(times))
        yield pd.DataFrame({key: [k[0]] * len(out), order: rows[order], "decision": out})

    kinds = dict(requests.dtypes)
    return requests.groupBy(key).applyInPandasWithState(decide, f"{key} {kinds[key]}, {order} {kinds[order]}, decision string", "status string, until long", "append", timeout)


def latest_status(events: DataFrame, key: str, status: str, order: str) -> DataFrame:
    """The last status of each event and whether a worker may claim it."""
    out = events.groupBy(key).agg(F.max_by(status, order).alias("status"))
    return out.withColumn("claimable", F.col("status").isin("received", "queued"))


def rate_quota(events: DataFrame, key: str, ts: str, order: str, limit: int, window: str = "1 minute") -> DataFrame:
    """Batch twin of stream_rate_quota: marks what goes over the limit in each tumbling window."""
    w = Window.partitionBy(key, "window_start").orderBy(order)
    return events.withColumn("window_start", F.window(ts, window)["start"]).withColumn("over_limit", F.row_number().over(w) > limit)


def stream_rate_quota(events: DataFrame, key: str, ts: str, limit: int, window: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Windows of a stream in which a key had more events than the limit."""
    counts = events.withWatermark(ts, late).groupBy(key, F.window(ts, window)).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(key, F.col("window.start").alias("window_start"), "n", (F.col("n") > limit).alias("over_limit"))


def stale_sweep(events: DataFrame, leases: DataFrame, at: Column, minutes: int = 10) -> DataFrame:
    """One sweep over a snapshot; run it on a schedule, or in foreachBatch of a rate stream."""
    from corpusspark.operators.relational import stale_events

    return stale_events(events, leases, at, minutes)


def incremental_sync(spark, folder: str, schema, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Process what landed in a folder since the last call, then stop; the checkpoint is the cursor."""
    stream = spark.readStream.schema(schema).parquet(folder)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_corpus(threads: DataFrame, most: int | None = None, overlap: int | None = None) -> DataFrame:
    """Chunks of landed documents (doc_id, text); stateless, so stream and table are the same."""
    from corpusspark.operators.documents import chunk_documents

    return chunk_documents(threads, "doc_id", "text", most, overlap)
