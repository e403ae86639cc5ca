"""Stateful stream operators with list state and timers: a sliding limit on calls, and a sweep of stale events that
runs by itself. State is in RocksDB, so it may outgrow memory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """What the operators here need of a session before a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


def admit(log: list[int], at: int, limit: int, span: int) -> bool:
    """Whether a call at a time is admitted: fewer than ``limit`` admitted ones are in the span before it. ``log`` has
    the times of those, and this one if it is admitted; older ones are forgotten."""
    log[:] = [t for t in log if t > at - span]
    if len(log) >= limit:
        return False
    log.append(at)
    return True


class SlidingLimit(StatefulProcessor):
    """A key's admitted calls in a list of at most ``limit`` times; forgotten when the last leaves the window."""

    def __init__(self, key: str, at: str, order: str, limit: int, span: int):
        self.key, self.at, self.order, self.limit, self.span = key, at, order, limit, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.log = handle, handle.getListState("admitted", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")  # one trigger's
        log = [r[0] for r in self.log.get()]
        admitted = [admit(log, t, self.limit, self.span) for t in _micros(calls[self.at])]
        if log:
            self.log.put([(t,) for t in log])
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((max(log) + self.span) // 1000 + 1)
        yield pd.DataFrame({self.key: [key[0]] * len(calls), self.order: calls[self.order], "admitted": admitted})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.log.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_sliding_quota(calls: DataFrame, key: str, at: str, order: str, limit: int, window: str = "1 minute", late: str = "0 seconds") -> DataFrame:
    """key, order, admitted for each call of a stream: at most ``limit`` admitted ones in any window up to a call. Calls
    of one trigger go by ``order``. A key whose window has passed by event time (and ``late``) has no state."""
    kinds = dict(calls.dtypes)
    keep_state_on_disk(calls.sparkSession)
    own = SlidingLimit(key, at, order, limit, _span(window))
    return calls.withWatermark(at, late).groupBy(key).transformWithStateInPandas(own, f"{key} {kinds[key]}, {order} {kinds[order]}, admitted boolean", "append", "eventTime")


def _span(window: str) -> int:
    return int(pd.Timedelta(window).total_seconds() * 1_000_000)


def sliding_quota(calls: DataFrame, key: str, at: str, order: str, limit: int, window: str = "1 minute") -> DataFrame:
    """Batch twin of stream_sliding_quota. Calls come sorted by key and order to a task, which carries at most ``limit``
    times along. Where a key's calls (in order) are a window apart nothing is carried over, so a key's calls are cut
    there first: a key with many calls becomes as many pieces as it has pauses."""
    from corpusspark.streaming.prefix import running

    kinds = dict(calls.dtypes)
    span = _span(window)
    rows = calls.select(F.col(key).alias("k"), F.col(order).alias("o"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"))
    # A call later than all before it by a window meets an empty log, whatever was admitted.
    rows = running(rows, ["k"], "o", before=F.col("t"))
    fresh = F.col("before").isNull() | (F.col("t") - F.col("before") >= span)
    rows = running(rows, ["k"], "o", including=True, p=F.when(fresh, F.col("o"))).drop("before")
    rows = rows.repartition("k", "p").sortWithinPartitions("k", "p", "o")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, log = None, []
        for pdf in batches:
            out = []
            for k, p, t in zip(pdf["k"].tolist(), pdf["p"].tolist(), pdf["t"].tolist(), strict=True):
                if last != (k, p):
                    last, log = (k, p), []
                out.append(admit(log, t, limit, span))
            yield pd.DataFrame({key: pdf["k"], order: pdf["o"], "admitted": out})

    return rows.mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, admitted boolean")


class StaleSweep(StatefulProcessor):
    """An event's status, the end of its worker's lease, and how often it was queued again. A timer goes off when the
    event has been still for too long."""

    def __init__(self, key: str, millis: int):
        self.key, self.millis = key, millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("event", "status string, until long, requeued int")

    def _again(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable").iloc[-1]
        if last["status"] in ("received", "processing"):
            was = self.state.get()
            self.state.update((last["status"], None if pd.isna(last["lease_until"]) else int(last["lease_until"].timestamp() * 1000), was[2] if was else 0))
            self._again(timerValues.getCurrentProcessingTimeInMs() + self.millis)
        else:
            self.state.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, own = timerValues.getCurrentProcessingTimeInMs(), self.state.get()
        if own is None:
            return
        status, until, requeued = own
        live = status == "processing" and until is not None and until > now
        self.state.update((status, until, requeued) if live else ("received", None, requeued + 1))
        self._again(until if live else now + self.millis)
        yield pd.DataFrame({self.key: [key[0]], "outcome": ["skipped" if live else "requeued"], "requeued": [requeued + (not live)]})

    def close(self) -> None:
        pass


def stream_stale_sweep(updates: DataFrame, key: str, minutes: float = 10) -> DataFrame:
    """key, outcome, requeued: what a sweep does about events that no update came for: ``requeued`` (and how often), or
    ``skipped`` while the lease of the worker that has it lasts; then it is looked at again. updates: key, seq, status,
    lease_until (timestamp or null). Sweeps run by timers of processing time, also when nothing arrives, so the stream
    needs a trigger of processing time. An event of another status than received or processing is forgotten."""
    kinds = dict(updates.dtypes)
    keep_state_on_disk(updates.sparkSession)
    rows = updates.select(key, "seq", "status", "lease_until")
    return rows.groupBy(key).transformWithStateInPandas(StaleSweep(key, int(minutes * 60_000)), f"{key} {kinds[key]}, outcome string, requeued int", "append", "processingTime")
