"""Sliding limit, stale sweep by timers, ledger sink: streams against loops and twins."""

import datetime
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from corpusspark.streaming import ledger as lg
from corpusspark.streaming import stateful as sf
from corpusspark.streaming import streams as st
from corpusspark.streaming.prefix import running

FOLDER = "/root/testdata/sf0.001"


def events(spark):
    return spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def landed(spark, df, order, files=3):
    """A stream of files, each with a range of the order, one a trigger."""
    path = tempfile.mkdtemp(prefix="spark-")
    parts = df.withColumn("_p", F.ntile(files).over(__import__("pyspark").sql.window.Window.orderBy(order)))
    for k in range(1, files + 1):
        parts.filter(F.col("_p") == k).drop("_p").coalesce(1).write.mode("append").parquet(f"{path}/in")
        time.sleep(0.05)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def drain(spark, df, name):
    df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def loop(rows, limit, span):
    """Admitted or not, by key and order."""
    logs, out = {}, {}
    for key, order, at in sorted(rows, key=lambda r: (r[0], r[1])):
        log = [t for t in logs.get(key, []) if t > at - span]
        out[key, order] = len(log) < limit
        logs[key] = log + [at] * out[key, order]
    return out


def test_running_maximum_of_one_key(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        e = events(spark).select("event_id", (F.col("event_id") * 7919 % 1009).alias("v"), F.when(F.col("event_id") % 10 == 0, F.col("event_id") % 3).otherwise(F.lit(5)).alias("k"))
        rows = sorted(e.collect(), key=lambda r: (r.k, r.event_id))
        for including in (False, True):
            got = {r.event_id: r.m for r in running(e, ["k"], "event_id", including, m=F.col("v")).collect()}
            last, most = None, None
            for r in rows:
                most = None if r.k != last else most
                now = r.v if most is None else max(most, r.v)
                assert got[r.event_id] == (now if including else most)
                last, most = r.k, now
            assert len(got) == len(rows)
        ranges = e.filter("k = 5").repartitionByRange(7, "k", "event_id").select(F.spark_partition_id()).distinct().count()
        assert ranges == 7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize(("limit", "hours"), [(1, 5), (3, 12), (4, 240)])
def test_sliding_quota_twin(spark, limit, hours):
    e = events(spark).withColumn("ts", F.col("ts") - F.make_interval(hours=(F.col("event_id") * 7 % 5).cast("int")))
    want = loop([(r.event_type, r.event_id, r.ts.timestamp()) for r in e.collect()], limit, hours * 3600)
    got = {(r.event_type, r.event_id): r.admitted for r in sf.sliding_quota(e, "event_type", "ts", "event_id", limit, f"{hours} hours").collect()}
    assert got == want and len(set(want.values())) == 2


def test_sliding_quota_stream(spark):
    e = events(spark).select("event_type", "event_id", "ts")
    got = drain(spark, sf.stream_sliding_quota(landed(spark, e, "ts"), "event_type", "ts", "event_id", 3, "12 hours", "40 days"), "sliding")
    want = loop([(r.event_type, r.event_id, r.ts.timestamp()) for r in e.collect()], 3, 12 * 3600)
    assert {(r.event_type, r.event_id): r.admitted for r in got.collect()} == want


def test_sweep_by_timers(spark):
    """Of two events in work the one whose worker's lease lasts is skipped; a finished one is forgotten; queueing again repeats."""
    path = tempfile.mkdtemp(prefix="spark-")
    schema = "event_id string, seq long, status string, lease_until timestamp"
    now = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
    rows = [("live", 1, "processing", now + datetime.timedelta(hours=1)), ("dead", 2, "processing", now - datetime.timedelta(seconds=1)), ("waiting", 3, "received", None), ("done", 4, "received", None), ("done", 5, "completed", None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in")
    updates = spark.readStream.schema(schema).parquet(f"{path}/in")
    q = sf.stream_stale_sweep(updates, "event_id", minutes=1 / 60).writeStream.format("memory").queryName("sweep").outputMode("append").option("checkpointLocation", f"{path}/cp").trigger(processingTime="500 milliseconds").start()
    try:
        seen = {}
        for _ in range(120):
            time.sleep(0.5)
            seen = {}
            for r in spark.table("sweep").collect():
                seen.setdefault(r.event_id, []).append((r.outcome, r.requeued))
            if len(seen.get("dead", [])) > 1 and len(seen.get("waiting", [])) > 1:
                break
        assert seen["live"] == [("skipped", 0)]  # looked at again only when its lease ends
        assert seen["dead"][:2] == seen["waiting"][:2] == [("requeued", 1), ("requeued", 2)]
        assert "done" not in seen
    finally:
        q.stop()


def test_ledger_sink(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    e = events(spark).select(F.sha2(F.concat_ws("-", "user_id", "event_type"), 256).alias("dedupe_key"), "event_id")
    got = []
    sink = lg.ledger_sink(f"{path}/ledger", "event_id", lambda new, n: got.append((n, new.count())))
    landed(spark, e, "event_id").writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
    want = {r.dedupe_key: r.m for r in e.groupBy("dedupe_key").agg(F.min("event_id").alias("m")).collect()}
    rows = lg.ledger(spark, f"{path}/ledger", "event_id long").collect()
    assert {r.dedupe_key: r.event_id for r in rows} == want and len(rows) == len(want)
    assert sum(n for _, n in got) == len(want) and len(got) == 3
    before = sorted(map(tuple, rows))
    for number in (2, 1, 0):  # each again, with what it had and what it hadn't
        part = e.withColumn("_p", F.ntile(3).over(__import__("pyspark").sql.window.Window.orderBy("event_id"))).filter(F.col("_p") == number + 1).drop("_p")
        lg.append_once(part, number, f"{path}/ledger", "event_id")
        assert sorted(map(tuple, lg.ledger(spark, f"{path}/ledger", "event_id long").collect())) == before
    assert lg.append_once(e, 7, f"{path}/ledger", "event_id").count() == 0


def test_large_batches_shuffle(spark, monkeypatch):
    monkeypatch.setattr(lg, "BROADCAST_KEYS", 0)
    path = tempfile.mkdtemp(prefix="spark-")
    e = events(spark).select(F.sha2(F.col("user_id").cast("string"), 256).alias("dedupe_key"), "event_id")
    n = e.select("dedupe_key").distinct().count()
    assert lg.append_once(e.filter("event_id % 2 = 0"), 0, path, "event_id").count() + lg.append_once(e, 1, path, "event_id").count() == n
    assert lg.append_once(e.limit(0), 2, path, "event_id").count() == 0


def test_high_water_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(st, "HOT_KEY", 50)
    e = events(spark).withColumn("ts", F.col("ts") - F.make_interval(hours=(F.col("event_id") * 7 % 100).cast("int"))).withColumn("one", F.lit("k"))
    rows, mark, want = sorted(e.collect(), key=lambda r: r.event_id), None, []
    for r in rows:
        if mark is None or r.ts > mark:
            want.append(r.event_id)
            mark = r.ts
    assert sorted(r.event_id for r in st.high_water(e, ["one"], "ts", "event_id").collect()) == want


@pytest.mark.parametrize("kinds", [None, "acquire acquire acquire acquire complete fail release release"])
def test_hot_keys_leases(spark, monkeypatch, kinds):
    """Decisions of many tasks are those of one task that carries the lease along."""
    import random

    r = random.Random(8)
    rows, t = [], 0
    for k in range(400):
        t += r.choice([0, 1, 2, 5, -6, 30])
        rows.append((r.choice("aab"), k, t, r.choice((kinds or "acquire").split())))
    df = spark.createDataFrame(rows, "k string, o long, t long, kind string").withColumn("t", F.timestamp_seconds("t"))
    kind = "kind" if kinds else None
    want = sorted(map(tuple, st.lease_decisions(df, "k", "t", "o", 10, kind).collect()))
    monkeypatch.setattr(st, "HOT_KEY", 150)  # a is hot, b isn't
    assert sorted(map(tuple, st.lease_decisions(df, "k", "t", "o", 10, kind).collect())) == want
    assert len({d for _, _, d in want}) >= 3
