"""Streams over landed files against their batch twins."""

import tempfile

from pyspark.sql import functions as F

from corpusspark.streaming import streams as st

FOLDER = "/root/testdata/sf0.001"


def landed(spark, df, files=1):
    path = f"{tempfile.mkdtemp(prefix='spark-')}/in"
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 10).parquet(path)


def drain(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def events(spark):
    return spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def ids(df):
    return sorted(r[0] for r in df.select("event_id").collect())


def test_dedupe(spark):
    e = events(spark).withColumn("dedupe_key", F.concat_ws("-", "user_id", "event_type"))
    got = drain(spark, st.stream_dedupe(landed(spark, e), horizon="90 days"), "dd")
    assert got.count() == e.select("dedupe_key").distinct().count() == st.stream_dedupe(e).count()


def test_high_water(spark):
    e = events(spark).withColumn("ts", F.col("ts") - F.make_interval(hours=(F.col("event_id") * 7 % 100).cast("int")))
    got = drain(spark, st.stream_high_water(landed(spark, e), ["user_id", "event_type"], "ts", "event_id"), "hw")
    assert ids(got) == ids(st.high_water(e, ["user_id", "event_type"], "ts", "event_id"))


def test_lease(spark):
    e = events(spark)
    got = drain(spark, st.stream_lease(landed(spark, e), "user_id", "ts", "event_id", 3600), "ls")
    want = st.lease_decisions(e, "user_id", "ts", "event_id", 3600)
    assert sorted(got.select("user_id", "event_id", "decision").collect()) == sorted(want.select("user_id", "event_id", "decision").collect())


def test_state_is_forgotten(spark):
    e = events(spark)
    got = drain(spark, st.stream_lease(landed(spark, e), "user_id", "ts", "event_id", 3600, forget="90 days"), "lf")
    want = st.lease_decisions(e, "user_id", "ts", "event_id", 3600)
    assert sorted(got.select("event_id", "decision").collect()) == sorted(want.select("event_id", "decision").collect())
    high = drain(spark, st.stream_high_water(landed(spark, e), ["user_id"], "ts", "event_id", forget="90 days"), "hf")
    assert ids(high) == ids(st.high_water(e, ["user_id"], "ts", "event_id"))


def test_rate_quota(spark):
    e = events(spark)
    got = drain(spark, st.stream_rate_quota(landed(spark, e), "event_type", "ts", 2, "1 day"), "rq", "append")
    batch = st.rate_quota(e, "event_type", "ts", "event_id", 2, "1 day").groupBy("event_type", "window_start").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("over_limit").cast("int")).alias("o"))
    want = {(r.event_type, r.window_start): (r.n, r.o == 1) for r in batch.collect()}
    for r in got.collect():  # windows that the watermark has closed
        assert want[r.event_type, r.window_start] == (r.n, r.over_limit)


def test_incremental_sync_continues(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    e, seen = events(spark), []
    for part in (e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1")):
        part.write.mode("append").parquet(f"{base}/in")
        st.incremental_sync(spark, f"{base}/in", e.schema, f"{base}/cp", lambda df, _: seen.append(df.count()))
    assert sum(seen) == e.count()


def test_corpus(spark):
    d = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    got = drain(spark, st.stream_corpus(landed(spark, d)), "ch")
    assert got.count() == st.stream_corpus(d).count()
