"""Queries of landed objects, of streams that write tables, and of their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusspark.operators.lineage import scratch
from corpusspark.plans.registry import Tables, query
from corpusspark.sources import connector as cn
from corpusspark.streaming import ledger as lg
from corpusspark.streaming import stateful as sf
from corpusspark.streaming import streams as st


# Documents land whole, then changes of them: every fifth is new, every seventh goes, every eleventh is as before.
@query("connector_objects", """
WITH a AS (SELECT doc_id, lang, source FROM documents),
 d AS (SELECT doc_id::VARCHAR AS external_id, CASE WHEN doc_id % 7 = 0 THEN 'removed' WHEN doc_id % 5 = 0 THEN 'updated' END AS change FROM a UNION ALL SELECT 'n' || doc_id, 'added' FROM a WHERE doc_id % 13 = 0),
 acl AS (SELECT doc_id::VARCHAR AS external_id, 'user:' || coalesce(source, '') || ':own' AS what FROM a WHERE doc_id % 7 <> 0
  UNION ALL SELECT doc_id::VARCHAR, 'role:' || coalesce(lang, 'all') || ':read' FROM a WHERE doc_id % 7 <> 0 AND (doc_id % 5 <> 0 OR doc_id % 3 = 0) UNION ALL SELECT 'n' || doc_id, 'user:' || coalesce(source, '') || ':own' FROM a WHERE doc_id % 13 = 0)
SELECT external_id, change AS what FROM d WHERE change IS NOT NULL UNION ALL SELECT * FROM acl""")
def _(t):
    """external_id and what: a change after the first batch, or an entry of the access list as it is now."""
    path, k = scratch(t.spark, "landing"), F.col("doc_id")
    who = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("id"))
    objects = t.documents.select(
        "doc_id", k.cast("string").alias("external_id"), F.lit("document").alias("type"), F.col("source").alias("title"), "text", F.lit("1").alias("version"), F.lit("upsert").alias("change"),
        who("user", F.coalesce("source", F.lit(""))).alias("owner"), F.array(who("role", F.coalesce("lang", F.lit("all")))).alias("viewers"),
    )
    cn.land(objects, path, "files", "w1")
    kept = objects.filter((k % 5 == 0) | (k % 7 == 0) | (k % 11 == 0)).withColumns({
        "version": F.when(k % 5 == 0, "2").otherwise("1"), "change": F.when(k % 7 == 0, "removed").otherwise("upsert"), "viewers": F.when((k % 5 != 0) | (k % 3 == 0), F.col("viewers")),
    })
    new = objects.filter(k % 13 == 0).withColumns({"external_id": F.concat(F.lit("n"), "external_id"), "viewers": F.lit(None).cast(dict(objects.dtypes)["viewers"])})
    cn.land(kept.unionByName(new), path, "files", "w1")
    landed = cn.objects(t.spark, path, "files", "w1")
    now = cn.current(landed.drop("text", "metadata", "raw_acl")).filter("change = 'upsert'")
    acl = cn.acls(now).select("external_id", F.concat_ws(":", "principal_type", "principal_id", "permission").alias("what"))
    return cn.deltas(landed, 1).select("external_id", F.col("change").alias("what")).unionByName(acl)


# Deliveries arrive in two runs, odd ones first; the second run is then processed once more.
@query("event_ledger_stream", """
WITH k AS (SELECT *, sha256(user_id || ':' || event_type || ':' || event_id % 300) AS dedupe_key FROM events)
SELECT dedupe_key, arg_min(event_id, (event_id % 2 = 0, event_id)) AS event_id, min(event_id % 2 = 0)::INT AS batch FROM k GROUP BY 1""")
def _(t):
    base = scratch(t.spark, "ledger")
    rows = t.events.select(F.sha2(F.concat_ws(":", "user_id", "event_type", F.col("event_id") % 300), 256).alias("dedupe_key"), "event_id")
    for run in (1, 0):
        part = rows.filter(F.col("event_id") % 2 == run)
        part.write.mode("append").parquet(f"{base}/in")
        st.incremental_sync(t.spark, f"{base}/in", rows.schema, f"{base}/cursor", lg.ledger_sink(f"{base}/ledger", "event_id", digits=1))
    lg.append_once(rows.filter("event_id % 2 = 0"), 1, f"{base}/ledger", "event_id", 1)
    return lg.ledger(t.spark, f"{base}/ledger", "event_id long").select("dedupe_key", "event_id", F.col("batch").cast("int").alias("batch"))


# Three calls of a group in any twelve hours.
@query("stream_rate_sliding", """
WITH RECURSIVE o AS (SELECT event_id, user_id % 40 AS grp, ts, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS k FROM events),
 r(grp, k, event_id, admitted, log) AS (SELECT grp, k, event_id, TRUE, [ts] FROM o WHERE k = 1
  UNION ALL SELECT o.grp, o.k, o.event_id, len(list_filter(r.log, lambda x: x > o.ts - INTERVAL 12 HOUR)) < 3,
   CASE WHEN len(list_filter(r.log, lambda x: x > o.ts - INTERVAL 12 HOUR)) < 3 THEN list_append(list_filter(r.log, lambda x: x > o.ts - INTERVAL 12 HOUR), o.ts) ELSE list_filter(r.log, lambda x: x > o.ts - INTERVAL 12 HOUR) END FROM r JOIN o ON o.grp = r.grp AND o.k = r.k + 1)
SELECT grp, event_id, admitted FROM r""")
def _(t):
    return sf.sliding_quota(t.events.withColumn("grp", F.col("user_id") % 40), "grp", "ts", "event_id", 3, "12 hours")
