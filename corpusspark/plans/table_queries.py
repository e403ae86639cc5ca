"""Queries of predicates, joins, aggregates, windows, pages and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusspark.operators import documents as doc
from corpusspark.operators import relational as op
from corpusspark.plans.registry import Tables, query

AT_SQL = "TIMESTAMP '2001-08-01'"


def _at():
    return F.lit("2001-08-01").cast("timestamp")


@query("predicate_set", """
SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 1000 AND o_totalprice < 300000 AND o_custkey IS NOT NULL)
  OR (o_orderpriority ILIKE '%low%' AND o_custkey % 7 = 0)""")
def _(t):
    one = {"o_orderstatus": ("eq", "F"), "o_orderpriority": ("in", ["1-URGENT", "2-HIGH"]), "o_totalprice": ("between", (1000, 300000)), "o_custkey": ("not_null", None)}
    two = {"o_orderpriority": ("ilike", "%low%"), "o_custkey": ("multiple_of", 7)}
    return op.predicate_set(t.orders, [one, two]).select("o_orderkey")


@query("tenant_scope", "SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE user_id END AS ws FROM events) WHERE ws = 8 OR ws IS NULL")
def _(t):
    e = t.events.select("event_id", F.when(F.col("event_id") % 50 != 0, F.col("user_id")).alias("ws"))
    return op.tenant_scope(e, "ws", 8, (None,)).select("event_id")


@query("role_visible", "SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 0")
def _(t):
    roles = F.when(F.col("quality") == 0, F.lit(None).cast("array<string>")).when(F.col("toxic") == 1, F.array(F.lit("admin"))).otherwise(F.array(F.lit("member")))
    return t.labels.filter(op.role_visible(roles, "member")).select("doc_id")


@query("sop_list", "SELECT p_partkey, p_retailprice FROM part WHERE p_brand = 'Brand#2' AND p_type = 'ECONOMY' ORDER BY p_retailprice DESC, p_partkey")
def _(t):
    return op.listed(t.part, {"p_brand": "Brand#2", "p_type": "ECONOMY"}, "p_retailprice", "p_partkey").select("p_partkey", "p_retailprice")


@query("sop_keyword_search", "SELECT p_partkey, p_name FROM part WHERE p_size > 10 AND (contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring'))")
def _(t):
    return op.keyword_search(t.part.filter("p_size > 10"), "RING", ["p_name", "p_type"]).select("p_partkey", "p_name")


@query("edge_valid_at", f"""
SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN o_orderdate END AS a, CASE WHEN o_custkey % 5 <> 0 THEN o_orderdate + INTERVAL 60 DAY END AS b FROM orders)
WHERE (a IS NULL OR TIMESTAMP '1998-01-01' >= a) AND (b IS NULL OR TIMESTAMP '1998-01-01' <= b)""")
def _(t):
    a, b = F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderdate")), F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderdate") + F.expr("interval 60 days"))
    return t.orders.filter(op.edge_valid_at(a, b, F.lit("1998-01-01").cast("timestamp"))).select("o_orderkey")


@query("stale_flags", f"SELECT o_orderkey, o_orderstatus = 'F' OR coalesce(CASE WHEN o_custkey % 4 <> 0 THEN o_orderdate END < {AT_SQL} - INTERVAL 30 DAY, false) AS is_stale FROM orders")
def _(t):
    o = t.orders.select("o_orderkey", F.when(F.col("o_custkey") % 4 != 0, F.col("o_orderdate")).alias("c"), (F.col("o_orderstatus") == "F").alias("is_stale"))
    return op.stale_flags(o, "c", _at()).select("o_orderkey", "is_stale")


def _chunk_state(t: Tables):
    """Documents with embeddings of mixed states."""
    k = F.col("doc_id")
    e = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    return t.documents.join(e, "doc_id", "left").select(
        "doc_id", F.col("text").alias("content"), F.when(k % 9 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")).alias("embedding"), F.when(k % 5 == 0, "old").otherwise("m").alias("embedding_model"),
        F.when(k % 7 != 0, "1").alias("embedding_version"), F.when(k % 11 == 0, "x").otherwise(F.sha2("text", 256)).alias("content_hash"),
    )


@query("embedding_staleness", """
SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'force' WHEN embedding IS NULL OR doc_id % 9 = 0 THEN 'missing_embedding' WHEN doc_id % 5 = 0 THEN 'model_mismatch' WHEN doc_id % 7 = 0 THEN 'version_mismatch'
  WHEN doc_id % 11 = 0 THEN 'content_hash_mismatch' END AS reason FROM documents LEFT JOIN embeddings ON vec_id = doc_id""")
def _(t):
    c = F.col
    return _chunk_state(t).select("doc_id", op.embedding_staleness(c("doc_id") % 13 == 0, c("embedding"), 64, c("embedding_model"), c("embedding_version"), c("content"), c("content_hash"), "m", "1").alias("reason"))


def _backfill_docs(t: Tables):
    k = F.col("doc_id")
    return t.documents.select("doc_id", F.when(k % 4 != 0, "completed").otherwise("pending").alias("extraction_stage"), F.when(k % 3 == 0, _at()).alias("claims_derived_at"), (k % 5).cast("int").alias("claims_backfill_failures"), F.col("n_chars").alias("created_at"))


_BACKFILL = "SELECT doc_id, n_chars AS created_at, (doc_id % 5)::INT AS failures FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 3 <> 0 AND doc_id % 5 < 3 ORDER BY n_chars, doc_id LIMIT 50"


@query("claims_backfill_candidates", f"SELECT doc_id, created_at FROM ({_BACKFILL})")
def _(t):
    return doc.claims_backfill_candidates(_backfill_docs(t), 50).select("doc_id", "created_at")


@query("derive_claims_backfill", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 0 END AS claims, doc_id % 2 = 0 AS stamped, CASE WHEN doc_id % 2 = 0 THEN failures ELSE failures + 1 END AS failures FROM ({_BACKFILL})")
def _(t):
    got = t.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 3).alias("n_claims"))
    return doc.derive_claims_backfill(_backfill_docs(t), got, _at(), 50).select("doc_id", "claims", F.col("claims_derived_at").isNotNull().alias("stamped"), F.col("claims_backfill_failures").alias("failures"))


@query("execution_gate", """
SELECT o_orderkey, (hi AND low AND NOT good) AS gated, CASE WHEN hi AND low AND NOT good THEN CASE WHEN a.id IS NULL THEN 'unrequested' WHEN a.used THEN 'already_consumed' ELSE a.status END END AS approval_status
FROM (SELECT o.*, o_orderpriority IN ('1-URGENT', '2-HIGH') AS hi, o_orderkey % 4 <> 0 AS low, o_orderkey % 2000 AS aid FROM orders o) o
LEFT JOIN (SELECT c_custkey AS id, c_custkey % 10 AS sop, CASE WHEN c_custkey % 3 = 0 THEN 'pending' ELSE 'approved' END AS status, c_custkey % 4 = 0 AS used FROM customer) a ON a.id = aid
CROSS JOIN LATERAL (SELECT coalesce(a.sop = o_custkey % 10 AND a.status = 'approved' AND NOT a.used, false) AS good)""")
def _(t):
    k = F.col("c_custkey")
    ap = t.customer.select(k.alias("id"), (k % 10).alias("sop_id"), F.when(k % 3 == 0, "pending").otherwise("approved").alias("status"), F.when(k % 4 == 0, _at()).alias("consumed_at"))
    pr = F.col("o_orderpriority")
    calls = t.orders.select("o_orderkey", (F.col("o_custkey") % 10).alias("sop_id"), F.when(pr == "1-URGENT", "Critical").otherwise("Low").alias("risk_level"), (pr == "2-HIGH").alias("human_gate"), F.when(F.col("o_orderkey") % 4 != 0, "low_trust").otherwise("admin").alias("trust_role"), (F.col("o_orderkey") % 2000).alias("approval_id"))
    return op.execution_gate(calls, ap).select("o_orderkey", "gated", "approval_status")


@query("policy_audit", """
WITH s AS (SELECT l_orderkey, l_partkey % 6 AS a, l_linenumber AS n, l_orderkey % 3 = 0 AS adm, l_suppkey % 10 AS r FROM lineitem),
 f AS (SELECT *, (a = 0)::INT AS f1, (a = 1)::INT AS f2, (a = 2)::INT AS f3, (r < 2)::INT AS f4, greatest(CASE WHEN a IN (0, 1) THEN 3 ELSE 1 END, CASE WHEN a = 2 THEN 4 ELSE 1 END, CASE r WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 1 END) AS k FROM s),
 g AS (SELECT *, list_concat(list_concat(CASE WHEN f1 = 1 THEN [1] ELSE [] END, CASE WHEN f2 = 1 THEN [2] ELSE [] END), list_concat(CASE WHEN f3 = 1 THEN [3] ELSE [] END, CASE WHEN f4 = 1 THEN [4] ELSE [] END)) AS rules,
  concat_ws('|', CASE WHEN f1 = 1 THEN 'Policy Trigger: Financial refund action detected. Human manager approval required.' END, CASE WHEN f2 = 1 THEN 'Policy Trigger: Direct database mutation action "Drop rows" on Postgres. Human manager approval required.' END,
  CASE WHEN f3 = 1 THEN 'Policy Trigger: Security critical credential/permission modification "Rotate SECRET".' END, CASE WHEN f4 = 1 THEN 'Policy Trigger: Step ' || n || ' explicitly marked with risk level "' || CASE r WHEN 0 THEN 'Critical' ELSE 'Low' END || '".' END) AS told FROM f)
SELECT l_orderkey AS plan_id, sum(f1 + f2 + f3 + f4)::BIGINT AS flags, ['Low', 'Medium', 'High', 'Critical'][max(k)] AS risk_level, sum(f1 + f2 + f3 + f4) > 0 AND NOT (bool_or(adm) AND max(k) < 4) AS requires_human_approval,
 coalesce(string_agg(told, '|' ORDER BY n, rules, told) FILTER (told <> ''), '') AS reasons FROM g GROUP BY 1""")
def _(t):
    a, r = F.col("l_partkey") % 6, F.col("l_suppkey") % 10
    steps = t.lineitem.select(
        F.col("l_orderkey").alias("plan_id"), F.lit(None).cast("string").alias("query"), F.when(F.col("l_orderkey") % 3 == 0, "admin").otherwise("member").alias("trust_role"), F.col("l_linenumber").alias("step_number"),
        F.when(a == 0, "Issue Refund").when(a == 1, "Drop rows").when(a == 2, "Rotate SECRET").otherwise("look").alias("action"), F.when(a == 1, "Postgres").otherwise("Slack").alias("target_system"), F.lit("{}").alias("parameters"),
        F.when(r == 0, "Critical").otherwise("Low").alias("risk_level"), (r == 1).alias("human_gate"),
    )
    return op.policy_audit(steps).withColumn("reasons", F.array_join("reasons", "|"))


@query("role_clearance", """
SELECT s_suppkey, rk >= 10 AND (rk >= 50 OR s_nationkey % 4 <= s_suppkey % 5) AS cleared FROM (SELECT *, [100, 50, 10, 1, 0][(s_suppkey % 5)::INT + 1] AS rk FROM supplier)""")
def _(t):
    role = F.element_at(F.array(*map(F.lit, ["admin", "manager", "member", "guest", "ghost"])), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return t.supplier.select("s_suppkey", op.role_clearance(role, F.lit("member"), F.col("s_nationkey") % 4, F.col("s_suppkey") % 5).alias("cleared"))


def _triples(t: Tables):
    k = F.col("l_partkey")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.when(k % 20 != 0, F.concat(F.lit("part "), k % 50)).otherwise(" ").alias("subject"), pick(["System", "Thing", "Team"], k % 3).alias("subject_type"), pick(["owns", " Requires", "likes", "DEPENDS_ON"], F.col("l_suppkey") % 4).alias("predicate"), F.concat(F.lit("supp "), F.col("l_suppkey") % 30).alias("object"), F.lit("Role").alias("object_type"))


_TRIPLES = """SELECT l_orderkey, l_linenumber, l_partkey % 20 = 0 AS e, l_partkey % 3 AS st, ['OWNS', 'REQUIRES', 'LIKES', 'DEPENDS_ON'][(l_suppkey % 4)::INT + 1] AS predicate, 'part_' || l_partkey % 50 AS s, 'supp_' || l_suppkey % 30 AS o FROM lineitem"""


@query("triple_validate", f"SELECT predicate, CASE WHEN e THEN 'empty_subject' WHEN st = 1 THEN 'bad_subject_type' WHEN predicate = 'LIKES' THEN 'bad_predicate' ELSE 'valid' END AS reason, count(*) AS n FROM ({_TRIPLES}) GROUP BY 1, 2")
def _(t):
    good, bad = op.triple_validate(_triples(t))
    both = good.select("predicate", F.lit("valid").alias("reason")).unionByName(bad.select("predicate", "reason"))
    return both.groupBy("predicate", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("persist_triples", f"""
WITH t AS (SELECT CASE WHEN e THEN 'unnamed_entity' ELSE s END AS s, o, predicate, CASE WHEN st = 1 THEN 'bad_subject_type' WHEN predicate = 'LIKES' THEN 'bad_predicate' END AS reason FROM ({_TRIPLES}))
SELECT 'edge' AS kind, s AS source_id, o AS target_id, predicate AS what, 1 AS n FROM t WHERE reason IS NULL GROUP BY 2, 3, 4
UNION ALL SELECT 'rejected', NULL, NULL, reason, count(*) FROM t WHERE reason IS NOT NULL GROUP BY 4
UNION ALL SELECT DISTINCT 'node', x, NULL, NULL, 1 FROM (SELECT s AS x FROM t WHERE reason IS NULL UNION SELECT o FROM t WHERE reason IS NULL)""")
def _(t):
    from corpusspark.operators.graph import persist_triples

    out, none = persist_triples(_triples(t)), F.lit(None).cast("string")
    one = F.lit(1).cast("long").alias("n")
    edges = out["edges"].select(F.lit("edge").alias("kind"), "source_id", "target_id", F.col("edge_type").alias("what"), one)
    bad = out["rejected"].groupBy(F.col("reason").alias("what")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("rejected").alias("kind"), none.alias("source_id"), none.alias("target_id"), "what", "n")
    return edges.unionByName(bad).unionByName(out["nodes"].select(F.lit("node").alias("kind"), F.col("id").alias("source_id"), none.alias("target_id"), none.alias("what"), one))


@query("claim_validate", """
SELECT doc_id, CASE WHEN doc_id % 3 <> 0 AND n_chars >= 20 THEN 2 END AS claims FROM documents""")
def _(t):
    c = lambda start, end: F.struct(F.lit("a claim of some length").alias("claim_text"), F.lit(0.5).alias("confidence"), start.alias("char_start"), end.alias("char_end"))
    js = F.to_json(F.struct(F.array(c(F.lit(0), F.lit(10)), c(F.lit(5), F.when(F.col("doc_id") % 3 == 0, F.lit(5)).otherwise(20))).alias("claims")))
    rows = t.documents.select("doc_id", F.col("text").alias("content"), F.concat(F.lit("```json\n"), js, F.lit("\n```")).alias("response"))
    return op.claim_validate(rows, "response", "content").select("doc_id", F.when(F.col("claims").isNotNull(), F.size("claims")).alias("claims"))


def _sop_responses(t: Tables):
    k = F.col("doc_id")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    js = F.to_json(F.struct((k % 5 != 0).alias("is_valid_sop"), (k % 10 / 10).alias("confidence"), F.concat(F.lit("Sop "), k % 100).alias("title"), pick(["Support", "Billing", "Fun"], k % 3).alias("category"), F.when(k % 4 == 0, "High").when(k % 4 == 1, "Odd").alias("risk_level")))
    return t.documents.select(k.alias("thread_id"), F.when(k % 17 == 0, "not json").otherwise(js).alias("response"))


_SOP = """SELECT doc_id AS thread_id, doc_id % 17 <> 0 AND doc_id % 5 <> 0 AND doc_id % 10 >= 4 AND doc_id % 3 <> 2 AND doc_id % 4 <> 1 AS accepted, 'Sop ' || doc_id % 100 AS title,
  CASE WHEN doc_id % 17 = 0 OR doc_id % 4 > 1 THEN 'Low' WHEN doc_id % 4 = 0 THEN 'High' ELSE 'Odd' END AS risk_level FROM documents"""


@query("sop_validate", f"SELECT thread_id, accepted, risk_level, risk_level = 'High' AS requires_human_gate FROM ({_SOP})")
def _(t):
    return op.sop_validate(_sop_responses(t), "response").select("thread_id", "accepted", "risk_level", "requires_human_gate")


_CLAIMS = """SELECT source AS workspace_id, doc_id, doc_id || '-' || (p - 1) AS claim_id, ((p - 1) // 5)::INT AS chunk_index, x AS claim_text, (length(x) * 7 + doc_id) % 100 / 100 AS confidence, (p - 1) AS pos, length(x) AS chars
 FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), '. ')) AS x, generate_subscripts(string_split(coalesce(text, ''), '. '), 1) AS p FROM documents)"""


@query("thread_to_sop", f"SELECT thread_id, CASE WHEN NOT accepted THEN 'no_sop' WHEN regexp_extract(title, '[0-9]+')::INT < 40 THEN 'sop_linked' ELSE 'sop_created' END AS outcome, CASE WHEN accepted THEN title END AS sop_title FROM ({_SOP})")
def _(t):
    known = t.benchmark.filter("item_id < 40").select(F.concat(F.lit("SOP "), F.col("item_id")).alias("title"))
    return doc.thread_to_sop(t.documents.select(F.col("doc_id").alias("thread_id")), _sop_responses(t), known)


def number_embedder(texts: list[str]) -> list[list[float] | None]:
    """A vector by the number after the first word: one of sixteen axes; none for multiples of 50."""
    out = []
    for x in texts:
        n = int(x.split(":")[0].split()[1])
        out.append(None if n % 50 == 0 else [float(k == n % 16) for k in range(16)])
    return out


# Known procedures: 'sop 0' to 'sop 19' by title, and 'Other 20' to 'Other 24', which are like those of the same axis.
@query("threads_to_sops", f"""
WITH s AS (SELECT *, regexp_extract(title, '[0-9]+')::INT AS n FROM ({_SOP})),
 o AS (SELECT thread_id, CASE WHEN NOT accepted THEN 'no_sop' WHEN n < 20 OR n % 50 <> 0 AND n % 16 BETWEEN 4 AND 8 THEN 'sop_linked' WHEN n % 50 = 0 THEN 'failed' ELSE 'sop_created' END AS outcome,
  CASE WHEN NOT accepted THEN NULL WHEN n < 20 THEN 'k' || n WHEN n % 50 <> 0 AND n % 16 BETWEEN 4 AND 8 THEN 'k' || (n % 16 + 16) WHEN n % 50 <> 0 THEN sha256('w:sop:' || thread_id) END AS sop_id FROM s),
 c AS (SELECT doc_id, claim_id, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, claim_id) AS r FROM ({_CLAIMS}))
SELECT 'outcome' AS kind, thread_id, outcome AS what, sop_id FROM o UNION ALL SELECT 'citation', thread_id, NULL, sop_id FROM o WHERE sop_id IS NOT NULL
UNION ALL SELECT 'citation', thread_id, claim_id, sop_id FROM o JOIN c ON doc_id = thread_id WHERE sop_id IS NOT NULL AND r <= 3 UNION ALL SELECT 'version', NULL, '1', sop_id FROM o WHERE outcome = 'sop_created'
UNION ALL SELECT 'sop', thread_id, title || '/Draft/' || risk_level, sop_id FROM o JOIN s USING (thread_id) WHERE outcome = 'sop_created'""")
def _(t):
    n = t.benchmark.sparkSession.range(25).select(F.col("id").alias("n"))
    known = n.select(
        F.concat(F.lit("k"), "n").alias("sop_id"), F.lit("w").alias("workspace_id"), F.concat(F.when(F.col("n") < 20, "SOP ").otherwise("Other "), "n").alias("title"),
        F.when(F.col("n") >= 20, F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: (k == F.col("n") % 16).cast("float"))).alias("embedding"),
    )
    threads = t.documents.select(F.col("doc_id").alias("thread_id"), F.lit("w").alias("workspace_id"))
    out = doc.threads_to_sops(threads, _sop_responses(t), known, _claims(t), number_embedder, top=3)
    none = lambda kind: F.lit(None).cast(kind)
    rows = out["outcomes"].select(F.lit("outcome").alias("kind"), "thread_id", F.col("outcome").alias("what"), "sop_id")
    rows = rows.unionByName(out["citations"].select(F.lit("citation").alias("kind"), "thread_id", F.col("claim_id").alias("what"), "sop_id"))
    rows = rows.unionByName(out["versions"].select(F.lit("version").alias("kind"), none("long").alias("thread_id"), F.col("version").cast("string").alias("what"), "sop_id"))
    return rows.unionByName(out["sops"].select(F.lit("sop").alias("kind"), F.col("source_doc_id").alias("thread_id"), F.concat_ws("/", "title", "status", "risk_level").alias("what"), "sop_id"))


def _judgements(t: Tables):
    k = F.col("doc_id")
    js = F.to_json(F.struct((k % 5).cast("int").alias("total_claims"), F.when(k % 3 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("unsupported_claims")))
    return t.labels.select("doc_id", F.when(k % 11 == 0, "broken").otherwise(js).alias("judge"), F.when(k % 7 == 0, " ").when(k % 7 == 1, "OK then").otherwise("A longer answer that makes claims of some kind.").alias("answer"))


_JUDGE = """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 5 = 0 THEN 1 ELSE (doc_id % 5 - (doc_id % 3 = 0)::INT) / (doc_id % 5) END::DOUBLE AS score, doc_id % 11 <> 0 AND doc_id % 3 <> 0 AS clean FROM labels"""


@query("grounding_scores", f"SELECT doc_id, round(score, 6) AS score, clean AND score >= 0.95 AS passed FROM ({_JUDGE})")
def _(t):
    return op.grounding_scores(_judgements(t), "judge").select("doc_id", F.round("score", 6).alias("score"), "passed")


@query("grounding_guard", f"SELECT doc_id, doc_id % 7 < 2 OR (clean AND score >= 0.95) AS grounded, CASE WHEN doc_id % 7 < 2 THEN 1.0 ELSE round(score, 6) END AS grounding_score FROM ({_JUDGE})")
def _(t):
    j = op.grounding_scores(_judgements(t), "judge").withColumn("bad", F.when(F.col("passed"), 0).otherwise(1))
    return op.grounding_guard(j, "answer", "score", "bad").select("doc_id", "grounded", F.round("grounding_score", 6).alias("grounding_score"))


# ---- joins ----


@query("pending_approvals", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' AND c_nationkey = 3")
def _(t):
    owners = t.customer.filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return op.pending_approvals(t.orders, owners, "o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "P").select("o_orderkey", "c_name")


def _claims(t: Tables):
    """Sentences of documents as claims."""
    s = t.documents.select("doc_id", F.col("source").alias("workspace_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\. ")).alias("pos", "claim_text"))
    return s.select("workspace_id", "doc_id", F.concat_ws("-", "doc_id", "pos").alias("claim_id"), F.floor(F.col("pos") / 5).cast("int").alias("chunk_index"), "claim_text", ((F.length("claim_text") * 7 + F.col("doc_id")) % 100 / 100).alias("confidence"), F.col("pos").cast("int").alias("char_start"), (F.col("pos") + F.length("claim_text")).cast("int").alias("char_end"), F.col("pos").alias("seq"))


_TOP = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, claim_id) AS rank FROM ({_CLAIMS})) WHERE rank <= 5"


@query("top_claims", f"SELECT doc_id, claim_id, rank::INT AS rank FROM ({_TOP})")
def _(t):
    return op.top_claims(_claims(t), 5).select("doc_id", "claim_id", "rank")


@query("link_claims", f"SELECT doc_id, claim_id FROM ({_TOP}) WHERE pos % 2 <> 0")
def _(t):
    c = _claims(t)
    return doc.link_claims(c, c.filter("seq % 2 = 0"), 5)


@query("store_claims", f"""
SELECT workspace_id, doc_id, chunk_index, sha256(claim_text) AS claim_text_hash, count(*) AS sightings, max(pos)::INT AS char_start FROM ({_CLAIMS}) GROUP BY 1, 2, 3, 4""")
def _(t):
    return doc.store_claims(_claims(t)).select("workspace_id", "doc_id", "chunk_index", "claim_text_hash", "sightings", "char_start")


def _stored_chunks(t: Tables):
    return t.documents.select(F.col("source").alias("workspace_id"), "doc_id", F.explode(F.array(F.lit(0), F.lit(2))).alias("chunk_index")).filter("doc_id % 4 != 0").withColumn("chunk_id", F.concat_ws("/", "doc_id", "chunk_index"))


@query("grounded_claims", f"SELECT doc_id, chunk_index, count(*) AS n FROM ({_CLAIMS}) WHERE doc_id % 4 <> 0 AND chunk_index IN (0, 2) GROUP BY 1, 2")
def _(t):
    good, _ = doc.grounded_claims(_claims(t), _stored_chunks(t))
    return good.groupBy("doc_id", "chunk_index").agg(F.count(F.lit(1)).alias("n"))


@query("bind_chunk_ids", f"SELECT claim_id, doc_id || '/' || chunk_index AS chunk_id FROM ({_CLAIMS}) WHERE doc_id % 4 <> 0 AND chunk_index IN (0, 2)")
def _(t):
    return doc.bind_chunk_ids(_claims(t), _stored_chunks(t)).select("claim_id", "chunk_id")


@query("sop_claims", f"""
SELECT doc_id % 50 AS sop_id, claim_id, round(confidence, 6) AS confidence, CASE WHEN pos % 3 = 0 THEN 0 ELSE 1 END AS n_evidence, sha256(claim_text) AS claim_hash FROM ({_CLAIMS}) WHERE pos % 5 = 0""")
def _(t):
    c = _claims(t)
    cites = c.filter("seq % 5 = 0").select((F.col("doc_id") % 50).alias("sop_id"), "claim_id")
    out = doc.sop_claims(cites, c.select("claim_id", "claim_text", "confidence"), c.filter("seq % 3 != 0").select("claim_id", "char_start", "char_end"))
    return out.select("sop_id", "claim_id", F.round("confidence", 6).alias("confidence"), F.size("evidence").alias("n_evidence"), F.sha2("claim_text", 256).alias("claim_hash"))


@query("cascade_delete", f"SELECT doc_id % 50 AS sop_id, CASE WHEN doc_id % 3 <> 0 THEN claim_id END AS claim_id FROM ({_CLAIMS}) WHERE pos % 7 = 0")
def _(t):
    c = _claims(t)
    cites = c.filter("seq % 7 = 0").select((F.col("doc_id") % 50).alias("sop_id"), "claim_id")
    gone = t.documents.filter("doc_id % 3 = 0").select("doc_id")
    return doc.cascade_delete(gone, c.select("doc_id", "chunk_index"), c.select("doc_id", "claim_id"), cites)["citations"].select("sop_id", "claim_id")


# Evidence of claims, also from the next document's chunk; documents divisible by 3 go.
@query("cascade_delete_evidence", f"""
WITH c AS (SELECT doc_id, claim_id, chunk_index, pos FROM ({_CLAIMS})), e AS (SELECT claim_id, doc_id, CASE WHEN pos % 4 = 0 THEN doc_id + 1 ELSE doc_id END AS source, chunk_index FROM c), k AS (SELECT DISTINCT doc_id, chunk_index FROM c)
SELECT 'evidence' AS kind, claim_id AS id, source || '/' || chunk_index AS chunk_id FROM e WHERE doc_id % 3 <> 0 AND source % 3 <> 0 AND EXISTS (SELECT 1 FROM k WHERE k.doc_id = source AND k.chunk_index = e.chunk_index)
UNION ALL SELECT 'chunk', doc_id || '/' || chunk_index, NULL FROM k WHERE doc_id % 3 <> 0 UNION ALL SELECT 'claim', claim_id, NULL FROM c WHERE doc_id % 3 <> 0""")
def _(t):
    c = _claims(t)
    place = lambda d: F.concat_ws("/", d, F.col("chunk_index"))
    source = F.when(F.col("seq") % 4 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id"))
    evidence = c.select("claim_id", source.alias("doc_id"), place(source).alias("chunk_id"))
    chunks = c.select("doc_id", place(F.col("doc_id")).alias("chunk_id")).distinct()
    out = doc.cascade_delete(t.documents.filter("doc_id % 3 = 0").select("doc_id"), chunks, c.select("doc_id", "claim_id"), c.select(F.lit(1).alias("sop_id"), "claim_id").limit(0), evidence)
    none = F.lit(None).cast("string").alias("chunk_id")
    rows = out["evidence"].select(F.lit("evidence").alias("kind"), F.col("claim_id").alias("id"), "chunk_id")
    return rows.unionByName(out["chunks"].select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), none)).unionByName(out["claims"].select(F.lit("claim").alias("kind"), F.col("claim_id").alias("id"), none))


@query("claims_backfill_pending", "SELECT source AS workspace_id, count_if(doc_id % 5 < 3) AS pending, count_if(doc_id % 5 >= 3) AS given_up FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 3 <> 0 GROUP BY 1")
def _(t):
    docs = _backfill_docs(t).join(t.documents.select("doc_id", F.col("source").alias("workspace_id")), "doc_id")
    return doc.claims_backfill_pending(docs)


@query("explicit_grants", """
SELECT doc_id FROM labels WHERE toxic = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0""")
def _(t):
    k = F.col("doc_id")
    rows = t.labels.select("doc_id", F.when(F.col("toxic") == 0, "Low").otherwise("High").alias("risk_level"))
    grants = t.labels.filter("doc_id % 5 = 0").select(k, F.lit("user").alias("principal_type"), F.lit("9").alias("principal_id")).union(t.labels.filter("doc_id % 7 = 0").select(k, F.lit("role"), F.lit("member"))).union(t.labels.filter("doc_id % 2 = 0").select(k, F.lit("user"), F.lit("8")))
    return op.explicit_grants(rows, grants, "doc_id", 9, ["member"]).select("doc_id")


@query("accessible_docs", "SELECT doc_id::VARCHAR AS doc_id FROM labels WHERE doc_id % 3 = 1 AND doc_id % 4 < 3")
def _(t):
    rel = F.element_at(F.array(*map(F.lit, ["viewer", "read", "owner", "editor"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return op.accessible_docs(t.labels.select(F.concat(F.lit("user:u"), F.col("doc_id") % 3, F.lit("#"), rel, F.lit("@document:"), F.col("doc_id")).alias("tuple")), "user:u1")


@query("unseen_items", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def _(t):
    seen = t.documents.filter("doc_id % 3 = 0").select("doc_id", "source")
    return op.unseen_items(t.documents, seen, ["doc_id", "source"]).select("doc_id")


def _snapshots(t: Tables):
    d = t.documents.select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha"))
    tree = d.filter("path % 5 != 0")
    return tree, d.filter("path % 7 != 0").withColumn("sha", F.when(F.col("path") % 3 == 0, "old").otherwise(F.col("sha")))


_DELTA = "SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 5 = 0 THEN 'removed' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 7 <> 0"


@query("sha_delta", _DELTA)
def _(t):
    return op.sha_delta(*_snapshots(t))


@query("source_delta", f"SELECT change, count(*) AS n, sum(path)::BIGINT AS paths FROM ({_DELTA}) WHERE change <> 'unchanged' GROUP BY 1")
def _(t):
    return op.sha_delta(*_snapshots(t)).filter("change != 'unchanged'").groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.sum("path").alias("paths"))


@query("reconcile_deletions", "SELECT doc_id AS path FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 = 0")
def _(t):
    tree, indexed = _snapshots(t)
    return op.reconcile_deletions(indexed, tree).select("path")


@query("unchanged_skip", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def _(t):
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("content_hash"))
    old = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "x").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("doc_id") % 2 == 0, "failed").otherwise("completed").alias("extraction_stage"))
    return op.unchanged_skip(d, old, ["doc_id"]).select("doc_id")


_STALE = """SELECT event_id, CASE WHEN event_type = 'view' AND user_id % 3 = 0 THEN 'skipped' ELSE 'requeued' END AS outcome FROM events WHERE event_type IN ('click', 'view') AND ts < TIMESTAMP '2024-01-20' - INTERVAL 10 MINUTE"""


def _stale(t: Tables):
    e = t.events.select("event_id", F.col("user_id").alias("key"), F.when(F.col("event_type") == "click", "received").when(F.col("event_type") == "view", "processing").otherwise("completed").alias("status"), F.col("ts").alias("updated_at"))
    at = F.lit("2024-01-20").cast("timestamp")
    leases = t.events.select(F.col("user_id").alias("key"), F.lit("pending").alias("status"), F.when(F.col("user_id") % 3 == 0, at + F.expr("interval 1 hour")).otherwise(at).alias("expires_at")).distinct()
    return e, leases, at


@query("stale_events", _STALE)
def _(t):
    return op.stale_events(*_stale(t))


# Three sweeps an hour apart: what one has requeued or skipped the next finds again.
@query("stream_stale_sweep", " UNION ALL ".join(f"SELECT {k} AS sweep, * FROM ({_STALE})".replace("2024-01-20'", f"2024-01-20' + INTERVAL {k} HOUR").replace("user_id % 3 = 0 THEN", f"user_id % 3 = 0 AND {k} = 0 THEN") for k in range(3)))
def _(t):
    from corpusspark.streaming.streams import stale_sweep

    e, leases, at = _stale(t)
    sweeps = [stale_sweep(e, leases, at + F.expr(f"interval {k} hours")).select(F.lit(k).alias("sweep"), "event_id", "outcome") for k in range(3)]
    return sweeps[0].unionByName(sweeps[1]).unionByName(sweeps[2])


# A run for each repository (user): every third was left in the middle, every fifth was never run.
@query("sync_since", """
SELECT 'w' AS workspace_id, user_id AS repository, CASE WHEN user_id % 2 = 0 THEN epoch(CASE WHEN user_id % 5 <> 0 THEN date_trunc('second', max(ts)) ELSE TIMESTAMP '2024-02-01' - INTERVAL 24 HOUR END)::BIGINT END AS since,
 CASE WHEN user_id % 3 = 0 AND user_id % 5 <> 0 THEN 'issues' END AS phase, CASE WHEN user_id % 3 = 0 AND user_id % 5 <> 0 THEN 'tree' ELSE '' END AS completed FROM events GROUP BY user_id""")
def _(t):
    u = F.col("user_id")
    w = F.lit("w").alias("workspace_id")
    runs = t.events.filter(u % 5 != 0).select(w, u.alias("repository"), F.when(u % 2 == 0, "incremental").otherwise("initial").alias("kind"), F.when(u % 3 == 0, "running").otherwise("completed").alias("status"), F.col("ts").alias("updated_at"), F.lit("issues").alias("phase"), F.array(F.lit("tree")).alias("completed_phases"))
    state = op.sync_state(runs.limit(0), runs)
    asked = t.events.select(w, u.alias("repository"), (u % 2 == 0).alias("incremental")).distinct()
    out = op.sync_since(state, asked, F.lit("2024-02-01").cast("timestamp"))
    return out.select("workspace_id", "repository", F.unix_timestamp("since").alias("since"), "phase", F.array_join("completed_phases", ",").alias("completed"))


# ---- aggregates ----


@query("sop_analytics", """
SELECT 'o_orderstatus' AS breakdown, o_orderstatus AS value, count(*) AS n, count_if(o_orderdate < TIMESTAMP '1998-01-01') AS stale FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderpriority', coalesce(o_orderpriority, 'Low'), count(*), count_if(o_orderdate < TIMESTAMP '1998-01-01') FROM orders GROUP BY 2
UNION ALL SELECT '', NULL, count(*), count_if(o_orderdate < TIMESTAMP '1998-01-01') FROM orders""")
def _(t):
    old = F.count_if(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"))
    rows = t.orders.withColumn("o_orderpriority", F.coalesce("o_orderpriority", F.lit("Low")))
    out = op.rollup_sets(rows, ["o_orderstatus", "o_orderpriority"], [["o_orderstatus"], ["o_orderpriority"], []], n=F.count(F.lit(1)), stale=old)
    return out.select("breakdown", F.coalesce("o_orderstatus", "o_orderpriority").alias("value"), "n", "stale")


@query("sop_dashboard", """
WITH s AS (SELECT p_partkey AS id, p_partkey % 4 AS ws, ['draft', 'active'][p_partkey % 2 + 1] AS status, p_brand AS category, CASE WHEN p_size % 3 <> 0 THEN ['High', 'Critical'][p_size % 2 + 1] END AS risk, p_size % 5 = 0 AS stale FROM part),
 a AS (SELECT l_partkey AS sop, l_returnflag AS st FROM lineitem), r AS (SELECT l_partkey AS sop, l_shipdate AS day FROM lineitem), t AS (SELECT user_id % 4 AS ws, event_type AS src FROM events)
SELECT ws AS workspace_id, 'status' AS breakdown, status AS value, count(*) AS n FROM s GROUP BY 1, 3 UNION ALL SELECT ws, 'category', category, count(*) FROM s GROUP BY 1, 3 UNION ALL SELECT ws, 'risk_level', coalesce(risk, 'Low'), count(*) FROM s GROUP BY 1, 3
UNION ALL SELECT ws, 'total', NULL, count(*) FROM s GROUP BY 1 UNION ALL SELECT ws, 'stale', NULL, count_if(stale) FROM s GROUP BY 1
UNION ALL SELECT ws, 'pending_approvals', NULL, count(*) FROM a JOIN s ON sop = id WHERE st = 'N' GROUP BY 1 UNION ALL SELECT ws, 'recent_executions', NULL, count(*) FROM r JOIN s ON sop = id WHERE day >= TIMESTAMP '1996-06-08' - INTERVAL 7 DAY GROUP BY 1
UNION ALL SELECT ws, 'source', src, count(*) FROM t GROUP BY 1, 3""")
def _(t):
    p, k = F.col("p_size"), F.col("p_partkey")
    sops = t.part.select(
        k.alias("id"), (k % 4).alias("workspace_id"), F.when(k % 2 == 0, "draft").otherwise("active").alias("status"), F.col("p_brand").alias("category"),
        F.when(p % 3 != 0, F.when(p % 2 == 0, "High").otherwise("Critical")).alias("risk_level"), (p % 5 == 0).alias("is_stale"),
    )
    approvals = t.lineitem.select(F.col("l_partkey").alias("sop_id"), F.when(F.col("l_returnflag") == "N", "pending").otherwise("approved").alias("status"))
    runs = t.lineitem.select(F.col("l_partkey").alias("sop_id"), F.col("l_shipdate").cast("timestamp").alias("created_at"))
    threads = t.events.select((F.col("user_id") % 4).alias("workspace_id"), F.col("event_type").alias("source"))
    return op.sop_dashboard(sops, approvals, runs, threads, F.lit("1996-06-08").cast("timestamp"))


_USAGE = "SELECT user_id::VARCHAR AS ws, CASE WHEN event_id % 2 = 0 THEN event_type ELSE split_part('llm:p' || event_id % 3 || ':m', ':', 2) END AS provider, event_type AS resource, value FROM events"


@query("usage_summary", f"""
WITH u AS ({_USAGE})
SELECT 'ws' AS breakdown, ws, NULL AS provider, NULL AS resource, count(*) AS requests, round(sum(value), 4) AS units FROM u GROUP BY ws
UNION ALL SELECT 'ws+provider', ws, provider, NULL, count(*), round(sum(value), 4) FROM u GROUP BY ws, provider
UNION ALL SELECT 'ws+resource', ws, NULL, resource, count(*), round(sum(value), 4) FROM u GROUP BY ws, resource""")
def _(t):
    model = F.concat(F.lit("llm:p"), F.col("event_id") % 3, F.lit(":m"))
    rows = t.events.select(F.col("user_id").alias("ws"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.split(model, ":")[1]).alias("provider"), F.col("event_type").alias("resource"), "value")
    return op.rollup_sets(rows, ["ws", "provider", "resource"], [["ws"], ["ws", "provider"], ["ws", "resource"]], requests=F.count(F.lit(1)), units=F.round(F.sum("value"), 4))


@query("period_cost", """
SELECT unit, epoch(CASE unit WHEN 'hour' THEN date_trunc('hour', ts) WHEN 'day' THEN date_trunc('day', ts) ELSE date_trunc('month', ts) END)::BIGINT AS period, event_type AS resource, round(sum(value), 4) AS cost
FROM events CROSS JOIN (VALUES ('hour'), ('day'), ('month')) AS u(unit) GROUP BY ALL""")
def _(t):
    usage = t.events.select("ts", F.col("event_type").alias("resource"), F.col("value").alias("cost"))
    return op.period_cost(usage, "ts", "cost", ["resource"]).withColumn("cost", F.round("cost", 4))


@query("quota_check", """
SELECT user_id, round(sum(value), 4) AS usage, user_id % 4 = 0 OR sum(value) < 2500 AS allowed, CASE WHEN user_id % 4 <> 0 AND sum(value) >= 2500 THEN 'quota_exceeded' END AS reason FROM events GROUP BY 1""")
def _(t):
    quotas = t.events.select("user_id", F.when(F.col("user_id") % 4 == 0, 0).otherwise(2500).alias("quota")).distinct()
    return op.quota_check(t.events, quotas, "user_id", "value").withColumn("usage", F.round("usage", 4))


@query("metric_rollup", "SELECT event_type || ':' || (user_id % 3) AS metric, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 2) AS mean FROM events GROUP BY 1")
def _(t):
    out = op.metric_rollup(t.events.withColumn("team", F.col("user_id") % 3), ["event_type", "team"], "value")
    return out.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 2)})


@query("sync_stats", "SELECT event_type AS phase, count_if(user_id % 3 = 0) AS indexed, count_if(user_id % 3 = 1) AS skipped, count_if(user_id % 3 = 2) AS failed FROM events GROUP BY 1")
def _(t):
    o = F.element_at(F.array(*map(F.lit, ["indexed", "skipped", "failed"])), (F.col("user_id") % 3 + 1).cast("int"))
    return op.sync_stats(t.events.withColumn("o", o), "event_type", "o")


@query("distinct_workspaces", "SELECT DISTINCT user_id FROM events")
def _(t):
    return op.distinct_values(t.events, "user_id")


# ---- windows ----


@query("version_history", """
SELECT o_custkey, v AS version_number, '{"o_orderstatus":"' || s || '","o_orderkey":' || k || '}' AS snapshot FROM (SELECT o_custkey, row_number() OVER w - 1 AS v, lag(o_orderstatus) OVER w AS s, lag(o_orderkey) OVER w AS k FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE v > 0""")
def _(t):
    return op.version_history(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderkey"]).select("o_custkey", F.col("version_number").cast("long").alias("version_number"), "snapshot")


@query("rank_fusion", """
WITH d AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 200), s AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars % 100, doc_id) AS r FROM documents QUALIFY r <= 200)
SELECT coalesce(d.id, s.id) AS id, d.r::INT AS dense_rank, s.r::INT AS sparse_rank, round(coalesce(1 / (60 + d.r), 0) + coalesce(1 / (60 + s.r), 0), 9) AS score FROM d FULL JOIN s ON d.id = s.id""")
def _(t):
    from corpusspark.operators.retrieval import _ranked

    d = t.documents.select(F.col("doc_id").alias("id"), "n_chars")
    leg = lambda *order: _ranked(d.orderBy(*order).limit(200), list(order)).select("id", "rank")
    return op.rank_fusion(leg(F.desc("n_chars"), F.asc("id")), leg((F.col("n_chars") % 100).asc(), F.asc("id"))).withColumn("score", F.round("score", 9))


@query("single_use_approval", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 THEN 'consumed' ELSE 'rejected' END AS outcome FROM events")
def _(t):
    return op.single_use_approval(t.events.withColumn("a", F.concat_ws("-", "user_id", "event_type")), "a", ["ts", "event_id"]).select("event_id", "outcome")


_STATES = ["IDLE", "PLANNING", "AUDITING", "EXECUTING", "COMPLETED", "FAILED", "PAUSED", "AWAITING_APPROVAL"]
_LEGAL = ", ".join(f"('{a}', '{b}')" for a, bs in op.TRANSITIONS.items() for b in bs)


@query("illegal_transitions", f"""
WITH s AS (SELECT event_id, {_STATES}[(event_id * 7 // 3 % 8)::INT + 1] AS to_status, user_id FROM events), l AS (SELECT event_id, to_status, lag(to_status) OVER (PARTITION BY user_id ORDER BY event_id) AS from_status FROM s)
SELECT event_id, from_status, to_status FROM l WHERE from_status IS NOT NULL AND from_status <> to_status AND (from_status, to_status) NOT IN ({_LEGAL})""")
def _(t):
    s = t.events.select("event_id", "user_id", F.element_at(F.array(*map(F.lit, _STATES)), (F.floor(F.col("event_id") * 7 / 3) % 8 + 1).cast("int")).alias("status"))
    return op.illegal_transitions(s, "user_id", ["event_id"], "status").select("event_id", "from_status", "to_status")


# ---- pages and set operations ----


@query("keyset_page", "SELECT doc_id, CASE WHEN count(*) OVER () = 100 THEN min(doc_id) OVER () END AS next_cursor FROM (SELECT doc_id FROM documents WHERE doc_id < 700 ORDER BY doc_id DESC LIMIT 100)")
def _(t):
    return op.keyset_page(t.documents.select("doc_id"), "doc_id", 700, 100)


@query("graph_page", "SELECT * FROM (SELECT 'node' AS kind, c_name AS id FROM customer ORDER BY c_name LIMIT 50) UNION ALL SELECT * FROM (SELECT 'edge', c_custkey || '-' || c_nationkey AS k FROM customer ORDER BY k LIMIT 100)")
def _(t):
    return op.graph_page(t.customer.select(F.col("c_name").alias("id")), t.customer.select(F.concat_ws("-", "c_custkey", "c_nationkey").alias("id")))


@query("distinct_tuples", "SELECT DISTINCT 'p' || l_partkey || ' SUPPLIED_BY s' || l_suppkey AS tuple FROM lineitem ORDER BY 1 LIMIT 25")
def _(t):
    return op.distinct_tuples(t.lineitem.select(F.concat(F.lit("p"), F.col("l_partkey")).alias("source_id"), F.lit("SUPPLIED_BY").alias("edge_type"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("target_id")))
