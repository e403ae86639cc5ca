"""Queries of documents, graph, retrieval and streams (their batch twins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusspark.operators import documents as doc
from corpusspark.operators import graph as g
from corpusspark.operators import retrieval as ret
from corpusspark.operators.lineage import cut, scratch, sized, spread, unique
from corpusspark.plans.registry import Tables, query
from corpusspark.streaming import streams as st

_CHUNKS = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents),
 c(doc_id, t, cur, stop, k) AS (
  SELECT doc_id, t, 0, CAST(NULL AS BIGINT), 0 FROM d WHERE length(t) > 0
  UNION ALL
  SELECT doc_id, t, greatest(e - 250, cur + 1), e, k + 1 FROM (
   SELECT doc_id, t, cur, k, CASE WHEN cur + 3000 >= length(t) THEN length(t) WHEN greatest(p, s) > cur + 1500 THEN CASE WHEN s > p THEN s + 1 ELSE p END ELSE cur + 3000 END AS e
   FROM (SELECT *, CASE WHEN instr(reverse(w), chr(10) || chr(10)) > 0 THEN length(w) - instr(reverse(w), chr(10) || chr(10)) - 1 ELSE -1 END AS p,
                CASE WHEN instr(reverse(w), ' .') > 0 THEN length(w) - instr(reverse(w), ' .') - 1 ELSE -1 END AS s
         FROM (SELECT *, substr(t, 1, cur + 3002) AS w FROM c WHERE stop IS NULL OR stop < length(t))))),
 x AS (SELECT doc_id, t, k - 1 AS k, stop, CASE WHEN k = 1 THEN 0 ELSE greatest(lag(stop) OVER (PARTITION BY doc_id ORDER BY k) - 250, lag(cur) OVER (PARTITION BY doc_id ORDER BY k) * 0 + lag(stop) OVER (PARTITION BY doc_id ORDER BY k) - 250) END AS start FROM c WHERE stop IS NOT NULL)
"""
_CHUNKS_OUT = _CHUNKS + """
SELECT doc_id, k::INT AS chunk_index, start::INT AS char_start, stop::INT AS char_end, sha256(regexp_replace(substr(t, start::INT + 1, (stop - start)::INT), '^\\s+|\\s+$', '', 'g')) AS content_hash FROM x"""


@query("chunk_documents", _CHUNKS_OUT)
def _(t):
    return doc.chunk_documents(t.documents).select("doc_id", "chunk_index", "char_start", "char_end", "content_hash")


@query("stream_corpus", _CHUNKS + "SELECT doc_id, count(*) AS chunks FROM x GROUP BY 1")
def _(t):
    return st.stream_corpus(t.documents).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))


@query("heading_sections", """
SELECT doc_id, 0::BIGINT AS section, 'Overview' AS heading, 1 AS level, sha256('intro') AS content_hash FROM documents
UNION ALL SELECT doc_id, 1, 'Lang ' || lang, 2, sha256('a' || chr(10) || 'b') FROM documents UNION ALL SELECT doc_id, 3, 'End', 1, sha256(source) FROM documents""")
def _(t):
    text = F.concat(F.lit("intro\n## Lang "), F.col("lang"), F.lit("\na\nb\n### Empty\n# End\n"), F.col("source"))
    return doc.heading_sections(t.documents.select("doc_id", text.alias("text"))).select("doc_id", F.col("section").cast("long"), "heading", "level", F.sha2("content", 256).alias("content_hash"))


@query("procedure_ast", """
SELECT p_partkey, 'Fix ' || p_name AS title, 'part ' || p_brand || ' fails' AS trigger, 3 AS n_steps, 'Slack,Postgres,Internal' AS systems, 'size > ' || p_size AS condition, 1 AS approvals FROM part""")
def _(t):
    md = F.concat(F.lit("# Fix "), F.col("p_name"), F.lit("\nTrigger: part "), F.col("p_brand"), F.lit(" fails\n- part_id: string (the part)\n1. Tell Slack\n 2. Delete from Postgres if size > "), F.col("p_size"), F.lit(", then stop\n3. Done\n"))
    a = spread(t.part, "p_partkey").select("p_partkey", doc.procedure_ast(md).alias("a"))
    steps = F.col("a.steps")
    return a.select("p_partkey", "a.title", "a.trigger", F.size(steps).alias("n_steps"), F.array_join(steps["target_system"], ",").alias("systems"), F.array_join(F.array_compact(steps["condition"]), ",").alias("condition"), F.size(F.filter(steps, lambda s: s["approval"])).alias("approvals"))


# Procedures that lack something: an id, a title, a trigger, steps, a step's number or action.
@query("procedure_errors", """
SELECT p_partkey, concat_ws('|', CASE WHEN p_partkey % 2 = 0 THEN 'AST missing required property "id".' END, CASE WHEN p_partkey % 3 = 0 THEN 'AST missing required property "title".' END, CASE WHEN p_partkey % 5 = 0 THEN 'AST missing required property "triggerCondition".' END,
 CASE WHEN p_partkey % 7 = 0 THEN 'AST must contain at least one step in "steps" array.' END, CASE WHEN p_partkey % 7 > 0 AND p_partkey % 11 = 0 THEN 'Step at index 1 missing "stepNumber".' END,
 CASE WHEN p_partkey % 7 > 0 AND p_partkey % 13 = 0 THEN 'Step ' || CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 2 END || ' missing "action" description.' END) AS errors FROM part""")
def _(t):
    k = F.col("p_partkey")
    parsed = spread(t.part, "p_partkey").select("p_partkey", doc.procedure_ast(F.concat(F.lit("# Fix "), F.col("p_name"), F.lit("\n1. Tell Slack\n2. Done\n"))).alias("ast"))
    ast = F.col("ast")
    changed = F.transform(ast["steps"], lambda s, i: F.struct(F.when((i != 1) | (k % 11 != 0), s["step_number"]).alias("step_number"), F.when((i != 1) | (k % 13 != 0), s["action"]).alias("action")))
    whole = F.struct(F.when(k % 2 != 0, k.cast("string")).alias("id"), F.when(k % 3 != 0, ast["title"]).alias("title"), F.when(k % 5 != 0, ast["trigger"]).alias("trigger"), F.when(k % 7 != 0, changed).alias("steps"))
    return parsed.select("p_partkey", F.array_join(doc.ast_errors(whole), "|").alias("errors"))


def _incoming(t: Tables):
    return t.documents.select(F.lit("w").alias("workspace_id"), "source", F.col("doc_id").cast("string").alias("external_id"), "text", F.array(F.lit("member")).alias("roles"))


@query("persist_corpus", _CHUNKS + """
, n AS (SELECT doc_id, source FROM documents WHERE doc_id % 3 <> 0),
 k AS (SELECT n.doc_id, source, sha256('w:' || source || ':' || n.doc_id) AS id FROM n)
SELECT 'chunk' AS kind, id AS doc_id, x.k::INT AS place, sha256(regexp_replace(substr(t, start::INT + 1, (stop - start)::INT), '^\\s+|\\s+$', '', 'g')) AS what FROM x JOIN k USING (doc_id)
UNION ALL SELECT 'document', id, (SELECT count(*) FROM x WHERE x.doc_id = k.doc_id)::INT, 'completed' FROM k UNION ALL SELECT 'acl', id, NULL, 'member' FROM k""")
def _(t):
    rows = _incoming(t)
    stored = rows.filter("cast(external_id as long) % 3 = 0").select("workspace_id", "source", "external_id", F.sha2("text", 256).alias("content_hash"), F.lit("completed").alias("extraction_stage"))
    out = doc.persist_corpus(rows, stored, doc.hashing_embedder())
    chunks = out["chunks"].filter(F.size("embedding") == 32).select(F.lit("chunk").alias("kind"), "doc_id", F.col("chunk_index").alias("place"), F.col("content_hash").alias("what"))
    docs = out["documents"].select(F.lit("document").alias("kind"), "doc_id", F.col("n_chunks").cast("int").alias("place"), F.col("extraction_stage").alias("what"))
    return chunks.unionByName(docs).unionByName(out["acl"].select(F.lit("acl").alias("kind"), "doc_id", F.lit(None).cast("int").alias("place"), F.col("principal_id").alias("what")))


@query("reembed_stale", """
SELECT doc_id AS chunk_id, 'missing_embedding' AS reason, CASE WHEN regexp_replace(coalesce(text, ''), '\\s', '', 'g') = '' THEN 'invalid' WHEN doc_id % 10 = 0 THEN 'raced' ELSE 'embedded' END AS outcome FROM documents""")
def _(t):
    k = F.col("doc_id")
    chunks = t.documents.select(k.alias("chunk_id"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"), F.lit(None).cast("array<float>").alias("embedding"), F.lit("m").alias("embedding_model"), F.lit("1").alias("embedding_version"))
    now = t.documents.select(k.alias("chunk_id"), F.when(k % 10 == 0, "changed").otherwise(F.col("text")).alias("content"), F.sha2("text", 256).alias("content_hash"))
    return doc.reembed_stale(chunks, now, doc.hashing_embedder(), "hash", "1", 32).select("chunk_id", "reason", "outcome")


# Chunks that are stale for each of the reasons, counted, with those in quarantine; the second page begins after 99.
@query("reembed_outcomes", """
WITH c AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\s', '', 'g') = '' AS bare, CASE WHEN doc_id % 13 = 0 THEN 'force' WHEN doc_id % 9 = 0 THEN 'missing_embedding' WHEN doc_id % 5 = 0 THEN 'model_mismatch' WHEN doc_id % 7 = 0 THEN 'version_mismatch' WHEN doc_id % 11 = 0 THEN 'content_hash_mismatch' END AS reason FROM documents),
 o AS (SELECT doc_id, reason, CASE WHEN bare THEN 'invalid' WHEN doc_id % 10 = 0 THEN 'raced' ELSE 'embedded' END AS outcome FROM c WHERE reason IS NOT NULL), p AS (SELECT * FROM o WHERE doc_id > 99 ORDER BY doc_id LIMIT 20)
SELECT 'all' AS page, NULL AS chunk_id, reason, outcome, count(*) AS n FROM o GROUP BY 3, 4 UNION ALL SELECT 'all', doc_id, reason, outcome, NULL FROM o WHERE outcome <> 'embedded' UNION ALL SELECT 'second', NULL, reason, outcome, count(*) FROM p GROUP BY 3, 4""")
def _(t):
    k = F.col("doc_id")
    own = F.sha2("text", 256)
    vector = F.array_repeat(F.lit(0.5).cast("float"), 32)
    chunks = t.documents.select(
        k.alias("chunk_id"), F.col("text").alias("content"), F.when(k % 11 == 0, "old").otherwise(own).alias("content_hash"), F.when(k % 9 != 0, vector).alias("embedding"),
        F.when(k % 5 == 0, "older").otherwise("hash").alias("embedding_model"), F.when(k % 7 == 0, "0").otherwise("1").alias("embedding_version"),
    )
    now = t.documents.select(k.alias("chunk_id"), F.when(k % 10 == 0, "changed").otherwise(F.col("text")).alias("content"), F.when(k % 11 == 0, "old").otherwise(own).alias("content_hash"))
    force = F.col("chunk_id") % 13 == 0
    _, bad, counts = doc.reembed_pages(chunks, now, doc.hashing_embedder(), "hash", "1", 32, force)
    _, _, second = doc.reembed_pages(chunks, now, doc.hashing_embedder(), "hash", "1", 32, force, 20, 99)
    none = F.lit(None).cast("long")
    row = lambda df, page: df.select(F.lit(page).alias("page"), none.alias("chunk_id"), "reason", "outcome", "n")
    return row(counts, "all").unionByName(bad.select(F.lit("all").alias("page"), "chunk_id", "reason", "outcome", none.alias("n"))).unionByName(row(second, "second"))


# ---- graph ----

_EDGES = """SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'IN' AS type FROM nation UNION SELECT 'c' || c_custkey, 'n' || c_nationkey, 'OF' FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey, 'OF' FROM supplier
 UNION SELECT 'p' || l_partkey, 's' || l_suppkey, 'SUPPLIED_BY' FROM lineitem"""


def _edge_rows(t: Tables):
    """Parts to suppliers, suppliers and customers to nations, nations to regions; an edge for each row."""
    e = lambda df, a, x, b, y, kind: df.select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"), F.lit(kind).alias("type"))
    parts = [e(t.nation, "n", "n_nationkey", "r", "n_regionkey", "IN"), e(t.customer, "c", "c_custkey", "n", "c_nationkey", "OF"), e(t.supplier, "s", "s_suppkey", "n", "s_nationkey", "OF"), e(t.lineitem, "p", "l_partkey", "s", "l_suppkey", "SUPPLIED_BY")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _edges(t: Tables):
    return _edge_rows(t).distinct()


def _two_hop(t: Tables):
    ed = _edge_rows(t)
    none = F.lit(None)
    return ed.select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.col("type").alias("edge_type"), none.cast("timestamp").alias("valid_from"), F.when(F.col("src") == "n3", F.lit("1990-01-01").cast("timestamp")).alias("valid_until"), F.when(F.substring("src", 1, 1) == "c", F.array(F.lit("admin"))).alias("allowed_roles"))


_HOP = """WITH e AS (SELECT * FROM ({edges}) WHERE src <> 'n3' AND src NOT LIKE 'c%'), q AS ({starts}),
 o AS (SELECT start, dst AS node, type, src, dst FROM q JOIN e ON start = src UNION ALL SELECT start, src, type, src, dst FROM q JOIN e ON start = dst),
 w AS (SELECT DISTINCT o.start, e.dst AS node, e.type, e.src, e.dst FROM o JOIN e ON o.node = e.src WHERE e.dst <> o.start),
 b AS (SELECT 1 AS depth, * FROM o UNION ALL SELECT 2, * FROM w)"""


@query("two_hop", _HOP.format(edges=_EDGES, starts="SELECT 's' || s_suppkey AS start FROM supplier UNION ALL SELECT 'n' || n_nationkey FROM nation") + " SELECT start, node, depth, type AS edge_type FROM (SELECT *, row_number() OVER (PARTITION BY start, node ORDER BY depth, type, src, dst) AS k FROM b) WHERE k = 1")
def _(t):
    starts = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("start")).union(t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey"))))
    return g.two_hop(_two_hop(t), starts, F.lit("2000-01-01").cast("timestamp"), "member", ends=False)


def _context_sql() -> str:
    """Suppliers that end in 4 and the nation 7 are hidden; every third query is a nation's name alone, which is canonical."""
    hop = _HOP.format(edges=_EDGES, starts="SELECT DISTINCT id AS start FROM h").replace("src NOT LIKE 'c%'", "src NOT LIKE 'c%' AND src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)", 1)
    return hop.replace("WITH e AS", """
WITH all_nodes AS (SELECT 'n' || n_nationkey AS id, n_name AS name, TIMESTAMP '1999-12-01' AS at FROM nation UNION ALL SELECT 's' || s_suppkey, s_name, TIMESTAMP '1999-11-11' FROM supplier),
 gone AS (SELECT id FROM all_nodes WHERE id LIKE 's%4' OR id = 'n7'), nodes AS (SELECT * FROM all_nodes WHERE id NOT IN (SELECT id FROM gone)),
 bq AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 's' || item_id % 10 ELSE 'what of nation_' || item_id % 25 || ' today' END AS q FROM benchmark),
 m AS (SELECT item_id AS query_id, id, 1 AS how FROM bq JOIN nodes ON contains(q, lower(name)) OR contains(lower(name), q) OR contains(q, id) UNION ALL SELECT item_id, id, 0 FROM bq JOIN nodes ON q = id),
 h AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY min(how), id) AS hit FROM m GROUP BY 1, 2 QUALIFY hit <= 3),
 e AS""", 1) + """,
 u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start, node ORDER BY depth, type, src, dst) AS k FROM b WHERE node <> start) WHERE k = 1),
 p AS (SELECT u.*, row_number() OVER (PARTITION BY start ORDER BY depth, node) AS place FROM u QUALIFY place <= 25),
 f AS (SELECT query_id, hit, place, start, type, coalesce(n.name, node) AS name, coalesce(exp(-ln(2.0) / 30 * date_diff('day', n.at, TIMESTAMP '2000-01-01')), 1.0) AS weight FROM h JOIN p ON h.id = p.start LEFT JOIN nodes n ON n.id = p.node),
 g AS (SELECT query_id, printf('(%s) -> [%s] -> (%s) (decayScore: %.2f)', start, type, name, weight) AS tuple, min((hit, place)) AS first, max(weight) AS weight FROM f GROUP BY 1, 2),
 r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY first, tuple))::INT AS tuple_rank, tuple, round(weight, 6) AS weight FROM g QUALIFY tuple_rank <= 25)
SELECT * FROM r UNION ALL SELECT query_id, 0, '[Knowledge Graph Context (Temporal Decay Filtered)]:' || chr(10) || string_agg('  - ' || tuple, chr(10) ORDER BY tuple_rank), NULL FROM r GROUP BY 1"""


@query("graph_context", _context_sql())
def _(t):
    """The tuples, and with rank 0 the text block of each query."""
    hidden = F.array(F.lit("admin"))
    nodes = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"), F.lit("1999-12-01").cast("timestamp").alias("created_at")).unionByName(
        t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"), F.lit("1999-11-11").cast("timestamp").alias("created_at"))
    )
    # Parts and regions are nodes without a name; their ids match no query.
    ends = _edge_rows(t).select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(sized(nodes.select("id")), "id", "left_anti")
    shown = nodes.withColumn("allowed_roles", F.when(F.col("id").like("s%4") | (F.col("id") == "n7"), hidden))
    k = F.col("item_id")
    text = F.when(k % 3 == 0, F.concat(F.lit("S"), k % 10)).otherwise(F.concat(F.lit("what of NATION_"), k % 25, F.lit(" today")))
    qs = t.benchmark.select(k.alias("query_id"), text.alias("query"))
    matched = g.graph_context(qs, shown.unionByName(ends.select("id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("array<string>").alias("allowed_roles"))), _two_hop(t), F.lit("2000-01-01").cast("timestamp"), "member")
    rows = cut(matched.withColumn("weight", F.round("weight", 6)))
    block = g.context_text(rows).select("query_id", F.lit(0).alias("tuple_rank"), F.col("text").alias("tuple"), F.lit(None).cast("double").alias("weight"))
    return rows.unionByName(block)


# Suppliers are merged along chains (2 to 1 to 0 of each ten) and in cycles (5 to 6 to 5, of which 5 stays).
_MERGED = "CASE WHEN {c} NOT LIKE 's%' THEN {c} WHEN substr({c}, 2)::INT % 10 IN (1, 2) THEN 's' || substr({c}, 2)::INT // 10 * 10 WHEN substr({c}, 2)::INT % 10 = 6 THEN 's' || (substr({c}, 2)::INT - 1) ELSE {c} END"


@query("merge_nodes", f"""
WITH m AS (SELECT src, dst, type FROM ({_EDGES})), f AS (SELECT {_MERGED.format(c="src")} AS source_id, {_MERGED.format(c="dst")} AS target_id, type AS edge_type, src, dst FROM m), n AS (SELECT 's' || s_suppkey AS id FROM supplier)
SELECT DISTINCT 'edge' AS kind, source_id, target_id, edge_type FROM f WHERE source_id <> target_id
UNION ALL SELECT 'node', id, NULL, NULL FROM n WHERE {_MERGED.format(c="id")} = id UNION ALL SELECT 'moved', count(*)::VARCHAR, NULL, NULL FROM f WHERE source_id <> src OR target_id <> dst""")
def _(t):
    """kind (edge, node, moved) and what is left, with the number of edges that moved."""
    e = unique(_edge_rows(t).select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.col("type").alias("edge_type")), "source_id", "target_id", "edge_type")
    k, name = F.col("s_suppkey"), lambda c: F.concat(F.lit("s"), c)
    m = t.supplier.select(name(k).alias("duplicate"), F.when((k % 10).isin(1, 2, 6), name(k - 1)).when(k % 10 == 5, name(k + 1)).alias("canonical")).filter("canonical is not null")
    out, none = g.merge_nodes(t.supplier.select(name(k).alias("id")), e, m), F.lit(None).cast("string")
    one = lambda kind, df, c: df.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("source_id"), none.alias("target_id"), none.alias("edge_type"))
    return out["edges"].select(F.lit("edge").alias("kind"), "source_id", "target_id", "edge_type").unionByName(one("node", out["nodes"], "id")).unionByName(one("moved", out["moved"], "moved"))


@query("connected_components", f"""
WITH RECURSIVE e AS (SELECT src, dst FROM ({_EDGES})), b AS (SELECT * FROM e UNION SELECT dst, src FROM e),
 r(id, c) AS (SELECT DISTINCT dst, dst FROM e WHERE dst LIKE 'r%' UNION SELECT b.dst, r.c FROM r JOIN b ON r.id = b.src)
SELECT DISTINCT id, min(id) OVER (PARTITION BY c) AS component FROM r""")
def _(t):
    return g.connected_components(_edge_rows(t))


@query("node_depth", f"""
WITH RECURSIVE e AS (SELECT src, dst FROM ({_EDGES})), r(id, d) AS (SELECT 'p' || p_partkey, 0 FROM part UNION SELECT dst, d + 1 FROM r JOIN e ON id = src)
SELECT id, min(d) AS depth FROM r GROUP BY 1""")
def _(t):
    return g.node_depth(_edges(t), t.part.select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id")))


@query("shortest_path", f"""
WITH RECURSIVE e AS (SELECT src, dst, substr(dst, 2)::BIGINT AS seq FROM ({_EDGES})), r(id, path, via) AS (SELECT 'p1', ['p1'], CAST([] AS BIGINT[]) UNION ALL SELECT dst, list_append(path, dst), list_append(via, seq) FROM r JOIN e ON id = src)
SELECT path FROM r WHERE id = 'r1' ORDER BY len(path), via LIMIT 1""")
def _(t):
    # Edges are ordered by the number of their target.
    e = _edges(t).withColumn("seq", F.substring("dst", 2, 12).cast("long"))
    return g.shortest_path(e, "p1", "r1")


@query("topological_order", f"""
WITH RECURSIVE e AS (SELECT src, dst FROM ({_EDGES})), r(id, d) AS (SELECT DISTINCT src, 0 FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT dst, d + 1 FROM r JOIN e ON id = src)
SELECT id, max(d) AS level FROM r GROUP BY 1""")
def _(t):
    return g.topological_order(_edges(t))


# A graph has a cycle where a vertex reaches itself; the second one also has an edge back from each region to a nation.
@query("is_acyclic", f"""
WITH RECURSIVE e AS (SELECT 'as is' AS graph, src, dst FROM ({_EDGES}) UNION SELECT 'with edges back', src, dst FROM ({_EDGES}) UNION SELECT 'with edges back', 'r' || n_regionkey, 'n' || min(n_nationkey) FROM nation GROUP BY n_regionkey),
 r(graph, a, b) AS (SELECT graph, src, dst FROM e UNION SELECT r.graph, a, dst FROM r JOIN e ON b = src AND r.graph = e.graph)
SELECT graph, NOT bool_or(a = b) AS acyclic FROM r GROUP BY 1""")
def _(t):
    e = _edge_rows(t).select("src", "dst")
    back = t.nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("n")).select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n").alias("dst"))
    named = lambda df, name: df.select(F.lit(name).alias("graph"), "acyclic")
    return named(g.is_acyclic(e), "as is").unionByName(named(g.is_acyclic(e.unionByName(back)), "with edges back"))


@query("entity_rollup", """
WITH m AS (SELECT l_suppkey % 5 AS workspace_id, CASE WHEN l_linenumber % 2 = 0 AND l_orderkey % 3 = 0 THEN 'Part ' ELSE 'part ' END || l_partkey % 40 AS name, l_returnflag AS type, epoch(l_shipdate)::BIGINT AS seen_at FROM lineitem)
SELECT workspace_id, 'part_' || regexp_extract(name, '[0-9]+') AS canonical_id, max(name) AS name, array_to_string(list_sort(list_distinct(list(name))), ',') AS aliases, count(*) AS times_seen, min(seen_at) AS first_seen, max(seen_at) AS last_seen, round(least(0.95, 0.7 + 0.05 * (count(*) - 1)), 6) AS confidence FROM m GROUP BY 1, 2""".replace("max(name)", "arg_max(name, (seen_at, name))"))
def _(t):
    m = t.lineitem.select((F.col("l_suppkey") % 5).alias("workspace_id"), F.concat(F.when((F.col("l_linenumber") % 2 == 0) & (F.col("l_orderkey") % 3 == 0), "Part ").otherwise("part "), F.col("l_partkey") % 40).alias("name"), F.col("l_returnflag").alias("type"), F.unix_timestamp("l_shipdate").alias("seen_at"))
    return g.entity_rollup(m).select("workspace_id", "canonical_id", "name", F.array_join("aliases", ",").alias("aliases"), "times_seen", "first_seen", "last_seen", F.round("confidence", 6).alias("confidence"))


_RELS = """SELECT l_suppkey % 5 AS workspace_id, 'part_' || l_partkey % 20 AS source_id, CASE WHEN l_suppkey % 7 = 0 THEN 'part_' || l_partkey % 20 ELSE 'supp_' || l_suppkey % 10 END AS target_id, CASE WHEN l_returnflag = 'A' THEN 'OWNS' ELSE 'LIKES' END AS type FROM lineitem"""


def _rels(t: Tables):
    r = t.lineitem.select((F.col("l_suppkey") % 5).alias("workspace_id"), F.concat(F.lit("Part "), F.col("l_partkey") % 20).alias("source"), F.when(F.col("l_suppkey") % 7 == 0, F.concat(F.lit("part_"), F.col("l_partkey") % 20)).otherwise(F.concat(F.lit("supp "), F.col("l_suppkey") % 10)).alias("target"), F.when(F.col("l_returnflag") == "A", "owns").otherwise("likes").alias("type"))
    return g.relationship_rollup(r)


@query("relationship_rollup", f"SELECT workspace_id, source_id, target_id, type, count(*) AS times_seen, round(least(0.95, 0.7 + 0.05 * (count(*) - 1)), 6) AS confidence, type = 'OWNS' AS projectable FROM ({_RELS}) WHERE source_id <> target_id GROUP BY 1, 2, 3, 4")
def _(t):
    return _rels(t).withColumn("confidence", F.round("confidence", 6))


@query("project_graph", f"""
WITH e AS (SELECT workspace_id || ':' || source_id AS source_id, workspace_id || ':' || target_id AS target_id, type AS edge_type, round(least(0.95, 0.7 + 0.05 * (count(*) - 1)), 6) AS confidence FROM ({_RELS}) WHERE source_id <> target_id AND type = 'OWNS' GROUP BY 1, 2, 3)
SELECT * FROM e UNION ALL SELECT source_id, NULL, NULL, NULL FROM (SELECT source_id FROM e UNION SELECT target_id FROM e)""")
def _(t):
    out, none = g.project_graph(_rels(t)), F.lit(None)
    nodes = out["nodes"].select(F.col("id").alias("source_id"), none.cast("string").alias("target_id"), none.cast("string").alias("edge_type"), none.cast("double").alias("confidence"))
    return out["edges"].withColumn("confidence", F.round("confidence", 6)).unionByName(nodes)


_COS = "round(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]))), 6)"
_COS_AB = _COS.format(a="a.embedding", b="b.embedding")


@query("entity_duplicates", f"""
WITH m AS (SELECT vec_id, label, list_reverse(embedding) AS embedding, 'E' || vec_id % 300 || CASE WHEN vec_id % 300 = 200 THEN 'x' ELSE '' END AS name FROM embeddings WHERE vec_id % 100 = 0), r AS (SELECT vec_id AS entity_id, label, embedding, 'e' || vec_id AS name FROM embeddings),
 x AS (SELECT vec_id AS mention_id, min(entity_id) AS entity_id, 1.0 AS similarity FROM m JOIN r ON lower(m.name) = r.name GROUP BY 1),
 n AS (SELECT a.vec_id AS mention_id, b.entity_id, {_COS_AB} AS similarity FROM m a JOIN r b ON a.label = b.label WHERE a.vec_id NOT IN (SELECT mention_id FROM x)),
 k AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY similarity DESC, entity_id) AS rn FROM n WHERE similarity >= 0.2)
SELECT mention_id, entity_id, similarity, similarity >= 0.3 AS accepted FROM (SELECT * FROM x UNION ALL SELECT mention_id, entity_id, similarity FROM k WHERE rn = 1)""")
def _(t):
    e = t.embeddings.select("vec_id", F.col("label").alias("type"), F.lit("w").alias("workspace_id"), "embedding")
    m = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("mention_id"), F.concat(F.lit("E"), F.col("vec_id") % 300, F.when(F.col("vec_id") % 300 == 200, "x").otherwise("")).alias("name"), "type", "workspace_id", F.reverse("embedding").alias("embedding"))
    r = e.select(F.col("vec_id").alias("entity_id"), F.concat(F.lit("e"), F.col("vec_id")).alias("name"), "type", "workspace_id", "embedding")
    return g.entity_duplicates(m, r, 0.2, 0.3)


@query("best_entity_match", f"""
WITH n AS (SELECT a.vec_id AS mention_id, b.vec_id AS entity_id, {_COS_AB} AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT mention_id, entity_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY similarity DESC, entity_id) AS k FROM n) WHERE k = 1""")
def _(t):
    e = t.embeddings.select("vec_id", "label", "embedding")
    return g.best_entity_match(g.block_matches(e.withColumnRenamed("vec_id", "mention_id"), e.withColumnRenamed("vec_id", "entity_id"), "label"))


# ---- retrieval ----


def _vector(t: Tables, k: int) -> list[float]:
    """The embedding of row k: the query vector, one row."""
    return [float(x) for x in t.embeddings.filter(F.col("vec_id") == k).select("embedding").first()[0]]


def _items(t: Tables):
    """Documents with an embedding; what is searched is the whole text."""
    d = t.documents.select(F.col("doc_id").alias("id"), F.concat_ws(" ", F.lit("from the"), "source").alias("title"), F.col("text").alias("trigger_condition"), F.col("lang").alias("category"))
    return d.join(t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label"), "id")


@query("vector_topk", f"SELECT a.vec_id AS id, {_COS_AB} AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = 7 WHERE {_COS_AB} > 0.1 ORDER BY similarity DESC, id LIMIT 20")
def _(t):
    return ret.vector_topk(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), _vector(t, 7), 20, 0.1)


@query("similar_sops", f"SELECT a.vec_id AS id, {_COS_AB} AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = 7 WHERE (a.label = 1 OR a.vec_id % 9 = 0) AND {_COS_AB} >= 0.1 ORDER BY similarity DESC, id LIMIT 5")
def _(t):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), "embedding", F.when(F.col("vec_id") % 9 != 0, F.col("label")).alias("workspace_id"))
    return ret.similar_sops(rows, _vector(t, 7), 1, threshold=0.1)


@query("dense_leg", f"SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id)::INT AS rank FROM (SELECT a.vec_id AS id, {_COS_AB} AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = 11 WHERE {_COS_AB} > 0.05 ORDER BY similarity DESC, id LIMIT 30)")
def _(t):
    return ret.dense_leg(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), _vector(t, 11), 10)


@query("sparse_leg", "SELECT id, row_number() OVER (ORDER BY id)::INT AS rank FROM (SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'of the') AND (lang <> 'de') ORDER BY doc_id LIMIT 25)")
def _(t):
    rows = t.documents.select(F.col("doc_id").alias("id"), "text", F.when(F.col("lang") == "de", F.array(F.lit("admin"))).alias("roles"))
    return ret.sparse_leg(rows, "OF the", 25, ["text"], role="member", roles="roles")


_HYBRID = f"""
WITH i AS (SELECT doc_id AS id, 'from the ' || source AS title, text AS trg, lang, embedding FROM documents JOIN embeddings ON vec_id = doc_id),
 v AS (SELECT embedding FROM embeddings WHERE vec_id = 3),
 dl AS (SELECT a.id, {_COS_AB} AS s FROM i a, v b WHERE {_COS_AB} > 0.05 ORDER BY s DESC, id LIMIT 30), d AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM dl),
 sl AS (SELECT id FROM i WHERE contains(lower(title), 'the') OR contains(lower(trg), 'the') OR contains(lower(lang), 'the') ORDER BY id LIMIT 10), s AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM sl),
 f AS (SELECT coalesce(d.id, s.id) AS id, d.r AS dr, s.r AS sr, coalesce(1 / (60 + d.r), 0) + coalesce(1 / (60 + s.r), 0) AS score FROM d FULL JOIN s ON d.id = s.id),
 o AS (SELECT f.*, i.title, i.trg, i.lang, row_number() OVER (ORDER BY score DESC, dr NULLS LAST, sr NULLS LAST, f.id) AS k, count(*) OVER () AS n FROM f JOIN i ON f.id = i.id)
SELECT id, round(CASE WHEN contains(lower(title), 'the') THEN 8.0 ELSE 0 END + CASE WHEN contains(lower(trg), 'the') THEN 2.0 ELSE 0 END + CASE WHEN contains(lower(lang), 'the') THEN 1.5 ELSE 0 END + (n - k + 1) * 0.01, 6) AS relevance
FROM o ORDER BY relevance DESC, id LIMIT 10"""


@query("hybrid_search", _HYBRID)
def _(t):
    return ret.hybrid_search(_items(t), _vector(t, 3), "the", 10).select("id", "relevance")


@query("rerank", """
WITH f AS (SELECT doc_id AS id, text AS title, lang, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k FROM documents QUALIFY k <= 100)
SELECT id, round(CASE WHEN contains(lower(title), 'the') THEN 3.0 ELSE 0 END + CASE WHEN contains(lower(title), 'and') THEN 3.0 ELSE 0 END + CASE WHEN contains(lower(title), 'the and') THEN 5.0 ELSE 0 END + (101 - k) * 0.01, 6) AS relevance FROM f ORDER BY relevance DESC, id LIMIT 20""")
def _(t):
    d = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("title"), F.lit(None).cast("string").alias("trigger_condition"), F.col("lang").alias("category"), F.col("n_chars").alias("score"))
    top = d.orderBy(F.desc("score"), "id").limit(100)
    return ret.rerank(top, "the and", 20, order=[F.desc("score"), F.asc("id")]).select("id", "relevance")


@query("name_match", """
WITH q AS (SELECT item_id AS query_id, lower('about the ' || ['ring', 'bolt', 'red widget', 'gear', 'zzz'][(item_id % 5)::INT + 1]) AS q FROM benchmark)
SELECT query_id, p_partkey::VARCHAR AS node_id FROM q JOIN part ON contains(q, lower(split_part(p_name, ' ', 1 + (p_partkey % 2)::INT))) WHERE split_part(p_name, ' ', 1 + (p_partkey % 2)::INT) <> ''""")
def _(t):
    word = F.element_at(F.array(*map(F.lit, ["ring", "bolt", "red widget", "gear", "zzz"])), (F.col("item_id") % 5 + 1).cast("int"))
    qs = t.benchmark.select(F.col("item_id").alias("query_id"), F.concat(F.lit("About the "), word).alias("query"))
    nodes = t.part.select(F.col("p_partkey").cast("string").alias("id"), F.coalesce(F.get(F.split("p_name", " "), (F.col("p_partkey") % 2).cast("int")), F.lit("")).alias("name"))
    return ret.name_match(qs, nodes)


@query("conflict_candidates", f"""
WITH q AS (SELECT vec_id AS query_id, label, embedding FROM embeddings WHERE vec_id % 100 = 0), n AS (SELECT q.query_id, a.vec_id AS id, {_COS.format(a="a.embedding", b="q.embedding")} AS s FROM q JOIN embeddings a ON a.vec_id <> q.query_id),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM n WHERE s > 0.5), v AS (SELECT query_id, id, 'vector' AS origin FROM k WHERE r <= 5),
 w AS (SELECT q.query_id, a.vec_id AS id, row_number() OVER (PARTITION BY q.query_id ORDER BY a.vec_id DESC) AS r FROM q JOIN embeddings a ON q.label = a.label AND a.vec_id <> q.query_id)
SELECT * FROM v UNION ALL SELECT query_id, id, 'newest' FROM w WHERE r <= 5 AND query_id NOT IN (SELECT query_id FROM v)""")
def _(t):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("workspace_id"), F.col("vec_id").alias("created_at"), "embedding")
    qs = t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("workspace_id"), "embedding")
    return ret.conflict_candidates(rows, qs, 0.5)


# ---- streams: batch twins ----


@query("stream_dedupe", "SELECT user_id || '-' || event_type || '-' || event_id % 20 AS dedupe_key, min(event_id) AS event_id FROM events GROUP BY 1")
def _(t):
    e = t.events.select(F.concat_ws("-", "user_id", "event_type", F.col("event_id") % 20).alias("dedupe_key"), "event_id")
    return st.first_deliveries(e, "dedupe_key", "event_id")


@query("stream_high_water", """
SELECT event_id FROM (SELECT event_id, t, max(t) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT *, ts - INTERVAL 1 HOUR * (event_id * 7 % 100) AS t FROM events)) WHERE m IS NULL OR t > m""")
def _(t):
    e = t.events.select("event_id", "user_id", "event_type", (F.col("ts") - F.make_interval(hours=(F.col("event_id") * 7 % 100).cast("int"))).alias("at"))
    return st.high_water(e, ["user_id", "event_type"], "at", "event_id").select("event_id")


@query("stream_lease", """
WITH RECURSIVE o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
 r(user_id, k, event_id, decision, until) AS (SELECT user_id, 1::BIGINT, event_id, 'acquired', ts + INTERVAL 6 HOUR FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.k, o.event_id, CASE WHEN o.ts >= r.until THEN 'reacquired' ELSE 'replay' END, CASE WHEN o.ts >= r.until THEN o.ts + INTERVAL 6 HOUR ELSE r.until END FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT user_id, event_id, decision FROM r""")
def _(t):
    return st.lease_decisions(t.events, "user_id", "ts", "event_id", 6 * 3600)


@query("stream_status", "SELECT user_id, arg_max(event_type, event_id) AS status, arg_max(event_type, event_id) IN ('received', 'queued') AS claimable FROM events GROUP BY 1")
def _(t):
    return st.latest_status(t.events, "user_id", "event_type", "event_id")


@query("stream_rate_quota", "SELECT event_id, row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL 1 HOUR, ts) ORDER BY event_id) > 3 AS over_limit FROM events")
def _(t):
    return st.rate_quota(t.events, "event_type", "ts", "event_id", 3, "1 hour").select("event_id", "over_limit")


@query("lease_ledger", """
WITH RECURSIVE o AS (SELECT event_id, user_id, ts, ['acquire', 'acquire', 'acquire', 'complete', 'fail', 'release'][(event_id % 6)::INT + 1] AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
 r(user_id, k, event_id, decision, status, until) AS (SELECT user_id, k, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::TIMESTAMP FROM (SELECT DISTINCT user_id, 0::BIGINT AS k FROM o)
  UNION ALL SELECT user_id, k, event_id, CASE WHEN kind = 'acquire' THEN CASE WHEN was IS NULL THEN 'acquired' WHEN was = 'pending' AND ts >= until THEN 'reacquired' ELSE 'replay' END WHEN was IS NULL THEN 'unknown' ELSE final END,
    CASE WHEN kind = 'acquire' THEN coalesce(was, 'pending') WHEN was IS NULL THEN NULL ELSE state END,
    CASE WHEN kind = 'acquire' AND (was IS NULL OR was = 'pending' AND ts >= until) OR kind = 'release' AND was IS NOT NULL THEN ts + INTERVAL 6 HOUR ELSE until END
   FROM (SELECT o.user_id, o.k, o.event_id, o.ts, o.kind, r.status AS was, r.until, CASE o.kind WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' ELSE 'released' END AS final, CASE o.kind WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' ELSE 'pending' END AS state FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1))
SELECT user_id, event_id, decision FROM r WHERE event_id IS NOT NULL""")
def _(t):
    kind = F.element_at(F.array(*map(F.lit, ["acquire", "acquire", "acquire", "complete", "fail", "release"])), (F.col("event_id") % 6 + 1).cast("int"))
    return st.lease_decisions(t.events.withColumn("kind", kind), "user_id", "ts", "event_id", 6 * 3600, "kind")


@query("stream_incremental_sync", "SELECT event_type, 2 - event_id % 2 AS run, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1, 2")
def _(t):
    """Events land in two parts in the shared folder; a run after each takes what is new."""
    base = scratch(t.spark, "sync")
    for run in (1, 2):
        t.events.filter(F.col("event_id") % 2 == 2 - run).write.mode("append").parquet(f"{base}/in")
        st.incremental_sync(t.spark, f"{base}/in", t.events.schema, f"{base}/cursor", lambda df, _, run=run: df.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{base}/out"))
    return t.spark.read.parquet(f"{base}/out").groupBy("event_type", F.col("run").cast("long").alias("run")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
