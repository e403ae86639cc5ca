"""Operators on hand-made tables: graphs, chunks, ledgers, gates."""

import random

import pytest
from pyspark.sql import functions as F

from corpusspark.operators import documents as doc
from corpusspark.operators import graph as g
from corpusspark.operators import relational as rel
from corpusspark.sources import ingest


def edges(spark, text):
    return spark.createDataFrame([(e[0], e[1], k) for k, e in enumerate(text.split())], "src string, dst string, seq long")


def pairs(df):
    return {r[0]: r[1] for r in df.collect()}


def test_components(spark):
    assert pairs(g.connected_components(edges(spark, "AB CB DE"), spark.createDataFrame([("F",)], "id string"))) == {"A": "A", "B": "A", "C": "A", "D": "D", "E": "D", "F": "F"}


def test_long_chain(spark):
    rows = [(k, k + 1) for k in range(40)]
    random.Random(1).shuffle(rows)
    assert set(pairs(g.connected_components(spark.createDataFrame(rows, "src long, dst long"))).values()) == {0}


def test_order_and_cycle(spark):
    assert pairs(g.topological_order(edges(spark, "AB BC AC AB"))) == {"A": 0, "B": 1, "C": 2}
    with pytest.raises(ValueError):
        g.topological_order(edges(spark, "AB BC CA"))
    assert g.is_acyclic(edges(spark, "AB BC CA")).first()[0] is False
    assert g.is_acyclic(edges(spark, "AB BC")).first()[0] is True


def test_paths_and_depth(spark):
    e = edges(spark, "AB AC BD CD DE")
    path = lambda a, b: g.shortest_path(e, a, b).first()[0]
    assert path("A", "D") == ["A", "B", "D"]
    assert path("A", "A") == ["A"]
    assert path("E", "A") == []
    assert pairs(g.node_depth(e, spark.createDataFrame([("A",)], "id string"))) == {"A": 0, "B": 1, "C": 1, "D": 2, "E": 3}


def test_two_hop_hides_what_a_role_may_not_see(spark):
    kind = "source_id string, target_id string, edge_type string, valid_from timestamp, valid_until timestamp, allowed_roles array<string>"
    e = spark.createDataFrame([("a", "b", "X", None, None, None), ("b", "c", "X", None, None, ["admin"]), ("d", "a", "X", None, None, None)], kind)
    starts, at = spark.createDataFrame([("a",)], "start string"), F.lit("2024-01-01").cast("timestamp")
    see = lambda role: {(r.node, r.depth) for r in g.two_hop(e, starts, at, role).collect()}
    assert see("member") == {("b", 1), ("d", 1)}
    assert see("admin") == {("b", 1), ("d", 1), ("c", 2)}


@pytest.mark.parametrize("seed", range(30))
def test_chunks_cover_the_text(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["word ", "x. ", "\n\n", "long" * r.randint(1, 40)]) for _ in range(r.randint(1, 900)))
    most, overlap = doc.chunk_limits(r.choice([None, 500, 800]), r.choice([None, 0, 100]))
    chunks = doc.chunk_text(text, most, overlap)
    clean = text.strip(doc._TRIM)
    assert [c[0] for c in chunks] == list(range(len(chunks)))
    covered = set()
    for _, content, a, b in chunks:
        assert content == clean[a:b].strip(doc._TRIM)
        assert b - a <= most + 1
        covered |= set(range(a, b))
    assert not chunks or covered == set(range(len(clean))) or all(not clean[k].strip() for k in set(range(len(clean))) - covered)


def test_break_at_a_paragraph():
    text = "a" * 300 + "\n\n" + "b" * 600
    assert doc.chunk_text(text, 500, 100)[0] == (0, "a" * 300, 0, 300)


def test_upsert_is_idempotent(spark):
    cur = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, seq int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 1), (1, "old", 0)], "k int, v string, seq int")
    once = ingest.upsert_by_key(cur, new, ["k"], "seq")
    twice = ingest.upsert_by_key(once, new, ["k"], "seq")
    assert sorted(once.collect()) == sorted(twice.collect()) == [(1, "a", 1), (2, "c", 2), (3, "d", 1)]


def test_no_tenant_no_rows(spark):
    rows = spark.createDataFrame([("a",), (None,)], "w string")
    assert rel.tenant_scope(rows, "w", None, (None,)).count() == 0
    assert rel.tenant_scope(rows, "w", "a", (None,)).count() == 2


def test_gate(spark):
    ap = spark.createDataFrame([(1, "s", "approved", None), (2, "s", "approved", "x"), (3, "s", "pending", None), (4, "other", "approved", None)], "id int, sop_id string, status string, consumed_at string")
    calls = spark.createDataFrame([(k, "s", "High", False, "low_trust") for k in (1, 2, 3, 4, 9)] + [(9, "s", "Low", None, "low_trust"), (9, "s", "High", True, "admin")], "approval_id int, sop_id string, risk_level string, human_gate boolean, trust_role string")
    got = {(r.approval_id, r.risk_level, r.trust_role): (r.gated, r.approval_status) for r in rel.execution_gate(calls, ap).collect()}
    assert got[1, "High", "low_trust"] == (False, None)
    assert got[2, "High", "low_trust"] == (True, "already_consumed")
    assert got[3, "High", "low_trust"] == (True, "pending")
    assert got[4, "High", "low_trust"][0] is True
    assert got[9, "High", "low_trust"] == (True, "unrequested")
    assert got[9, "Low", "low_trust"][0] is False and got[9, "High", "admin"][0] is False


def test_one_bad_claim_rejects_the_response(spark):
    good = '{"claim_text":"a claim that is long","confidence":0.5,"char_start":0,"char_end":5}'
    rows = spark.createDataFrame([(1, f'{{"claims":[{good}]}}', "x" * 20), (2, f'{{"claims":[{good},{good.replace("5}", "50}")}]}}', "x" * 20), (3, "nonsense", "x")], "id int, r string, c string")
    got = {r.id: r.claims for r in rel.claim_validate(rows, "r", "c").collect()}
    assert got[1][0].claim_type == "operational"
    assert got[2] is None and got[3] is None


def test_failed_embedding_leaves_no_chunks(spark):
    rows = spark.createDataFrame([("w", "s", "1", "good text", ["member"]), ("w", "s", "2", "bad text", None)], "workspace_id string, source string, external_id string, text string, roles array<string>")
    stored = spark.createDataFrame([], "workspace_id string, source string, external_id string, content_hash string, extraction_stage string")
    base = doc.hashing_embedder(8)
    out = doc.persist_corpus(rows, stored, lambda ts: [None if "bad" in t else v for t, v in zip(ts, base(ts), strict=True)])
    assert {r.external_id: r.extraction_stage for r in out["documents"].collect()} == {"1": "completed", "2": "failed"}
    assert out["chunks"].select("doc_id").distinct().count() == 1
    assert out["acl"].count() == 1


def test_rejects_say_why(spark):
    rows = spark.createDataFrame([(1, "slack", None, "{}"), (2, "fax", None, '{"workspace_id":"w"}'), (3, "slack", None, '{"workspace_id":"w","external_thread_id":"t","messages":[]}'), (4, "slack", None, '{"workspace_id":"w","external_thread_id":"t","messages":[{"text":"x"}]}')], "id int, provider string, received_at timestamp, payload string")
    good, bad = ingest.normalize_threads(rows)
    assert [(r.external_thread_id, r.messages[0].user) for r in good.collect()] == [("t", "Unknown")]
    assert {r.id: r.reason for r in bad.collect()} == {1: "no_workspace", 2: "unknown_provider", 3: "no_messages"}


@pytest.mark.parametrize(("path", "want"), [("README.md", True), ("a/README", True), ("src/x.py", True), ("node_modules/x.js", False), ("yarn.lock", False), ("x.png", False), ("", False), (".env", False), ("public/vendor/a.js", False), ("public/a.js", True), ("Dockerfile", True)])
def test_paths(spark, path, want):
    assert spark.range(1).select(ingest.indexable_path(F.lit(path))).first()[0] is want


def test_shortest_path_has_no_bound(spark):
    chain = spark.createDataFrame([(k, k + 1, k) for k in range(66)], "src long, dst long, seq long").coalesce(1).cache()
    assert chain.count() == 66
    assert g.shortest_path(chain, 0, 66).first()[0] == list(range(67))


def test_chunks_of_a_long_text_without_breaks():
    import time

    began = time.time()
    chunks = doc.chunk_text("a" * 4_000_000, 3000, 250)
    assert time.time() - began < 3 and chunks[-1][3] == 4_000_000 and all(c[3] - c[2] <= 3000 for c in chunks)


@pytest.mark.parametrize("block", [1, 3, 2000])
def test_search_in_blocks(spark, monkeypatch, block):
    from corpusspark.operators import retrieval as ret

    monkeypatch.setattr(ret, "query_blocks", lambda q, most=block, f=ret.query_blocks: f(q, block))
    r = random.Random(2)
    vectors = [[r.gauss(0, 1) for _ in range(5)] for _ in range(40)] + [[0.0] * 5, [1.0, 2.0], None, []]
    rows = spark.createDataFrame(list(enumerate(vectors)), "id long, embedding array<float>")
    asked = rows.filter("id % 4 = 0").withColumnRenamed("id", "query_id")

    def cosine(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0

    got = {(x.query_id, x["rank"]): (x.id, round(x.similarity, 4)) for x in ret.vector_topk_many(rows, asked, 3, 0.1, others=True).collect()}
    want = {}
    for q in range(0, len(vectors), 4):
        near = [(-cosine(vectors[q], v), i) for i, v in enumerate(vectors) if vectors[q] and v and i != q and len(v) == len(vectors[q])]
        for k, (s, i) in enumerate(sorted((s, i) for s, i in near if -s > 0.1)[:3], 1):
            want[q, k] = i
    assert {k: v[0] for k, v in got.items()} == want
    names = spark.createDataFrame([("n1", "alpha"), ("n2", "beta"), ("n3", "")], "id string, name string")
    texts = spark.createDataFrame([(1, "what of ALPHA"), (2, "bet"), (3, ""), (4, "see n3"), (5, None)], "query_id int, query string")
    assert {tuple(x) for x in ret.name_match(texts, names).collect()} == {(1, "n1"), (2, "n2"), (4, "n3")}
    assert ret.name_match(texts.limit(0), names).count() == 0 and ret.vector_topk_many(rows, asked.limit(0), 3).count() == 0


def test_lease_goes_on_across_batches(spark):
    from corpusspark.streaming.streams import lease_decisions

    ops = [("a", 1, 0, "complete"), ("a", 2, 0, "acquire"), ("a", 3, 5, "acquire"), ("a", 4, 11, "acquire"), ("a", 5, 12, "complete"), ("a", 6, 99, "acquire"), ("a", 7, 100, "release"), ("a", 8, 105, "acquire"), ("a", 9, 110, "acquire"), ("a", 10, 111, "fail"), ("a", 11, 999, "acquire"), ("b", 12, 0, "acquire")]
    rows = spark.createDataFrame(ops, "k string, o long, s long, what string").withColumn("t", F.timestamp_seconds("s"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        got = [r.decision for r in lease_decisions(rows, "k", "t", "o", 10, "what").orderBy("o").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == ["unknown", "acquired", "replay", "reacquired", "completed", "replay", "released", "replay", "reacquired", "failed", "replay", "acquired"]


def test_a_run_left_in_the_middle_goes_on(spark):
    kind = "workspace_id string, repository string, kind string, status string, updated_at timestamp, phase string, completed_phases array<string>"
    import datetime as d

    at = d.datetime(2024, 1, 1)
    state = rel.sync_state(spark.createDataFrame([("w", "a", "incremental", "running", at, "issues", ["tree"])], kind), spark.createDataFrame([("w", "b", "incremental", "completed", at, "issues", ["tree"]), ("w", "a", "initial", "running", at, "tree", [])], kind))
    asked = spark.createDataFrame([("w", "a", True), ("w", "b", True), ("w", "c", True), ("w", "a", False)], "workspace_id string, repository string, incremental boolean")
    got = {(r.repository, r.since, r.phase, tuple(r.completed_phases)) for r in rel.sync_since(state, asked, F.lit("2024-02-01").cast("timestamp")).collect()}
    assert got == {("a", at, "issues", ("tree",)), ("b", at, None, ()), ("c", d.datetime(2024, 1, 31), None, ()), ("a", None, "tree", ())}
