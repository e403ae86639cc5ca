"""Steps that are cut for large tables give what plain ones give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusspark.operators import graph as g
from corpusspark.operators import lineage
from corpusspark.plans import QUERIES


def test_two_hop_by_lists_and_numbers(spark, monkeypatch):
    """Edge types by comparison or by join, edges sought near the starts or not: the same rows."""
    rows = [(f"v{a}", f"v{b}", "XYZ"[(a + b) % 3]) for a in range(12) for b in range(12) if (a * 7 + b * 5) % 4 == 0]
    e = spark.createDataFrame(rows, "source_id string, target_id string, edge_type string")
    e = e.select("*", *[F.lit(None).cast("timestamp").alias(c) for c in ("valid_from", "valid_until")], F.lit(None).cast("array<string>").alias("allowed_roles"))
    starts = spark.createDataFrame([("v1",), ("v5",)], "start string")
    at = F.lit("2024-01-01").cast("timestamp")
    see = lambda: sorted(map(tuple, g.two_hop(e, starts, at, ends=False).collect()))
    want = sorted((r.start, r.node, r.depth, r.edge_type) for r in g.two_hop(e, starts, at).collect())
    assert want and see() == want
    monkeypatch.setattr(g, "FEW_TYPES", 1)
    monkeypatch.setattr(g, "FEW_STARTS", 0)
    monkeypatch.setattr(g, "MEET", 2)
    assert see() == want


def _hops(rows, starts):
    """(start, node) -> least (depth, type, source, target), nulls first."""
    want = {}
    for s in starts:
        one = [(b if a == s else a, (1, t, a, b)) for a, b, t in rows if s in (a, b)]
        two = [(b, (2, t, a, b)) for v in {n for n, _ in one if n != s} for a, b, t in rows if a == v]
        for n, x in one + two:
            if n != s:
                want[s, n] = min(want.get((s, n), x), x, key=lambda x: (x[0], x[1] is not None, x[1] or "", x[2], x[3]))
    return want


def _edges_of(spark, rows, kind="string"):
    e = spark.createDataFrame(rows, f"source_id {kind}, target_id {kind}, edge_type string")
    return e.select("*", *[F.lit(None).cast("timestamp").alias(c) for c in ("valid_from", "valid_until")], F.lit(None).cast("array<string>").alias("allowed_roles"))


def test_two_hop_shuffles_nothing_it_reaches(spark, monkeypatch):
    """Products are reduced where they arise; numbers as ids, loops, equal edges, and types and ends that are null."""
    rows = [(a, 100 + b, "XY"[b % 2] if (a + b) % 5 else None) for a in range(30) for b in range(20) if (a * 7 + b * 3) % 4]
    rows += rows[:50] + [(100, 100, "X"), (101, 3, "X"), (3, 101, "W"), (102, 103, None), (None, 104, "X"), (104, None, "X")]
    starts = [*range(100, 120), 3]
    monkeypatch.setattr(g, "FEW_STARTS", 0)
    out = g.two_hop(_edges_of(spark, rows, "int"), spark.createDataFrame([(s,) for s in starts], "start int"), F.lit("2024-01-01").cast("timestamp"))
    got = [((r.start, r.node), (r.depth, r.edge_type, r.source_id, r.target_id)) for r in out.collect()]
    assert len(got) == len(dict(got)) and dict(got) == _hops([x for x in rows if None not in x[:2]], starts)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("FlatMapGroupsInArrow")] and "hashpartitioning(start" not in plan


def test_two_hop_goes_on_with_a_start(monkeypatch):
    """A start whose products are more than are reduced at once gives the same rows."""
    import pyarrow as pa

    via = [f"v{k}" for k in range(12)]
    others = [[f"s{j}" for j in range(9) if (j + k) % 4] + ([f"v{k - 1}"] if k else []) for k in range(12)]
    types = [[(j * k) % 3 for j, _ in enumerate(o)] for k, o in enumerate(others)]
    codes = [[7 if x in ("s1", "s2", "s5") else 6 for x in o] for o in others]
    batch = pa.RecordBatch.from_pydict({"to": [0] * 12, "part": [0] * 12, "via": via, "others": others, "types": types, "codes": codes})
    see = lambda: [tuple(r.values()) for b in g._reach(iter([batch])) for r in b.to_pylist()]
    rows = [(v, x, t) for v, o, k in zip(via, others, types, strict=True) for x, t in zip(o, k, strict=True)]
    want = {k: x for k, x in _hops([(a, b, str(t)) for a, b, t in rows], ["s1", "s2", "s5"]).items()}
    for most in (2_000_000, 20, 1):
        monkeypatch.setattr(g, "PRODUCTS", most)
        got = see()
        assert len(got) == len(want) and {(s, n): (d, str(t), a, b) for s, n, d, t, a, b in got} == want


@pytest.mark.parametrize("name", ["procedure_ast", "procedure_errors", "tabular_to_markdown"])
def test_small_files_fill_all_cores(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_best_match_in_blocks(spark, monkeypatch):
    """Not with itself, by group, the smallest id of equal ones; bad vectors have 0."""
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [2.0, 0.0]), (2, 1, [3.0, 0.0]), (3, 1, [0.0, 0.0]), (4, 2, [1.0, 1.0]), (5, 2, None), (6, 2, [-1.0, -1.0]), (7, 3, [1.0]), (8, None, [1.0]), (9, None, [1.0])]
    e = spark.createDataFrame(rows, "id int, label int, embedding array<float>")
    want = {(0, 1, 1.0), (1, 0, 1.0), (2, 0, 1.0), (3, 0, 0.0), (4, 5, 0.0), (5, 4, 0.0), (6, 5, 0.0)}
    for cell in (2000, 1):
        monkeypatch.setattr(g, "CELL", cell)
        found = g.block_matches(e.withColumnRenamed("id", "mention_id"), e.withColumnRenamed("id", "entity_id"), "label")
        assert {(r.mention_id, r.entity_id, abs(r.similarity)) for r in g.best_entity_match(found).collect()} == want


def test_best_match_of_every_row(spark):
    """Each vector with another one of its label has its match, not only some."""
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "label").collect()
    many = {}
    for r in rows:
        many[r.label] = many.get(r.label, 0) + 1
    got = QUERIES["best_entity_match"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.mention_id for r in got) == sorted(r.vec_id for r in rows if r.label is not None and many[r.label] > 1)
    assert len(got) > len(rows) // 2


def test_best_match_in_cells_that_grow(spark, monkeypatch):
    """Cells by the number of pairs, and their scores by pieces, give what all pairs give."""
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(90, 4)), 1).astype(np.float32)
    x[40:50] = x[:10]
    size = lambda k: 0 if k % 17 == 3 else 2 if k % 13 == 5 else 4
    e = spark.createDataFrame([(k, k % 3, x[k, : size(k)].tolist()) for k in range(90)], "id int, label int, embedding array<float>")
    unit = lambda k: x[k, : size(k)].astype(float) / (np.linalg.norm(x[k, : size(k)].astype(float)) or 1)
    cosine = lambda a, b: round(float(unit(a) @ unit(b)), 6) if size(a) == size(b) > 0 else 0.0
    want = {a: max((b for b in range(90) if b != a and b % 3 == a % 3), key=lambda b: (cosine(a, b), -b)) for a in range(90)}
    monkeypatch.setattr(g, "CELL", 1)
    for tasks, numbers, scores in ((1, 4_000_000, 1_000_000), (20, 4_000_000, 70), (1, 12, 1)):
        monkeypatch.setattr(g, "PAIR_TASKS", tasks)
        monkeypatch.setattr(g, "CELL_NUMBERS", numbers)
        monkeypatch.setattr(g, "SCORES", scores)
        found = g.block_matches(e.withColumnRenamed("id", "mention_id"), e.withColumnRenamed("id", "entity_id"), "label")
        got = {m.mention_id: (m.entity_id, m.similarity) for m in g.best_entity_match(found).collect()}
        assert got == {a: (b, cosine(a, b)) for a, b in want.items()}


def test_rejected_triples_need_no_names(spark):
    rows = [(" ", "System", "owns", "b", "Role"), ("A b", "System", "owns", "c", "Role"), ("a B", "System", "OWNS ", "c", "Role"), ("a", "Thing", "owns", "c", "Role"), ("a", "System", "likes", None, "Role")]
    out = g.persist_triples(spark.createDataFrame(rows, "subject string, subject_type string, predicate string, object string, object_type string"))
    bad = out["rejected"].groupBy("reason").count()
    assert {tuple(r) for r in bad.collect()} == {("bad_subject_type", 1), ("bad_predicate", 1)}
    assert "lower" not in bad._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in out["edges"].collect()} == {("unnamed_entity", "b", "OWNS"), ("a_b", "c", "OWNS")}


def test_acyclic_with_null_ends(spark):
    acyclic = lambda rows: g.is_acyclic(spark.createDataFrame(rows, "src string, dst string")).first()[0]
    assert acyclic([(None, "a"), ("a", "b"), ("b", None)])
    assert not acyclic([(None, "a"), ("a", "b"), ("b", "a"), ("b", "c")])


def test_components_by_hash_or_by_name(spark, monkeypatch):
    edges = spark.createDataFrame([("d", "c"), ("c", "b"), ("x", "y"), ("z", "z"), ("y", None)], "src string, dst string")
    want = {("b", "b"), ("c", "b"), ("d", "b"), ("x", "x"), ("y", "x"), ("z", "z"), (None, None)}
    see = lambda: {tuple(r) for r in g.connected_components(edges).collect()}
    plan = []
    contract = g._contract
    monkeypatch.setattr(g, "_contract", lambda e: plan.append(dict(e.dtypes)["src"]) or contract(e))
    assert see() == want and plan == ["bigint"]
    monkeypatch.setattr(g, "HEAVY", 2)
    monkeypatch.setattr(g, "BROADCAST_ROWS", 0)
    assert see() == want


def test_merged_edges_are_dealt_by_their_number(spark, monkeypatch):
    """More edges, more tasks: none holds more with the table. Edges are worked out once."""
    monkeypatch.setattr(lineage, "UNIQUE_ROWS", 10)
    rows = [(f"p{k}", f"s{k % 5}", "X", k) for k in range(100)]
    edges = spark.createDataFrame(rows + rows, "source_id string, target_id string, edge_type string, n int")
    m = spark.createDataFrame([("s1", "s0"), ("s2", "s1"), ("p7", "s2")], "duplicate string, canonical string")
    out = g.merge_nodes(spark.createDataFrame([("s0",), ("s1",)], "id string"), edges, m)
    assert out["edges"].rdd.getNumPartitions() >= 20 and out["edges"].columns == edges.columns
    of = lambda x: "s0" if x in ("s1", "s2", "p7") else x
    want = {(of(a), of(b), t, n) for a, b, t, n in rows if of(a) != of(b)}
    assert sorted(map(tuple, out["edges"].collect())) == sorted(want) and out["moved"].first().moved == 2 * sum(of(a) != a or of(b) != b for a, b, *_ in rows)
    assert "Join" not in out["moved"]._jdf.queryExecution().optimizedPlan().toString()


def test_context_passes_all_nodes_few_times(spark, monkeypatch):
    """What makes the nodes runs once; hops ask only for nodes that are near, whoever is hidden."""
    runs = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def name(i):
        runs.add(1)
        return f"Pump {i}"

    nodes = spark.range(40).select(F.concat(F.lit("v"), "id").alias("id"), name("id").alias("name"), F.lit(None).cast("timestamp").alias("created_at"), F.when(F.col("id") % 7 == 3, F.array(F.lit("admin"))).alias("allowed_roles"))
    e = spark.createDataFrame([(f"v{a}", f"v{(a * 3 + b) % 40}", "X") for a in range(40) for b in (1, 2)], "source_id string, target_id string, edge_type string")
    e = e.select("*", *[F.lit(None).cast("timestamp").alias(c) for c in ("valid_from", "valid_until")], F.lit(None).cast("array<string>").alias("allowed_roles"))
    q = spark.createDataFrame([(1, "what of pump 5"), (2, "pump 11 now"), (3, "V4")], "query_id int, query string")
    see = lambda: sorted(map(tuple, g.graph_context(q, nodes, e, F.lit("2024-01-01").cast("timestamp"), "member").collect()))
    got = see()
    assert got and {x[0] for x in got} == {1, 2, 3} and runs.value == 40
    assert not any(f"Pump {k})" in x[2] or f"(v{k})" in x[2] for x in got for k in range(3, 40, 7))
    monkeypatch.setattr(g, "FEW_STARTS", 0)
    assert see() == got
