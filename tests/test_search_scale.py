"""Searches in blocks, and the index over angles, against loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusspark.operators import graph as g
from corpusspark.operators import retrieval as ret


def test_suffixes_are_sorted():
    r = random.Random(1)
    for text in ("", "a", "aaaa\0aa\0", "".join(r.choice("ab\0é") for _ in range(300))):
        assert ret.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:]) if text else True


@pytest.mark.parametrize("characters", [10, 1_000_000])
def test_names_against_the_loop(spark, monkeypatch, characters):
    monkeypatch.setattr(ret, "BLOCK_CHARACTERS", characters)
    r = random.Random(characters)
    word = lambda n: "".join(r.choice("abÄ ") for _ in range(r.randrange(n)))
    queries = [(k, word(9)) for k in range(12)] + [(90, None), (91, ""), (92, "AB"), (93, "ab")]
    nodes = [(f"x{word(3)}{k}", word(7)) for k in range(80)] + [("n", None), ("m", ""), ("", "b")]
    want = set()
    for q, text in queries:
        t = (text or "").lower()
        for i, name in nodes:
            name = (name or "").lower()
            if t and ((name and (name in t or t in name)) or (i and i.lower() in t)):
                want.add((q, i))
    n, alive, most = [], set(), [0]
    sc = spark.sparkContext
    real = type(sc).broadcast

    def counted(self, value):
        b = real(self, value)
        alive.add(id(b))
        most[0] = max(most[0], len(alive))
        n.append(b)
        destroy = b.destroy
        b.destroy = lambda *a: (alive.discard(id(b)), destroy(*a))
        return b

    monkeypatch.setattr(type(sc), "broadcast", counted)
    out = ret.name_match(spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(nodes, "id string, name string"))
    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert most[0] == 1 and not alive and (len(n) > 2) == (characters == 10)
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize(("cell", "candidate"), [(10, 0.85), (2000, 0.85), (7, 0.3)])
def test_entities_by_angles(spark, monkeypatch, cell, candidate):
    """All of the most similar entities are found; cells that are far away aren't compared."""
    monkeypatch.setattr(g, "CELL", cell)
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 6))
    near = lambda: (centres[r.integers(12)] + 0.15 * r.normal(size=6)).tolist()
    registry = [(k, f"e{k}", "T" if k % 3 else "U", "w", near()) for k in range(300)] + [(900, "z", "T", "w", [0.0] * 6), (901, "y", "T", "w", None), (902, "s", "T", "w", [1.0, 2.0]), (903, "dup", "T", "w", registry_vector := near()), (904, "dup2", "T", "w", registry_vector)]
    mentions = [(k, f"m{k}", "T" if k % 2 else "U", "w", near()) for k in range(60)] + [(70, "E7", "T", "w", None), (71, "q", "T", "w", [1.0, 2.0]), (72, "q", "T", "v", near()), (73, "q", "T", "w", [0.0] * 6), (74, "q", "T", "w", registry_vector), (75, "q", "T", "w", [])]
    kind = "id long, name string, type string, workspace_id string, embedding array<double>"
    m, e = spark.createDataFrame(mentions, kind).withColumnRenamed("id", "mention_id"), spark.createDataFrame(registry, kind).withColumnRenamed("id", "entity_id")
    want = {}
    for i, name, t, w, v in mentions:
        same = [j for j, n, _, u, _ in registry if n.lower() == name.lower() and u == w]
        if same:
            want[i] = (min(same), 1.0)
            continue
        scored = []
        for j, _, s, u, x in registry:
            if s == t and u == w and v and x and len(v) == len(x) and any(v) and any(x):
                scored.append((-round(float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)), 6), j))
        if scored and -min(scored)[0] >= candidate:
            want[i] = (min(scored)[1], -min(scored)[0])
    got = {x.mention_id: (x.entity_id, round(x.similarity, 6)) for x in g.entity_duplicates(m, e, candidate, 0.92).collect()}
    assert got == want
    if (cell, candidate) == (10, 0.85):
        _, cells = g.near_entities(m, e, candidate)
        n = cells.agg(F.sum(F.col("entities") * F.col("mentions")).alias("compared"), F.sum("entities").alias("entities")).first()
        assert n.compared < 0.5 * sum(1 for i in mentions for j in registry if i[2] == j[2] and i[3] == j[3])
