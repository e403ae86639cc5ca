"""Raking against numpy, probabilities, and drawing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusspark.llm import mixing as op


def ipf(cells, goal):
    w = {k: v for k, v in cells.items()}
    for _ in range(500):
        for axis in range(3):
            sums = {}
            for k, v in w.items():
                sums[k[axis]] = sums.get(k[axis], 0) + v
            w = {k: v * goal[axis][k[axis]] / sums[k[axis]] for k, v in w.items()}
    return {k: w[k] / (cells[k] / sum(cells.values())) for k in w}


def table(spark, seed=1):
    r = np.random.default_rng(seed)
    rows = [(s, l, t, int(r.integers(1, 1000)), 1) for s in "abcdefg" for l in ("en", "de", "") for t in ("t0", "t1") if r.random() < 0.85]
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, docs long"), {tuple(x[:3]): x[3] for x in rows}


def test_raking(spark):
    df, cells = table(spark)
    goal = []
    for axis, name in enumerate(op.AXES):
        sums = {}
        for k, v in cells.items():
            sums[k[axis]] = sums.get(k[axis], 0) + v
        p = {k: v ** op.POWERS[name] for k, v in sums.items()}
        goal.append({k: v / sum(p.values()) for k, v in p.items()})
    want = ipf(cells, goal)
    got = {(r.source, r.lang, r.topic): r.weight for r in op.rake(df).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] / want[k] - 1) < 1e-3 for k in want)


@pytest.mark.parametrize("keep", [0.05, 0.5, 0.9])
def test_probabilities(spark, keep):
    df, _ = table(spark, 2)
    rows = op.calibrate(op.rake(df), keep).collect()
    total = sum(r.tokens for r in rows)
    assert abs(sum(r.tokens * r.probability for r in rows) / total - keep) < 1e-3
    assert all(0 < r.probability <= 1 for r in rows)


def test_draw(spark):
    rows = op.op1_mixing(spark, "/root/testdata/sf0.01")
    n, kept, tokens, kept_tokens = rows.agg(F.count(F.lit(1)), F.sum(F.col("kept").cast("int")), F.sum("n_tokens"), F.sum(F.when(F.col("kept"), F.col("n_tokens")).otherwise(0))).first()
    assert n == 1000 and 0.5 < kept / n < 0.9 and abs(kept_tokens / tokens - op.KEEP) < 0.1
    assert sorted(map(str, rows.collect())) == sorted(map(str, op.op1_mixing(spark, "/root/testdata/sf0.01").collect()))


def test_edges(spark, monkeypatch):
    rows = [(1, "a b c", None, None, "q"), (1, "a b c", None, None, "q"), (2, None, "en", "s", "q"), (3, "", "en", "s", "q"), (None, "x y", "de", "s", "q")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _topic string")
    topics = spark.createDataFrame([(1, "t1")], "_vec long, _topic string")
    assert op.mix(df, topics, 1.0).columns == df.columns
    assert op.mix(df, topics, 1.0).count() == 15
    assert op.mix(df.filter("text = ''"), topics, 1.0).count() == 3
    assert op.mix(df.limit(0), topics).count() == 0
    out, name = op.plan(df, topics)
    same = out.groupBy("doc_id", "text").agg(F.countDistinct(name["drawn"]).alias("n"))
    assert same.filter("n > 1").count() == 0
    monkeypatch.setattr(op, "BROADCAST_ROWS", 0)
    monkeypatch.setattr("corpusspark.llm.common.BROADCAST_ROWS", 0)
    assert op.mix(df, topics, 1.0).count() == 15
    monkeypatch.setattr(op, "MOST_PAIRS", 1)
    monkeypatch.setattr(op, "SWEEPS", 1)
    monkeypatch.setattr(op, "BOUNDED_SWEEPS", 1)
    assert op.mix(df, topics, 1.0).count() == 15 and op.mix(df, topics).columns == df.columns


def test_margins_are_met_where_cells_are_cut_at_one(spark):
    df, _ = table(spark, 3)
    cells = op.materialise(op.calibrate(op.materialise(op.rake(df), "raked"), 0.8), "cells")
    assert cells.filter("probability > 0.999").count() > 0
    rows = op.margins(cells, 0.8).collect()
    assert {r.axis for r in rows} == set(op.AXES)
    assert all(abs(r.drawn - r.goal) < 1e-4 for r in rows)


def test_value_with_too_few_tokens_is_drawn_whole(spark):
    rows = [(s, l, t, n * m * k, 1) for s, n in (("a", 1000), ("b", 10), ("c", 1000)) for l, m in (("en", 3), ("de", 2)) for t, k in (("t0", 2), ("t1", 3))]
    df = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, docs long")
    cells = op.materialise(op.calibrate(op.materialise(op.rake(df), "raked"), 0.7), "cells")
    rows = {(r.axis, r.value): r for r in op.margins(cells, 0.7).collect()}
    small = rows["source", "b"]
    assert small.target > small.goal and abs(small.goal - 10 / 2010 / 0.7) < 1e-4
    assert all(abs(r.drawn - r.goal) < 1e-4 for r in rows.values())
    assert cells.filter("source = 'b' and probability < 0.999").count() == 0


def test_many_pairs_give_the_same(spark, monkeypatch):
    df, _ = table(spark, 3)
    few = {(r.source, r.lang, r.topic): (r.weight, r.probability) for r in op.calibrate(op.materialise(op.rake(df), "raked"), 0.6).collect()}
    monkeypatch.setattr(op, "MOST_PAIRS", 1)
    monkeypatch.setattr(op, "SWEEPS", 5)
    monkeypatch.setattr(op, "BOUNDED_SWEEPS", 5)
    many = {(r.source, r.lang, r.topic): (r.weight, r.probability) for r in op.calibrate(op.materialise(op.rake(df), "raked"), 0.6).collect()}
    assert few.keys() == many.keys()
    assert all(abs(a / b - 1) < 2e-2 for k in few for a, b in zip(few[k], many[k], strict=True))


def test_topics_come_from_the_texts(spark):
    r = np.random.default_rng(4)
    bags = {"ta": "sun moon star sky light".split(), "tb": "soup bread salt oven dough".split(), "tc": "goal ball team match win".split()}
    rows = [(k, " ".join(r.choice(bags[t], 12)), t) for k in range(90) for t in [["ta", "tb", "tc"][k % 3]]]
    df = spark.createDataFrame([(*x, "en", "s") for x in rows], "doc_id long, text string, true string, lang string, source string")
    labels = df.filter("doc_id < 30").select(F.col("doc_id").alias("_vec"), F.col("true").alias("_topic"))
    out, name = op.with_axes(df, op.fit_topics(df, labels))
    assert out.filter(F.col(name["topic"]) != F.col("true")).count() == 0 and out.filter(F.col(name["tokens"]) != 12).count() == 0


def test_sampled_margins(spark):
    """What is drawn meets the targets as nearly as its number allows."""
    rows = op.op1_mixing(spark, "/root/testdata/sf0.01").collect()
    drawn = [r for r in rows if r.kept]
    total, of = sum(r.n_tokens for r in rows), sum(r.n_tokens for r in drawn)
    assert {r.topic for r in rows} <= {f"t{k}" for k in range(10)} | {"none"} and sum(r.topic == "none" for r in rows) == sum(r.n_tokens == 0 for r in rows)
    for axis in op.AXES:
        all_of, part = {}, {}
        for r in rows:
            all_of[r[axis]] = all_of.get(r[axis], 0) + r.n_tokens
        for r in drawn:
            part[r[axis]] = part.get(r[axis], 0) + r.n_tokens
        power = {k: v ** op.POWERS[axis] for k, v in all_of.items() if v}
        for k, v in power.items():
            goal = min(v / sum(power.values()), all_of[k] / total / op.KEEP)
            spread = 4 * sum(r.n_tokens**2 * r.probability * (1 - r.probability) for r in rows if r[axis] == k) ** 0.5 / of
            assert abs(part.get(k, 0) / of - goal) < spread + 0.02
