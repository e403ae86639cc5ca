"""Links against all pairs, and signatures by property."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusspark.llm import jaccard_join as op
from corpusspark.llm.textops import hashes, shingles, utf8, words

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, num, den):
    sets = {i: shingle_set(t, k) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, groups=(40, 14, 3), alone=25):
    """Near copies at all distances around the threshold, a passage that many share, and short texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))
    passage, rows = " ".join(word() for _ in range(60)), []
    for size in groups:
        base = [word() for _ in range(r.choice([30, 90, 200]))]
        for _ in range(size):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                own[r.randrange(len(own))] = word()
            rows.append(" ".join(own).upper() if r.random() < 0.2 else "  ".join(own))
    for _ in range(alone):
        rows.append(" ".join(word() for _ in range(r.randint(5, 20))) + " " + passage)
        rows.append(" ".join(word() for _ in range(r.randint(0, 6))))
    rows += [None, "", " \n", "one", "one", "ONE\ttwo", "one two", "a b c d e", "a b c d e f", "a b c d e f g h", rows[0], rows[0]]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "k", "num"), [(1, 4, 85), (2, 5, 80), (3, 4, 85), (4, 2, 60)])
def test_links(spark, monkeypatch, seed, k, num):
    if seed == 3:  # the ways for large tables
        monkeypatch.setattr(op, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(op, "FREQUENT", 4)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op.link(df, k, op.Threshold(num, 100)).collect()}
    assert got == brute(rows, k, num, 100)


def test_edges(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (None, "a b c d e f g h"), (5, "a b c d e f g h"), (7, None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, _gone string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op.link(df, 4, op.Threshold(85, 100)).collect()), key=str)
    assert got == sorted([(1, 5, 1), (1, 5, 1), (None, 5, None), (5, 5, 1), (7, 0, 7)], key=str)
    kept = op.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 1, 7, None]
    assert op.link(df.limit(0), 4, op.Threshold(85, 100)).count() == 0
    with pytest.raises(ValueError):
        op.Threshold(1, 2)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.sampled_from([(85, 100), (80, 100), (60, 100)]), st.integers(1, 60))
def test_linked_sets_share_a_signature(seed, n, at, common_from):
    r = random.Random(seed)
    t = op.Threshold(*at)
    x = {r.getrandbits(62) for _ in range(n)}
    y = set(x)
    for _ in range(r.randint(0, t.missing(n) + 1)):
        if r.random() < 0.5 and y:
            y.remove(r.choice(sorted(y)))
        if r.random() < 0.5:
            y.add(r.getrandbits(62))
    if x == y or not y or not t.linked(len(x & y), len(x), len(y)):
        return
    count = {v: r.choice([2, 3, 11, 12, 50]) if r.random() < 0.5 else common_from for v in x | y}
    extra = {v for v in (x ^ y) if r.random() < 0.5}  # tokens that no other set has
    sides = []
    for s in (x, y):
        token = np.array(sorted(s - extra), dtype=np.int64)
        sides.append(set(op.signatures(token, np.array([count[v] for v in token.tolist()], dtype=np.int64), len(s), t).tolist()))
    assert sides[0] & sides[1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \n\x0b", max_size=30), max_size=6), st.integers(1, 5))
def test_shingles_are_those_of_a_loop(texts, k):
    import pyarrow as pa

    data, offsets = utf8(pa.array(texts, pa.string()))
    starts, ends, row = words(data, offsets)
    token, owner = shingles(hashes(data, starts, ends, lower=True), row, k)
    for i, t in enumerate(texts):
        assert len(set(token[owner == i].tolist())) == len(shingle_set(t, k))


def test_one_document_of_several_texts(spark):
    r = random.Random(5)
    a, b = ([f"w{r.randrange(10**6)}" for _ in range(80)] for _ in range(2))
    near = lambda x, k: " ".join([*x[:k], "other", *x[k + 1:]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 3)), (4, near(a, 70)), (3, near(b, 5)), (5, near(b, 60)), (6, near(b, 61)), (9, "all by itself in here now")]
    rows += [(0, "shared text of some words"), (7, "shared text of some words"), (7, "and another text of it"), (8, "and another text of it")]
    got = {(x.doc_id, x.component_id) for x in op.link(spark.createDataFrame(rows, "doc_id long, text string"), 4, op.Threshold(85, 100)).collect()}
    assert got == {*((k, 1) for k in (1, 2, 3, 4, 5, 6)), (9, 9), (0, 0), (7, 0), (8, 0)}
    kept = op.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 4, op.Threshold(85, 100))
    assert sorted(x.doc_id for x in kept.collect()) == [0, 1, 1, 9]


def test_many_texts_of_one_document(spark, monkeypatch):
    """A hot doc_id whose texts are all of a kind, with large buckets cut in parts."""
    monkeypatch.setattr(op, "SPLIT", 3)
    monkeypatch.setattr(op, "BROADCAST_ROWS", 0)
    rows = [(i if i % 3 else 1, t) for i, t in corpus(6) if shingle_set(t, 4)]
    got = {x.doc_id: x.component_id for x in op.link(spark.createDataFrame(rows, "doc_id long, text string"), 4, op.Threshold(85, 100)).collect()}
    apart = brute([((i, n), t) for n, (i, t) in enumerate(rows)], 4, 85, 100)
    top = {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (i, _), (_, (j, _)) in apart.items():
        x, y = find(i), find(j)
        top[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in top}


def test_very_long_texts(spark):
    r = random.Random(7)
    base = [f"w{r.randrange(3000)}" for _ in range(60_000)]
    near = list(base)
    for k in range(0, 60_000, 2000):
        near[k] = "other"
    far = list(base[:30_000]) + [f"v{k}" for k in range(30_000)]
    rows = [(3, " ".join(base)), (5, " ".join(near)), (8, " ".join(far)), (9, "x" * 2_000_000)]
    got = {x.doc_id: x.component_id for x in op.link(spark.createDataFrame(rows, "doc_id long, text string"), 5, op.Threshold(80, 100)).collect()}
    assert got == {3: 3, 5: 3, 8: 8, 9: 9}
