"""Base counts against loops, and the language model's own laws."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusspark.llm import perplexity as lm
from corpusspark.llm import quality as op


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    runs = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    c, covered = collections.Counter(runs), set()
    for i, x in enumerate(runs):
        if c[x] > 1:
            covered.update((i, i + 1, i + 2))
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "cé", " ", "\n", "#", "\r\n", "\x0b", "a b c ", "☃"]), max_size=25).map("".join)), max_size=5))
def test_base_counts(texts):
    assert op.base_counts(pa.array(texts, pa.string())).tolist() == [brute(t) for t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_probabilities_add_up(spark, docs):
    model, types = lm.fit(docs)
    arrays = lm.load(lm.packed(model))["en"]
    chars = np.array([r[0] for r in types.filter("lang = 'en'").selectExpr(f"gram & {(1 << lm.BITS) - 1}").distinct().collect()], dtype=np.uint64)
    for gram in lm.grams(["the other and xq"])[0][:8]:
        context = gram >> np.uint64(lm.BITS) << np.uint64(lm.BITS)
        assert abs(np.exp(arrays.logp(context | chars)).sum() - 1) < 1e-3


@given(st.text(max_size=30), st.text(max_size=30))
def test_symbols_tell_all_characters_apart(a, b):
    norm = lambda t: re.sub("[0-9]", "0", re.sub(r"[ \t-\r]+", " ", re.sub("[\0-\2]", "\3", t.lower())))
    x, y = lm.code_points(a), lm.code_points(b)
    assert (norm(a) == norm(b)) == (x.tolist() == y.tolist()) and x.max(initial=0) < 1 << lm.BITS
    far = lm.code_points("漢字字\U0010ffff")
    assert len(far) == 8 and len(set(zip(far[::2].tolist(), far[1::2].tolist(), strict=True))) == 3 and far.max() < 1 << lm.BITS


class Plain:
    """Modified Kneser-Ney by its formulas, from dictionaries of tuples of code points."""

    def __init__(self, texts):
        self.counts = [None, *(collections.Counter() for _ in range(lm.ORDER))]
        for t in texts:
            c = [lm.PAD] * (lm.ORDER - 1) + lm.code_points(t).tolist() + [lm.END]
            self.counts[lm.ORDER].update(tuple(c[k:k + lm.ORDER]) for k in range(len(c) - lm.ORDER + 1))
        for k in range(lm.ORDER - 1, 0, -1):
            self.counts[k].update(g[1:] for g in self.counts[k + 1])
        self.discounts = [None]
        for k in range(1, lm.ORDER + 1):
            n = collections.Counter(self.counts[k].values())
            if n[1] and n[2] and n[3]:
                y = n[1] / (n[1] + 2 * n[2])
                raw = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
                self.discounts.append([min(0.95 * j, max(0.05, x)) for j, x in enumerate(raw, 1)])
            else:
                self.discounts.append([0.5, 1.0, 1.5])

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / (len(self.counts[1]) + 1)
        own = {g: n for g, n in self.counts[k].items() if g[:-1] == gram[:-1]}
        if not own:
            return self.p(gram[1:])
        cut = lambda n: self.discounts[k][min(n, 3) - 1]
        n, total = own.get(gram, 0), sum(own.values())
        return (n - cut(n) if n else 0) / total + sum(map(cut, own.values())) / total * self.p(gram[1:])


def test_values_by_formula(spark):
    texts = ["the cat sat on the mat", "the other cat", "a mat 12 and a hat", "the cat sat"]
    model, _ = lm.fit(spark.createDataFrame([(t, "en") for t in texts] + [(None, "en"), ("", "en")], "text string, lang string"))
    arrays, plain = lm.load(lm.packed(model)), Plain(texts)
    for t in [*texts, "the hat sat", "zz the", "a"]:
        c = [lm.PAD] * (lm.ORDER - 1) + lm.code_points(t).tolist() + [lm.END]
        want = np.exp(-np.mean([np.log(plain.p(tuple(c[k:k + lm.ORDER]))) for k in range(len(c) - lm.ORDER + 1)]))
        assert abs(lm.perplexities([t], ["en"], arrays)[0] / want - 1) < 1e-5


def test_many_ranges_give_the_same(spark, docs, monkeypatch):
    model, _ = lm.fit(docs)
    one = lm.load(lm.packed(model))
    monkeypatch.setattr(lm, "SHARD", 500)
    two = lm.load(lm.packed(model))
    for lang in one:
        for a, b in zip(one[lang].levels, two[lang].levels, strict=True):
            assert all((x == y).all() for x, y in zip(a, b, strict=True))


def test_join_gives_the_same(spark, docs, monkeypatch):
    one = {r.doc_id: r.ppl for r in op.measure(docs).collect()}
    monkeypatch.setattr(lm, "MODEL_ENTRIES", 0)
    two = {r.doc_id: r.ppl for r in op.measure(docs).collect()}
    assert one.keys() == two.keys() and all(one[k] == two[k] or abs(one[k] - two[k]) < 1e-4 for k in one)


def test_fold_has_not_seen_its_texts(spark, docs):
    lone = "qxjz vwkq " * 40
    rows = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(-k, lone, "en") for k in range(1, 30)], "doc_id long, text string, lang string"))
    got = {r.doc_id: r.ppl for r in op.measure(rows).filter("lang = 'en'").collect()}
    assert len({got[-k] for k in range(1, 30)}) == 1 and got[-1] > 5 * np.median([x for k, x in got.items() if k >= 0 and x])


def test_strange_text_is_rejected(spark, docs):
    import random

    r = random.Random(3)
    odd = " ".join("".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(6)) for _ in range(80))
    rows = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(-1, odd, "en"), (-2, odd, None)], "doc_id long, text string, lang string"))
    got = {x.doc_id: x for x in op.verdicts(rows).collect()}
    assert not got[-1].base_failed and not got[-1].kept
    good = [x for x in got.values() if x.doc_id >= 0 and not x.base_failed]
    assert sum(x.kept for x in good) > 0.9 * len(good)


def test_edges(spark, docs):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, text, "en", 1), (1, text, "en", 1), (2, None, None, 1), (3, "", "en", 1), (None, text, None, 1), (4, "same " * 80, "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _text_hash int")
    got = op.verdicts(df).collect()
    assert len(got) == 6
    assert {(r.doc_id, r.base_failed) for r in got} == {(1, False), (2, True), (3, True), (None, False), (4, True)}
    kept = op.keep(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 1, None]
    assert op.verdicts(df.limit(0)).count() == 0
