"""Kernels against sets, and held-out accuracy."""

import numpy as np

from corpusspark.llm import language as op


def grams(text):
    codes = op.code_points(text).tolist()
    return {tuple(codes[i:i + n]) for n in op.ORDERS for i in range(len(codes) - n + 1)}


def test_kernel_counts_shared_grams():
    texts = ["the cat sat", "the hat", "un chat gris", "ÜBER uns"]
    x = op.presence_matrix(texts)
    sets = [grams(t) for t in texts]
    want = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    assert np.abs(op.kernel(x, x) - want).max() < 0.02  # slots may be shared


def test_ridge_against_the_whole_kernel():
    """With every text a landmark, the features give kernel ridge regression itself."""
    r = np.random.default_rng(3)
    bags = {"a": "lorem ipsum dolor sit amet".split(), "b": "quick brown foxes jump over".split(), "c": "ein zwei drei vier fünf".split()}
    langs = [x for _ in range(12) for x in bags] + ["a"] * 5
    texts = [" ".join(r.choice(bags[x], 6)) + f" {k}x" for k, x in enumerate(langs)]
    x = op.presence_matrix(texts)
    model = op.fit(x, langs)
    k = op.kernel(x, x).astype(np.float64)
    w = np.array([1 / langs.count(v) for v in langs])
    y = np.where(np.array(langs)[:, None] == np.array(sorted(bags))[None, :], 1.0, -1.0)
    want = k @ np.linalg.solve(w[:, None] * k + op.RIDGE / len(langs) * np.eye(len(langs)), w[:, None] * y)
    assert np.abs(model.kernel(x) @ model.weights - want).max() < 2e-3


def test_every_language_has_landmarks(monkeypatch):
    monkeypatch.setattr(op, "LANDMARKS", 3)
    langs = [f"l{k}" for _ in range(5) for k in range(9)]
    x = op.presence_matrix([chr(97 + int(v[1])) * 3 + chr(107 + int(v[1])) for v in langs])
    model = op.fit(x, langs)
    assert len(model.landmarks) == 4 * 9 and model.predict(["aaak", "cccm", "iiis"])[0] == ["l0", "l2", "l8"]


def test_rare_languages_and_hot_rows(spark, monkeypatch):
    rows = [(1, "hello there my friend", "en")] * 500 + [(k, f"hallo mein freund {k}", "de") for k in range(20)] + [(99, "uno", "es")]
    got = op.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(got[1]) == ["de"] * 20 + ["en", "es"]
    monkeypatch.setattr(op, "SAMPLE_ROWS", 6)  # two of each
    got = op.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(got[1]) == ["de"] * 2 + ["en", "es"]


def test_200_languages_in_bounded_memory(spark):
    """Every one of many languages is learned and told apart; the driver holds bits, not numbers."""
    import tracemalloc

    r = np.random.default_rng(5)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 1000)]
    rows = []
    for k in range(200):
        words = ["".join(r.choice(letters[5 * k:5 * k + 5], 3)) for _ in range(12)]
        rows += [(k * 100 + j, " ".join(r.choice(words, 8)), f"l{k:03}") for j in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tracemalloc.start()
    model = op.train(docs.filter("doc_id % 100 < 15"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print("peak MB:", peak >> 20)
    assert len(model.languages) == 200 and peak < 500 << 20  # spread out, the sample alone has 400 MB
    got = op.identify(docs.filter("doc_id % 100 >= 15"), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(x.lang == x.lang_pred for x in got) / len(got) > 0.97


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op.op4_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    n, right = got.count(), got.filter("lang = lang_pred").count()
    assert n > 100 and right / n > 0.97


def test_long_texts_in_pieces_are_whole(monkeypatch):
    text = "some words of a text " * 50
    want = op.presence_matrix([text])
    monkeypatch.setattr(op, "CHUNK", 37)
    assert (op.presence_matrix([text]) == want).all()


def test_edges(spark):
    rows = [(1, "hello there my friend", "en", "s"), (2, "hallo mein freund", "de", "s"), (3, None, "en", None), (4, "12 34", None, "s"), (5, "", "de", "s"), (None, "hello my friend", None, "s"), (2, "hallo mein freund", "de", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in op.identify(docs, op.train(docs)).collect()]
    by = {r[0]: r for r in got}
    assert len(got) == 7 and by[1][1] == "en" and by[2][1] == "de" and by[None][1] == "en"
    assert all(by[k][1:] == ("und", 0.0) for k in (3, 4, 5))
    assert all(0 <= r[2] <= 1 for r in got)
    none = op.train(docs.withColumn("lang", docs["lang"].substr(1, 0)).filter("doc_id > 99"))
    assert {r.lang_pred for r in op.identify(docs, none).collect()} == {"und"}
    assert op.identify(docs.limit(0), none).count() == 0
