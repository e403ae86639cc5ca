"""Folding, matching against a loop, learning on made labels, held-out accuracy on the test tables, edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusspark.llm import toxicity as tx


@pytest.mark.parametrize("text", ["idiot", "IDIOT", "1d10t", "!idiot", "ïdîot".upper(), "іdіоt", "i​di­ot", "ｉｄｉｏｔ", "𝐢𝐝𝐢𝐨𝐭", "ıdıot", "ídiot", "αdidas"])
def test_folding(text):
    words = tx.Folder()(text)
    assert len(words) == 1
    assert ("idiot" in words[0]) == (text != "αdidas")


def test_digits_stay_numbers():
    assert [w for w, _ in tx.Folder()("10 2024 3.14 $100 c1own 1oser $tupid a$$ co@t")] == ["10", "2024", "3", "14", "$100", "ciown", "ioser", "stupid", "a", "coat"]
    assert [o for _, o in tx.Folder()("c1own 1oser")] == ["clown", "loser"]


def loop(words, terms, exceptions):
    """Places and entries that count, by trying every entry at every word."""
    folded = [w for w, _ in words]
    covered = set()
    for x in exceptions:
        own = x.split()
        for i in range(len(folded) - len(own) + 1):
            if folded[i:i + len(own)] == own:
                covered |= set(range(i, i + len(own)))
    out = []
    for i, (w, other) in enumerate(words):
        hits = [k for k in terms if (k[1:-1] == w if k.endswith(" ") else w.startswith(k[1:]))] or [k for k in terms if other and k == f" {other} "]
        if hits and i not in covered:
            out.append((i, max(hits, key=len)))
    return out


def test_matching_against_the_loop():
    r = random.Random(4)
    terms = {" trash ": 3.0, " idio": 2.0, " idiot ": 4.0, " a": 1.0, " ab ": 2.0, " clown ": 3.0, " réeu": 1.0, " loser ": 2.0}
    exceptions = [" trash can ", " the ab ", " abc ", " class clown act "]
    vocabulary = "trash can idiot idiotic ab abc a the class clown act réeux reeux xtrash c1own l0ser 1oser losers TRASH Idìot".split()
    lexicon, folder = tx.Lexicon(terms, exceptions), tx.Folder()
    for _ in range(300):
        words = folder(" ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 30))))
        assert lexicon.matches(words) == loop(words, terms, exceptions)


def test_choice_of_entries(spark):
    counts = {f" {w[:n]}": (60, 60, 0) for w in ("grumble",) for n in range(3, 8)} | {" grumble ": (60, 60, 0)}
    counts |= {" blo": (80, 90, 900), " bloat": (40, 40, 1), " blo ": (1, 1, 5), " rare ": (3, 3, 0), " common ": (90, 90, 9000)}
    rows = [(h, 1, k, r - r // 2 if h else r // 2, t - t // 2 if h else t // 2) for k, (r, t, c) in counts.items() for h in (0, 1)]
    rows += [(0, 0, k, 1, c) for k, (r, t, c) in counts.items()] + [(0, 1, "", 200, 1000), (1, 1, "", 0, 0), (0, 0, "", 900, 100_000), (1, 0, "", 0, 0)]
    chosen = tx._lexicons(spark.createDataFrame(rows, "half int, toxic int, key string, n long, words long"))[0]
    assert set(chosen) == {" grumble ", " blo", " bloat"}
    assert chosen[" grumble "] >= chosen[" bloat"] > chosen[" blo"] > 0


def made(spark, n=900, seed=2):
    """Texts of plain words; toxic ones have grok or a word that begins with zarb; trap is grok before a word of peace."""
    r = random.Random(seed)
    plain = [a + b for a in "mo la te si ku ra".split() for b in "na po li ve du".split()]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randrange(20, 120))]
        toxic = i % 4 == 0
        for k in range(0, len(words) - 1, 25):
            if toxic:
                words[k] = r.choice(["grok", "GR0K", "zarb" + r.choice(plain), "gгоk"])
            elif i % 12 == 1:
                words[k:k + 2] = ["grok", "salad"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learned_lexicon(spark):
    docs, labels = made(spark)
    model = tx.train(docs.filter("doc_id < 600"), labels.filter("doc_id < 600"))
    assert " zarb" in model.lexicon.terms and any(k.startswith(" grok") for k in model.lexicon.terms)
    assert any("salad" in x for x in model.lexicon.exceptions)
    got = tx.score(docs.filter("doc_id >= 600"), model).join(labels, "doc_id").collect()
    assert all((r["score"] >= 0.7) == (r["toxic"] == 1) for r in got)
    short, long = model.score(tx.Folder()("grok " + "mona " * 20))[0], model.score(tx.Folder()("grok " + "mona " * 3000))[0]
    assert short > 0.7 > 0.5 > long  # normalised by length


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"  # 300 toxic rows to learn from; sf0.01 has 35
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = tx.op11_toxicity(spark, folder).join(labels, "doc_id").filter("held_out").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hit / max(1, sum(r["predicted"] for r in rows)) >= 0.95
    # Rows of quality 0 had their words replaced after they were labelled.
    good = [r for r in rows if r["quality"] == 1 and r["toxic"] == 1]
    assert sum(r["predicted"] for r in good) / len(good) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_sample_is_bounded_and_weighed(spark, monkeypatch):
    docs, labels = made(spark, 200)
    monkeypatch.setattr(tx, "CLEAN_ROWS", 30)
    rows, weight = tx.sample(docs.unionByName(docs), labels.unionByName(labels))
    assert rows.count() == 80 and weight == {1: 1.0, 0: 5.0}


def test_edge_cases(spark):
    schema = "doc_id long, text string, score string, FOUND string"
    rows = [(1, None, "a", "b"), (2, "", "a", "b"), (3, "!!! ​", "a", "b"), (None, "grok", "a", "b"), (4, "grok", "a", "b"), (4, "grok", "a", "b"), (5, "grok " * 100_000, None, None)]
    model = tx.Model(tx.Lexicon({" grok ": 5.0}), np.array([4.0, 1.0, 1.0]))
    got = {(r["doc_id"], r["n_words"]): (r["score"], [tuple(x) for x in r["found"]]) for r in tx.score(spark.createDataFrame(rows, schema), model).collect()}
    empty = got[1, 0]
    assert got[2, 0] == got[3, 0] == empty and empty[1] == [] and 0 <= empty[0] < 0.7
    assert got[None, 1] == got[4, 1] and got[4, 1][1] == [("grok", 1)] and got[5, 100_000][1] == [("grok", 100_000)]
    assert tx.score(spark.createDataFrame([], schema), model).count() == 0
    nothing = tx.train(spark.createDataFrame(rows, schema), spark.createDataFrame([(4, None), (None, 1)], "doc_id long, toxic int"))
    assert {r["score"] for r in tx.score(spark.createDataFrame(rows, schema), nothing).collect()} == {0.0}
    one = tx.train(spark.createDataFrame(rows, schema), spark.createDataFrame([(4, 1)], "doc_id long, toxic int"))
    assert {r["score"] for r in tx.score(spark.createDataFrame(rows, schema), one).collect()} == {1.0}


def test_held_out_rows_teach_nothing(spark, tmp_path):
    docs, labels = made(spark, 300)
    out = []
    for k in range(2):
        folder = f"{tmp_path}/{k}"
        docs.write.parquet(f"{folder}/documents.parquet")
        changed = F.when(tx.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))
        labels.withColumn("toxic", changed if k else F.col("toxic")).write.parquet(f"{folder}/labels.parquet")
        out.append(sorted(map(tuple, tx.op11_toxicity(spark, folder).collect())))
    assert out[0] == out[1] and any(r[1] for r in out[0])
