"""Exact deduplication against a dictionary."""

import hashlib
import re

from corpusspark.llm import dedup_exact as op

ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (9, "a b"), (1, None), (2, ""), (7, "x"), (8, " x"), (None, "x"), (4, " "), (6, "y" * 200_000), (10, "y" * 200_000)]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_groups(spark):
    got = op.groups(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()
    sets = {}
    for i, t in set(ROWS):
        sets.setdefault(norm(t), set()).add(i)
    want = set()
    for t, ids in sets.items():
        keep = min(x for x in ids if x is not None)
        want |= {(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids}
    assert {tuple(r) for r in got} == want
    assert len(got) == len(want)


def test_deduplicate_keeps_clashing_columns(spark):
    rows = [(i, t, str(i), 7) for i, t in ROWS]
    df = spark.createDataFrame(rows, "doc_id long, text string, _digest string, _KEEP int")
    got = op.deduplicate(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4, 6, 7, 8]


def test_no_copies_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert op.deduplicate(df).count() == 2
    assert op.deduplicate(df.limit(0)).count() == 0
    assert op.groups(df.limit(0)).count() == 0


def test_filter_in_chunks_gives_the_same(spark, monkeypatch):
    rows = [(k, f"text {k // 3 if k % 7 == 0 else k}") for k in range(400)] + ROWS
    df = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, _slot string")
    want, kept = sorted(map(str, op.groups(df).collect())), sorted(map(str, op.deduplicate(df).collect()))
    monkeypatch.setattr(op, "CHUNK_PIECES", 1)
    monkeypatch.setattr(op, "BITS_PER_SLOT", 1 << 13)  # many pieces
    monkeypatch.setattr(op, "KEEPERS", 0)
    assert op.Filter(df.selectExpr("sha(text) as _digest")).pieces > 1
    assert sorted(map(str, op.groups(df).collect())) == want
    assert sorted(map(str, op.deduplicate(df).collect())) == kept
    by_text = {}
    for i, t in rows:
        if i is not None:
            by_text[norm(t)] = min(i, by_text.get(norm(t), i))
    assert len(kept) == len(by_text)


def test_few_unique_rows_seem_repeated(spark):
    df = spark.range(20_000).selectExpr("unhex(sha2(cast(id as string), 256)) as _digest", "id as _id").union(spark.range(50).selectExpr("unhex(sha2('same', 256))", "-id"))
    maybe, others = op.Filter(df).split(df)
    assert maybe.filter("_id > 0").count() < 300 and maybe.filter("_id < 0").count() == 49 and others.count() + maybe.count() == 20_050
