"""The pipeline's stages, each judged on its own input."""

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from corpusspark.llm import pieces  # noqa: E402
from corpusspark.llm.common import materialise, table  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    assert len(corpus_pipeline.STAGES) == 5
    outs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        outs.append(materialise(stage(spark, outs[-1], FOLDER), "stage"))
    raw, clean, unique, apart, mixed, encoded = outs
    assert all(x.columns == raw.columns for x in outs[:5])
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    before, after = rows(raw), rows(clean)
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) >= 50 for r in after.values())
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    first = {}
    for i, r in sorted(after.items()):
        first.setdefault(norm(r.text), i)
    assert set(rows(unique)) == set(first.values())
    sets = {}
    for i, r in rows(unique).items():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text.lower())
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    kept = set(rows(apart))
    gone = set(sets) - kept
    like = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    assert not any(like(a, b) for a in kept for b in kept if a < b)
    assert all(any(like(a, b) for b in sets if b != a) for a in gone)
    assert set(rows(mixed)) <= kept
    piece_bytes = [bytes([int(p[3:5], 16)]) if byte else b"" if s != s else p.encode() for p, s, byte in pieces.vocabulary()]
    assert all(pieces.decode_ids(piece_bytes, r.ids) == before[r.doc_id].text for r in encoded.collect())
    assert encoded.count() == mixed.count() > 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).select("doc_id").collect()} == set(rows(mixed))


def test_odd_rows_through_all_stages(spark):
    """Nulls in any column, empty and repeated rows, and extra columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    docs = table(spark, FOLDER, "documents")
    some = docs.filter("doc_id < 80")
    odd = some.filter("doc_id < 3").unionByName(some.filter("doc_id = 4")).unionByName(some.filter("doc_id = 4"))  # repeated rows
    for column in docs.columns:
        odd = odd.unionByName(some.filter("doc_id between 5 and 7").withColumn(column, F.lit(None).cast(dict(docs.dtypes)[column])))
    odd = odd.unionByName(some.filter("doc_id = 8").withColumn("text", F.lit(""))).unionByName(some.filter("doc_id = 9").withColumn("text", F.lit(" \n\t ")))
    extra = {"_topic": "t", "tokens": "x", "ppl": "p", "kept": "k", "text_hash": "h", "th": "y", "ID": "i", "_hash": "z", "group_size": "g", "keep_id": "q", "n": "n"}
    rows = some.unionByName(odd).withColumns({k: F.lit(v) for k, v in extra.items()})
    out = rows
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        new = materialise(stage(spark, out, FOLDER), "odd")
        assert k == len(corpus_pipeline.STAGES) - 1 or new.columns == rows.columns, name
        assert 0 < new.count() <= out.count(), name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert new.filter("text is null or trim(text) = ''").count() == 0
            assert {tuple(r) for r in new.select(*extra).distinct().collect()} == {tuple(extra.values())}
        out = new
    none = rows.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none = materialise(stage(spark, none, FOLDER), "none")
        assert none.count() == 0, name
