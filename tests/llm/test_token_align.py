"""Alignment against loops over the tokens of the libraries' own encodings of whole texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpusspark.llm import token_align as ta

FOLDER = "/root/testdata/sf0.001"
ODD = [
    "a", " ", "  ", "a ", " a", "  two  spaces  ", "tab\tand\nline\n\n  next \n", "it's we'll THEY'RE", "<|endoftext|> <s> </s> <unk> [INST]", "▁", "a▁b", "x ▁", "naïve café – “quoted” … ½",
    "日本語のテキスト です。 中文 文本", "😀 👩‍👩‍👧 flags🇩🇪", "0123456789 12 345,678.90", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "\x00 nul\x1c \x1f x\x85y\xa0z w", "word " * 300, "\r\n \r\n", "a\n b\n  c", "ﬁ ﬂ ﬀ", "é ́",
]


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(ta.BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=ta.PIECES)


def loop(text, sides):
    """(ids of A, ids of B, groups text, links as (a index, b index)) of one text."""
    a, b = sides
    if not text:
        return [], [], "", []
    whole = (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    chars = ta.byte_characters()
    bytes_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return [], [], "", []
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    links, groups = [], []
    for i, e in enumerate(ends_a):
        s = e - len(bytes_a[i])
        links += [(i, j) for j, f in enumerate(ends_b) if f > s and f - len(bytes_b[j]) < e]
    last = 0
    for e in sorted(set(ends_a) & set(ends_b)):
        groups.append(([i for i, x in zip(ids_a, ends_a) if last < x <= e], [i for i, x in zip(ids_b, ends_b) if last < x <= e]))
        last = e
    return ids_a, ids_b, ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups), links


def test_odd_texts_against_the_loop(sides):
    memory = ta.Memory(ta.ByteSide(), ta.PieceSide())
    texts = [None, "", *ODD, *ODD]
    got = ta.align_texts(texts, memory)
    zeros = 0
    for k, text in enumerate(texts):
        ids_a, ids_b, groups, links = loop(text, sides)
        pairs = Counter(ids_a[i] * ta.SIDE + ids_b[j] for i, j in links)
        assert (got["n_a"][k].as_py(), got["n_b"][k].as_py(), got["n_links"][k].as_py()) == (len(ids_a), len(ids_b), len(links)), text
        assert got["groups"][k].as_py() == groups
        assert got["n_groups"][k].as_py() == (groups.count(";") + 1 if groups else 0)
        assert dict(zip(got["pairs"][k].as_py(), got["times"][k].as_py(), strict=True)) == pairs
        zeros += not ids_a
    assert zeros == 8  # null, empty and three with the sign of a space, twice


def test_memory_forgets(sides, monkeypatch):
    monkeypatch.setattr(ta, "UNITS", 5)
    memory = ta.Memory(ta.ByteSide(), ta.PieceSide())
    for text in ODD:
        got = ta.align_texts([text], memory)
        assert got["groups"][0].as_py() == loop(text, sides)[2]


def expected(rows, sides):
    done = [(i, *loop(t, sides)) for i, t in rows]
    count, best = Counter(), defaultdict(int)
    for _, a, b, _, links in done:
        count.update({(a[i], b[j]) for i, j in links})
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    for doc_id, a, b, groups, links in done:
        own = [(a[i], b[j]) for i, j in links]
        yield (doc_id, len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def test_query_and_shards(spark, sides, tmp_path, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect() if len(r["text"] or "") < 1500][:40]
    rows += [(None, "again and again"), (7, None), (7, ""), (8, "a▁b"), (8, "again and again")] + [(900 + k, t) for k, t in enumerate(ODD)]
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, PAIRS string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(expected(rows, sides), key=repr)
    assert sorted(map(tuple, ta.op12_token_align(spark, str(tmp_path)).collect()), key=repr) == want
    monkeypatch.setattr(ta, "SHARD", 2000)
    assert sorted(map(tuple, ta.op12_token_align(spark, str(tmp_path)).collect()), key=repr) == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert ta.op12_token_align(spark, str(tmp_path)).collect() == []
