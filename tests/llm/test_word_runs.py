"""Runs against a loop over all periods, the planted repetitions, and the edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from corpusspark.llm import word_runs as wr

FOLDER = "/root/testdata/sf0.001"


def brute(words):
    """All runs by comparing words at every distance."""
    found = {}
    n = len(words)
    for q in range(1, n):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(12, 2 * q) and not any(q % d == 0 and words[s:e - d] == words[s + d:e] for d in range(1, q)):
                found[s, e - s, q] = True
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def thue_morse(n):
    return [str(bin(i).count("1") % 2) for i in range(n)]


def shapes():
    r = random.Random(3)
    yield fibonacci(400)
    yield thue_morse(512)
    yield ["a"] * 300
    yield (list("aab") * 40 + ["a"]) * 3
    yield list("aab") * 60 + ["a"] + list("aab") * 60 + ["a"]
    yield list("b") + list("aab") * 30 + ["a"] + list("aab") * 45 + list("ab")
    root = list("aabab")
    yield root * 40 + root[:2] + root * 30 + ["c"] + root * 9
    for p in (13, 20, 37, 64, 100):
        w = [str(r.randrange(3)) for _ in range(p)]
        yield (w * 5)[:4 * p + p // 2] + [str(r.randrange(3)) for _ in range(40)] + w * 2
        yield w * 2
        yield w * 2 + w[:1]
    for _ in range(60):
        n, alphabet = r.randrange(0, 220), r.choice([1, 2, 2, 2, 3, 5, 50])
        yield [str(r.randrange(alphabet)) for _ in range(n)]
    for _ in range(60):  # periodic inside periodic, with faults
        base = [str(r.randrange(2)) for _ in range(r.randrange(1, 5))]
        w = []
        while len(w) < 300:
            w += base * r.randrange(1, 25) + [str(r.randrange(3)) for _ in range(r.randrange(0, 3))]
            if r.random() < 0.4:
                w += w[-r.randrange(1, len(w) + 1):]
        yield w[:420]


@pytest.fixture(scope="module")
def cases():
    return list(shapes())


def test_all_runs_of_each_shape_alone(cases):
    for w in cases:
        found, left = wr.runs_of([" ".join(w)])
        want = brute(w)
        assert found[0] == want
        assert left[0] == collapse(w, want)


def test_all_shapes_at_once(cases):
    found, left = wr.runs_of([" ".join(w) for w in cases])
    for w, runs, text in zip(cases, found, left, strict=True):
        assert runs == brute(w)
        assert text == collapse(w, runs)


def test_equal_stretches_choose_equal_positions():
    r = random.Random(5)
    part = [r.randrange(4) for _ in range(200)]
    ids = np.array([r.randrange(4) for _ in range(90)] + part + [r.randrange(4) for _ in range(70)] + part)
    t = wr.Texts(ids, np.array([len(ids)]))
    for k in (2, 3, 4):
        at = set(wr.synchronising_set(t, k, wr._direct(t)).tolist())
        first = {i - 90 for i in at if 90 <= i <= 290 - (2 << k)}
        second = {i - 360 for i in at if 360 <= i <= 560 - (2 << k)}
        assert first == second and first
        steps = np.diff(sorted(at))
        assert steps.max() <= 1 << k  # random words have no period, so no t positions in a row are left out


def test_a_name_of_two_windows_is_noticed(monkeypatch):
    """With names of few values, stretches look equal that are not: all is done again with other names."""
    real, calls = wr.mix, []

    def poor(x):
        calls.append(1)
        return real(x) & wr.U64(7) if len(calls) < 6 else real(x)

    monkeypatch.setattr(wr, "mix", poor)
    w = [str(i) for i in range(60)] * 2
    assert wr.runs_of([" ".join(w)])[0][0] == [(0, 120, 60)]


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_against_the_loop(spark):
    rows = {r["doc_id"]: r for r in wr.op13_word_runs(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(rows) == len(docs)
    seen = 0
    for d in docs:
        words = planted(d["doc_id"], d["text"])
        if len(words) > 1200:
            continue
        runs, r = brute(words), rows[d["doc_id"]]
        seen += len(runs)
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r["collapsed_sha256"] == sha(collapse(words, runs))
        if runs:
            s, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2]))
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (s, n, q, 1000 * n // q)
        else:
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (None,) * 4
    assert seen > 10


def test_edge_cases(spark):
    schema = "doc_id long, text string, runs string, collapsed string, TEXT2 string"
    rows = [(1, None, "x", "y", "z"), (2, "", "x", "y", "z"), (3, " \n\t ", "x", "y", "z"), (None, "a " * 30, "x", "y", "z"), (5, "b\tb\n" * 6, "x", "y", "z"), (5, "b\tb\n" * 6, "x", "y", "z"), (6, "a a " * 12, None, None, None)]
    out = wr.periodic_runs(spark.createDataFrame(rows, schema)).collect()
    got = sorted(((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out), key=repr)
    assert got == sorted([(1, [], ""), (2, [], ""), (3, [], ""), (0, [(0, 30, 1)], "a"), (5, [(0, 12, 1)], "b"), (5, [(0, 12, 1)], "b"), (6, [(0, 12, 1)], "a a")], key=repr)
    assert wr.periodic_runs(spark.createDataFrame([], schema)).count() == 0
    assert wr.collapse(spark.createDataFrame(rows, schema)).columns == ["doc_id", "text"]


def test_long_text():
    r = random.Random(1)
    part = [str(r.randrange(1000)) for _ in range(30_000)]
    w = part * 3 + [str(r.randrange(1000)) for _ in range(5000)] + ["x"] * 40_000
    (runs,), (left,) = wr.runs_of([" ".join(w)])
    assert [(0, 90_000, 30_000), (95_000, 40_000, 1)] == [x for x in runs if x[1] > 100]
    assert len(left.split()) == 30_000 + 5000 + 1 - sum(n - q for s, n, q in runs if n < 100)
