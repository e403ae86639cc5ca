"""Segmentations against all of them, and round trips."""

import pickle
import random
import time

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusspark.llm import pieces as op

VOCAB = op.vocabulary()
LATTICE = op.Lattice(VOCAB)
RAW = [bytes([int(p[3:5], 16)]) if byte else b"" if s != s else p.encode() for p, s, byte in VOCAB]


def every(text):
    text, out = op.ESCAPED + text.replace(" ", op.ESCAPED), []

    def go(at, score, ids):
        if at == len(text):
            out.append((score, ids))
        for e in range(at + 1, min(len(text), at + LATTICE.longest) + 1):
            piece = LATTICE.pieces.get(text[at:e])
            if piece:
                go(e, score + piece[0], [*ids, piece[1]])
            elif e == at + 1:
                go(e, score + LATTICE.unknown, [*ids, *LATTICE._fallback(text[at])])

    go(0, 0, [])
    return sorted(out, key=lambda x: -x[0])


def edited(ids, edits):
    ids = list(ids)
    for e in sorted(edits, key=lambda e: -e["start"]):
        ids[e["start"]:e["end"]] = e["ids"]
    return ids


def test_n_best():
    r = random.Random(1)
    for _ in range(150):
        text = "".join(r.choice("thea n\nö☃ ") for _ in range(r.randint(1, 9)))
        (ids, score, others, _), = op.encode_texts(LATTICE, [text], 4)
        want = every(text)[:4]
        assert [w[0] for w in want] == [score, *(o["score"] for o in others)]
        scores = dict(map(lambda w: (tuple(w[1]), w[0]), every(text)))
        assert scores[tuple(ids)] == score
        seen = {tuple(ids)}
        for o in others:
            alt = tuple(edited(ids, o["edits"]))
            assert scores[alt] == o["score"] and alt not in seen
            seen.add(alt)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=["Cs"], blacklist_characters=op.ESCAPED), max_size=60))
def test_round_trip(text):
    (ids, _, _, _), = op.encode_texts(LATTICE, [text], 2)
    assert op.decode_ids(RAW, ids.tolist()) == text


def test_long_word():
    (ids, _, others, _), = op.encode_texts(LATTICE, ["abcdefg" * 2000], 2)
    assert op.decode_ids(RAW, ids.tolist()) == "abcdefg" * 2000 and len(others) == 1


def test_rows(spark):
    rows = [(1, "hello  wörld\n", "k"), (2, None, "k"), (3, "", "k"), (1, "hello  wörld\n", "k"), (None, " x ", "k")]
    df = op.decode(op.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), ["doc_id", "text"]))
    got = df.collect()
    assert [r.decoded for r in got] == [r[1] or "" for r in rows]
    assert got[1].ids == got[1].best_ids == [] and got[1].alternatives == [] and got[0].ids == got[3].ids
    assert op.encode(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0


def test_own_ids_are_the_models(spark):
    """Against the library's encoding of whole texts."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=op.MODEL)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(-1, "  two  spaces   here "), (-2, " "), (-3, "a\n\nb\t☃ö漢"), (-4, "x" * 3000), (-5, op.ESCAPED + "a" + op.ESCAPED)]
    docs = docs.union(spark.createDataFrame(odd, "doc_id long, text string"))
    got = op.encode(docs, ["doc_id", "text"]).collect()
    assert len(got) > 150 and all(r.ids == model.encode(r.text or "") for r in got)
    assert all(op.decode_ids(RAW, r.best_ids) == (r.text or "").replace(op.ESCAPED, " ") for r in got)


def test_rare_units_are_forgotten_and_frequent_ones_kept(monkeypatch):
    """With the same results; a lattice is sent with its tables and without what it has learned."""
    plain, lattice, learned = op.Lattice(VOCAB, op.model_bytes()), op.Lattice(VOCAB, op.model_bytes()), []
    texts = [f"often  again {k}x often here{k % 3} y " * 2 for k in range(30)] + ["", "  ", "often"]
    want = op.encode_texts(plain, texts, 3)
    monkeypatch.setattr(op, "REMEMBERED", 10)
    monkeypatch.setattr(op, "LEARNED", 3)
    real = lattice.learn
    monkeypatch.setattr(lattice, "learn", lambda units: learned.extend(units.to_pylist()) or real(units))
    got = [x for t in texts for x in op.encode_texts(lattice, [t], 3)]
    assert [(a.tolist(), s, o, m.tolist()) for a, s, o, m in got] == [(a.tolist(), s, o, m.tolist()) for a, s, o, m in want]
    assert learned.count("often") == 1 and len(lattice.known) <= 20
    sent = pickle.loads(pickle.dumps(plain))
    assert len(plain.known) > 30 and not len(sent.known) and (sent.keys == plain.keys).all()
    assert op.encode_texts(sent, texts[:1], 3)[0][0].tolist() == want[0][0].tolist()


def test_trie_has_the_pieces_and_their_beginnings_only():
    states = {"": 0}
    for p in sorted(LATTICE.pieces, key=len):
        for k in range(len(p)):
            to = int(LATTICE.step[states[p[:k]]] + LATTICE.char[ord(p[k])])
            assert LATTICE.keys[to] == states[p[:k]] and states.setdefault(p[:k + 1], to) == to
        assert (LATTICE.scores[to], LATTICE.ids[to]) == LATTICE.pieces[p]
    assert len(set(states.values())) == len(states) == (LATTICE.keys >= 0).sum() + 1
    assert (LATTICE.ids >= 0).sum() == len(LATTICE.pieces)
    assert (LATTICE.keys[LATTICE.step] != np.arange(len(LATTICE.step))).all()  # characters of no piece lead nowhere


def test_results_do_not_depend_on_what_is_searched_at_once(monkeypatch):
    r = random.Random(2)
    texts = ["".join(r.choice("thea n\nö☃ ") for _ in range(r.randint(0, 90))) for _ in range(60)] + ["there" * 300, "☃" * 40, "", " "]
    want = [(a.tolist(), s, o) for a, s, o, _ in op.encode_texts(LATTICE, texts, 3)]
    for area, learned in ((1, 3), (40, 7), (10**6, 10**6)):
        monkeypatch.setattr(op, "AREA", area)
        monkeypatch.setattr(op, "LEARNED", learned)
        LATTICE.clear()
        assert [(a.tolist(), s, o) for a, s, o, _ in op.encode_texts(LATTICE, texts, 3)] == want


def test_new_units_cost_little_more_than_the_librarys_encoding():
    """CPU time of forward scores, best paths and losses, as a multiple of that of the model's merges of the same units."""
    r = random.Random(4)
    parts = ["th", "ed", "re", "tion", "ea", "ble", "on", "ing", "ou", "en", "st", "ha"]
    units = pa.array(sorted({"".join(r.choice(parts) for _ in range(r.randint(2, 6))) for _ in range(20_000)}))
    lattice, merging = op.Lattice(VOCAB), op.Lattice(VOCAB, op.model_bytes())

    def cpu(f, *args):
        begun = time.process_time()
        f(*args)
        return time.process_time() - begun

    searched = min(lattice.clear() or cpu(lattice.number, units) for _ in range(3))
    assert np.isfinite(lattice.loss).any() and searched < 2.2 * min(cpu(merging._merge, units) for _ in range(3))
