"""Periodic runs of words: stretches that repeat themselves with some period at least twice, found exactly.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that is at least
max(LEAST, 2 * q) words long and that no neighbouring word extends. Texts are searched by themselves, whole, many
at once as one array of word numbers:

1. Periods under DIRECT: words are compared with those at that distance.
2. Larger periods, scale by scale (t = 4, 8, 16, ... for periods from 3 * t to 6 * t): a string synchronising set.
   Every window of t words has a name (a hash by doubling). Position i is in the set if the smallest name of the
   windows from i to i + t is the first or the last one's; windows with a period of at most t / 3 have no name.
   Whether a position is in the set depends on its 2 * t words alone, so equal stretches choose equal positions.
   Positions with equal 2 * t words (their context) propose their distance as a period. An unnamed window is no
   context, so a context recurs within 6 * t words a bounded number of times, and all such pairs are looked at.
3. What a set omits, as its windows have no names: a run whose two halves are themselves runs of one small
   period, which then touch each other. Each touching pair of such runs, found before, proposes all distances at
   which their small periods are in step.

Every proposal is extended both ways by doubling and checked word by word; stretches with a smaller period go.
The three ways together miss no run: a run of period q has a chosen position in its first t words and its partner
q later unless its first half is without names, and then both halves are touching runs as in 3.

Edge cases: null and empty texts, and texts without words, have no runs and collapse to an empty text. Each row
is handled by itself, so repeated rows give repeated results and a null doc_id is kept. Other columns, whatever
their names, are not read. A text of any length is taken whole: its task needs about 8 bytes for each word and
each doubling (160 bytes a word for a million words).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusspark.llm.common import SPACE, table
from corpusspark.llm.textops import U64, chunks, give_back, mix, utf8

#: Words of the shortest run.
LEAST = 12
#: Periods under this are found by comparing words directly; the first scale begins with it.
DIRECT = 12
WORD = re.compile(rf"[^{SPACE}]+")
_ODD = U64(0xD6E8FEB86659FD93)
_NONE = U64(2**64 - 1)


class Texts:
    """Word numbers of texts one after another, longest text first, and the names of their windows of 1, 2, 4, ... words."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, salt: int = 0):
        self.ids, self.sizes, self.salt = ids, sizes, salt
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.begin, self.end = np.repeat(self.offsets[:-1], sizes), np.repeat(self.offsets[1:], sizes)
        self.names = [mix(ids.astype(U64) + U64((salt + 1) * int(_ODD) % 2**64))]
        while (step := 1 << len(self.names)) <= (sizes[0] if len(sizes) else 0):
            below, n = self.names[-1], self.covered(step)
            other = np.zeros(n, dtype=U64)
            near = below[step // 2:step // 2 + n]
            other[:len(near)] = near
            self.names.append(mix((below[:n] ^ U64(step)) * _ODD + other))

    def covered(self, least: int) -> int:
        """The end of the last text of at least so many words."""
        return int(self.offsets[np.count_nonzero(self.sizes >= least)])

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on, for b after a in one text."""
        got, room = np.zeros(len(a), dtype=np.int64), self.end[a] - b
        for k in range(len(self.names) - 1, -1, -1):
            at = np.flatnonzero(got + (1 << k) <= room)
            at = at[self.names[k][a[at] + got[at]] == self.names[k][b[at] + got[at]]]
            got[at] += 1 << k
        return got

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a equal those before b, for b after a in one text."""
        got, room = np.zeros(len(a), dtype=np.int64), a - self.begin[a]
        for k in range(len(self.names) - 1, -1, -1):
            step = 1 << k
            at = np.flatnonzero(got + step <= room)
            at = at[self.names[k][a[at] - got[at] - step] == self.names[k][b[at] - got[at] - step]]
            got[at] += step
        return got

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether so many words from a and from b on are the same; all lie within a text."""
        out = np.zeros(len(a), dtype=bool)
        level = np.log2(np.maximum(length, 1)).astype(np.int64)
        for k in np.unique(level):
            at, name = np.flatnonzero(level == k), self.names[k]
            last = length[at] - (1 << k)
            out[at] = (name[a[at]] == name[b[at]]) & (name[a[at] + last] == name[b[at] + last])
        return out


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + ([n] if n > 1 else [])


def _smallest(t: Texts, runs: np.ndarray) -> np.ndarray:
    """The rows of start, end, period, at least two periods long, that have no smaller period: it would divide theirs."""
    keep = np.ones(len(runs), dtype=bool)
    if not len(runs):
        return runs
    order = np.argsort(runs[:, 2], kind="stable")
    values, first = np.unique(runs[order, 2], return_index=True)
    for q, own in zip(values.tolist(), np.split(order, first[1:]), strict=True):
        for p in _primes(q):
            d = q // p
            keep[own] &= ~t.equal(runs[own, 0], runs[own, 0] + d, runs[own, 1] - runs[own, 0] - d)
    return runs[keep]


def _direct(t: Texts) -> np.ndarray:
    """Stretches with a period under DIRECT, those of three periods (for the scales) and those that are runs."""
    found = [np.zeros((0, 3), dtype=np.int64)]
    for q in range(1, DIRECT):
        if len(t.ids) <= q:
            break
        same = np.zeros(len(t.ids) + 2, dtype=np.int8)
        same[1:len(t.ids) - q + 1] = (t.ids[:-q] == t.ids[q:]) & (t.begin[:-q] == t.begin[q:])
        edge = np.diff(same)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + q
        long = end - start >= min(max(3 * q, 4), max(LEAST, 2 * q))
        found.append(np.stack([start[long], end[long], np.full(long.sum(), q)], axis=1))
    return _smallest(t, np.concatenate(found))


def _unnamed(known: np.ndarray, t: int, n: int) -> np.ndarray:
    """Which windows of t words have a period of at most t / 3: they lie in a run of it."""
    own = known[(3 * known[:, 2] <= t) & (known[:, 1] - known[:, 0] >= t) & (known[:, 0] < n)]
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, own[:, 0], 1)
    np.add.at(change, np.minimum(own[:, 1] - t + 1, n), -1)
    return np.cumsum(change[:-1]) > 0


def synchronising_set(t: Texts, k: int, known: np.ndarray) -> np.ndarray:
    """The chosen positions of the scale 2 ** k in texts of at least 6 * 2 ** k words. known: all runs with a period of
    at most a third of the scale."""
    size = 1 << k
    n = t.covered(6 * size)
    name = t.names[k][:n] >> U64(1)
    name[_unnamed(known, size, n)] = _NONE
    least = name.copy()
    for j in range(k):
        least[:n - (1 << j)] = np.minimum(least[:n - (1 << j)], least[1 << j:])
    last = np.full(n, _NONE)
    last[:max(n - size, 0)] = name[size:]
    least = np.minimum(least, last)
    chosen = (least != _NONE) & ((least == name) | (least == last)) & (np.arange(n) + 2 * size <= t.end[:n])
    return np.flatnonzero(chosen)


def _pairs(t: Texts, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions with equal contexts from 3 to under 6 times the scale apart: (the first of the two, their distance)."""
    size, at = 1 << k, synchronising_set(t, k, known)
    context = t.names[k + 1][at]
    order = np.argsort(context, kind="stable")
    at, context = at[order], context[order]
    first, apart, step = [], [], 1
    while step < len(at):
        d = at[step:] - at[:-step]
        near = (context[step:] == context[:-step]) & (d < 6 * size) & (t.begin[at[step:]] == t.begin[at[:-step]])
        if not near.any():
            break
        near &= d >= 3 * size
        first.append(at[:-step][near])
        apart.append(d[near])
        step += 1
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *first]), np.concatenate([none, *apart])


def _touching(t: Texts, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proposals from touching runs of one period: (position, distance) with the small periods in step."""
    rows = known[np.lexsort((known[:, 0], known[:, 2]))]
    a, b = rows[:-1], rows[1:]
    near = (a[:, 2] == b[:, 2]) & (b[:, 0] <= a[:, 1]) & (np.minimum(a[:, 1] - a[:, 0], b[:, 1] - b[:, 0]) >= DIRECT)
    near[near] &= t.begin[a[near, 0]] == t.begin[b[near, 0]]
    first, apart = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for (l1, r1, p), (l2, r2, _) in zip(a[near].tolist(), b[near].tolist(), strict=True):
        most = min(r1 - l1, r2 - l2) + p
        shifts = np.arange(p, 2 * p)
        shifts = shifts[(shifts <= r1 - l1) & (r1 + p <= r2)]
        if len(shifts):
            at = np.full(len(shifts), r1)
            for q in shifts[t.equal(at - shifts, at, np.full(len(shifts), p))].tolist():
                apart.append(np.arange(q, most + 1, p))
                first.append(r1 - apart[-1])
    at, q = np.concatenate(first), np.concatenate(apart)
    good = q >= DIRECT
    at, q = at[good], q[good]
    inside = at >= t.begin[at + q]
    return at[inside], q[inside]


def _checked(t: Texts, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The different runs of proposals, as start, end, period."""
    start, end = at - t.backward(at, at + q), at + q + t.forward(at, at + q)
    long = end - start >= np.maximum(LEAST, 2 * q)
    return _smallest(t, np.unique(np.stack([start[long], end[long], q[long]], axis=1), axis=0))


def find_runs(ids: np.ndarray, sizes: np.ndarray, salt: int = 0) -> np.ndarray:
    """Start, end and period of every run, by start and period, as places in ``ids``: the texts' word numbers one text
    after another. sizes: words of each text, longest first."""
    t = Texts(ids, sizes, salt)
    known = _direct(t)
    k = 2
    while len(sizes) and 6 << k <= sizes[0]:
        known = np.concatenate([known, _checked(t, *_pairs(t, k, known))])
        k += 1
    known = np.concatenate([known, _checked(t, *_touching(t, known))])
    out = np.unique(known[known[:, 1] - known[:, 0] >= np.maximum(LEAST, 2 * known[:, 2])], axis=0)
    # Different words never have one name; should two windows have one, all is done again with other names.
    if any(not np.array_equal(ids[s:e - q], ids[s + q:e]) for s, e, q in out.tolist()):
        return find_runs(ids, sizes, salt + 1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def runs_of(texts: list[str]) -> tuple[list[list[tuple[int, int, int]]], list[str]]:
    """Of each text its runs (start, length, period) and the text without what repeats: words after the first period
    of a run go, and the others are joined by one space."""
    words = [WORD.findall(x) for x in texts]
    order = sorted(range(len(words)), key=lambda j: -len(words[j]))
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for j in order for w in words[j]], dtype=np.int64)
    sizes = np.array([len(words[j]) for j in order], dtype=np.int64)
    runs = find_runs(ids, sizes)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    cuts = np.searchsorted(runs[:, 0], offsets)
    change = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    gone = np.cumsum(change) > 0
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    left = [" ".join(w) for w in words]
    for place, j in enumerate(order):
        if cuts[place] < cuts[place + 1]:
            own = runs[cuts[place]:cuts[place + 1]]
            found[j] = list(zip((own[:, 0] - offsets[place]).tolist(), (own[:, 1] - own[:, 0]).tolist(), own[:, 2].tolist(), strict=True))
            left[j] = " ".join([words[j][i] for i in np.flatnonzero(~gone[offsets[place]:offsets[place + 1]]).tolist()])
    return found, left


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start and period) and collapsed, the text without
    repetitions, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for i, j, _, _ in chunks(*utf8(column)):
                found, left = runs_of(column.slice(i, j - i).to_pylist())
                flat = np.array([r for own in found for r in own], dtype=np.int64).reshape(-1, 3)
                rows = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(RUN))
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))), type=pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.ListArray.from_arrays(offsets, rows), pa.array(left, type=pa.string())], ["doc_id", "runs", "collapsed"])
            give_back()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def collapse(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the text without repetitions."""
    return periodic_runs(docs, doc_id, text).select("doc_id", F.col("collapsed").alias("text"))


def repeated(doc_id: Column, text: Column) -> Column:
    """The contract's texts: of a tenth of the documents, by the hash of doc_id, the words from some place on repeat."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(text, F.lit(rf"[^{SPACE}]+"), F.lit(0))

    def again(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i))), " ")

    # One element arrays carry the words into the expression, so that they are worked out once.
    made = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, again(w)).otherwise(F.lit("")))[0]
    return F.when(h % 10 == 0, made).otherwise(text)


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", repeated(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("m"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    m = F.col("m")
    return out.select(
        "doc_id", "n_runs", (-m["s"]).alias("start"), m["length"].alias("length"), (-m["p"]).alias("period"),
        F.floor(1000 * m["length"] / -m["p"]).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
