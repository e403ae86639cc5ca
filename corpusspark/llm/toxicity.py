"""Toxicity of texts: a weighted lexicon matched by Aho-Corasick after folding, with exception phrases.

Folding: compatibility forms, lower case, letters of other scripts that look like Latin ones, digits and signs that
stand for letters inside words; invisible characters and loose accents go. A text becomes its folded words with one
space around each. Entries are whole words (`` idiot ``), openings of words (`` achlich``) and phrases that are
exceptions (`` trash can ``); one automaton finds all. A word counts once, by its longest entry; not if an exception
covers it. A word that could be read otherwise (1 as l, accented letters without accents) is looked up again as a
whole word. The sum of weights is normalised by the number of words, and a logistic curve turns it into a score.

The lexicon is learned from a labelled sample: at most TOXIC_ROWS toxic and CLEAN_ROWS other rows by the order of a
hash of doc_id (rows of one doc_id once), their texts whole. Openings and words that are much more frequent among
toxic rows' different words become entries; weights are log ratios. A phrase with an entry that clean rows have at
least as often as toxic ones is an exception. The curve is fitted to rows scored by a lexicon of the other half of
the sample, with the weights of the whole table's labels.

Edge cases: a null or empty text, or one without words, has no entries and gets the score of that; without labels of
both kinds there are no entries and every score is the share of toxic labels (0 without any). Rows are scored by
themselves, so repeated rows are equal; a null label or doc_id teaches nothing; of rows with one doc_id in the labels
the most toxic counts. Scores read the text alone. A text is taken whole, whatever its length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusspark.llm.common import materialise, table
from corpusspark.llm.textops import give_back

#: The largest sample that a lexicon is learned from, and its largest number of entries.
TOXIC_ROWS, CLEAN_ROWS, MOST_KEYS = 4000, 8000, 200_000
#: An entry is in so many toxic rows, so much more frequent there (log ratio), with so much evidence (log likelihood).
LEAST_ROWS, LEAST_RATIO, LEAST_EVIDENCE = 5, 1.4, 12.0
MOST_WEIGHT = 7.0
#: Letters of an opening.
OPENINGS = range(3, 13)
#: Words that every text has besides its own when its weights are normalised.
EXTRA_WORDS = 20
#: An exception is in at least so many clean rows.
EXCEPTION_ROWS = 3
THRESHOLD = 0.7

# Letters that look like Latin ones, under the ones that they look like.
_LOOK = (
    "авеёікмнорстухѕјԁһԛԝгь" "αβεηικνορτυχγω" "ıɑɡʟʀɴ",
    "abeeikmhopctyxsjdhqwrb" "abeniknoptuxyw" "iaglrn",
)
LOOK = str.maketrans(*_LOOK)
#: Digits and signs that stand for letters, and what 1 may stand for besides.
DIGITS = str.maketrans("0134578@$!|", "oieastbasii")
ELSE = str.maketrans("1!|", "lll")
WORD = re.compile(r"[@$]?[^\W_]+(?:[@$!|]+[^\W_]+)*")
UNSEEN = re.compile("[­᠎​-‏‪-‮⁠-⁤︀-️﻿̀-ͯ]")


def fold(word: str) -> tuple[str, str]:
    """(the word folded, another reading or an empty string)."""
    x = "".join(c for c in unicodedata.normalize("NFKC", word).lower() if not unicodedata.combining(c)).translate(LOOK)
    first, other = x, x
    if any(map(str.isalpha, x)):
        first, other = x.translate(DIGITS), x.translate(ELSE).translate(DIGITS)
    if not other.isascii():
        other = "".join(c for c in unicodedata.normalize("NFKD", other) if not unicodedata.combining(c))
    return first, other if other != first else ""


class Folder:
    """Folds words and remembers what it folded."""

    def __init__(self, most: int = 300_000):
        self.most, self.known = most, {}

    def __call__(self, text: str | None) -> list[tuple[str, str]]:
        if not text:
            return []
        if not text.isascii() and UNSEEN.search(text):
            text = UNSEEN.sub("", unicodedata.normalize("NFC", text))
        if len(self.known) > self.most:
            self.known.clear()
        known, out = self.known, []
        for w in WORD.findall(text):
            f = known.get(w)
            if f is None:
                f = known[w] = fold(w)
            out.append(f)
        return out


class Lexicon:
    """Entries (a space, letters, and a space if it is a whole word) with weights, and exception phrases."""

    def __init__(self, terms: dict[str, float], exceptions: list[str] = ()):
        self.terms, self.exceptions = dict(terms), sorted(exceptions)
        self.automaton = None

    def build(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for k in self.terms:
            a.add_word(k, k)
        for x in self.exceptions:
            a.add_word(x, x)
        if len(a):
            a.make_automaton()
        self.automaton = a
        return self

    def matches(self, words: list[tuple[str, str]]) -> list[tuple[int, str]]:
        """(place of the word, entry) of every word that counts."""
        if self.automaton is None:
            self.build()
        if not words or not len(self.automaton):
            return []
        text = " " + " ".join([w for w, _ in words]) + " "
        found: dict[int, str] = {}
        covered: set[int] = set()
        starts = None
        for end, key in self.automaton.iter(text):
            if starts is None:
                starts = np.cumsum([0, *(len(w) + 1 for w, _ in words)])
            at = int(np.searchsorted(starts, end - len(key) + 1))
            if key in self.terms:
                if len(key) > len(found.get(at, "")):
                    found[at] = key
            else:
                covered.update(range(at, at + key.count(" ") - 1))
        for at, (_, other) in enumerate(words):
            if other and at not in found and f" {other} " in self.terms:
                found[at] = f" {other} "
        return sorted((at, key) for at, key in found.items() if at not in covered)


def features(matches: list[tuple[int, str]], n_words: int, terms: dict[str, float]) -> tuple[float, float]:
    """Logarithms of the weights by the word, and of the number of different words that count."""
    total = sum(terms[k] for _, k in matches)
    return math.log((total + 0.1) / (n_words + EXTRA_WORDS)), math.log1p(len({k for _, k in matches}))


class Model:
    """A lexicon and the curve that makes a score of its features."""

    def __init__(self, lexicon: Lexicon, curve: np.ndarray):
        self.lexicon, self.curve = lexicon, curve

    def score(self, words: list[tuple[str, str]]) -> tuple[float, list[tuple[int, str]]]:
        found = self.lexicon.matches(words)
        x = float(np.dot(self.curve, (1.0, *features(found, len(words), self.lexicon.terms))))
        return round(1 / (1 + math.exp(-max(-30.0, min(30.0, x)))), 6), found


def keys_of(words: list[tuple[str, str]]) -> tuple[set[str], Counter]:
    """A text's different folded words, and its openings and whole words with the number of different words of each."""
    different = {w for w, _ in words}
    count = Counter(f" {w} " for w in different if len(w) > 1)
    for w in different:
        for n in OPENINGS:
            if len(w) < n:
                break
            count[f" {w[:n]}"] += 1
    return different, count


def _evidence(toxic: float, clean: float) -> Column:
    """Whether a key's counts (rows and words of toxic rows, words of clean ones: r, t, c) make it an entry."""
    r, t, c = map(F.col, "rtc")
    expected = F.greatest((t + c) * toxic / max(toxic + clean, 1), F.lit(1e-9))
    ratio = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
    return (r >= LEAST_ROWS) & (ratio >= LEAST_RATIO) & (t * F.log(t / expected) - (t - expected) >= LEAST_EVIDENCE)


def _lexicons(counted: DataFrame) -> list[dict[str, float]]:
    """The lexicons of the whole sample and of each half. counted: as from ``_count_keys``."""
    counted = materialise(counted, "counted")
    whole = counted.filter("key = ''").select("half", "toxic", "words").collect()  # four rows
    out = []
    for halves in ([0, 1], [0], [1]):
        toxic, clean = (sum(r["words"] for r in whole if r["toxic"] == k and r["half"] in halves) for k in (1, 0))
        of = lambda c, k: F.sum(F.when(F.col("toxic") == k, F.col(c)).otherwise(0))
        keys = counted.filter((F.col("key") != "") & F.col("half").isin(halves)).groupBy("key").agg(of("n", 1).alias("r"), of("words", 1).alias("t"), of("words", 0).alias("c"))
        rows = keys.filter(_evidence(toxic, clean)).toArrow().to_pydict()
        out.append(lexicon_of(dict(zip(rows["key"], zip(rows["t"], rows["c"], strict=True), strict=True)), toxic, clean))
    return out


def lexicon_of(counts: dict[str, tuple[int, int]], toxic: float, clean: float) -> dict[str, float]:
    """Entries and weights. counts: the different words of toxic and of clean rows for each key with enough evidence;
    toxic and clean: all different words of each kind."""

    def ratio(t: float, c: float) -> float:
        return math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))

    below: dict[str, int] = {}
    for k, (t, _) in counts.items():
        below[k[:-1]] = max(below.get(k[:-1], 0), t)
    # Of openings that mean the same words, the longest.
    own = {k: v for k, v in counts.items() if below.get(k, 0) < 0.9 * v[0]}
    kept: dict[str, str | None] = {}
    for k in sorted(own, key=lambda k: (len(k), k)):
        above = next((k[:n] for n in range(len(k) - 1, 1, -1) if k[:n] in kept), None)
        if above is None or ratio(*own[k]) > ratio(*own[above]) + 1:
            kept[k] = above
    left = {k: list(own[k]) for k in kept}
    for k, above in kept.items():
        if above is not None:
            left[above] = [x - y for x, y in zip(left[above], own[k], strict=True)]
    weight = {k: ratio(max(t, 0), max(c, 0)) for k, (t, c) in left.items()}
    return {k: round(min(w, MOST_WEIGHT), 4) for k, w in weight.items() if w >= LEAST_RATIO}


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression with an intercept by Newton's method."""
    z = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (weight * (y - p)) - ridge * b
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return b


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, toxic, half, text of the sample, written; how many labelled rows each of its rows stands for)."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    place = F.xxhash64("doc_id", F.lit(5))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pick = lambda t, n: known.filter(F.col("toxic") == t).orderBy(place, "doc_id").limit(n)
    chosen = materialise(pick(1, TOXIC_ROWS).unionByName(pick(0, CLEAN_ROWS)), "chosen")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most TOXIC_ROWS + CLEAN_ROWS rows
    texts = texts.groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    out = materialise(texts.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(2)).cast("int")), "sample")
    taken = {r["toxic"]: r["n"] for r in out.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    return out, {t: sizes[t] / n for t, n in taken.items()}


def _count_keys(rows: DataFrame, only: set[str] | None) -> DataFrame:
    """half, toxic, key, n (rows) and words (different words) of the keys in ``only``, or of all. An empty key has the
    number of rows and of all different words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder = Folder()
        for pdf in batches:
            n, words = Counter(), Counter()
            for toxic, half, text in zip(pdf["toxic"], pdf["half"], pdf["text"], strict=True):
                different, own = keys_of(folder(text))
                n[half, toxic, ""] += 1
                words[half, toxic, ""] += len(different)
                for k, c in own.items():
                    if only is None or k in only:
                        n[half, toxic, k] += 1
                        words[half, toxic, k] += c
            keys = list(n)
            yield pd.DataFrame({"half": [k[0] for k in keys], "toxic": [k[1] for k in keys], "key": [k[2] for k in keys], "n": [n[k] for k in keys], "words": [words[k] for k in keys]})

    parts = rows.select("toxic", "half", "text").mapInPandas(run, "half int, toxic int, key string, n long, words long")
    return parts.groupBy("half", "toxic", "key").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))


def _exceptions(rows: DataFrame, terms: dict[str, float], weight: dict[int, float]) -> list[str]:
    """Phrases (an entry's word with the one before or after it; the word itself, if the entry is an opening) that mark
    no toxic rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder, lexicon = Folder(), Lexicon(terms)
        for pdf in batches:
            n = Counter()
            for toxic, text in zip(pdf["toxic"], pdf["text"], strict=True):
                words = folder(text)
                seen = set()
                for at, key in lexicon.matches(words):
                    own = words[at][0]
                    seen |= {f" {words[at - 1][0]} {own} "} if at else set()
                    seen |= {f" {own} {words[at + 1][0]} "} if at + 1 < len(words) else set()
                    seen |= {f" {own} "} if not key.endswith(" ") else set()
                n.update((toxic, s) for s in seen)
            yield pd.DataFrame({"toxic": [k[0] for k in n], "phrase": [k[1] for k in n], "n": list(n.values())})

    found = rows.select("toxic", "text").mapInPandas(run, "toxic int, phrase string, n long")
    in_kind = lambda t: F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0))
    total = found.groupBy("phrase").agg(in_kind(1).alias("t"), in_kind(0).alias("c"))
    share = weight.get(1, 1.0) * rows.filter("toxic = 1").count() / max(1.0, weight.get(0, 1.0) * rows.filter("toxic = 0").count())
    good = total.filter((F.col("c") >= EXCEPTION_ROWS) & (F.col("t") * weight.get(1, 1.0) <= F.col("c") * weight.get(0, 1.0) * share))
    return [r["phrase"] for r in good.orderBy(F.desc("c"), "phrase").limit(MOST_KEYS).collect()]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the documents' texts and their labels (doc_id, toxic)."""
    rows, weight = sample(docs, labels)
    total = sum(weight.values())
    if set(weight) != {0, 1}:
        always = 1.0 if weight.get(1) else 0.0
        return Model(Lexicon({}), np.array([30.0 if always else -30.0, 0.0, 0.0]))
    spark = rows.sparkSession
    toxic_keys = _count_keys(rows.filter("toxic = 1"), None).groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_ROWS)
    only = set(toxic_keys.orderBy(F.desc("n"), "key").limit(MOST_KEYS).select("key").toArrow().column("key").to_pylist()) - {""}
    lexicons = _lexicons(_count_keys(rows, only))
    exceptions = _exceptions(rows, lexicons[0], weight)
    state = spark.sparkContext.broadcast((lexicons, exceptions))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicons, exceptions = state.value
        folder, other = Folder(), {h: Lexicon(lexicons[2 - h], exceptions) for h in (0, 1)}
        for pdf in batches:
            out = []
            for toxic, half, text in zip(pdf["toxic"], pdf["half"], pdf["text"], strict=True):
                words = folder(text)
                out.append((toxic, *features(other[half].matches(words), len(words), other[half].terms)))
            yield pd.DataFrame(out, columns=["toxic", "x", "z"])

    scored = rows.select("toxic", "half", "text").mapInPandas(run, "toxic int, x double, z double").toPandas()
    state.destroy()
    scored = scored.sort_values(["toxic", "x", "z"])
    y = scored["toxic"].to_numpy().astype(float)
    w = np.where(y > 0, weight[1], weight[0]) * len(y) / total / max(1, len(y))
    return Model(Lexicon(lexicons[0], exceptions), fit_curve(scored[["x", "z"]].to_numpy(), y, w))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, n_words and found (entry, n: the words that count by entry) of every row."""
    state = docs.sparkSession.sparkContext.broadcast((model.lexicon.terms, model.lexicon.exceptions, model.curve))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, exceptions, curve = state.value
        own, folder = Model(Lexicon(terms, exceptions).build(), curve), Folder()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                scores, counts, found = [], [], []
                for x in batch.column("text").to_pylist():
                    words = folder(x)
                    s, matches = own.score(words)
                    scores.append(s)
                    counts.append(len(words))
                    found.append([{"entry": k.strip(), "n": n} for k, n in sorted(Counter(k for _, k in matches).items())])
                kind = pa.list_(pa.struct([("entry", pa.string()), ("n", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array(counts), pa.array(found, type=kind)], ["doc_id", "score", "n_words", "found"])
            give_back()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, n_words long, found array<struct<entry:string,n:long>>")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))).select("doc_id", "toxic"))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
