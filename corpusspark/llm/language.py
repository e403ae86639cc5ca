"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams, for all lengths in ORDERS, that occur in
both (a blended spectrum of presence), divided by the root of the product of each text's own number.
N-grams are hashed to DIMENSIONS slots. Nyström landmarks turn the kernel into features; a
one-versus-rest ridge regression on them scores the languages. A batch of texts is scored by two
matrix products: presence times landmarks, then kernel values times the regression.

The model learns from a bounded sample: up to PER_LANGUAGE labelled texts of every language, and of all together at
most SAMPLE_ROWS (then fewer of each; with more languages than that, one of each of the most frequent), taken by the
order of a hash of doc_id and text. Of these LANDMARKS, or LEAST_LANDMARKS of each language if that is more, but at
most MOST_LANDMARKS, are landmarks. Presence is kept as bits, DIMENSIONS / 8 bytes a text, and the kernel and the
regression's sums are worked out ROWS texts at a time, so the driver needs SAMPLE_ROWS times that, and a quarter of a
gigabyte, however many languages there are.

Edge cases: a null text or one without a letter is ``und`` with score 0; equal scores go to the first
language by name; with no labelled text every prediction is ``und``; a null lang teaches nothing. Each
row is scored by itself, whole, so repeated rows and long texts need nothing special, and other
columns, lang and source among them, are not read for a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusspark.llm.common import table
from corpusspark.llm.textops import U64, mix

ORDERS = (1, 2, 3, 4)
DIMENSIONS = 1 << 15
PER_LANGUAGE = 150
LANDMARKS, LEAST_LANDMARKS, MOST_LANDMARKS = 256, 4, 1024
RIDGE = 0.1
#: Texts that all languages learn from together, and texts whose bits are spread out at once.
SAMPLE_ROWS, ROWS = 40_000, 500
#: Code points whose n-grams are hashed at once.
CHUNK = 400_000
#: Steepness of the soft maximum that turns regression scores into a share.
SHARPNESS = 6.0
UNKNOWN = "und"


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points with every run of non-letters as one zero, and zeros at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = (codes >= 0xC0) & (codes != 0xD7) & (codes != 0xF7) & ((codes < 0x2000) | (codes > 0x206F)) | (codes >= 97) & (codes <= 122)
    out = np.concatenate(([0], np.where(letters, codes, 0), [0])).astype(np.uint32)
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def presence(text: str, out: np.ndarray) -> None:
    """Marks the slots of the text's n-grams in ``out``, a row of zeros."""
    codes = code_points(text).astype(U64)
    most = max(ORDERS)
    for at in range(0, max(1, len(codes)), CHUNK):
        part = codes[at:at + CHUNK + most - 1]
        run = np.zeros(len(part), dtype=U64)
        for n in range(1, most + 1):
            if len(part) < n:
                break
            run = run[:len(part) - n + 1] * U64(0x100000001B3) + part[n - 1:] + U64(n)
            if n in ORDERS:
                out[(mix(run) & U64(DIMENSIONS - 1)).astype(np.int64)] = 1


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def presence_matrix(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    for k, t in enumerate(texts):
        presence(t, out[k])
    return out


def spread_out(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of numbers."""
    return np.unpackbits(bits, axis=1).astype(np.float32).reshape(len(bits), DIMENSIONS)


class Model:
    """Landmarks by slot, as bits or spread out, the languages, and the regression on kernel values."""

    def __init__(self, landmarks: np.ndarray, languages: list[str], weights: np.ndarray):
        self.landmarks, self.languages, self.weights = landmarks, languages, weights

    def spread(self) -> Model:
        """The same with landmarks ready for products, at most MOST_LANDMARKS rows."""
        return Model(spread_out(self.landmarks), self.languages, self.weights) if self.landmarks.dtype == np.uint8 else self

    def predict(self, texts: list[str | None], batch: int = 64) -> tuple[list[str], list[float]]:
        own_model = self.spread()
        out, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [k for k, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for at in range(0, len(known), batch):
            own = known[at:at + batch]
            raw = own_model.kernel(presence_matrix([texts[k] for k in own])) @ self.weights
            share = np.exp(SHARPNESS * (raw - raw.max(axis=1, keepdims=True)))
            share /= share.sum(axis=1, keepdims=True)
            for k, row, best in zip(own, share, np.round(raw, 6).argmax(axis=1), strict=True):
                out[k], scores[k] = self.languages[best], round(float(row[best]), 4)
        return out, scores

    def kernel(self, x: np.ndarray) -> np.ndarray:
        """Normalised kernel values of presence rows with the landmarks."""
        return kernel(x, self.spread().landmarks)


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x @ y.T) / np.sqrt(np.maximum(1, x.sum(axis=1))[:, None] * np.maximum(1, y.sum(axis=1))[None, :])


def fit(presences: np.ndarray, langs: list[str]) -> Model:
    """presences: rows of bits, or spread out. Rows must alternate between languages as far as they can, so that the first are good
    landmarks."""
    languages = sorted(set(langs))
    if not languages:
        return Model(np.zeros((0, DIMENSIONS // 8), dtype=np.uint8), [], np.zeros((0, 0)))
    presences = presences if presences.dtype == np.uint8 else np.packbits(presences.astype(bool), axis=1)
    bits = presences[:min(MOST_LANDMARKS, max(LANDMARKS, LEAST_LANDMARKS * len(languages)))]
    landmarks = spread_out(bits)
    own = kernel(landmarks, landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh(own)
    good = values > 1e-6 * values.max()
    project = vectors[:, good] / np.sqrt(values[good])
    place = {x: k for k, x in enumerate(languages)}
    column = np.array([place[x] for x in langs])
    # Each language weighs the same, however many samples it has.
    weight = 1 / np.bincount(column)[column]
    left, right = np.zeros((project.shape[1],) * 2), np.zeros((project.shape[1], len(languages)))
    for at in range(0, len(langs), ROWS):
        z = kernel(spread_out(presences[at:at + ROWS]), landmarks).astype(np.float64) @ project
        w = weight[at:at + ROWS, None]
        y = np.where(column[at:at + ROWS, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
        left += z.T @ (z * w)
        right += z.T @ (y * w)
    ridge = np.linalg.solve(left + RIDGE / len(langs) * np.eye(len(left)), right)
    return Model(bits, languages, (project @ ridge).astype(np.float32))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame) -> tuple[np.ndarray, list[str]]:
    """Presence rows and languages of the training sample, alternating between languages."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE_ROWS)
    sizes = {r["lang"]: r["count"] for r in most.collect()}
    if not sizes:
        return np.zeros((0, DIMENSIONS // 8), dtype=np.uint8), []
    each = max(1, min(PER_LANGUAGE, SAMPLE_ROWS // len(sizes)))
    # A share of each language that gives somewhat more than its part of the sample; the rest is cut below. A small
    # one is taken whole, as its rows may be repeated.
    rank = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 40))
    share = docs.sparkSession.createDataFrame([(k, int(min(1, max(1.4 * each + 30, 1000) / n) * (1 << 40))) for k, n in sizes.items()], "lang string, share long")
    # Repeated rows have one hash: once each, so that not all of them come at once.
    near = labelled.select("lang", rank.alias("rank"), "text").join(F.broadcast(share), "lang").filter("rank < share").select("lang", "rank", "text").dropDuplicates(["lang", "rank"])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[[has_letter(t) for t in pdf["text"]]]
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at:at + 64]
                bits = np.packbits(presence_matrix(list(part["text"])).astype(bool), axis=1)
                yield pd.DataFrame({"lang": part["lang"], "rank": part["rank"], "bits": [x.tobytes() for x in bits]})

    found = near.mapInPandas(pack, "lang string, rank long, bits binary")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "bits"))
    rows = found.withColumn("turn", turn).filter(F.col("turn") <= each).toPandas().sort_values(["turn", "lang"])
    bits = np.frombuffer(b"".join(rows["bits"]), dtype=np.uint8).reshape(len(rows), -1)
    return bits, list(rows["lang"])


def train(docs: DataFrame) -> Model:
    """A model of the rows' lang and text."""
    return fit(*sample(docs))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score for every row. Its landmarks are sent to executors as bits, 1 MB for LANDMARKS."""
    state = docs.sparkSession.sparkContext.broadcast((model.landmarks, model.languages, model.weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*state.value).spread()
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at:at + 1000]
                langs, scores = own.predict(list(part["text"]))
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "lang_pred": langs, "score": scores})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    out = identify(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
