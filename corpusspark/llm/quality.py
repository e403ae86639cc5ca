"""Quality rules: counts of words, symbols, repeated lines and windows, and perplexity bands by language.

A document fails if it has under MIN_WORDS words or over half of its words in repeated windows, or if
its perplexity (see ``perplexity``) lies outside its language's band. Documents fall into two folds by a
hash of their text, so that copies stay together; each is scored by its language's model of the other
fold, which has not seen it. The logarithm of a perplexity spreads around its language's median as
one over the root of the words; a language's band is the median plus or minus LOWER or UPPER times the
distance to the quartile on that side, of deviations scaled by that root, so that short and long texts
are judged alike. Median and quartiles are those of the different texts that pass the rules. A language
whose other fold is empty has no model, and its documents no perplexity: the rules alone judge these.

Edge cases: null text has no words; null lang is a language of its own; an empty table gives no rows.
Documents that repeat a row get the same verdict. ``keep`` carries all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusspark.llm import perplexity as lm
from corpusspark.llm.common import BROADCAST_ROWS, fresh, materialise, table
from corpusspark.llm.textops import _SPACE, chunks, give_back, hashes, utf8, words

MIN_WORDS = 50
REPEAT_PERCENT = 50
WINDOW = 3
#: Distance from the median to the band's ends, in distances from median to quartile: about three deviations.
LOWER, UPPER = 4.5, 4.5
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCORES = "doc_id long, lang string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ppl double"


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which (key, row) occur again, and which occurred earlier, by position."""
    order = np.lexsort((np.arange(len(key)), key, row))
    same = (key[order[1:]] == key[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    twice, again = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    again[order[1:]] = same
    return twice, again


def base_counts(column: pa.Array) -> np.ndarray:
    """The BASE counts, a row for each text."""
    data, offsets = utf8(column)
    out = np.zeros((len(offsets) - 1, len(BASE)), dtype=np.int64)
    for i, j, part, at in chunks(data, offsets):
        n = j - i
        starts, ends, row = words(part, at)
        out[i:j, 0] = np.bincount(row, minlength=n)
        out[i:j, 1] = _per_row(~_SPACE[part] & ((part & 0xC0) != 0x80), at)
        out[i:j, 2] = _per_row(_SYMBOL[part], at)
        if not len(starts):
            continue
        # Lines: from each newline or row start to the next; only those in which a word starts.
        cut = np.union1d(np.flatnonzero(part == 10) + 1, at[:-1])
        cut = cut[cut < len(part)]
        stop = np.append(cut[1:], len(part))
        stop = stop - (part[stop - 1] == 10)
        line_row = np.searchsorted(at, cut, "right") - 1
        has = np.searchsorted(starts, stop) > np.searchsorted(starts, cut)
        cut, stop, line_row = cut[has], stop[has], line_row[has]
        again = _repeated(hashes(part, cut, stop), line_row)[1]
        out[i:j, 3] = np.bincount(line_row, again, n)
        if len(starts) >= WINDOW:
            h = hashes(part, starts, ends)
            w = h[:-2] * lm.U64(3) + h[1:-1] * lm.U64(0x9E3779B97F4A7C15) + h[2:] * lm.U64(0xD6E8FEB86659FD93)
            whole = np.flatnonzero(row[:-2] == row[2:])
            twice = np.zeros(len(starts), dtype=bool)
            twice[whole] = _repeated(w[whole], row[whole])[0]
            covered = twice.copy()
            for k in range(1, WINDOW):
                covered[k:] |= twice[:-k]
            out[i:j, 4] = np.bincount(row, covered, n)
    return out


def _model_key(lang: str, fold: Column) -> Column:
    return F.concat(fold.cast("string"), F.lit(":"), F.coalesce(lang, F.lit(lm.NO_LANG)))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the hash of the text, the base counts and the perplexity of every row, as a written table."""
    spark = docs.sparkSession
    fold = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(2))
    model, seen = lm.fit(docs.select(_model_key("lang", fold).alias("lang"), "text"))
    rows = docs.select("doc_id", _model_key("lang", 1 - fold).alias("lang"), F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    fits = model.count() <= lm.MODEL_ENTRIES
    state = spark.sparkContext.broadcast(lm.packed(model) if fits else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = lm.load(state.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                counts = base_counts(batch.column("text"))
                ppl = lm.perplexities(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), arrays)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in ("doc_id", "lang", "text_hash")] + [pa.array(counts[:, k]) for k in range(len(BASE))] + [pa.array(ppl, from_pandas=True)],
                    ["doc_id", "lang", "text_hash", *BASE, "ppl"],
                )
            give_back()
        del arrays
        give_back()

    scored = materialise(rows.mapInArrow(run, SCORES), "scored")
    state.destroy()  # executors' workers give the model back
    if not fits:
        texts = rows.filter("text != ''").dropDuplicates(["lang", "text_hash"])
        # The n-grams that a model judges are those that the other fold's was made from.
        other = F.concat((1 - F.substring("lang", 1, 1).cast("int")).cast("string"), F.substring("lang", 2, 1 << 30))
        total = lm.perplexities_by_join(texts, "text_hash", seen.withColumn("lang", other), model)
        scored = scored.drop("ppl").join(total.hint("merge"), ["lang", "text_hash"], "left")
    return scored.withColumn("lang", F.substring("lang", 3, 1 << 30))


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, the base counts, ppl, base_failed and kept for every row of doc_id, lang and text."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    scored = measure(docs).withColumn("base_failed", failed)
    log = F.log("ppl")
    texts = scored.filter("not base_failed and ppl is not null").groupBy("lang", "text_hash").agg(F.min("ppl").alias("ppl"), F.min("n_words").alias("n_words"))
    texts = materialise(texts, "texts")
    middle = materialise(texts.groupBy("lang").agg(F.percentile_approx(log, 0.5, 10000).alias("middle")), "middle")
    few = middle.count() <= BROADCAST_ROWS  # one row a language
    of = lambda one: F.broadcast(one) if few else one.hint("merge")
    off = (log - F.col("middle")) * F.sqrt("n_words")
    width = texts.join(of(middle), "lang").groupBy("lang").agg(F.percentile_approx(off, [0.25, 0.75], 10000).alias("q"), F.first("middle").alias("middle"))
    bands = materialise(width.select("lang", "middle", (F.col("q")[0] * LOWER).alias("under"), (F.col("q")[1] * UPPER).alias("over")), "bands")
    judged = scored.join(of(bands), "lang", "left")
    inside = F.coalesce(off.between(F.col("under") - 1e-9, F.col("over") + 1e-9), F.lit(True))
    end = lambda c: F.exp(F.col("middle") + F.col(c) / F.sqrt(F.greatest("n_words", F.lit(1)))).alias
    return judged.select("doc_id", "text_hash", *BASE, "ppl", end("under")("low"), end("over")("high"), "base_failed", (~F.col("base_failed") & inside).alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    gone = materialise(verdicts(docs).filter("not kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th")).distinct(), "rejected")
    key = fresh(docs.columns, "_text_hash")
    gone = gone.withColumnRenamed("_th", key + "_r")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone.hint("merge")
    left = docs.withColumn(key, F.xxhash64("text"))
    return left.join(gone, left["doc_id"].eqNullSafe(gone["_id"]) & (left[key] == gone[key + "_r"]), "left_anti").drop(key)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents")).select("doc_id", *BASE, "base_failed", "kept", F.round("ppl", 4).alias("ppl"))
