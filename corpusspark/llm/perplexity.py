"""A character n-gram language model with modified Kneser-Ney smoothing, counted by Spark.

N-grams of ORDER characters are packed into one integer (12 bits a symbol; most characters are one). Tasks count those of
their rows and Spark adds up the counts of all documents, one model for each value of ``lang``, which may
be a language or a language and a fold; lower orders are continuation counts of the order above.
Probabilities are made by joins and windows over the count tables. The finished model is kept in arrays
sorted by a 64-bit hash of the n-gram (a bijection, so no two n-grams share one), in which whole texts are
looked up at once. The arrays are made by ranges of the hash, so no task holds a whole order. While the
model has at most MODEL_ENTRIES n-grams it is sent to every executor; a larger one stays a table that the
documents' n-grams are joined to, with the same results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusspark.llm.common import join_per_key, materialise, text_batches, union_all
from corpusspark.llm.textops import U64, give_back, mix

ORDER = 5
BITS = 12
#: N-grams of all languages and orders that are sent to executors (about 12 bytes each).
MODEL_ENTRIES = 8_000_000
#: N-grams of one range of hashes, on average.
SHARD = 100_000
#: Distinct n-grams that a task holds before it hands on what it has counted.
HELD = 1_000_000
CHUNK = 400_000
PAD, SPACE, END = 0, 1, 2
#: Characters from here on are two symbols, a quotient and a rest, so that each has its own.
PLAIN, BASE = 1984, 1055
NO_LANG = ""


def code_points(text: str) -> np.ndarray:
    """Lower-cased characters as symbols under 2**BITS: white space runs as one, digits alike, characters from PLAIN
    on as two symbols."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    space = (codes <= 32) & ((codes == 32) | (codes >= 9) & (codes <= 13))
    codes = np.where(space, SPACE, np.where((codes >= 48) & (codes <= 57), 48, np.where(codes <= END, 3, codes)))
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    codes = codes[keep]
    far = codes >= PLAIN
    if far.any():
        own = codes[far]
        last = np.cumsum(1 + far) - 1  # the place of each character's last symbol
        out = np.empty(len(codes) + len(own), dtype=np.int64)
        out[last] = np.where(far, PLAIN + codes % BASE, codes)
        out[last[far] - 1] = PLAIN + BASE + own // BASE
        return out
    return codes


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-gram ending at every character of every text and at its end, and the row of each."""
    pad = np.zeros(ORDER - 1, dtype=np.int64)
    parts, sizes = [], []
    for t in texts:
        own = code_points(t)
        parts += [pad, own, [END]]
        sizes.append(len(own) + 1)
    codes = np.concatenate(parts).astype(U64)
    packed = np.zeros(len(codes), dtype=U64)
    for k in range(ORDER):
        packed[k:] |= codes[:len(codes) - k] << U64(BITS * k)
    row = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(row)) + (ORDER - 1) * (row + 1)
    return packed[at], row


def text_runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of rows of about CHUNK characters; a row stays whole."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= CHUNK:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of lang and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(lang):
            keys, counts = (np.concatenate(x) for x in zip(*held[lang], strict=True))
            unique, where = np.unique(keys, return_inverse=True)
            held[lang] = [(unique, np.bincount(where, counts, len(unique)).astype(np.int64))]
            return held[lang][0]

        def flush():
            for lang in list(held):
                keys, counts = merged(lang)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(counts)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                for a, b in text_runs(own):
                    held.setdefault(lang, []).append(np.unique(grams(own[a:b])[0], return_counts=True))
                    if len(held[lang]) >= 8:
                        merged(lang)
            if sum(len(k) for x in held.values() for k, _ in x) > HELD:
                for lang in list(held):
                    merged(lang)
                if sum(len(k) for x in held.values() for k, _ in x) > HELD:
                    yield from flush()
            give_back()
        yield from flush()
        give_back()

    text_batches(docs.sparkSession)
    rows = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).filter("text != ''")
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(types: DataFrame) -> DataFrame:
    """d1, d2, d3 for each language from the counts of counts; without enough of them, plain absolute discounts."""
    n = types.groupBy("lang").agg(*[F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    fine = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    raw = [1 - 2 * y * F.col("n2") / F.col("n1"), 2 - 3 * y * F.col("n3") / F.col("n2"), 3 - 4 * y * F.col("n4") / F.col("n3")]
    return n.select("lang", *[F.when(fine, F.least(F.lit(0.95 * k), F.greatest(F.lit(0.05), x))).otherwise(0.5 * k).alias(f"d{k}") for k, x in enumerate(raw, 1)])


def mask(k: int) -> int:
    return (1 << BITS * k) - 1


def fit(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The model as a table: lang, k (order), kind, gram, value. Of kind p, the value is the log probability
    of the n-gram's last character given the others; of kind b, it is the log weight that falls to the order
    below when the next character after the n-gram is new. Second, lang, gram, n: the counts it was made from."""
    types = materialise(count_grams(docs), "grams")
    orders = {ORDER: types}
    for k in range(ORDER - 1, 0, -1):
        orders[k] = orders[k + 1].groupBy("lang", F.col("gram").bitwiseAND(mask(k)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    below, parts = None, []
    for k in range(1, ORDER + 1):
        context = Window.partitionBy("lang", "context")  # at most 2**BITS rows: the characters that can follow
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = orders[k].join(F.broadcast(_discounts(orders[k])), "lang").withColumn("context", F.shiftright("gram", BITS))  # one row a language and fold
        rows = rows.withColumns({"d": d, "total": F.sum("n").over(context), "kinds": F.count(F.lit(1)).over(context)})
        rows = rows.withColumn("b", F.sum("d").over(context) / F.col("total"))
        if below is None:
            rows = rows.withColumn("lower", 1 / (F.col("kinds") + 1))
        else:
            lower = below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND(mask(k - 1))).join(lower.hint("merge"), ["lang", "suffix"])
        below = materialise(rows.select("lang", "gram", "context", "b", ((F.col("n") - F.col("d")) / F.col("total") + F.col("b") * F.col("lower")).alias("p")), f"order{k}")
        parts.append(below.select("lang", F.lit(k).alias("k"), F.lit("p").alias("kind"), "gram", F.log("p").cast("float").alias("value")))
        contexts = below.groupBy("lang", "context").agg(F.max("b").alias("b"))
        parts.append(contexts.select("lang", F.lit(k).alias("k"), F.lit("b").alias("kind"), F.col("context").alias("gram"), F.log("b").cast("float").alias("value")))
    return materialise(union_all(parts), "model"), types


def logp_of(wanted: DataFrame, model: DataFrame) -> DataFrame:
    """lang, gram, logp for each distinct lang and gram of ``wanted``, by joins: what ``Arrays.logp`` gives."""
    alphabet = model.filter("k = 1 and kind = 'p'").groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"))
    rows = wanted.join(F.broadcast(alphabet), "lang").withColumns({"logp": F.lit(None).cast("double"), "handed": F.lit(0.0)})  # one row a language and fold
    for k in range(ORDER, 0, -1):
        level = lambda kind, key, k=k: model.filter((F.col("k") == k) & (F.col("kind") == kind)).select("lang", F.col("gram").alias(key), F.col("value").cast("double").alias(f"{kind}{k}")).hint("merge")
        rows = rows.withColumns({"own": F.col("gram").bitwiseAND(mask(k)), "context": F.shiftright(F.col("gram").bitwiseAND(mask(k)), BITS)})
        rows = rows.join(level("p", "own"), ["lang", "own"], "left").join(level("b", "context"), ["lang", "context"], "left")
        rows = rows.withColumns({
            "logp": F.coalesce("logp", F.col("handed") + F.col(f"p{k}")),
            "handed": F.col("handed") + F.coalesce(f"b{k}", F.lit(0.0)),
        }).drop("own", "context", f"p{k}", f"b{k}")
    return rows.select("lang", "gram", F.coalesce("logp", F.col("handed") - F.log(F.col("kinds") + 1)).alias("logp"))


def perplexities_by_join(rows: DataFrame, key: str, seen: DataFrame, model: DataFrame) -> DataFrame:
    """lang, ``key``, ppl for rows of lang, ``key`` and text, one row a text; ``seen`` has lang, gram and n of all
    their n-grams, counted with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column("text").to_pylist()):
                gram, n = np.unique(grams([text])[0], return_counts=True)
                same = lambda c, size=len(gram), k=k: pa.repeat(batch.column(c)[k], size)
                yield pa.RecordBatch.from_arrays([same("lang"), same(key), pa.array(gram.astype(np.int64)), pa.array(n)], ["lang", key, "gram", "n"])

    own = materialise(rows.select("lang", key, "text").mapInArrow(run, f"lang string, {key} long, gram long, n long"), "text_grams")
    values = materialise(logp_of(seen.select("lang", "gram"), model), "logp").join(seen.withColumnRenamed("n", "w").hint("merge"), ["lang", "gram"])
    met = join_per_key(own, materialise(values, "logp_n"), ["lang", "gram"], "w")
    return met.groupBy("lang", key).agg(F.exp(-F.sum(F.col("n") * F.col("logp")) / F.sum("n")).alias("ppl"))


class Arrays:
    """One language's model: for each order, hashes in order with log probabilities, and contexts with log weights."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    @staticmethod
    def find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted), dtype=np.float32)
        hashed = mix(wanted).view(np.int64)
        at = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
        return keys[at] == hashed, values[at]

    def logp(self, gram: np.ndarray) -> np.ndarray:
        """Log probability of the last character of each n-gram given the ones before it."""
        out = np.zeros(len(gram))
        todo = np.arange(len(gram))
        for k in range(len(self.levels), 0, -1):
            keys, logp, contexts, logb = self.levels[k - 1]
            own = gram[todo] & U64((1 << BITS * k) - 1)
            there, value = self.find(keys, logp, own)
            out[todo[there]] += value[there]
            todo, own = todo[~there], own[~there]
            if not len(todo):
                break
            there, value = self.find(contexts, logb, own >> U64(BITS))
            out[todo[there]] += value[there]
        out[todo] += -np.log(len(self.levels[0][0]) + 1)
        return out


PACKED = "lang string, k int, kind string, keys binary, vals binary"


def packed(model: DataFrame) -> list[tuple[str, int, str, bytes, bytes]]:
    """The model's sorted arrays as bytes, made by executors in ranges of the hash: each range of a language, order
    and kind is one row or some that follow each other. The model's size must have been checked."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = mix(batch.column("gram").to_numpy().astype(U64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "k", "kind", "value")), pa.array(keys)], ["lang", "k", "kind", "value", "key"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # sorted by lang, k, kind, key
            names = [list(x) for x in zip(*(batch.column(c).to_pylist() for c in ("lang", "k", "kind")), strict=True)]
            cuts = [k for k in range(len(names)) if not k or names[k] != names[k - 1]] + [len(names)]
            keys, vals = batch.column("key").to_numpy(), batch.column("value").to_numpy()
            rows = [(*names[a], keys[a:b].tobytes(), vals[a:b].astype(np.float32).tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "k", "kind", "keys", "vals"])

    bits = max(1, (model.count() // SHARD).bit_length())
    rows = model.mapInArrow(hashed, "lang string, k int, kind string, value float, key long").withColumn("range", F.shiftright("key", 64 - bits))
    rows = rows.repartition("lang", "k", "kind", "range").sortWithinPartitions("lang", "k", "kind", "key")
    return [(r["lang"], r["k"], r["kind"], bytes(r["keys"]), bytes(r["vals"])) for r in rows.drop("range").mapInArrow(pack, PACKED).collect()]


def load(rows: list[tuple[str, int, str, bytes, bytes]]) -> dict[str, Arrays]:
    """The arrays of ``packed``, by language. A task's rows may hold parts of several ranges, so ranges are sorted once more."""
    parts: dict[tuple, list] = {}
    for lang, k, kind, keys, vals in rows:
        parts.setdefault((lang, k, kind), []).append((np.frombuffer(keys, dtype=np.int64), np.frombuffer(vals, dtype=np.float32)))
    found = {}
    for name, own in parts.items():
        keys, vals = (np.concatenate(x) for x in zip(*sorted(own, key=lambda x: x[0][0]), strict=True))
        if (keys[1:] < keys[:-1]).any():
            order = np.argsort(keys)
            keys, vals = keys[order], vals[order]
        found[name] = (keys, vals)
    none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32))
    return {
        lang: Arrays([(*found.get((lang, k, "p"), none), *found.get((lang, k, "b"), none)) for k in range(1, ORDER + 1)])
        for lang in {x[0] for x in found}
    }


def perplexities(texts: list[str], langs: list[str], arrays: dict[str, Arrays]) -> np.ndarray:
    """Per character, of each text under its language's model; nan for an empty text or an unknown language."""
    out = np.full(len(texts), np.nan)
    for lang in sorted(set(langs) & set(arrays)):
        own = [k for k, x in enumerate(langs) if x == lang and texts[k]]
        some = [texts[k] for k in own]
        for a, b in text_runs(some):
            gram, row = grams(some[a:b])
            total = np.bincount(row, arrays[lang].logp(gram), b - a)
            out[own[a:b]] = np.exp(-total / np.bincount(row, minlength=b - a))
    return out
