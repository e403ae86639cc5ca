"""Similarity join of documents on word shingles, by token-combination prefixes.

A document is the set of hashes of its k-word shingles. With Jaccard similarity t, at most
e = n - ceil(t n) of a set's n tokens are missing in a partner. The first tokens of a set by hash are
its index tokens; a token that FREQUENT or more sets have among theirs is frequent, others are rare.

- A set with e + 1 rare tokens among its first index tokens has these as its prefix, and any partner
  has one of them: it is indexed by single rare tokens. Index tokens reach far enough down that a
  partner, which may be somewhat larger, has that token among its own index tokens.
- The other sets, which consist of frequent tokens for the most part, are joined with each other by
  extended prefixes. Their tokens are counted among them; the u tokens of a set that no other has
  are missing in any partner. The others are ordered by count, and the prefix is extended until

      rare tokens + sum over sub-classes of frequent tokens of (tokens in it - 1) > e - u,

  so that partners must share a rare token or two tokens of one sub-class: single rare tokens and
  pairs of frequent tokens are indexed. Sub-classes depend on a size band; a set indexes its pairs for
  every band in which a partner of its can lie. Of two such sets, at most min(n - u) tokens are common.

No link is lost, whichever tokens are called frequent.

Equal sets are one representative from the start. Buckets of the index are not expanded into pairs:
each set first meets the one smallest member that it shares most buckets with, sets with frequent tokens
also the other smallest members; links found are contracted to components, and members of different
components that still share a bucket are compared last. Two sets indexed by rare tokens alone whose
prefixes share c tokens can have c and what lies beyond a prefix in common at most; where that is too
little they aren't compared. Nor are sets whose parity bitmaps differ in too many bits: tokens flip one of
64 WORDS bits, so at least as many tokens as bits are in one set alone. All comparisons are exact. Every stage is a table in the shared folder.

Equal sets are known by their digest, and represented by the smallest doc_id that has one. Where several
sets have the same such doc_id, all but one get a number that is no doc_id; the sets of one doc_id are linked.

Edge cases: a null or empty text has no shingles and is alone; fewer than k words are one shingle; rows
with the same doc_id are one document of possibly several sets; a null doc_id is linked with nothing and
has a null component. An empty table gives no rows. Other columns are carried by ``keep_one`` only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusspark.llm.common import BROADCAST_ROWS, batches_of, join_per_key, materialise, table, text_batches, union_all
from corpusspark.llm.textops import U64, chunks, give_back, hashes, mix, shingles, utf8, words

#: Sets that have a token among their index tokens, from which it counts as frequent.
FREQUENT = 12
#: The first index tokens of a set: on average so many times its prefix, so many deviations, and so many more.
POOL, POOL_DEVIATIONS, POOL_MORE = 1.2, 2.5, 6
#: Words of 64 bits of a set's parity bitmap.
WORDS = 8
#: Tokens of a size band for each sub-class of frequent tokens.
PER_CLASS = 12
#: Members of a bucket that meet all of its others in one task.
SPLIT = 1000


class Threshold:
    """Jaccard similarity of at least ``num / den``; over one half."""

    def __init__(self, num: int, den: int):
        if not 2 * num > den or num > den:
            raise ValueError("the threshold must be over 0.5 and at most 1")
        self.num, self.den = num, den

    def missing(self, n):
        """Tokens of a set of n that a partner may lack."""
        return n - -(-self.num * n // self.den)

    def bound(self, n: np.ndarray) -> np.ndarray:
        """The hash below which the first index tokens of a set of n tokens lie; it falls as n grows."""
        prefix = (1 - self.num / self.den) * n + 2
        share = np.minimum(1.0, (POOL * prefix + POOL_DEVIATIONS * np.sqrt(prefix) + POOL_MORE) / np.maximum(n, 1))
        return np.where(share >= 1, 2.0**63, (share - 0.5) * 2.0**64)

    def room(self, n: str, m: str, a: str, b: str) -> str:
        """SQL: whether sets of n and m tokens of which a and b may be common can be linked."""
        least = f"least({a}, {b})"
        return f"({self.den} * {least} >= {self.num} * ({n} + {m} - {least}))"

    def possible(self, shared: str, n: str, m: str) -> str:
        """SQL: whether sets of n and m tokens whose prefixes of rare tokens share so many may be linked."""
        beyond = lambda x: f"(({x} * {self.num} + {self.den - 1}) div {self.den} - 1)"
        most = f"({shared} + greatest({beyond(n)}, {beyond(m)}))"
        return f"({self.den} * {most} >= {self.num} * ({n} + {m} - {most}))"

    def alike(self, n: str, m: str, x: str, y: str) -> str:
        """SQL: whether sets of n and m tokens with the parity bitmaps x and y may be linked."""
        apart = " + ".join(f"bit_count({x}[{k}] ^ {y}[{k}])" for k in range(WORDS))
        most = f"(({n} + {m} - ({apart})) div 2)"
        return f"({self.den} * {most} >= {self.num} * ({n} + {m} - {most}))"

    def linked(self, common, a, b):
        return self.den * common >= self.num * (a + b - common)

    def bands(self, n: int) -> range:
        """Numbers of the size bands that a set of n tokens and its partners can be in."""
        low, high = -(-self.num * n // self.den), n * self.den // self.num
        return range(low.bit_length() - 1, high.bit_length())


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted tokens of some rows one set after the other, where each begins, with the end)."""
    data, offsets = utf8(batch.column("text"))
    for i, j, part, at in chunks(data, offsets):
        starts, ends, row = words(part, at)
        token, owner = shingles(hashes(part, starts, ends, lower=True), row, k)
        token = token.view(np.int64)
        order = np.lexsort((token, owner))
        token, owner = token[order], owner[order]
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        token, owner = token[new], owner[new]
        yield i, token, np.searchsorted(owner, np.arange(j - i + 1))


def index_tokens(docs: DataFrame, k: int, t: Threshold) -> DataFrame:
    """doc_id, the text's hash, n, two halves of the set's digest, its index tokens in order, how many of
    them are the first, and its parity bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, token, begin in _sets(batch, k):
                n = np.diff(begin)
                u = token.view(np.uint64)
                halves = []
                for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                    sums = np.concatenate((np.zeros(1, dtype=U64), np.cumsum(mix(u ^ U64(salt)), dtype=U64)))
                    halves.append((sums[begin[1:]] - sums[begin[:-1]]).view(np.int64))
                # Tokens below each set's bounds: its first index tokens, and all that a partner's first may be.
                row = np.repeat(np.arange(len(n)), n)
                low = token.astype(np.float64)
                flips = np.zeros(len(n) * WORDS, dtype=U64)
                bit = mix(u ^ U64(0xA0761D6478BD642F))
                np.bitwise_xor.at(flips, row * WORDS + (bit >> U64(6) & U64(WORDS - 1)).astype(np.int64), U64(1) << (bit & U64(63)))
                bits = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flips) + 1, WORDS, dtype=np.int32)), pa.array(flips.view(np.int64)))
                own = np.bincount(row, low < t.bound(n)[row], len(n)).astype(np.int64)
                size = np.bincount(row, low < t.bound(n * t.num // t.den)[row], len(n)).astype(np.int64)
                at = np.concatenate(([0], np.cumsum(size)))
                pick = np.repeat(begin[:-1] - at[:-1], size) + np.arange(at[-1])
                pool = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(token[pick]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, len(n)), batch.column("th").slice(i, len(n)), pa.array(n), *map(pa.array, halves), pool, pa.array(own), bits], ["doc_id", "th", "n", "d1", "d2", "pool", "own", "bits"])
            give_back()

    text_batches(docs.sparkSession)
    return _rows(docs).mapInArrow(run, "doc_id long, th long, n long, d1 long, d2 long, pool array<long>, own long, bits array<long>")


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


class Source:
    """Where the full sets come from: the documents, and, if a doc_id occurs more than once, the doc_id and text
    of each class."""

    def __init__(self, docs: DataFrame, k: int, classes: DataFrame | None):
        self.docs, self.k, self.classes = docs, k, classes

    def full_sets(self, ids: DataFrame, name: str) -> DataFrame:
        """id, n and the sorted tokens, as bytes, of the classes with these ids, as a written table."""
        rows, k = _rows(self.docs), self.k
        few = ids.count() <= BROADCAST_ROWS
        if self.classes is None:
            ids = ids.select(F.col("id").alias("doc_id"))
            rows = rows.join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id", "left_semi").withColumn("id", F.col("doc_id"))
        else:
            ids = ids.join(self.classes.hint("merge"), "id")
            rows = rows.join(F.broadcast(ids) if few else ids.hint("merge"), ["doc_id", "th"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, token, begin in _sets(batch, k):
                    own = [token[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, len(own)), pa.array(np.diff(begin)), pa.array(own, pa.binary())], ["id", "n", "tokens"])
                give_back()

        out = rows.select("id", "text").mapInArrow(run, "id long, n long, tokens binary")
        return materialise(out if self.classes is None else out.dropDuplicates(["id"]), name)


def signatures(token: np.ndarray, count: np.ndarray, n: int, t: Threshold) -> np.ndarray:
    """All signatures of a set of n tokens, given those that other sets of the join have too, and in how many
    sets each is. Empty if too many of the set's tokens are its own for it to have a partner."""
    need = t.missing(n) - (n - len(token)) + 1
    if need < 1:
        return np.zeros(0, dtype=np.int64)
    order = np.lexsort((token, count))
    token, frequent = token[order], count[order] >= FREQUENT
    rare = token[~frequent]
    if len(rare) >= need:
        return rare[:need]
    common, out = token[frequent].view(np.uint64), [rare]
    for band in t.bands(n):
        classes = max(1, (1 << band) // PER_CLASS)
        own = (mix(common) % U64(classes)).astype(np.int64)
        gain = np.ones(len(common), dtype=np.int64)
        gain[np.unique(own, return_index=True)[1]] = 0
        stop = int(np.searchsorted(len(rare) + np.cumsum(gain), need)) + 1
        order = np.argsort(own[:stop], kind="stable")
        sorted_class, sorted_token = own[:stop][order], common[:stop][order]
        # Pairs within a sub-class: each token with those that follow it at one distance after another.
        gap = 1
        while True:
            same = np.flatnonzero(sorted_class[gap:] == sorted_class[:-gap]) if gap < stop else np.zeros(0, dtype=int)
            if not len(same):
                break
            a, b = sorted_token[same], sorted_token[same + gap]
            out.append(mix(np.minimum(a, b) * U64(3) + np.maximum(a, b) * U64(0x9E3779B97F4A7C15) + U64(band + 1)).view(np.int64))
            gap += 1
    return np.concatenate(out)


def index(source: Source, reps: DataFrame, t: Threshold) -> DataFrame:
    """sig, id, short, most: the signatures that representatives (id, n, own, pool) may share, whether a set
    needs frequent tokens, and how many of its tokens another such set may have."""
    tokens = reps.select("id", "n", "own", F.posexplode("pool").alias("pos", "token"))
    shared = materialise(tokens.groupBy("token").count().filter("count > 1"), "shared", free=True)
    met = tokens.join(shared.hint("merge"), "token").withColumn("often", (F.col("count") >= FREQUENT).cast("int"))
    own = Window.partitionBy("id")  # at most the index tokens of one set
    need = F.expr(f"n - (n * {t.num} + {t.den - 1}) div {t.den} + 1")
    met = met.withColumns({
        "before": F.coalesce(F.sum("often").over(own.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "all_often": F.sum(F.when(F.col("pos") < F.col("own"), F.col("often")).otherwise(0)).over(own), "need": need,
    }).withColumn("short", F.col("own") - F.col("all_often") < F.col("need"))
    met = materialise(met.filter("short or often = 0").select("id", "n", "token", "short", (F.col("pos") - F.col("before")).alias("rank"), "often", "need", (F.col("pos") < F.col("own")).alias("first")), "met", free=True)
    few = reps.filter(F.col("own") < need).select("id")
    short = materialise(met.filter("short").select("id").union(few).distinct(), "short")
    # Rare tokens: of other sets their prefix, of short sets all that may be in another's prefix.
    single = met.filter("often = 0 and (short or (first and rank < need))").select(F.col("token").alias("sig"), "id", "short", F.col("n").alias("most"))
    sets = source.full_sets(short, "short_sets")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own, raw in zip(pdf["id"], pdf["tokens"], strict=True):
                token = np.frombuffer(raw, dtype=np.int64)
                yield pd.DataFrame({"id": np.full(len(token), own), "n": len(token), "token": token})
            give_back()

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own, n, token, count in zip(pdf["id"], pdf["n"], pdf["token"], pdf["count"], strict=True):
                sig = np.unique(signatures(np.asarray(token, dtype=np.int64), np.asarray(count, dtype=np.int64), int(n), t))
                yield pd.DataFrame({"sig": sig, "id": np.full(len(sig), own), "most": np.full(len(sig), len(token))})
            give_back()

    rows = sets.mapInPandas(spread, "id long, n long, token long")
    common = materialise(rows.groupBy("token").count().filter("count > 1"), "common", free=True)
    rows = rows.join(common.hint("merge"), "token")
    rows = rows.groupBy("id", "n").agg(F.collect_list(F.struct("token", "count")).alias("c")).select("id", "n", "c.token", "c.count")  # one set
    pairs = materialise(rows.mapInPandas(sign, "sig long, id long, most long"), "combinations", free=True)
    most = pairs.groupBy("id").agg(F.max("most").alias("m"))
    # A set with too many tokens of its own has no partner among the short ones, but may have one among the others.
    single = single.join(most.hint("merge"), "id", "left").withColumn("most", F.when(F.col("short"), F.coalesce("m", F.lit(0))).otherwise(F.col("most"))).drop("m")
    return single.unionByName(pairs.withColumn("short", F.lit(True)).select("sig", "id", "short", "most"))


class Sets:
    """The full sets of the classes compared so far."""

    def __init__(self, source: Source):
        self.source, self.known = source, None

    def of(self, pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        if self.known is not None:
            ids = ids.join(self.known.select("id").hint("merge"), "id", "left_anti")
        ids = materialise(ids, "compared")
        if self.known is None or ids.head(1):
            new = self.source.full_sets(ids, "full_sets")
            self.known = new if self.known is None else self.known.unionByName(new)
        return self.known


#: Sets in one block: each set meets a block's others in one task.
BLOCK = 256
#: Sets that cross to a Python worker at once.
BATCH = 500


def verified(pairs: DataFrame, known: Sets, t: Threshold) -> DataFrame:
    """The pairs a, b of a written table that are linked.

    Sets are dealt to blocks; a set travels once to each pair of blocks in which it has pairs, not once a pair."""
    if not pairs.head(1):
        return pairs
    sets = known.of(pairs)
    blocks = max(1, known.known.count() // BLOCK)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    pairs = pairs.withColumn("g", F.least(block("a"), block("b")) * blocks + F.greatest(block("a"), block("b")))
    wanted = pairs.select("g", F.explode(F.array("a", "b")).alias("id")).distinct()
    rows = wanted.join(sets.select("id", "tokens").hint("merge"), "id").select("g", F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "tokens")
    rows = rows.unionByName(pairs.select("g", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("tokens")))
    rows = rows.repartition("g").sortWithinPartitions("g", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, {}
        for pdf in batches:
            found = []
            for g, kind, a, b, tokens in zip(pdf["g"].array, pdf["kind"].array, pdf["a"].array, pdf["b"].array, pdf["tokens"].array, strict=True):
                if g != at:
                    at, held = g, {}
                if kind == 0:
                    held[int(a)] = np.frombuffer(tokens, dtype=np.int64)
                    continue
                x, y = held[int(a)], held[int(b)]
                if len(x) > len(y):
                    x, y = y, x
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if t.linked(common, len(x), len(y)):
                    found.append((int(a), int(b)))
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])
        held = {}
        give_back()

    with batches_of(pairs.sparkSession, BATCH):
        return materialise(rows.mapInPandas(run, "a long, b long"), "linked", free=True)


def components(edges: DataFrame) -> DataFrame:
    """id, label: the smallest id that each id of the edges a, b reaches.

    Each round hooks every id to its smallest neighbour, shortens the chains by doubling, and goes on
    with the edges between the roots; it halves the components at least."""
    edges = materialise(edges.filter("a != b").select("a", "b"), "edges")
    label = None
    while edges.head(1):
        both = edges.union(edges.select("b", "a"))
        parent = materialise(both.groupBy("a").agg(F.min("b").alias("p"), F.count(F.lit(1)).alias("deg")).select(F.col("a").alias("id"), F.least("a", "p").alias("p")), "parent")
        while True:
            up = parent.select(F.col("id").alias("p"), F.col("p").alias("pp"))
            width = parent.groupBy("p").agg(F.count(F.lit(1)).alias("w"))
            weighted = materialise(up.join(width.hint("merge"), "p"), "up")
            jumped = materialise(join_per_key(parent, weighted, ["p"], "w").select("id", F.col("p"), "pp"), "jumped")
            moved = jumped.filter("p != pp").head(1)
            parent = jumped.select("id", F.col("pp").alias("p"))
            if not moved:
                break
        root = parent.withColumnRenamed("p", "label")
        if label is None:
            label = root
        else:
            label = label.join(root.select(F.col("id").alias("label"), F.col("label").alias("next")).hint("merge"), "label", "left").select("id", F.coalesce("next", "label").alias("label"))
            label = materialise(label, "label")
        mapped = edges.join(root.select(F.col("id").alias("a"), F.col("label").alias("la")).hint("merge"), "a").join(root.select(F.col("id").alias("b"), F.col("label").alias("lb")).hint("merge"), "b")
        edges = materialise(mapped.filter("la != lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
    return label if label is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("label"))


def _label_of(rows: DataFrame, label: DataFrame, column: str, out: str) -> DataFrame:
    named = label.select(F.col("id").alias(column), F.col("label").alias(out))
    return rows.join(named.hint("merge"), column, "left").withColumn(out, F.coalesce(out, column))


def _own_ids(classes: DataFrame) -> DataFrame:
    """Written classes with an id that no other has: the doc_id, or where another class has that too, a number
    outside the doc_ids."""
    first = classes.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("f"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    low, high = classes.agg(F.min("doc_id"), F.max("doc_id")).first()
    number = F.monotonically_increasing_id()  # once for all, as the table is written
    fresh = F.lit(low - 1) - number if low > -(1 << 61) else F.lit(high + 1) + number
    same = F.col("f").isNull() | (F.struct("d1", "d2") == F.col("f"))
    met = join_per_key(classes, materialise(first, "first"), ["doc_id"], "c", "left")
    return materialise(met.withColumn("id", F.when(same, F.col("doc_id")).otherwise(fresh)).drop("f", "c"), "numbered")


def _same_documents(some: DataFrame, repeats: DataFrame, classes: DataFrame) -> DataFrame:
    """Links a, b between the classes of one doc_id, for written rows, doc_ids that occur more than once, and classes."""
    named = materialise(classes.select("d1", "d2", "w", "id"), "named")
    several = repeats.filter("lo != hi").select("doc_id", "c", "lo.d1", "lo.d2")
    several = join_per_key(materialise(several, "several"), named, ["d1", "d2"], "w").select("doc_id", "c", F.col("id").alias("a"))
    rows = join_per_key(some.select("doc_id", "d1", "d2"), materialise(several, "several"), ["doc_id"], "c").select("a", "d1", "d2").distinct()
    return join_per_key(materialise(rows, "rows"), named, ["d1", "d2"], "w").filter("a != id").select("a", F.col("id").alias("b")).distinct()


def link(docs: DataFrame, k: int, t: Threshold) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of doc_id and text."""
    every = materialise(index_tokens(docs, k, t), "sets")
    some = every.filter("n > 0 and doc_id is not null")
    classes = some.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "th", "n", "own", "pool", "bits")).alias("r"), F.count(F.lit(1)).alias("w"))
    classes = materialise(classes.select("d1", "d2", "w", "r.*").withColumn("id", F.col("doc_id")), "classes", free=True)
    digest = F.struct("d1", "d2")
    repeats = some.groupBy("doc_id").agg(F.min(digest).alias("lo"), F.max(digest).alias("hi"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    repeats = materialise(repeats, "repeats", free=True)
    several = bool(repeats.head(1))
    if several:
        classes = _own_ids(classes)
    source = Source(docs, k, classes.select("id", "doc_id", "th") if several else None)
    sigs = index(source, classes.select("id", "n", "own", "pool"), t)
    sigs = materialise(sigs.join(classes.select("id", "n").hint("merge"), "id"), "signatures", free=True)
    me = F.struct("id", "n", "short", "most")
    buckets = materialise(sigs.groupBy("sig").agg(F.min(me).alias("p"), F.count(F.lit(1)).alias("c")).filter("c > 1"), "buckets")
    members = materialise(join_per_key(sigs, buckets, ["sig"], "c"), "members", free=True)
    sets = Sets(source)

    def may(n: str, short: str, most: str, m: str, m_short: str, m_most: str, shared: str | None = None) -> str:
        """SQL: whether two sets may be linked, by their sizes, their common tokens at most, and their shared buckets."""
        fits = f"{n} * {t.den} >= {m} * {t.num} and {m} * {t.den} >= {n} * {t.num}"
        both = f"(not ({short} and {m_short}) or {t.room(n, m, most, m_most)})"
        return f"{fits} and {both}" + (f" and ({short} or {m_short} or {t.possible(shared, n, m)})" if shared else "")

    # The smallest members that a set meets, and in how many buckets.
    met = members.filter("p.id != id").groupBy("id", "n", "short", "most", "p").agg(F.count(F.lit(1)).alias("shared"))
    met = met.filter(may("n", "short", "most", "p.n", "p.short", "p.most", "shared"))
    met = materialise(met.select("id", "short", F.col("p.id").alias("a"), F.col("p.short").alias("a_short"), "shared"), "met", free=True)
    # One comparison for each set; then, for sets with frequent tokens, with the others in other components.
    best = met.groupBy("id").agg(F.max(F.struct("shared", -F.col("a"))).alias("m")).select((-F.col("m.col2")).alias("a"), F.col("id").alias("b"))
    label = components(verified(materialise(best, "pairs"), sets, t))
    apart = met.filter("short or a_short").select("a", F.col("id").alias("b"))
    apart = _label_of(_label_of(apart, label, "a", "la"), label, "b", "lb").filter("la != lb").select("a", "b")
    label = _merge(label, verified(materialise(apart, "pairs", free=True), sets, t))
    # Last, all that share a bucket and are in different components.
    named = materialise(_label_of(members.select("sig", "id", "n", "short", "most"), label, "id", "l"), "named", free=True)
    mixed = named.groupBy("sig").agg(F.min("l").alias("l0"), F.max("l").alias("l1"), F.count(F.lit(1)).alias("c")).filter("l0 != l1")
    mixed = join_per_key(named, materialise(mixed.select("sig", "c"), "mixed"), ["sig"], "c").join(classes.select("id", "bits").hint("merge"), "id")
    mixed = materialise(mixed.withColumn("parts", F.expr(f"cast(1 + c div {SPLIT} as int)")).drop("c"), "mixed_members", free=True)
    # A large bucket is cut in parts: each member is in one, and meets the members of all.
    one = mixed.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    other = mixed.select("sig", F.col("id").alias("a"), F.col("n").alias("na"), F.col("short").alias("sa"), F.col("most").alias("ma"), F.col("l").alias("la"), F.col("bits").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rest = one.alias("x").join(other.hint("merge").alias("y"), F.expr(f"x.sig = y.sig and x.part = y.part and a < id and la != l and {may('n', 'short', 'most', 'na', 'sa', 'ma')} and {t.alike('n', 'na', 'bits', 'y.b')}"))
    rest = rest.select("a", "id", "n", "na", "short", "sa").groupBy("a", F.col("id").alias("b"), "n", "na", (F.col("short") | F.col("sa")).alias("either")).agg(F.count(F.lit(1)).alias("shared"))
    rest = materialise(rest.filter(f"either or {t.possible('shared', 'n', 'na')}").select("a", "b"), "pairs", free=True)
    label = _merge(label, verified(rest, sets, t))

    if several:
        label = _merge(label, _same_documents(some, repeats, classes))
    named = materialise(_label_of(classes.select("d1", "d2", "w", "id", "doc_id"), label, "id", "component_id"), "component")
    if several:  # the smallest number of a component may be no doc_id
        least = named.groupBy("component_id").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c"))
        named = materialise(join_per_key(named, materialise(least, "least"), ["component_id"], "c").withColumn("component_id", F.col("least")), "component")
    known = join_per_key(some, named.select("d1", "d2", "w", "component_id"), ["d1", "d2"], "w")
    alone = every.filter("n = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    out = union_all([x.select("doc_id", F.col("n").alias("n_shingles"), "component_id") for x in (known, alone)])
    return out


def _merge(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links between ids."""
    links = materialise(links, "links")
    if not links.head(1):
        return label
    edges = _label_of(_label_of(links, label, "a", "la"), label, "b", "lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    root = components(edges)
    old = label.select("id", "label").union(root.select("id", F.col("id").alias("label"))).distinct()
    return materialise(_label_of(old, root, "label", "top").groupBy("id").agg(F.min("top").alias("label")), "label")


def keep_one(docs: DataFrame, k: int = 5, t: Threshold | None = None) -> DataFrame:
    """``docs`` without the documents that are linked, over any chain, to one with a smaller doc_id."""
    found = link(docs, k, t or Threshold(80, 100))
    gone = materialise(found.filter("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone.hint("merge")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents").select("doc_id", "text"), 4, Threshold(85, 100))
