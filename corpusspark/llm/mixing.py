"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

A document's topic is that of the nearest centroid, in a space of hashed words, of the documents that have a
topic label: each document gets one from its own text. Documents are counted into cells of source, language
and topic. Raking finds a factor for each source,
language and topic so that the weighted tokens have the target share in every margin. Sources may be
many: their factors stay in Spark, one row a source, and a sweep is one aggregation over these rows;
languages and topics are mostly few, and their factors then are values in the plan; with over MOST_PAIRS pairs
of them all factors are columns of the cells and a sweep is a join for each axis. A document's
inclusion probability is kappa times its cell's weight, with kappa such that the expected tokens are
``keep`` of all; where that is over 1, the cells under 1 are raked again until the expected tokens drawn
have the target margins. A value with fewer tokens than its target is drawn whole and the others share
what it lacks; ``margins`` lists targets and expected shares. Documents are drawn by a hash of their id, text and a seed, so a task that
runs again draws the same.

Edge cases: null source and language count as ''; a text without words, or any where no document with words
has a label, has topic ``none``; texts without words weigh nothing but are drawn with their cell's probability; repeated rows are drawn alike;
margins that cannot all be met are approached for SWEEPS sweeps. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusspark.llm.common import BROADCAST_ROWS, batches_of, fresh, hand_back, join_per_key, materialise, small_or_hinted, table, text_batches, union_all
from corpusspark.llm.textops import U64, chunks, give_back, hashes, utf8, words

#: Target shares are proportional to tokens to these powers: below 1 lifts what is rare.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.5}
#: Expected share of the tokens that is kept.
KEEP = 0.7
SWEEPS, TOLERANCE = 40, 1e-6
#: Sweeps when cells are cut at probability 1.
BOUNDED_SWEEPS = 60
#: Up to so many cells (28 bytes each) the driver makes these sweeps itself; more stay in Spark.
DRIVER_CELLS = 100_000
#: Pairs of language and topic that the driver's factors may cover.
MOST_PAIRS = 20_000
SEED = 17
AXES = ["source", "lang", "topic"]
#: Slots of the space of hashed words, and the most topics that have a centroid: those with the most labels.
SLOTS, MOST_TOPICS = 512, 2000
NO_TOPIC = "none"


def topics_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and topic from the labels of the documents' embeddings; of several, the smallest."""
    return table(spark, sf_dir, "embeddings").filter("vec_id is not null and label is not null").groupBy(F.col("vec_id").alias("_vec")).agg(
        F.concat(F.lit("t"), F.min("label")).alias("_topic")
    )


def word_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(unit vectors of dampened counts of hashed words, words) of some texts after the others."""
    data, offsets = utf8(column)
    for i, j, part, at in chunks(data, offsets, 300_000):
        starts, ends, row = words(part, at)
        slot = row * SLOTS + (hashes(part, starts, ends, lower=True) & U64(SLOTS - 1)).astype(np.int64)
        x = np.log1p(np.bincount(slot, minlength=(j - i) * SLOTS).reshape(j - i, SLOTS)).astype(np.float32)
        yield x / np.maximum(1e-9, np.sqrt((x * x).sum(axis=1, keepdims=True))), np.bincount(row, minlength=j - i)


class Topics:
    """Names in order, and their centroids as unit vectors."""

    def __init__(self, names: list[str], centroids: np.ndarray):
        self.names, self.centroids = names, centroids

    def of(self, column: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Topic and words of each text; of equally near centroids the first."""
        best, count = [], []
        for x, n in word_vectors(column):
            near = np.round(x @ self.centroids.T, 5).argmax(axis=1) if self.names else np.zeros(len(n), dtype=np.int64)
            best.append(np.where((n > 0) & bool(self.names), near, len(self.names)))
            count.append(n)
        names = pa.array([*self.names, NO_TOPIC])
        give_back()
        return names.take(pa.array(np.concatenate(best or [np.zeros(0, dtype=np.int64)]))), pa.array(np.concatenate(count or [np.zeros(0, dtype=np.int64)]))


def fit_topics(docs: DataFrame, labels: DataFrame) -> Topics:
    """Centroids of the labelled documents: labels has _vec (a doc_id) and _topic. What reaches the driver is at most
    MOST_TOPICS times SLOTS numbers."""
    labels = materialise(labels.select("_vec", "_topic"), "labels")
    most = labels.groupBy("_topic").count().orderBy(F.desc("count"), "_topic").limit(MOST_TOPICS).select("_topic")
    rows = docs.select(F.col("doc_id").alias("_vec"), "text").filter("text is not null").join(small_or_hinted(labels, labels.count()), "_vec").join(F.broadcast(most), "_topic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            topics, at = np.array(batch.column("_topic").to_pylist(), dtype=object), 0
            for x, n in word_vectors(batch.column("text")):
                own = topics[at:at + len(n)]
                at += len(n)
                for t in set(own.tolist()):
                    sums[t] = sums.get(t, 0) + x[own == t].sum(axis=0, dtype=np.float64)
        for t, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([t] * SLOTS), pa.array(np.arange(SLOTS)), pa.array(v)], ["topic", "slot", "x"])

    found = rows.select("_topic", "text").mapInArrow(run, "topic string, slot long, x double").groupBy("topic", "slot").agg(F.sum("x").alias("x")).filter("x > 0").toArrow()
    names = sorted(set(found.column("topic").to_pylist()))
    centroids = np.zeros((len(names), SLOTS))
    if names:
        place = {t: k for k, t in enumerate(names)}
        centroids[[place[t] for t in found.column("topic").to_pylist()], found.column("slot").to_numpy()] = found.column("x").to_numpy()
        centroids /= np.sqrt((centroids * centroids).sum(axis=1, keepdims=True))
        centroids -= centroids.mean(axis=0) if len(names) > 1 else 0  # what all topics share tells nothing
        centroids /= np.maximum(1e-9, np.sqrt((centroids * centroids).sum(axis=1, keepdims=True)))
    return Topics(names, np.round(centroids, 6).astype(np.float32))


def with_axes(docs: DataFrame, topics: Topics, narrow: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the three axes, the words and a hash of the text under names that clash with none of its own;
    ``narrow``: without the text."""
    text_batches(docs.sparkSession)
    name = {x: fresh(docs.columns, f"_{x}") for x in [*AXES, "tokens", "hash"]}
    state = docs.sparkSession.sparkContext.broadcast(topics)
    rows = docs.withColumns({name["source"]: F.coalesce("source", F.lit("")), name["lang"]: F.coalesce("lang", F.lit("")), name["hash"]: F.xxhash64("text")})
    kept = [f for f in rows.schema.fields if not (narrow and f.name == "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*own, *state.value.of(batch.column("text"))], [*(f.name for f in kept), name["topic"], name["tokens"]])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField(name["topic"], T.StringType()), T.StructField(name["tokens"], T.LongType())])), name


def targets(cells: DataFrame, axis: str, power: float) -> DataFrame:
    """value, share: the axis's target shares."""
    sums = cells.groupBy(F.col(axis).alias("value")).agg(F.sum("tokens").alias("t")).filter("t > 0").withColumn("share", F.pow("t", F.lit(power)))
    total = sums.agg(F.sum("share")).first()[0] or 1.0
    return sums.select("value", (F.col("share") / total).alias("share"))


def rake(cells: DataFrame, powers: dict[str, float] | None = None, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """source, lang, topic, tokens, docs, weight for each cell: target over observed share of the cell, so
    that the margins of weight times tokens are the targets. ``given`` may hold targets as value, share."""
    powers = POWERS | (powers or {})
    goal = {x: (given or {}).get(x) if (given or {}).get(x) is not None else targets(cells, x, powers[x]) for x in AXES}
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return cells.withColumn("weight", F.lit(1.0))
    few = {}
    for x in ("lang", "topic"):
        few[x] = dict(goal[x].limit(MOST_PAIRS + 1).collect())
    if len(few["lang"]) * len(few["topic"]) > MOST_PAIRS:
        share = cells.filter("tokens > 0").withColumns({"x": F.col("tokens") / F.lit(float(total)), "w": F.lit(1.0)})
        done = rake_by_joins(share, {x: goal[x].withColumnRenamed("share", "goal") for x in AXES}, SWEEPS)
        return cells.join(done.select(*AXES, F.col("w").alias("weight")).hint("merge"), AXES, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    langs, topics = sorted(few["lang"]), sorted(few["topic"])
    place = lambda names, c: F.create_map(*[y for k, n in enumerate(names) for y in (F.lit(n), F.lit(k))])[F.col(c)]
    parts = cells.filter("tokens > 0").groupBy("source").agg(
        F.collect_list(F.struct(place(langs, "lang").alias("l"), place(topics, "topic").alias("t"), (F.col("tokens") / F.lit(float(total))).alias("x"))).alias("cell")
    )  # at most MOST_PAIRS for a source
    parts = materialise(parts.join(small_or_hinted(goal["source"], BROADCAST_ROWS + 1).withColumnRenamed("value", "source"), "source"), "parts")
    factor = {"l": np.ones(len(langs)), "t": np.ones(len(topics))}
    goals = {"l": np.array([few["lang"][x] for x in langs]), "t": np.array([few["topic"][x] for x in topics])}

    def own_factor() -> Column:
        b, c = (F.array(*[F.lit(float(v)) for v in factor[x]]) for x in "lt")
        return F.col("share") / F.aggregate("cell", F.lit(0.0), lambda s, y: s + y["x"] * b[y["l"]] * c[y["t"]])

    for _ in range(SWEEPS):
        seen = parts.select(own_factor().alias("a"), F.explode("cell").alias("y")).groupBy(F.col("y.l").alias("l"), F.col("y.t").alias("t")).agg(F.sum(F.col("a") * F.col("y.x")).alias("m"))
        margin = np.zeros((len(langs), len(topics)))
        for r in seen.collect():
            margin[r["l"], r["t"]] = r["m"]
        hand_back(cells.sparkSession)
        before = {x: factor[x].copy() for x in factor}
        for _ in range(50):  # the two small margins, on the table of their pairs alone
            factor["l"] = goals["l"] / np.maximum(1e-300, margin @ factor["t"])
            factor["t"] = goals["t"] / np.maximum(1e-300, factor["l"] @ margin)
        scale = factor["t"].mean()
        factor["t"], factor["l"] = factor["t"] / scale, factor["l"] * scale
        if all(np.abs(np.log(factor[x] / before[x])).max() < TOLERANCE for x in factor):
            break
    b, c = (F.create_map(*[y for n, v in zip(names, factor[x], strict=True) for y in (F.lit(n), F.lit(float(v)))]) for x, names in (("l", langs), ("t", topics)))
    own = parts.select("source", own_factor().alias("a"))
    weight = F.col("a") * b[F.col("lang")] * c[F.col("topic")]
    return cells.join(own.hint("merge"), "source", "left").withColumn("weight", F.coalesce(weight, F.lit(1.0))).drop("a")


def rake_by_joins(cells: DataFrame, goals: dict[str, DataFrame], sweeps: int, cut: bool = False) -> DataFrame:
    """``cells`` (the axes, x, w) with w such that the sums of x w, or with ``cut`` of x times the lesser of 1 and w,
    are the goals (value, goal) in every margin. Nothing of it is collected, so axes may have any number of values."""
    size = F.when(F.col("w") < 1, F.col("x") * F.col("w")) if cut else F.col("x") * F.col("w")
    full = F.when(F.col("w") >= 1, F.col("x")) if cut else F.lit(0.0)
    cells = materialise(cells, "swept")
    for _ in range(sweeps):
        for axis in AXES:
            sums = cells.groupBy(F.col(axis).alias("value")).agg(F.coalesce(F.sum(size), F.lit(0.0)).alias("free"), F.coalesce(F.sum(full), F.lit(0.0)).alias("full"), F.count(F.lit(1)).alias("n"))
            left = F.col("goal") - F.col("full")
            f = F.when((left > 0) & (F.col("free") > 0), left / F.col("free")).when(left > 0, 1.0).otherwise(F.col("goal") / (F.col("full") + F.col("free")))
            factor = materialise(sums.join(goals[axis].select("value", "goal").hint("merge"), "value").select(F.col("value").alias(axis), "n", f.alias("f")), "factors")
            cells = materialise(join_per_key(cells, factor, [axis], "n").withColumn("w", F.col("w") * F.col("f")).drop("n", "f"), "swept")
            moved = factor.agg(F.max(F.abs(F.log("f"))).alias("m")).first()[0] if axis == AXES[0] else max(moved, factor.agg(F.max(F.abs(F.log("f")))).first()[0])
        if moved < 1e-5:
            break
    return cells


def kappa(rows: DataFrame, keep: float) -> float:
    """The factor with which min(1, factor times weight) draws ``keep`` of the tokens; rows have tokens above 0."""
    total, low, high, n = rows.agg(F.sum("tokens"), F.min("weight"), F.max("weight"), F.count(F.lit(1))).first()
    if n <= DRIVER_CELLS and keep < 1:
        near = rows.select(F.col("tokens").cast("double"), "weight").toArrow()
        x, w = (near.column(k).to_numpy() for k in range(2))
        return float(_own(np.array([keep * x.sum()]), np.zeros(len(x), dtype=np.int64), x, w)[0])
    a, b = math.log(keep / high) - 1e-9, math.log(1 / low) + 1e-9
    for _ in range(4):
        grid = np.linspace(a, b, 64)
        sums = rows.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * F.lit(float(math.exp(g))))).alias(f"g{k}") for k, g in enumerate(grid)]).first()
        over = next((k for k in range(64) if sums[k] >= keep * total), 63)
        a, b = grid[max(0, over - 1)], grid[over]
    return float(math.exp(b))


def attainable(cells: DataFrame, axis: str, power: float, keep: float) -> DataFrame:
    """value, share, goal: the axis's target shares, and the shares of all tokens to draw. A value that has fewer
    tokens than its target is drawn whole, and what it lacks is spread over the others by their targets."""
    sums = cells.groupBy(F.col(axis).alias("value")).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
    total, parts = sums.agg(F.sum("tokens"), F.sum(F.pow("tokens", F.lit(power)))).first()
    sums = sums.withColumn("share", F.pow("tokens", F.lit(power)) / F.lit(float(parts)))
    sums = materialise(sums.withColumn("weight", F.col("share") * F.lit(float(total)) / F.col("tokens")), "sums")
    most = F.lit(kappa(sums, keep)) * F.col("weight")
    return sums.select("value", "share", (F.least(F.lit(1.0), most) * F.col("tokens") / F.lit(float(total))).alias("goal"))


def _own(goal: np.ndarray, row: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each row the factor with which its cells' x times min(1, factor w) add up to its goal; Newton's steps go
    up from below, as the sum is concave, and end when no further cell is cut at 1."""
    n = len(goal)
    a, cut = goal / np.bincount(row, x * w, n), np.zeros(len(row), dtype=bool)
    while True:
        now = cut | (a[row] * w >= 1)
        if (now == cut).all():
            return a
        cut = now
        left, free = goal - np.bincount(row, x * cut, n), np.bincount(row, x * w * ~cut, n)
        a = np.maximum(a, np.where(free > 0, left / np.where(free > 0, free, 1), 0))


def rake_bounded(cells: DataFrame, keep: float, powers: dict[str, float]) -> DataFrame:
    """``cells`` (tokens above 0, weight) with probability min(1, weight times a factor for each source, language
    and topic), so that the expected tokens of every margin are its goal: cells at 1 are counted as they are, and
    the factors of the others meet what remains. The set of cells at 1 is found anew in each sweep."""
    total = float(cells.agg(F.sum("tokens")).first()[0])
    goal = {x: attainable(cells, x, powers[x], keep) for x in AXES}
    goal = {x: materialise(goal[x], "goals") for x in AXES}
    if goal["lang"].count() * goal["topic"].count() > MOST_PAIRS:
        share = cells.withColumns({"x": F.col("tokens") / F.lit(total), "w": F.col("weight")})
        return rake_by_joins(share, goal, BOUNDED_SWEEPS, cut=True).withColumn("probability", F.least(F.lit(1.0), F.col("w"))).drop("x", "w")
    few = {x: {r["value"]: r["goal"] for r in goal[x].collect()} for x in ("lang", "topic")}
    names = {"l": sorted(few["lang"]), "t": sorted(few["topic"])}
    aims = {"l": np.array([few["lang"][x] for x in names["l"]]), "t": np.array([few["topic"][x] for x in names["t"]])}
    place = lambda k, c: F.create_map(*[y for j, n in enumerate(names[k]) for y in (F.lit(n), F.lit(j))])[F.col(c)]
    cell = F.struct(place("l", "lang").alias("l"), place("t", "topic").alias("t"), (F.col("tokens") / F.lit(total)).alias("x"), F.col("weight").alias("w"))
    parts = cells.groupBy("source").agg(F.collect_list(cell).alias("cell"))  # at most MOST_PAIRS for a source
    parts = parts.join(small_or_hinted(goal["source"], BROADCAST_ROWS + 1).select(F.col("value").alias("source"), "goal"), "source")
    parts = materialise(parts.select("source", "goal", *[F.col(f"cell.{x}").alias(x) for x in "ltxw"]), "parts")
    near = parts.toArrow().to_batches() if cells.count() <= DRIVER_CELLS else None
    factor = {"l": np.ones(len(names["l"])), "t": np.ones(len(names["t"]))}
    shape = (len(names["l"]), len(names["t"]))

    def solved(batch: pa.RecordBatch, b: np.ndarray, c: np.ndarray):
        l, t, x, w = (batch.column(y).flatten().to_numpy(zero_copy_only=False) for y in "ltxw")
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("x")).to_numpy(zero_copy_only=False))
        a = _own(batch.column("goal").to_numpy(zero_copy_only=False), row, x, w * b[l] * c[t])
        return a, l, t, x, w * a[row]

    def sweep(b: np.ndarray, c: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            free, full = np.zeros(shape), np.zeros(shape)
            for batch in batches:
                _, l, t, x, w = solved(batch, b, c)
                cut = w * b[l] * c[t] >= 1
                np.add.at(free, (l, t), x * w * ~cut)
                np.add.at(full, (l, t), x * cut)
            l, t = np.nonzero(free + full)
            yield pa.RecordBatch.from_arrays([pa.array(l), pa.array(t), pa.array(free[l, t]), pa.array(full[l, t])], ["l", "t", "free", "full"])

        free, full = np.zeros(shape), np.zeros(shape)
        if near is not None:
            rows = [r for batch in run(iter(near)) for r in batch.to_pylist()]
        else:
            rows = parts.mapInArrow(run, "l long, t long, free double, full double").groupBy("l", "t").agg(F.sum("free").alias("free"), F.sum("full").alias("full")).collect()
        for r in rows:
            free[r["l"], r["t"]], full[r["l"], r["t"]] = r["free"], r["full"]
        return free, full

    def turned(f: np.ndarray, aim: np.ndarray, free: np.ndarray, full: np.ndarray) -> np.ndarray:
        """The factors that meet the aims beside full cells; where these are too much, all are scaled down."""
        left = aim - full
        new = np.where(left > 0, left / np.where(free > 0, free, 1), f * aim / np.maximum(full + free * f, 1e-300))
        return np.clip(np.where((free > 0) | (left <= 0), new, f), 1e-12, 1e12)

    with batches_of(cells.sparkSession, 200):
        for _ in range(BOUNDED_SWEEPS):
            free, full = sweep(factor["l"], factor["t"])
            before = {x: factor[x].copy() for x in factor}
            for _ in range(50):  # the two small margins, on the table of their pairs alone
                factor["l"] = turned(factor["l"], aims["l"], free @ factor["t"], full.sum(1))
                factor["t"] = turned(factor["t"], aims["t"], factor["l"] @ free, full.sum(0))
            if all(np.abs(np.log(factor[x] / before[x])).max() < TOLERANCE for x in factor):
                break

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("source"), pa.array(solved(batch, factor["l"], factor["t"])[0])], ["source", "a"])

        own = materialise(parts.mapInArrow(run, "source string, a double"), "factors")
    b, c = (F.create_map(*[y for n, v in zip(names[x], factor[x], strict=True) for y in (F.lit(n), F.lit(float(v)))]) for x in "lt")
    weight = F.col("weight") * F.col("a") * b[F.col("lang")] * c[F.col("topic")]
    return cells.join(own.hint("merge"), "source").withColumn("probability", F.least(F.lit(1.0), weight)).drop("a")


def calibrate(cells: DataFrame, keep: float = KEEP, powers: dict[str, float] | None = None) -> DataFrame:
    """``cells`` with a probability; their expected tokens are ``keep`` of all. While kappa times weight is at most
    1 everywhere it is that; else the cells below 1 are raked again, see ``rake_bounded``."""
    some = cells.filter("tokens > 0")
    if not some.head(1):
        return cells.withColumn("probability", F.lit(float(keep)))
    factor = kappa(some, keep)
    plain = cells.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * F.lit(factor)))
    if keep >= 1 or some.agg(F.max("weight")).first()[0] * factor <= 1:
        return plain
    start = materialise(some.withColumn("weight", F.col("weight") * F.lit(factor)), "start")
    drawn = materialise(rake_bounded(start, keep, POWERS | (powers or {})), "bounded").select(*AXES, F.col("probability").alias("weight"), "tokens")
    rest = F.lit(kappa(drawn, keep))  # 1 unless the goals could not all be met
    drawn = drawn.select(*AXES, F.least(F.lit(1.0), F.col("weight") * rest).alias("_p"))
    return plain.join(drawn.hint("merge"), AXES, "left").withColumn("probability", F.coalesce("_p", "probability")).drop("_p")


def margins(cells: DataFrame, keep: float = KEEP, powers: dict[str, float] | None = None) -> DataFrame:
    """axis, value, target, goal, drawn for calibrated cells: of the tokens drawn, the target share, the share that
    the tokens there are allow, and the expected one."""
    powers = POWERS | (powers or {})
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    out = []
    for x in AXES:
        goal = attainable(cells.filter("tokens > 0"), x, powers[x], keep) if total else cells.limit(0).select(F.col(x).alias("value"), F.lit(0.0).alias("share"), F.lit(0.0).alias("goal"))
        drawn = cells.filter("tokens > 0").groupBy(F.col(x).alias("value")).agg((F.sum(F.col("tokens") * F.col("probability")) / F.lit(keep * total or 1.0)).alias("drawn"))
        out.append(goal.join(drawn, "value").select(F.lit(x).alias("axis"), "value", F.col("share").alias("target"), (F.col("goal") / F.lit(keep)).alias("goal"), "drawn"))
    return union_all(out)


def plan(docs: DataFrame, labels: DataFrame, keep: float = KEEP, seed: int = SEED, powers: dict[str, float] | None = None, narrow: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with axes, tokens, weight, probability and whether each row is drawn; and the added names. ``narrow``
    leaves the text out, and works each one out once."""
    topics = fit_topics(docs, labels)
    rows, name = with_axes(docs, topics, narrow=True)
    if narrow:
        rows = materialise(rows, "axes")
    cells = rows.groupBy(*[F.col(name[x]).alias(x) for x in AXES]).agg(F.sum(name["tokens"]).alias("tokens"), F.count(F.lit(1)).alias("docs"))
    cells = materialise(cells, "cells")
    cells = materialise(calibrate(materialise(rake(cells, powers), "raked"), keep, powers), "calibrated")
    if not narrow:
        rows, name = with_axes(docs, topics)
    for x in ("weight", "probability", "drawn", "docs"):
        name[x] = fresh(rows.columns, f"_{x}")
    own = cells.select(*[F.col(x).alias(name[x]) for x in AXES], *[F.col(x).alias(name[x]) for x in ("weight", "probability", "docs")])
    keys = [name[x] for x in AXES]
    out = rows.join(F.broadcast(own), keys) if own.count() <= BROADCAST_ROWS // 10 else join_per_key(rows, own, keys, name["docs"])
    draw = F.pmod(F.xxhash64("doc_id", name["hash"], F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return out.withColumn(name["drawn"], draw < F.col(name["probability"])), name


def mix(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that are drawn."""
    rows, name = plan(docs, labels, keep)
    return rows.filter(name["drawn"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows, name = plan(docs, topics_of(spark, sf_dir), narrow=True)
    return rows.select(
        "doc_id", *[F.col(name[x]).alias(x) for x in AXES], F.col(name["tokens"]).alias("n_tokens"),
        F.round(name["weight"], 6).alias("weight"), F.round(name["probability"], 6).alias("probability"), F.col(name["drawn"]).alias("kept"),
    )
