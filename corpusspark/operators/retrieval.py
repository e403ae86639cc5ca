"""Vector, keyword and hybrid search."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusspark.functions.text import cosine
from corpusspark.operators.lineage import Levels
from corpusspark.operators.relational import allowed, rank_fusion, role_visible, top_per_group


def vector_topk(rows: DataFrame, query: list[float], k: int, threshold: float = 0.0, ids: list | None = None, key: str = "id", vector: str = "embedding", inclusive: bool = False) -> DataFrame:
    """id, similarity of the k most similar rows for one query. The list of allowed ids is applied before any scoring."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.filter(allowed(F.col(key), ids) & F.col(vector).isNotNull()).select(key, F.round(cosine(F.col(vector), q), 6).alias("similarity"))
    keep = F.col("similarity") >= threshold if inclusive else F.col("similarity") > threshold
    return scored.filter(keep).orderBy(F.desc("similarity"), key).limit(k)


#: Queries, and characters of queries, that are sent to all executors at once.
BLOCK, BLOCK_CHARACTERS = 2000, 1_000_000


def query_blocks(queries: DataFrame, most: int | None = None) -> Iterator[DataFrame]:
    """The queries (query_id) dealt by hash to blocks of about BLOCK, and of about BLOCK_CHARACTERS if they have texts
    (``_q``); together they are all of them."""
    n = queries.agg(F.count(F.lit(1)).alias("n"), (F.sum(F.length("_q")) if "_q" in queries.columns else F.lit(0)).alias("c")).first()
    blocks = max(-(-n["n"] // (most or BLOCK)), -(-(n["c"] or 0) // BLOCK_CHARACTERS))
    for k in range(blocks):
        yield queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)


def _block_topk(rows: DataFrame, queries: DataFrame, k: int, threshold: float, key: str, others: bool):
    """Each task's best k rows for each of one block's queries, by matrix products of batches; and the broadcast
    block."""
    block = queries.toArrow()
    asked = block.column("query_id").combine_chunks()
    sizes = pc.list_value_length(block.column("embedding")).to_numpy()
    groups = {}
    for n in sorted(set(sizes.tolist()) - {0}):
        own = np.flatnonzero(sizes == n)
        q = block.column("embedding").take(pa.array(own)).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), n)
        groups[n] = (own, q, np.sqrt((q * q).sum(axis=1)))
    kinds = dict(rows.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}
    state = rows.sparkSession.sparkContext.broadcast((asked, groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, groups = state.value
        for batch in batches:
            sizes = pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
            for n, (own, q, q_norm) in groups.items():
                place = np.flatnonzero(sizes == n)
                for at in range(0, len(place), 500):
                    here = place[at:at + 500]
                    part = batch.take(pa.array(here))
                    x = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(here), n)
                    norms = np.sqrt((x * x).sum(axis=1))[:, None] * q_norm[None, :]
                    score = np.round(np.where(norms > 0, x @ q.T / np.where(norms > 0, norms, 1), 0.0), 6)
                    r, c = np.nonzero(score > threshold)
                    found = pa.table({"query_id": asked.take(pa.array(own[c])), key: part.column(key).take(pa.array(r)), "similarity": score[r, c]})
                    if others:
                        found = found.filter(pc.not_equal(found.column(key), found.column("query_id")))
                    found = found.to_pandas().sort_values(["query_id", "similarity", key], ascending=[True, False, True])
                    found = found[found.groupby("query_id").cumcount() < k]
                    yield from pa.Table.from_pandas(found, schema=pa.schema([("query_id", asked.type), (key, batch.schema.field(key).type), ("similarity", pa.float64())]), preserve_index=False).to_batches()

    whole = rows.filter(F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull())).select(key, "embedding")
    return whole.mapInArrow(run, f"query_id {kinds['query_id']}, {key} {kinds[key]}, similarity double"), state


def vector_topk_many(rows: DataFrame, queries: DataFrame, k: int, threshold: float = 0.0, key: str = "id", others: bool = False) -> DataFrame:
    """query_id, id, similarity, rank for any number of queries (query_id, embedding): all rows meet one block of
    queries after another, each batch hands on its k best a query, and a block's k best are written before the next
    block is sent. ``others``: not the row that has the query's own id. Only similarities over the threshold count,
    which must not be negative."""
    kinds = dict(rows.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}
    schema = f"query_id {kinds['query_id']}, {key} {kinds[key]}, similarity double, rank int"
    out = Levels(rows.sparkSession, schema)
    for block in query_blocks(queries.filter("embedding is not null").filter(F.forall("embedding", lambda v: v.isNotNull())).select("query_id", "embedding")):
        found, state = _block_topk(rows, block, k, threshold, key, others)
        out.add(top_per_group(found, ["query_id"], [F.desc("similarity"), F.asc(key)], k).select("query_id", key, "similarity", "rank"))
        state.destroy()
    return out.read().drop("level") if out.sizes else rows.sparkSession.createDataFrame([], schema)


def similar_sops(rows: DataFrame, query: list[float], workspace, k: int = 5, threshold: float = 0.75, key: str = "id") -> DataFrame:
    own = rows.filter((F.col("workspace_id") == workspace) | F.col("workspace_id").isNull())
    return vector_topk(own, query, k, threshold, key=key, inclusive=True)


def dense_leg(rows: DataFrame, query: list[float], limit: int, ids: list | None = None, key: str = "id") -> DataFrame:
    """id, similarity, rank: three times the limit, above 0.05."""
    top = vector_topk(rows, query, 3 * limit, 0.05, ids, key)
    return _ranked(top, [F.desc("similarity"), F.asc(key)])


def _ranked(top: DataFrame, order: list[Column]) -> DataFrame:
    """Ranks of a limited table."""
    from pyspark.sql.window import Window

    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def sparse_leg(rows: DataFrame, phrase: str, limit: int, fields: list[str], ids: list | None = None, role: str | None = None, roles: str | None = None, key: str = "id") -> DataFrame:
    """id, rank of rows one of whose fields has the phrase, in any case; visibility comes before the limit."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.contains(F.lower(f), F.lit(phrase.lower())), F.lit(False))
    seen = rows.filter(hit & allowed(F.col(key), ids) & (role_visible(F.col(roles), role) if roles else F.lit(True)))
    return _ranked(seen.select(key).orderBy(key).limit(limit), [F.asc(key)])


def rerank(fused: DataFrame, query: str, top: int = 5, key: str = "id", order: list[Column] | None = None) -> DataFrame:
    """The top rows of a limited fused list (key, title, trigger_condition, category, score) by term overlap."""
    order = order or [F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), F.asc(key)]
    from pyspark.sql.window import Window

    one = Window.partitionBy(F.lit(0))
    place, n = F.row_number().over(one.orderBy(*order)), F.count(F.lit(1)).over(one)
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    terms = [t for t in query.lower().split() if len(t) > 2]
    score = F.lit(0.0)
    for t in terms:
        for c, w in (("title", 3.0), ("trigger_condition", 2.0), ("category", 1.5)):
            score = score + F.when(F.contains(low(c), F.lit(t)), w).otherwise(0.0)
    score = score + F.when(F.contains(low("title"), F.lit(query.lower())), 5.0).otherwise(0.0) + (n - place + 1) * 0.01
    return fused.withColumn("relevance", F.round(score, 6)).orderBy(F.desc("relevance"), key).limit(top)


def hybrid_search(rows: DataFrame, vector: list[float], phrase: str, limit: int = 5, ids: list | None = None, role: str | None = None, graph: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Dense and keyword legs (and a graph leg of key, rank) fused by reciprocal rank and reranked. rows: id,
    embedding, title, trigger_condition, category."""
    dense = dense_leg(rows, vector, limit, ids, key)
    sparse = sparse_leg(rows, phrase, limit, ["title", "trigger_condition", "category"], ids, key=key)
    fused = rank_fusion(dense, sparse, key)
    if graph is not None:
        extra = graph.select(key, (1 / (60 + F.col("rank"))).alias("g"))
        fused = fused.join(extra, key, "left").withColumn("score", F.col("score") + F.coalesce("g", F.lit(0.0))).drop("g")
    shown = fused.join(rows.select(key, "title", "trigger_condition", "category"), key)
    return rerank(shown, phrase, limit, key)


class Phrases:
    """Lower-cased queries, indexed in flat arrays for both tests: an automaton finds those within a name, and the sorted
    suffixes of all queries, one text after another, those that a name is within."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.whole = "\0".join(texts) + "\0"
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])
        self.suffixes = suffix_array(self.whole)

    def automaton(self):
        import ahocorasick

        own, out = {}, ahocorasick.Automaton()
        for k, t in enumerate(self.texts):
            own.setdefault(t, []).append(k)
        for t, places in own.items():
            out.add_word(t, places)
        out.make_automaton()
        return out

    def having(self, word: str) -> np.ndarray:
        """Places of the queries that have a word, which isn't empty."""
        start = lambda i: self.whole[i:i + len(word)]
        low = bisect.bisect_left(self.suffixes, word, key=start)
        if low == len(self.suffixes) or start(self.suffixes[low]) != word:
            return self.owner[:0]
        high = bisect.bisect_right(self.suffixes, word, lo=low, key=start)
        return np.unique(self.owner[self.suffixes[low:high]])


def suffix_array(text: str) -> np.ndarray:
    """Places of all suffixes in their order, by doubling of what they are compared by."""
    _, rank = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_inverse=True)
    rank, size, n = rank.astype(np.int64), 1, len(text)
    while size < n and rank.max() < n - 1:
        after = np.zeros(n, dtype=np.int64)
        after[:n - size] = rank[size:] + 1
        _, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
        size *= 2
    return np.argsort(rank, kind="stable")


def name_match(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, node_id where a query has a node's name or id, or a name has the query; in any case, and nothing that is
    empty counts. Queries are indexed in blocks by number and size; nodes pass by each block in Arrow batches, and its
    matches are written before the next block is sent. The names are never sent anywhere."""
    kinds = {"query_id": dict(queries.dtypes)["query_id"], "node_id": dict(nodes.dtypes)["id"]}
    schema = ", ".join(f"{c} {kind}" for c, kind in kinds.items())
    spark = nodes.sparkSession
    out = Levels(spark, schema)
    for block in query_blocks(queries.select("query_id", F.lower("query").alias("_q")).filter("_q != ''")):
        asked = block.toArrow()
        if not asked.num_rows:
            continue
        state = spark.sparkContext.broadcast((asked.column("query_id").combine_chunks(), Phrases(asked.column("_q").to_pylist())))

        def run(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            ids, phrases = state.value
            automaton = phrases.automaton()
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part, rows, hits = batch.slice(at, 1000), [], []
                    for k, (name, word) in enumerate(zip(part.column("name").to_pylist(), part.column("word").to_pylist(), strict=True)):
                        own = {q for w in (name, word) if w for q in phrases.having(w).tolist()}
                        if name:
                            own.update(q for _, places in automaton.iter(name) for q in places)
                        rows += [k] * len(own)
                        hits += sorted(own)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(hits, pa.int64())), part.column("id").take(pa.array(rows, pa.int64()))], ["query_id", "node_id"])

        out.add(nodes.select("id", F.lower("name").alias("name"), F.lower(F.col("id").cast("string")).alias("word")).mapInArrow(run, schema))
        state.destroy()
    return out.read().drop("level") if out.sizes else spark.createDataFrame([], schema)


def conflict_candidates(rows: DataFrame, queries: DataFrame, threshold: float = 0.75, k: int = 5) -> DataFrame:
    """query_id, id, origin: the most similar other rows, or the newest others of the workspace for queries without
    one. rows: id, workspace_id, created_at, embedding; queries: query_id, workspace_id, embedding."""
    near = vector_topk_many(rows, queries, k, threshold, others=True).select("query_id", "id", F.lit("vector").alias("origin"))
    rest = queries.join(near.select("query_id").distinct().hint("merge"), "query_id", "left_anti").select("query_id", "workspace_id")
    newest = top_per_group(rows.select("id", "workspace_id", "created_at"), ["workspace_id"], [F.desc("created_at"), F.asc("id")], k + 1)
    picked = rest.join(newest.drop("rank").hint("merge"), "workspace_id").filter("id != query_id")  # k + 1 rows a workspace
    return near.unionByName(top_per_group(picked, ["query_id"], [F.desc("created_at"), F.asc("id")], k).select("query_id", "id", F.lit("newest").alias("origin")))
