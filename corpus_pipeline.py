"""From raw documents to token ids: five stages, each written to the shared folder before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusspark.llm import dedup_exact, jaccard_join, mixing, pieces, quality
from corpusspark.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules or lie outside their language's perplexity band go."""
    return quality.keep(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return dedup_exact.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles, the smallest doc_id stays."""
    return jaccard_join.keep_one(docs, 5, jaccard_join.Threshold(80, 100))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens meet the targets for source, language and topic, as far as each value has tokens for it."""
    return mixing.mix(docs, mixing.topics_of(spark, sf_dir))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids by the model's own merges; score and pieces of the best segmentation, and the losses of the next best."""
    done = pieces.encode(docs, ["doc_id", "lang", "source"])
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids", "score", F.size("best_ids").cast("long").alias("n_best_pieces"), F.transform("alternatives", lambda a: F.col("score") - a["score"]).alias("losses"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", to_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents: doc_id, lang, source, token ids and scores of what is left."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "_"))
    return docs


#: The language model's bands and the raking are not expressible in SQL.
ORACLE_SQL = None
