"""Exact deduplication by two passes of Bloom filtering, in DataFrame functions only.

Pass one is a filter of one hash: each row hits one slot of SLOTS_PER_ROW a row, and slots hit twice are found by
counting slot numbers, a few bytes a row. Pass two makes a Bloom filter of those slots alone, BITS_PER_SLOT bits
each, and sends it to all executors; rows that hit it go to the grouping shuffle, all others are unique and pass
through. The filter grows with the repeated slots, not with the rows; where it is larger than CHUNK_PIECES pieces
of 4 kB, it is sent in chunks, one after another, and each row is looked up in the chunk of its slot. So at any
size only rows that may be repeated shuffle, and no text does but for copies in ``deduplicate``.

Edge cases: a null text counts as empty, so all null and empty texts are one group. Rows repeated
with the same doc_id and the same normalised text are one document and give one row. A null doc_id
is the last to be kept. A table without rows gives no rows. Other columns, whatever their names, are
carried by ``deduplicate`` and ignored by ``groups``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusspark.llm.common import SPACE, fresh, join_per_key, materialise, table, union_all

#: Bits in one piece of the filter, as Spark's bitmap functions have it.
PIECE_BITS = 32768
#: Slots of pass one for each row: one unique row in so many shares its slot with another.
SLOTS_PER_ROW = 256
#: Bits of pass two's filter for each repeated slot; with three of them set, one other slot in 200 seems repeated.
BITS_PER_SLOT = 16
#: The filter is broadcast in chunks of so many pieces (4 kB each), 64 MB or 33 million repeated slots.
CHUNK_PIECES = 16_384
#: Groups of copies whose keepers are broadcast by ``deduplicate``, so that their rows needn't move.
KEEPERS = 500_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


def _is_set(bit: str) -> Column:
    byte = F.conv(F.hex(F.expr(f"substring(_bitmap, cast({bit} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (F.col(bit) % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


class Filter:
    """Both passes over written rows with a ``_digest``: the repeated slots, and the pieces of their filter."""

    def __init__(self, digests: DataFrame):
        self.slots = max(1, digests.count()) * SLOTS_PER_ROW
        hit = self._slot(digests).groupBy("_slot").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_slot")
        hit = materialise(hit, "slots")
        self.pieces = max(1, -(-hit.count() * BITS_PER_SLOT // PIECE_BITS))
        bits = self._bits(hit).select("_piece", F.explode(F.array("_bit1", "_bit2", "_bit3")).alias("_bit"))
        # bitmap_bit_position counts from 1, so that position p of a piece is bit p - 1.
        self.bitmaps = materialise(bits.groupBy("_piece").agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("_bit") + 1)).alias("_bitmap")), "bitmaps")

    def _slot(self, rows: DataFrame, digest: str = "_digest") -> DataFrame:
        return rows.withColumn("_slot", F.pmod(F.xxhash64(digest), F.lit(self.slots)))

    def _bits(self, rows: DataFrame) -> DataFrame:
        h, low = F.xxhash64("_slot", F.lit(7)), lambda x: x.bitwiseAND(F.lit(PIECE_BITS - 1))
        return rows.withColumns({"_piece": F.pmod(h, F.lit(self.pieces)), "_bit1": low(F.shiftright(h, 19)), "_bit2": low(F.shiftright(h, 41)), "_bit3": low(F.xxhash64("_slot", F.lit(11)))})

    def split(self, rows: DataFrame, digest: str = "_digest") -> tuple[DataFrame, DataFrame]:
        """Rows that may be repeated, and the others; the columns that the filter adds are taken off again."""
        rows = self._bits(self._slot(rows, digest))
        parts = []
        for first in range(0, self.pieces, CHUNK_PIECES):
            inside = F.col("_piece").between(first, first + CHUNK_PIECES - 1)
            seen = rows.filter(inside).join(F.broadcast(self.bitmaps.filter(inside)), "_piece", "left")  # at most CHUNK_PIECES rows
            hit = _is_set("_bit1") & _is_set("_bit2") & _is_set("_bit3")
            seen = seen.withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_piece", "_bit1", "_bit2", "_bit3", "_slot", "_bitmap")
            # Chunks one after another: each is written before the next one is sent.
            parts.append(materialise(seen, "seen") if self.pieces > CHUNK_PIECES else seen)
        every = union_all(parts)
        return every.filter("_maybe").drop("_maybe"), every.filter("not _maybe").drop("_maybe")


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document, dropped ones too."""
    digests = materialise(
        docs.select(F.col(doc_id).alias("_id"), F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("_digest")), "digests"
    )
    maybe, unique = Filter(digests).split(digests)
    maybe = materialise(maybe.groupBy("_digest", "_id").agg(F.lit(1).alias("_one")).drop("_one"), "repeated")
    sizes = maybe.groupBy("_digest").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    grouped = join_per_key(maybe, materialise(sizes, "sizes"), ["_digest"], "group_size")
    alone = unique.withColumns({"keep_id": F.col("_id"), "group_size": F.lit(1).cast("long")})
    return alone.unionByName(grouped).select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without its copies: of equal texts, the row with the smallest doc_id, all its columns.

    Whole rows move only if they may be repeated; the others go through a broadcast filter."""
    digest = fresh(docs.columns, "_digest")
    with_digest = docs.withColumn(digest, F.unhex(F.sha2(normalised(F.col(f"`{text}`")), 256)))
    narrow = materialise(with_digest.select(F.col(digest).alias("_digest"), F.col(f"`{doc_id}`").alias("_id")), "digests")
    own = Filter(narrow)
    maybe = materialise(own.split(narrow)[0].groupBy("_digest", "_id").agg(F.count(F.lit(1)).alias("_rows")), "maybe")
    keepers = maybe.groupBy("_digest").agg(F.min("_id").alias("_id"), F.sum("_rows").alias("_n")).filter("_n > 1")
    keepers = materialise(keepers, "keepers")
    if not keepers.head(1):
        return docs
    columns = [F.col(f"`{c}`") for c in docs.columns]
    dup, keep, n = fresh(docs.columns, "_dup"), fresh(docs.columns, "_keep"), fresh(docs.columns, "_n_rows")
    hot = keepers.select(F.col("_digest").alias(digest), F.col("_id").alias(keep), F.lit(True).alias(dup), F.col("_n").alias(n))
    if keepers.count() <= KEEPERS:
        tagged, alone = with_digest.join(F.broadcast(hot), digest, "left"), None
    else:  # the rows that may be repeated meet the keepers in a shuffle
        ready = {c: f"__{c}" for c in docs.columns if c.lower() in FILTER_COLUMNS}
        some, others = own.split(with_digest.withColumnsRenamed(ready), digest)
        back = lambda df: df.withColumnsRenamed({v: k for k, v in ready.items()})
        tagged, alone = join_per_key(materialise(back(some), "may_be_copies"), hot, [digest], n, "left"), back(others).select(*columns)
    first = F.col(dup) & F.col(f"`{doc_id}`").eqNullSafe(F.col(keep))
    if maybe.filter("_rows > 1").head(1):  # rows that repeat id and text are left to merge
        out = tagged.filter(F.col(dup).isNull()).select(*columns).unionByName(tagged.filter(first).dropDuplicates([digest, doc_id]).select(*columns))
    else:
        out = tagged.filter(F.col(dup).isNull() | first).select(*columns)
    return out if alone is None else out.unionByName(alone)


#: Names that the filter adds for a while.
FILTER_COLUMNS = ("_slot", "_piece", "_bit1", "_bit2", "_bit3", "_bitmap", "_maybe")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (SELECT DISTINCT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents),
     g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256
FROM n JOIN g USING (text_sha256)
"""
