"""Alignment of two tokenizers: which tokens of one cover which of the other, and where both end together.

Both tokenizers are byte-exact, so their tokens are byte ranges of the same string, a space and the text. Tables of
token starts, of some documents at once, are joined by ``pandas.merge_asof`` keyed by document: each token's start
finds the other side's token that covers it. The union of both directions is all overlaps; a pair with one start is
found twice and kept once. Ends that both sides have cut the tokens into groups.

Neither tokenizer has a token across the place between a character that isn't white space and a space, so a text is
encoded by the units between such places, and each different unit once while it is remembered (UNITS at most).

Counts of id pairs are over all documents: pairs of each document once, summed by Spark. They then meet the written
pairs of the documents again: the table of counts is dealt to shards by ranges of the first id, of at most SHARD
entries each, and one shard after another goes to all executors, so no document's pairs shuffle and memory is
bounded for any number of pairs.

Edge cases: null and empty texts have no tokens, and neither have texts whose tokens' bytes are not the text's (a
U+2581 in a text reads as a space): all their numbers are 0 and groups is empty. Special tokens in a text are plain
text. Rows are documents of their own even if doc_id repeats or is null. Other columns are not read. A text is taken
whole, whatever its length.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusspark.llm.common import materialise, table, union_all
from corpusspark.llm.textops import chunks, give_back, utf8

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECES = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
#: Units that a task remembers, with their tokens.
UNITS = 200_000
#: Entries of the table of counts that executors hold at once (13 bytes each).
SHARD = 4_000_000
#: A pair is one number: the first id times this, plus the second, which is smaller.
SIDE = 1 << 15
#: New units that are encoded in one call.
TOGETHER = 1000
UNIT = re.compile(r"(?<=\S)(?= )")
#: How byte-level vocabularies split text before merging. Fixed value, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> dict[str, int]:
    """Characters of a byte-level vocabulary and their bytes: printable ones are themselves, the others follow U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteSide:
    """The byte-level tokenizer of a vocabulary file. Merges are taken in the order of ids."""

    def __init__(self, path: str = BYTE_BPE):
        import tiktoken

        model = json.load(open(path, encoding="utf-8"))
        of, special = byte_characters(), {t["content"] for t in model["added_tokens"]}
        vocabulary = {bytes(map(of.__getitem__, token)): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.bytes = {i: token for token, i in vocabulary.items()}
        self.encoding = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens={})

    def encode(self, unit: str) -> list[int]:
        return self.encoding.encode_ordinary(unit)


class PieceSide:
    """The sentence piece tokenizer of a model file, which puts a space before a text."""

    def __init__(self, path: str = PIECES):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = {}
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            self.bytes[i] = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()
        self.space = [self.model.piece_to_id("▁")]

    def encode(self, unit: str) -> list[int]:
        """The unit begins with a space, which the model adds; nothing but that space would come back empty."""
        return self.model.encode(unit[1:], num_threads=1) if unit != " " else self.space


class Memory:
    """Units met lately and their tokens on both sides, one unit after another."""

    def __init__(self, a: ByteSide, b: PieceSide):
        self.sides = (a, b)
        self.lengths = [np.zeros(max(s.bytes) + 1, dtype=np.int64) for s in self.sides]
        self.names = []
        for lengths, s, end in zip(self.lengths, self.sides, "|;", strict=True):
            lengths[list(s.bytes)] = [len(x) for x in s.bytes.values()]
            self.names.append([np.array([f"{i}{mark}" for i in range(len(lengths))], dtype=object) for mark in (",", end)])
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.good: list[bool] = []
        self.count = [0, 0]
        self.tokens: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.int64)] for _ in self.sides]
        self.edges: list[list[np.ndarray]] = [[np.zeros(1, dtype=np.int64)] for _ in self.sides]

    def look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the texts' units, and how many each text has; an empty text has none."""
        split = [UNIT.split(" " + t) if t else [] for t in texts]
        if len(self.known) > UNITS:
            self.clear()
        before = len(self.known)
        known = self.known
        places = np.array([known.setdefault(u, len(known)) for own in split for u in own], dtype=np.int64)
        if len(known) > before:
            self._add(list(itertools.islice(known, before, None)))
        self.exact = np.array(self.good, dtype=bool)
        for parts in (*self.tokens, *self.edges):
            parts[:] = [np.concatenate(parts)]
        return places, np.array([len(x) for x in split], dtype=np.int64)

    def _add(self, units: list[str]) -> None:
        """Units that end in a character, not in white space, are encoded some at a time, one after another."""
        single = {k for k, u in enumerate(units) if u[-1].isspace() or "▁" in u}
        at = 0
        while at < len(units):
            stop = at + 1
            if at not in single:
                while stop < len(units) and stop < at + TOGETHER and stop not in single:
                    stop += 1
            self._encode(units[at:stop])
            at = stop

    def _encode(self, units: list[str]) -> None:
        raw, ends = "".join(units), np.cumsum([len(u.encode()) for u in units])
        whole = raw.encode()
        exact = True
        for k, s in enumerate(self.sides):
            ids = s.encode(raw)
            exact &= b"".join([s.bytes[i] for i in ids]) == whole
            flat = np.array(ids, dtype=np.int64)
            stops = np.cumsum(self.lengths[k][flat])
            last = np.searchsorted(stops, ends) + 1 if len(units) > 1 else np.array([len(ids)])
            self.tokens[k].append(flat)
            self.edges[k].append(self.count[k] + last)
            self.count[k] += len(ids)
            if len(units) > 1 and not np.array_equal(stops[last - 1], ends):
                raise ValueError("a token reaches over the end of a unit")
        if len(units) > 1 and not exact:
            raise ValueError("units that are not encoded byte by byte")
        self.good += [exact] * len(units)

    def side(self, k: int, places: np.ndarray, row: np.ndarray) -> pd.DataFrame:
        """The tokens of one side: document, id, start and end among the bytes of all documents."""
        edges = self.edges[k][0]
        first, counts = edges[places], np.diff(edges)[places]
        total = np.cumsum(counts)
        at = np.arange(total[-1] if len(total) else 0) + np.repeat(first - (total - counts), counts)
        ids = self.tokens[k][0][at]
        size = self.lengths[k][ids]
        end = np.cumsum(size)
        return pd.DataFrame({"doc": np.repeat(row, counts), "id": ids, "start": end - size, "end": end, "token": np.arange(len(ids))})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """token_a, token_b of every pair that shares bytes: both sides' starts look for the covering token."""
    key = ["doc", "start", "token"]
    left = pd.merge_asof(a[key], b[key], on="start", by="doc", suffixes=("_a", "_b"))
    other = b.assign(begin=b["start"])[["doc", "start", "token"]]
    right = pd.merge_asof(other, a.assign(begin=a["start"])[["doc", "start", "token", "begin"]], on="start", by="doc", suffixes=("_b", "_a"))
    right = right[right["begin"] != right["start"]]
    return pd.concat([left[["token_a", "token_b"]], right[["token_a", "token_b"]]], ignore_index=True).astype("int64")


def group_strings(a: pd.DataFrame, b: pd.DataFrame, group_a: np.ndarray, group_b: np.ndarray, docs: int, names: list) -> list[str]:
    """``a1,a2|b1;a3|b2,b3``: ids by group, of each document. names: each side's ids as text, with a comma and with
    the mark that ends its part of a group."""
    out = np.empty(len(a) + len(b), dtype=object)
    for side, group, other, more, (inner, end) in ((a, group_a, group_b, 0, names[0]), (b, group_b, group_a, 1, names[1])):
        if len(side):
            ids, last = side["id"].to_numpy(), np.append(group[1:] != group[:-1], True)
            words = inner[ids]
            words[last] = end[ids[last]]
            # Before it come the other side's tokens of earlier groups, for the second side those of its own group too.
            before = np.concatenate(([0], np.cumsum(np.bincount(other))))
            out[np.arange(len(side)) + before[group + more]] = words
    edges = np.cumsum(np.bincount(a["doc"], minlength=docs) + np.bincount(b["doc"], minlength=docs))
    parts, start = [], 0
    for stop in edges.tolist():
        parts.append("".join(out[start:stop].tolist())[:-1])
        start = stop
    return parts


def align_texts(texts: list[str | None], memory: Memory) -> dict[str, pa.Array]:
    """Columns of ``align`` but doc_id, for some texts."""
    places, units = memory.look_up([t or "" for t in texts])
    row = np.repeat(np.arange(len(texts)), units)
    wrong = np.unique(row[~memory.exact[places]])
    keep = ~np.isin(row, wrong)
    places, row = places[keep], row[keep]
    a, b = memory.side(0, places, row), memory.side(1, places, row)
    links = overlaps(a, b)
    common = np.intersect1d(a["end"].to_numpy(), b["end"].to_numpy(), assume_unique=True)
    group_a, group_b = np.searchsorted(common, a["end"].to_numpy()), np.searchsorted(common, b["end"].to_numpy())
    doc = a["doc"].to_numpy()[links["token_a"]]
    pair = a["id"].to_numpy()[links["token_a"]] * SIDE + b["id"].to_numpy()[links["token_b"]]
    each, times = np.unique(doc << 32 | pair, return_counts=True)
    n = len(texts)
    count = lambda x: pa.array(np.bincount(x, minlength=n).astype(np.int64))
    edges = pa.array(np.searchsorted(each >> 32, np.arange(n + 1)).astype(np.int32))
    groups = doc[:0] if not len(a) else a["doc"].to_numpy()[np.append(group_a[1:] != group_a[:-1], True)]
    return {
        "n_a": count(a["doc"]), "n_b": count(b["doc"]), "n_groups": count(groups), "n_links": count(doc),
        "groups": pa.array(group_strings(a, b, group_a, group_b, n, memory.names), type=pa.string()),
        "pairs": pa.ListArray.from_arrays(edges, pa.array((each & (2**32 - 1)).astype(np.int32))),
        "times": pa.ListArray.from_arrays(edges, pa.array(times.astype(np.int32))),
    }


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", byte_bpe: str = BYTE_BPE, piece_model: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;...``), pairs (different linked ids, each first id times
    SIDE plus second) and times (links of each pair) of every row. The files must be on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(ByteSide(byte_bpe), PieceSide(piece_model))
        for batch in batches:
            column = batch.column("text")
            for i, j, _, _ in chunks(*utf8(column)):
                found = align_texts(column.slice(i, j - i).to_pylist(), memory)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *found.values()], ["doc_id", *found])
            give_back()

    for path in (byte_bpe, piece_model):
        if not os.path.exists(path):
            raise FileNotFoundError(path)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<int>, times array<int>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n: how many rows hold each pair. rows: pairs, each at most once a row."""
    return rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def shards(counts: DataFrame, most: int | None = None) -> list[tuple[int, int]]:
    """Ranges (from, to) of first ids that hold at most ``most`` pairs together, or one first id's. One row for each id
    of the vocabulary comes to the driver."""
    most = most or SHARD
    sizes = sorted((r["a"], r["size"]) for r in counts.groupBy(F.shiftright("pair", 15).alias("a")).agg(F.count(F.lit(1)).alias("size")).collect())
    out, start, held = [], 0, 0
    for a, size in sizes:
        if held and held + size > most:
            out.append((start, a))
            start, held = a, 0
        held += size
    return [*out, (start, 1 << 16)]


def _shard_sums(rows: DataFrame, counts: DataFrame, start: int, end: int, keep: list[str]) -> tuple[DataFrame, object]:
    """n_best and count_sum over the pairs of one shard for every row, and the broadcast that must live until they are
    written."""
    own = counts.filter((F.col("pair") >= start * SIDE) & (F.col("pair") < min(end * SIDE, 2**31 - 1))).toArrow()
    pair, n = own.column("pair").to_numpy(), own.column("n").to_numpy()
    order = np.argsort(pair)
    pair, n = pair[order], n[order]
    heads = np.flatnonzero(np.append(True, (pair[1:] >> 15) != (pair[:-1] >> 15))) if len(pair) else np.zeros(0, dtype=np.int64)
    best = n == np.repeat(np.maximum.reduceat(n, heads), np.diff(np.append(heads, len(n)))) if len(pair) else np.zeros(0, dtype=bool)
    state = rows.sparkSession.sparkContext.broadcast((pair, n, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = state.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                lists = batch.column("pairs")
                ids, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                inside = (ids >= start * SIDE) & (ids >> 15 < end)
                ids, times, row = ids[inside], times[inside], row[inside]
                place = np.searchsorted(pair, ids)
                sums = [pa.array(_sums(row, times * x[place], batch.num_rows)) for x in (best, n)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + sums, [*keep, "n_best", "count_sum"])

    kinds = dict(rows.dtypes)
    return rows.select(*keep, "pairs", "times").mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "n_best long", "count_sum long"])), state


def _sums(row: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Whole-number sums of x by ascending row."""
    total = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
    edges = np.searchsorted(row, np.arange(n + 1))
    return total[edges[1:]] - total[edges[:-1]]


def with_counts(rows: DataFrame, counts: DataFrame, most: int | None = None) -> DataFrame:
    """rows (pairs, times and any others; written) with n_best and count_sum instead of pairs and times. counts:
    pair, n; written."""
    keep = [c for c in rows.columns if c not in ("pairs", "times")]
    parts = shards(counts, most)
    if len(parts) == 1:
        return _shard_sums(rows, counts, *parts[0], keep)[0]
    numbered = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    sums = []
    for start, end in parts:
        part, state = _shard_sums(numbered, counts, start, end, ["_row"])
        sums.append(materialise(part.filter("count_sum > 0"), "sums"))
        state.destroy()
    total = union_all(sums).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    none = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")}
    return numbered.select("_row", *keep).join(total.hint("merge"), "_row", "left").withColumns(none).drop("_row")


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    rows = materialise(found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"), "aligned")
    counts = materialise(pair_counts(rows), "pair_counts", free=True)
    out = with_counts(rows, counts)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
