"""SentencePiece encoding and decoding with N-best segmentation.

A text becomes the model's pieces with the largest sum of piece scores. White space is escaped as
the model does; no piece crosses from a character into an escaped space, so a text falls apart into
units (a run of spaces with the word after it), whose lattices are searched one by one.

Forward: Viterbi scores of a batch's new units, those of similar length at once, in numpy. Backward: A* from a unit's end,
with the forward scores as exact heuristic, yields its segmentations from best to worst. A text's
N best segmentations take their deviations from the N - 1 occurrences of units with the smallest loss
of their second best, and only those units are searched; sums of losses are merged by a heap.

A model whose pieces come from merges encodes by the order of its merges, which need not give the largest sum.
``encode`` also returns that encoding, as ``ids``; the lattice's best is ``best_ids``. Merges stay within units
too, so each new unit is merged once.

Scores are integers in the models used here and are kept as such where they are, so sums are exact.
Characters without a piece become their UTF-8 bytes' pieces, at the model's lowest score less 10.

Edge cases: a null or empty text has no pieces and no alternatives, and decodes to an empty text; ties
go to the longer last piece, then to the earlier deviation; a text of one long word is searched as one
unit. Each row is handled by itself; columns named in ``carry`` are handed through.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusspark.llm.common import table, text_batches
from corpusspark.llm.textops import give_back, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
ESCAPED = "▁"
UNITS = re.compile(" +[^ ]*")
#: Units whose segmentation a task remembers before it forgets rare ones, and bytes of text it takes at once.
REMEMBERED = 60_000
CHUNK = 500_000
#: New units that are learned at once, and characters whose lattices are searched at once, units filled up to the longest.
LEARNED = 20_000
AREA = 20_000
#: Places for a state's children that are tried at once.
BLOCK = 256
#: Units that are merged as one text.
JOINED = 100
#: Pieces that are decoded at once.
DECODED = 400_000


def vocabulary(path: str = MODEL) -> list[tuple[str, float, bool]]:
    """(piece, score, is a byte) by id. Control and unknown pieces have a nan score and are never used."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    out = [(model.id_to_piece(i), float("nan") if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else model.get_score(i), model.is_byte(i)) for i in range(n)]
    if any(p[k] == ESCAPED != p[k - 1] for p, s, b in out for k in range(1, len(p)) if s == s and not b):
        raise ValueError("a piece crosses into an escaped space; units would not be independent")
    return out


def model_bytes(path: str = MODEL) -> bytes:
    """The model as it is sent to executors, which need no file of it."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto()


class Lattice:
    """Segmentation of units by one vocabulary; remembers what it has worked out. With the model's bytes also the
    segmentation that its merges give. Pickled without what it remembers, so that tasks need not build its tables."""

    def __init__(self, vocab: list[tuple[str, float, bool]], model: bytes | None = None):
        self.model = model
        self.spaced = np.array([p.startswith(ESCAPED) for p, _, _ in vocab])
        usable = [(p, int(s) if s == int(s) else s, i) for i, (p, s, byte) in enumerate(vocab) if s == s and not byte]
        self.exact = all(isinstance(s, int) for _, s, _ in usable)
        self.longest = max(len(p) for p, _, _ in usable)
        self.pieces = {p: (s, i) for p, s, i in usable}
        self.unknown = min(s for _, s, _ in usable) - 10
        self.bytes = {int(p[3:5], 16): i for i, (p, _, byte) in enumerate(vocab) if byte}
        self._grow(usable)
        self._load()

    def _grow(self, usable: list[tuple[str, float, int]]) -> None:
        """The trie of the pieces as a double array. From a state, a character leads to the state ``step`` of the one plus
        ``char`` of the other, if ``keys`` of that is the state it comes from; the root is state 0."""
        after: dict[str, list[str]] = {"": []}
        for p in sorted({p[:k] for p, _, _ in usable for k in range(1, len(p) + 1)}, key=len):
            after[p[:-1]].append(p[-1])
            after[p] = []
        # Frequent characters have small numbers; 0 is none of the pieces'.
        alphabet = [c for c, _ in Counter(chain.from_iterable(after.values())).most_common()]
        number = dict(zip(alphabet, range(1, len(alphabet) + 1), strict=True))
        self.char = np.zeros(0x110000, dtype=np.int32)
        self.char[[ord(c) for c in alphabet]] = list(number.values())
        # A state's children take the first places where all are free; only children fill the gaps. The root's are 1, 2, 3, ...
        free = np.ones(4 * len(after) + len(alphabet), dtype=bool)
        free[:len(alphabet) + 1] = False
        step, first = {"": 0}, len(alphabet) + 1
        for p in sorted((p for p in after if p and len(after[p]) > 1), key=lambda p: -len(after[p])):
            own = np.sort([number[c] for c in after[p]])
            for tried, at in enumerate(range(first, len(free), BLOCK)):
                if at + BLOCK + len(alphabet) > len(free):
                    free = np.concatenate((free, np.ones(len(free), dtype=bool)))
                starts = np.arange(at, at + BLOCK) - own[0]
                starts = starts[free[starts[:, None] + own].all(axis=1)]
                if len(starts):
                    break
            step[p] = int(starts[0])
            free[starts[0] + own] = False
            first += BLOCK * (tried // 2)  # what is nearly full is left to the only children
        lone = [p for p in after if p and len(after[p]) == 1]
        step |= {p: gap - number[after[p][0]] for p, gap in zip(lone, np.flatnonzero(free)[:len(lone)].tolist(), strict=True)}
        size = max(step.values()) + len(alphabet) + 1
        self.keys, self.step, self.ids = np.full(size, -1, dtype=np.int32), np.zeros(size, dtype=np.int32), np.full(size, -1, dtype=np.int32)
        self.scores = np.zeros(size)
        state = {"": 0}
        for p, chars in after.items():  # the shorter first
            for c in chars:
                state[p + c] = step[p] + number[c]
                self.keys[state[p + c]] = state[p]
            self.step[state[p]] = step.get(p, 0)
        for p, score, i in usable:
            self.ids[state[p]], self.scores[state[p]] = i, score

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in REMEMBERS}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._load()

    def _load(self) -> None:
        self.merges = None
        if self.model is not None:
            import sentencepiece

            self.merges = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.string())  # units by number, see ``split_units``
        self.used = np.zeros(0, dtype=np.int64)  # how often each was found
        self.best = np.zeros(0, dtype=np.int64 if self.exact else np.float64)  # score of the best segmentation, by unit
        self.loss = np.zeros(0)  # of the second best; none: infinity
        self.flat = np.zeros(0, dtype=np.int32)  # ids of the best segmentations one after the other
        self.begin = np.zeros(1, dtype=np.int64)  # where a unit's ids begin, and the end
        self.merged, self.merged_begin = self.flat, self.begin  # the same for the merges' segmentations
        self.ranked: dict[int, list] = {}

    def forget(self) -> None:
        """Leaves the units found more than once, at most half of REMEMBERED: most units of a text are found only there."""
        least = max(2, np.partition(self.used, -(REMEMBERED // 2))[-(REMEMBERED // 2)] + 1 if len(self.used) > REMEMBERED // 2 else 0)
        keep = np.flatnonzero(self.used >= least)
        self.flat, self.begin, self.merged, self.merged_begin = *self.paths(keep), *self.paths(keep, merged=True)
        self.known, self.used, self.best, self.loss = self.known.take(pa.array(keep)), self.used[keep], self.best[keep], self.loss[keep]
        place = dict(zip(keep.tolist(), range(len(keep)), strict=True))
        self.ranked = {place[k]: v for k, v in self.ranked.items() if k in place}

    def number(self, units: pa.Array) -> np.ndarray:
        """The numbers of different units; new ones are learned."""
        found = pc.index_in(units, value_set=self.known)
        if found.null_count:
            new = units.filter(found.is_null())
            for at in range(0, len(new), LEARNED):
                self.learn(new[at:at + LEARNED])
            places = np.arange(len(self.known), len(self.known) + len(new))
            self.known = pa.concat_arrays([self.known, new])
            self.used = np.concatenate((self.used, np.zeros(len(new), dtype=np.int64)))
            out = found.fill_null(0).to_numpy().astype(np.int64)
            out[found.is_null().to_numpy(zero_copy_only=False)] = places
            return out
        return found.to_numpy().astype(np.int64)

    def learn(self, units: pa.Array) -> None:
        """Forward scores, best paths and second-best losses of new units, those of similar length at once."""
        text = pc.binary_join_element_wise(ESCAPED, pc.replace_substring(units, " ", ESCAPED), "")
        data, offsets = utf8(text)
        codes = np.frombuffer(data[offsets[0]:offsets[-1]].tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        lengths = pc.utf8_length(text).to_numpy().astype(np.int64)
        offset = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        best, loss, parts, at = np.empty(len(units)), np.empty(len(units)), [], 0
        while at < len(order):
            own = order[at:at + max(1, AREA // int(lengths[order[at]]))]
            best[own], loss[own], steps = self._search(codes, offset[own], lengths[own])
            parts += [(own[u], np.full(len(u), k), ids, ends) for k, (u, ids, ends) in enumerate(steps)]
            at += len(own)
        # Paths come from their ends, units in the order of their lengths.
        owner, step, ids, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
        sizes = np.bincount(owner, minlength=len(units))
        place = np.cumsum(sizes)[owner] - 1 - step
        idents = np.empty(len(ids), dtype=np.int32)
        idents[place] = ids
        lone = np.flatnonzero(ids < 0)
        if len(lone):
            lone = lone[np.argsort(place[lone])]
            own = [self._fallback(chr(c)) for c in codes[offset[owner[lone]] + ends[lone] - 1].tolist()]
            repeats = np.ones(len(idents), dtype=np.int64)
            repeats[place[lone]] = [len(x) for x in own]
            np.add.at(sizes, owner[lone], repeats[place[lone]] - 1)
            idents = np.repeat(idents, repeats)
            idents[idents < 0] = [x for y in own for x in y]
        if self.merges:
            merged_sizes, merged = self._merge(units)
            self.merged_begin = np.concatenate((self.merged_begin, self.merged_begin[-1] + np.cumsum(merged_sizes)))
            self.merged = np.concatenate((self.merged, merged))
        self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(sizes)))
        self.flat = np.concatenate((self.flat, idents))
        self.best = np.concatenate((self.best, best.astype(self.best.dtype)))
        self.loss = np.concatenate((self.loss, loss))

    def _search(self, codes: np.ndarray, offset: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, ...]]]:
        """Of units of similar length, which begin at ``offset`` of ``codes``: score of the best segmentation, loss of the
        second best, and step by step from the ends the units that go on, the id of their piece (-1: a character without
        one) and where it ends."""
        count, high = len(lengths), int(lengths.max())
        inside = np.arange(high)[:, None] < lengths
        # By place, then by unit, so that all units' characters of a place are next to each other.
        chars = np.zeros((high + self.longest, count), dtype=np.int32)
        chars[:high] = np.where(inside, self.char[codes[np.minimum(offset + np.arange(high)[:, None], len(codes) - 1)]], 0)
        chars, alive = chars.ravel(), np.flatnonzero(inside)
        alone = inside.ravel()  # until a piece is found
        state, found = np.zeros(len(alive), dtype=np.int32), []
        for n in range(1, min(self.longest, high) + 1):
            to = self.step[state] + chars[alive + (n - 1) * count]
            on = np.flatnonzero(self.keys[to] == state)
            alive, state = alive[on], to[on]
            hit = np.flatnonzero(self.ids[state] >= 0)
            if len(hit):
                found.append((n, alive[hit], state[hit]))
                if n == 1:
                    alone[found[0][1]] = False
            if not len(alive):
                break
        # Edges by their ends, the longest first, then by unit.
        wide = max((n for n, _, _ in found), default=1)
        score, ident = np.full((high, wide, count), -np.inf), np.empty((high, wide, count), dtype=np.int32)
        flat_score, flat_ident = score.ravel(), ident.ravel()
        alone = np.flatnonzero(alone)
        place = np.arange(high)[:, None] * (wide * count) + np.arange(count)
        place = place.ravel()
        cell = place[alone] + (wide - 1) * count
        flat_score[cell], flat_ident[cell] = self.unknown, -1
        for n, start, state in found:
            cell = place[start] + ((n - 1) * wide + wide - n) * count
            flat_score[cell], flat_ident[cell] = self.scores[state], self.ids[state]
        forward, loss = np.full((high + 1, count), -np.inf), np.empty((high, count))
        forward[0], chosen, unit = 0, np.empty((high, count), dtype=np.int64), np.arange(count)
        with np.errstate(invalid="ignore"):  # beyond a unit's end
            for end in range(1, high + 1):
                n = min(end, wide)
                sums = forward[end - n:end] + score[end - 1, wide - n:]
                first = sums.argmax(axis=0)
                forward[end] = top = sums[first, unit]
                sums[first, unit] = -np.inf
                chosen[end - 1], loss[end - 1] = n - first, top - sums.max(axis=0)
        here, least, steps = lengths.copy(), np.full(count, np.inf), []
        while len(unit):
            end = here[unit]
            n = chosen[end - 1, unit]
            least[unit] = np.minimum(least[unit], loss[end - 1, unit])
            steps.append((unit, ident[end - 1, wide - n, unit], end))
            here[unit] = end - n
            unit = unit[end > n]
        return forward[lengths, np.arange(count)], least, steps

    def _merge(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each unit by the model's merges, and the ids one after the other."""
        flat = lambda x: np.fromiter(chain.from_iterable(x), dtype=np.int32)
        # Units of one space and a word go to the model JOINED at a time: a piece with the space begins each.
        lone = pc.and_not(pc.not_equal(units, ""), pc.match_substring(units, " "))
        words = units.filter(lone)
        lone = lone.to_numpy(zero_copy_only=False)
        cuts = pa.array(np.append(np.arange(0, len(words), JOINED), len(words)).astype(np.int32))
        joined = pc.binary_join(pa.ListArray.from_arrays(cuts, words), " ").to_pylist()
        ids = flat(self.merges.encode(joined, num_threads=1))
        sizes = np.zeros(len(units), dtype=np.int64)
        sizes[lone] = np.diff(np.append(np.flatnonzero(self.spaced[ids]), len(ids)))
        if lone.all():
            return sizes, ids
        # The model puts one space before a text itself; of a single one it makes nothing.
        others = [x or [self.pieces[ESCAPED][1]] for x in self.merges.encode(units.filter(pa.array(~lone)).to_pylist(), num_threads=1)]
        sizes[~lone] = [len(x) for x in others]
        out, mine = np.empty(int(sizes.sum()), dtype=np.int32), np.repeat(lone, sizes)
        out[mine], out[~mine] = ids, flat(others)
        return sizes, out

    def paths(self, own: np.ndarray, merged: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known units one after the other, and where each unit's begin, with the end."""
        flat, begin = (self.merged, self.merged_begin) if merged else (self.flat, self.begin)
        sizes = begin[own + 1] - begin[own]
        at = np.concatenate(([0], np.cumsum(sizes)))
        return flat[np.repeat(begin[own] - at[:-1], sizes) + np.arange(at[-1])], at

    def _fallback(self, char: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in char.encode("utf-8", "surrogatepass"))

    def segmentations(self, text: str) -> Iterator[tuple[float, list[int]]]:
        """(score, ids) of one unit from best to worst: backward A* under forward scores."""
        n = len(text)
        low = float("-inf")
        forward, into = [0] + [low] * n, [[] for _ in range(n + 1)]
        for s in range(n):
            for e in range(s + 1, min(n, s + self.longest) + 1):
                piece = self.pieces.get(text[s:e])
                if piece is None and e == s + 1:
                    piece = (self.unknown, -1)
                if piece is not None:
                    into[e].append((s, *piece))
                    if forward[s] + piece[0] > forward[e]:
                        forward[e] = forward[s] + piece[0]
        # An entry: minus the best full score through it, a running number, its node, its score so far, its edges.
        heap, tick = [(-forward[n], 0, n, 0, None)], 0
        while heap:
            f, _, at, done, tail = heapq.heappop(heap)
            if at == 0:
                ids = []
                while tail:
                    (s, i), tail = tail
                    ids += (i,) if i >= 0 else self._fallback(text[s])
                yield -f, ids
                continue
            for s, score, i in into[at]:
                tick += 1
                heapq.heappush(heap, (-(forward[s] + score + done), tick, s, done + score, ((s, i), tail)))

    def top(self, k: int, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a known unit as (loss, ids), the best first."""
        if k not in self.ranked or len(self.ranked[k]) < n:
            out, unit = [], ESCAPED + self.known[k].as_py().replace(" ", ESCAPED)
            for score, ids in self.segmentations(unit):
                out.append((int(self.best[k]) - score if self.exact else float(self.best[k]) - score, ids))
                if len(out) == n:
                    break
            self.ranked[k] = out
        return self.ranked[k]


#: What a lattice works out and does not hand on.
REMEMBERS = {"merges", "known", "used", "best", "loss", "flat", "begin", "merged", "merged_begin", "ranked"}


def split_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different units of texts, the place among these of each unit, and where each text's units begin, with the
    end. The model puts a space before a text; units are told without their first space."""
    texts = pc.replace_substring(texts.cast(pa.string()).fill_null(""), ESCAPED, " ")  # as the model reads it
    odd = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " "))
    plain = pc.split_pattern(pc.if_else(pc.or_(odd, pc.equal(texts, "")), None, texts), " ")
    sizes = pc.list_value_length(plain).fill_null(0).to_numpy().astype(np.int64)
    units, mine = plain.flatten(), None
    if pc.any(odd).as_py():
        others = [[u[1:] for u in UNITS.findall(" " + t)] for t in texts.filter(odd).to_pylist()]
        odd = odd.to_numpy(zero_copy_only=False)
        sizes[odd] = [len(x) for x in others]
        mine, many = np.repeat(odd, sizes), len(units)
        units = pa.concat_arrays([units, pa.array(chain.from_iterable(others), units.type)])
    coded = units.dictionary_encode()
    places = coded.indices.to_numpy()
    if mine is not None:
        own = places
        places = np.empty(len(own), dtype=own.dtype)
        places[~mine], places[mine] = own[:many], own[many:]
    return coded.dictionary, places, np.concatenate(([0], np.cumsum(sizes)))


def n_best(lattice: Lattice, own: np.ndarray, n: int) -> list[tuple[float, list[tuple[int, list[int]]]]]:
    """The 2nd to nth best segmentations of a text as (loss, [(unit's place, ids)])."""
    loss, places = lattice.loss[own], []
    while len(places) < min(n - 1, len(own)):  # the first of equal ones
        p = int(loss.argmin())
        if not np.isfinite(loss[p]):
            break
        places.append(p)
        loss[p] = np.inf
    if not places:
        return []
    lists = [lattice.top(int(own[p]), n) for p in places]
    out, heap, seen = [], [(0, (0,) * len(places))], {(0,) * len(places)}
    while heap and len(out) < n:
        total, picks = heapq.heappop(heap)
        out.append((total, [(p, lists[j][r][1]) for j, (p, r) in enumerate(zip(places, picks, strict=True)) if r]))
        for j in range(len(places)):
            following = (*picks[:j], picks[j] + 1, *picks[j + 1:])
            if following[j] < len(lists[j]) and following not in seen:
                seen.add(following)
                heapq.heappush(heap, (sum(lists[i][r][0] for i, r in enumerate(following)), following))
    return out[1:]


EDIT = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
ALTERNATIVE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("edits", T.ArrayType(EDIT))])
ENCODED = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("best_ids", T.ArrayType(T.IntegerType())), T.StructField("score", T.DoubleType()), T.StructField("alternatives", T.ArrayType(ALTERNATIVE))]


def encode_texts(lattice: Lattice, texts: pa.Array | list[str], n: int) -> list[tuple[np.ndarray, float, list[dict], np.ndarray]]:
    """(best ids, score, alternatives, ids by merges) of each text."""
    if len(lattice.known) > REMEMBERED:
        lattice.forget()
    units, places, cuts = split_units(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    numbers = lattice.number(units)
    lattice.used[numbers] += np.bincount(places, minlength=len(units))
    known = numbers[places]
    ids, at = lattice.paths(known)
    merged, merged_at = lattice.paths(known, merged=True) if lattice.merges else (ids, at)
    out = []
    for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own, begin = known[first:last], at[first]
        score, others = lattice.best[own].sum(), []
        for loss, edits in n_best(lattice, own, n) if n > 1 else ():
            others.append({"score": float(score - loss), "edits": [{"start": int(at[first + p] - begin), "end": int(at[first + p + 1] - begin), "ids": own_ids} for p, own_ids in sorted(edits)]})
        out.append((ids[begin:at[last]], float(score), others, merged[merged_at[first]:merged_at[last]]))
    return out


def encode(docs: DataFrame, carry: list[str], text: str = "text", n: int = N_BEST, model: str = MODEL) -> DataFrame:
    """The carried columns with the model's own ids; best_ids and score of the best segmentation, and the next n - 1
    as scores and edits of it: pieces start to end of the best are replaced by ids."""
    spark = docs.sparkSession
    text_batches(spark)
    state = spark.sparkContext.broadcast(Lattice(vocabulary(model), model_bytes(model)))
    rows = docs.select(*carry, F.coalesce(F.col(text), F.lit("")).alias("_encoded_text"))
    schema = T.StructType([*docs.select(*carry).schema.fields, *ENCODED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = state.value  # one a worker: what a task has learned is given back at its end
        lattice.clear()
        for batch in batches:
            offsets = utf8(batch.column(batch.num_columns - 1))[1]
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
                part = batch.slice(at, stop - at)
                done = encode_texts(lattice, part.column(part.num_columns - 1), n)
                lists = lambda k, done=done: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x[k]) for x in done]))).astype(np.int32)), pa.array(np.concatenate([x[k] for x in done]).astype(np.int32)))
                edit = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ids", pa.list_(pa.int32()))])
                others = pa.array([x[2] for x in done], pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(edit))])))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists(3), lists(0), pa.array([x[1] for x in done]), others], names=[f.name for f in schema.fields])
                at = stop
            del done, others, part, batch
            give_back()
        lattice.clear()
        give_back()

    return rows.mapInArrow(run, schema)


def decode_ids(piece_bytes: list[bytes], ids: list[int]) -> str:
    """The text of a list of ids."""
    text = b"".join([piece_bytes[i] for i in ids]).decode("utf-8", "replace").replace(ESCAPED, " ")
    return text[1:] if text.startswith(" ") else text


class Decoder:
    """Texts of many lists of ids at once."""

    def __init__(self, piece_bytes: list[bytes]):
        self.raw = piece_bytes
        plain = [x.replace(ESCAPED.encode(), b" ") for x in piece_bytes]
        self.data = np.frombuffer(b"".join(plain), dtype=np.uint8)
        self.size = np.array([len(x) for x in plain], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size

    def texts(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts of the lists that begin at ``at``, with the end."""
        size = self.size[ids]
        stop = np.concatenate(([0], np.cumsum(size)))
        data = self.data[np.repeat(self.begin[ids] - stop[:-1], size) + np.arange(stop[-1])]
        offsets = stop[at]
        # The space that the model puts before a text goes.
        some = np.flatnonzero(offsets[1:] > offsets[:-1])
        keep = np.ones(len(data), dtype=bool)
        keep[offsets[some][data[offsets[some]] == 32]] = False
        kept = np.concatenate(([0], np.cumsum(keep)))
        out = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(kept[offsets].astype(np.int32)), pa.py_buffer(data[keep])])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            return pa.array([decode_ids(self.raw, ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())
        return out


def decode(encoded: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``encoded`` with a column ``decoded`` made from ids."""
    raw = [bytes([int(p[3:5], 16)]) if byte else b"" if s != s else p.encode() for p, s, byte in vocabulary(model)]
    state = encoded.sparkSession.sparkContext.broadcast(raw)

    @F.arrow_udf("string")
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(state.value)
        for lists in batches:
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat, parts, at = lists.values.to_numpy(zero_copy_only=False), [], 0
            while at < len(lists):
                stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + DECODED, "right")) - 1)
                parts.append(decoder.texts(flat[offsets[at]:offsets[stop]], offsets[at:stop + 1] - offsets[at]))
                at = stop
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())
            del parts, lists, flat
            give_back()

    return encoded.withColumn("decoded", text_of(ids))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's own encoding and best segmentation as counts and digests, whether the best decodes to the
    text, its score, and the losses and edits of its next best ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # The model reads its escape character as a space, so a text with one decodes to a text with spaces.
    docs = docs.withColumn("text_sha256", F.sha2(F.translate("text", ESCAPED, " "), 256))
    return report(decode(encode(docs, ["doc_id", "text_sha256"]), "best_ids"))


def report(done: DataFrame) -> DataFrame:
    return done.select(
        "doc_id", F.size("best_ids").cast("long").alias("n_pieces"), "score", F.sha2(F.array_join("best_ids", " "), 256).alias("ids_sha256"),
        F.size("ids").cast("long").alias("n_merged"), F.xxhash64("ids").alias("merged_hash"),
        (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"),
        F.transform("alternatives", lambda a: F.col("score") - a["score"]).alias("losses"), F.to_json("alternatives.edits").alias("edits"),
    )
