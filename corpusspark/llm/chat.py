"""Chat formatting: conversations rendered by a compiled template, with a loss mask.

Rows are dealt by conversation and sorted by turn inside each task; the renderer and the reader work
on streams, so a conversation of any number of turns needs the memory of one turn.

Control strings inside texts are made harmless reversibly: one backslash more goes behind the first
character of each (``<s>`` becomes ``<\\s>``, ``<\\s>`` becomes ``<\\\\s>``), and reading takes one away.

Edge cases: null text and null role are empty; rows with the same turn follow each other by role and
text; a null conv_id is a conversation; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusspark.llm.common import table
from corpusspark.llm.template import compile_template

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings with a meaning to this template or to common chat models.
CONTROL = [TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>"]
_AT = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROL))
TEMPLATE = (
    "{%- for m in messages -%}" + TURN + "{{ m.role | guard }}" + TEXT
    + "{% if m.role == 'assistant' %}{% generation %}{{ m.text | guard }}{% endgeneration %}"
    + "{% else %}{{ m.text | guard }}{% endif %}" + END + "{{ '\\n' }}{% endfor %}"
)
#: Code points of formatted text in one output row, before the turn that passes it ends.
PIECE = 65_536
FORMATTED = "conv_id long, piece_no long, piece string, loss array<array<long>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def guard(text: str) -> str:
    return _AT.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unguard(text: str) -> str:
    return _AT.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(conv_id, role, text) of rows sorted by conversation."""
    for pdf in batches:
        yield from zip(pdf["conv_id"].array, pdf["role"].array, pdf["text"].array, strict=True)


def _same(a, b) -> bool:
    return a is b or (pd.isna(a) and pd.isna(b)) or bool(not pd.isna(a) and not pd.isna(b) and a == b)


def _groups(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Like itertools.groupby, with nulls equal."""
    row = next(rows, None)
    while row is not None:
        key = row[0]

        def own():
            nonlocal row
            while row is not None and _same(row[0], key):
                yield row
                row = next(rows, None)

        yield key, own()


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, piece_no, piece, loss: a conversation's pieces joined in order are its formatted text;
    ``loss`` has the [start, end) offsets under generation markers, counted from the conversation's start."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = compile_template(template, guard=guard)
        for key, own in _groups(_conversations(batches)):
            messages = ({"role": r, "text": t} for _, r, t in own)
            parts, loss, at, n, size = [], [], 0, 0, 0
            for text, marked in run(messages=messages):
                parts.append(text)
                if marked and text:
                    loss.append([at, at + len(text)])
                at += len(text)
                size += len(text)
                if size >= PIECE:
                    yield _piece(key, n, parts, loss)
                    parts, loss, n, size = [], [], n + 1, 0
            if parts:
                yield _piece(key, n, parts, loss)

    return rows.drop("turn").mapInPandas(_batched(render), FORMATTED)


def _piece(key, n, parts, loss):
    return (None if pd.isna(key) else int(key), n, "".join(parts), loss)


def _batched(rows_of, size: int = 2_000, chars: int = 4_000_000):
    """Rows made by ``rows_of`` gathered into frames of bounded size."""

    def run(batches):
        out, held = [], 0
        for row in rows_of(batches):
            out.append(row)
            held += len(row[2])
            if len(out) >= size or held >= chars:
                yield _frame(out)
                out, held = [], 0
        if out:
            yield _frame(out)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "piece_no", "piece", "loss"])
    return out.assign(conv_id=out["conv_id"].astype("Int64"))


class Reader:
    """Reads one conversation back from its pieces."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.open = ""

    def feed(self, piece: str, loss) -> None:
        for start, end in loss:
            text = unguard(piece[start - self.chars:end - self.chars])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.chars += len(piece)
        text, at = self.open + piece, 0
        while (stop := text.find(END + "\n", at)) >= 0:
            if not text.startswith(TURN, at) or (mid := text.find(TEXT, at, stop)) < 0:
                raise ValueError("the formatted text can't be read back")
            role, body = text[at + len(TURN):mid], text[mid + len(TEXT):stop]
            self.turns.update(f"{unguard(role)}\n{unguard(body)}\n".encode())
            self.n += 1
            at = stop + len(END) + 1
        self.open = text[at:]


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, made from the formatted text alone. The pieces of a conversation must be
    in one partition and in order, as format_conversations leaves them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for pdf in batches for row in zip(pdf["conv_id"].array, pdf["piece"].array, pdf["loss"].array, strict=True))
        out = []
        for key, own in _groups(rows):
            reader = Reader()
            for _, piece, loss in own:
                reader.feed(piece, loss)
            if reader.open:
                raise ValueError("the formatted text ends inside a turn")
            out.append((None if pd.isna(key) else int(key), reader.n, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars))
            if len(out) >= 5_000:
                yield _digests(out)
                out = []
        if out:
            yield _digests(out)

    return formatted.mapInPandas(run, DIGESTS)


def _digests(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return out.assign(conv_id=out["conv_id"].astype("Int64"))


#: A conversation whose texts hold control strings of other templates, formatted with the others.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(probe)))


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
     e AS (SELECT *, len(regexp_extract_all(text, '<\\*\|(turn|text|end|im_start|im_end)\|>|<\\*/?s>|\[\\*/?INST\]')) AS escapes FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(text) + escapes + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
