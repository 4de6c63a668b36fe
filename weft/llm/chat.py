"""Chat formatting: conversations rendered by a compiled template, with a loss mask, and read back.

Turns are shuffled by conversation and stream in order through the template: a task holds two turns and one chunk of
output, so a conversation of any length needs little memory. It stays in one task, since its digests are of its turns
in order. Chunks end at turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import keep, table, tasks
from weft.llm.template import CONTROLS, Template, joined, unescape

TEMPLATE = (
    "{% for message in messages %}<|turn|>{{ message.role | escape }}<|text|>"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}<|end|>\n{% endfor %}"
)
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.S)
FORMATTED = "conv_id long, chunk long, text string, mask array<struct<start:long,end:long>>"
_MASK = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns), strict=True)


def format_chats(turns: DataFrame, template: str = TEMPLATE, *, chunk_chars: int = 1 << 20) -> DataFrame:
    """Rows (conv_id, chunk, text, mask) of the formatted conversations; masks are code points within the chunk.

    Turns are in the order of turn, then role and text, nulls first; repeated rows are turns of their own. Null text or
    role: empty. Null conversation ids form one conversation. Other columns are ignored. An empty table gives no row.
    """
    Template(template)  # errors show here

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template)
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            n, held, size = 0, [], 0
            for pieces in compiled.stream({"role": r[1], "text": r[2]} for r in rows):
                held += pieces
                size += sum(len(t) for t, _ in pieces)
                if size >= chunk_chars:
                    yield chunk(conv, n, held)
                    n, held, size = n + 1, [], 0
            if held or not n:
                yield chunk(conv, n, held)

    def chunk(conv: int | None, n: int, pieces: list) -> pa.RecordBatch:
        text, marks = joined(pieces)
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([n], pa.int64()), pa.array([text]), pa.array([[{"start": s, "end": e} for s, e in marks]], _MASK)], ["conv_id", "chunk", "text", "mask"])

    rows = turns.select(F.col("conv_id").cast("long").alias("c"), "turn", F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("x"))
    rows = rows.repartition(tasks(turns.sparkSession), "c").sortWithinPartitions("c", "turn", "r", "x").select("c", "r", "x")
    return rows.mapInArrow(render, FORMATTED)


def read_chats(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text holds, per conversation; for texts made by ``TEMPLATE``."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for conv, chunks in groupby(_rows(batches), key=lambda r: r[0]):
            n = loss_chars = chars = 0
            turns, loss = hashlib.sha256(), hashlib.sha256()
            for _, text, mask in chunks:
                at = 0
                for m in _TURN.finditer(text):
                    if m.start() != at:
                        raise ValueError(f"conversation {conv}: text between turns")
                    at, n = m.end(), n + 1
                    turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                if at != len(text):
                    raise ValueError(f"conversation {conv}: text after the last turn")
                for x in mask:
                    own = unescape(text[x["start"] : x["end"]])
                    loss.update(own.encode())
                    loss_chars += len(own)
                chars += len(text)
            found.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(found) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    rows = formatted.repartition(tasks(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "chunk").select("conv_id", "text", "mask")
    return rows.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "</s>[INST] ok [/INST]"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_chats(keep(format_chats(turns.unionByName(probe)), "op7-chats"))


def _marks(column: str) -> str:
    """How many backslashes the escape adds to a text."""
    return " + ".join(f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in (*CONTROLS, "\\"))


OP7_SQL = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -1, 0, 'user', '{PROBE}' union all select -1, 1, 'assistant', '{PROBE}')
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(cast(sum(length(text)) filter (role = 'assistant') as bigint), 0) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum({len("<|turn|><|text|><|end|>") + 1} + length(role) + length(text) + {_marks("role")} + {_marks("text")}) as bigint) as formatted_chars
from t group by conv_id
"""
