"""Chat formatting: event-sourced conversations, rendered in a reversible template with a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that tokenizers of chat models read as control tokens.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
KINDS = ("message", "delta", "edit", "regenerate", "delete")
SEGMENT, MAX_CHARS = 64, 1 << 18

_control = re.compile("|".join(map(re.escape, CONTROL)))
_turn = re.compile(re.escape(OPEN) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(CLOSE) + r"\n", re.S)


def escape(text: str) -> str:
    r"""Doubles each backslash and puts one behind the first character of a control string."""
    return _control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """What was given to ``escape`` or ``escape_role``."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    """A role may hold line breaks; the first plain one ends the header."""
    return escape(role).replace("\n", "\\\n")


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, with the start and length of the text in it (code points)."""
    head = f"{OPEN}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(body)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of the turns in a formatted string."""
    for m in _turn.finditer(formatted):
        yield unescape(m[1]), unescape(m[2])


def fold(events: Iterator[tuple]) -> Iterator[tuple]:
    """Final messages from sorted events ``(key, turn, kind, role, text)``: ``(key, role, text)``.

    A ``message`` opens a message. A ``delta`` adds to the open one of its
    turn, an ``edit`` replaces its text, ``regenerate`` empties it for new
    deltas, ``delete`` drops it. Any but a message opens one if its turn has none.
    """
    at, role, parts = None, "", None

    def done() -> Iterator[tuple]:
        if parts is not None:
            yield at[0], role, "".join(parts)

    for key, turn, kind, who, text in events:
        if kind not in KINDS:
            raise ValueError(f"unknown kind of event: {kind!r}")
        if kind == "message" or at != (key, turn):
            yield from done()
            at, role, parts = (key, turn), who, []
        if kind == "delete":
            parts = None
            continue
        if kind in ("edit", "regenerate") or parts is None:
            parts = []
        if kind != "regenerate":
            parts.append(text)
            role = who or role
    yield from done()


def events_from_turns(turns: DataFrame) -> DataFrame:
    """A table of finished turns ``(conv_id, turn, role, text)`` as an event log: one ``message`` each."""
    return turns.select("conv_id", "turn", F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def format_conversations(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``(conv_id, segment, part, formatted, n_turns, loss)`` from events ``(conv_id, turn, seq, kind, role, text)``.

    Events are dealt by conversation and run of 64 turns, sorted by turn and
    seq, folded (see ``fold``) and rendered; so no conversation, however
    long, meets in one task or one cell: a cell ends beyond 262,144
    characters. loss holds ``(start, end)`` code points of formatted, end
    exclusive, of the texts of ``loss_roles``. Segments and parts in order
    give the conversation. Null turns come first, ties go by kind, role and text,
    repeated events count each; null roles and texts are empty. Null ids
    form one conversation; an empty table gives no row.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for conv, segment, turn, kind, role, text in zip(*cols, strict=True):
                yield (conv, segment), turn, kind, role or "", text or ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, texts, loss, turns, size = None, 0, [], [], 0, 0
        out: list[tuple] = []

        def close() -> None:
            if texts:
                out.append((*key, part, "".join(texts), turns, loss))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        waiting = 0
        for new, role, text in fold(rows(batches)):
            if new != key or size > MAX_CHARS:
                close()
                waiting += size
                part = part + 1 if new == key else 0
                key, texts, loss, turns, size = new, [], [], 0, 0
                if waiting > MAX_CHARS:
                    yield flush()
                    out, waiting = [], 0
            turn, start, length = render(role, text)
            if role in loss_roles:
                loss.append({"start": size + start, "end": size + start + length})
            texts.append(turn)
            size += len(turn)
            turns += 1
        close()
        yield flush()

    kind = events.schema["conv_id"].dataType
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("segment", T.LongType()), T.StructField("part", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("n_turns", T.LongType()), T.StructField("loss", span)])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    segment = F.floor(F.col("turn") / SEGMENT).cast("long")
    dealt = events.select("conv_id", segment.alias("segment"), "turn", "seq", "kind", "role", "text").repartition("conv_id", "segment")
    ranked = dealt.sortWithinPartitions("conv_id", "segment", "turn", "seq", "kind", "role", "text")
    return ranked.select("conv_id", "segment", "turn", "kind", "role", "text").mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``, read back from formatted segments.

    Both digests run over the whole conversation in order. The segments, a
    row for 64 turns, are streamed through them; none is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, key, out = True, None, []
        state: list = []

        def close() -> None:
            n, turns, chars, loss, size = state
            out.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            for conv, formatted, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if first or conv != key:
                    if not first:
                        close()
                    first, key, state = False, conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in spans:
                    text = unescape(formatted[span["start"] : span["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(formatted)
        if not first:
            close()
        cols = list(zip(*out, strict=True)) or [[] for _ in arrow]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = formatted.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    arrow = to_arrow_schema(schema)
    ranked = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "part")
    return ranked.select("conv_id", "formatted", "loss").mapInArrow(run, schema)
