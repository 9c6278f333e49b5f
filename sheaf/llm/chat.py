"""Chat formatting by prefix-target expansion.

A conversation becomes one stream of formatted turns.  Every assistant turn is
an example of its own: its text is the stream from the start to the end of that
turn, and only that reply is trainable.  As each example is a prefix of the
same stream, examples are kept as ranges over it, which is linear in the
conversation; :func:`expand` writes their texts out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Template, and the control strings that texts may not contain as they are.
OPEN, CLOSE, INST, END_INST = "<s>", "</s>", "[INST]", "[/INST]"
_CONTROL = r"(?<=[<\[])(?=/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    r"""Doubles backslashes and puts one inside each control string, as in ``<\s>``."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def format_turns(conv: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    r"""One formatted piece per turn: conv_id, turn, role, piece, body_start, body_chars.

    A piece is ``<s>[INST]role[/INST]text</s>``; body_start and body_chars give
    the place of the escaped text in it.  Null roles and texts are empty.
    """
    own_role, body = escape(F.coalesce(F.col(role).cast("string"), F.lit(""))), escape(F.coalesce(F.col(text).cast("string"), F.lit("")))
    head = F.concat(F.lit(OPEN + INST), own_role, F.lit(END_INST))
    return conv.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.concat(head, body, F.lit(CLOSE)).alias("piece"),
        F.char_length(head).cast("long").alias("body_start"), F.char_length(body).cast("long").alias("body_chars"),
    )


def numbered(pieces: DataFrame) -> DataFrame:
    """Pieces with n_turns and n_chars, the stream's size up to and with each, and whether one is the last.

    Turns are in order, equal ones by role, then piece.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "piece")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    return pieces.select(
        "*", F.sum(F.char_length("piece")).over(before).alias("n_chars"), F.count(F.lit(1)).over(before).alias("n_turns"), F.lead(F.lit(1)).over(order).isNull().alias("last")
    )


def examples(pieces: DataFrame) -> DataFrame:
    """One row per trainable reply, plus one without a target for turns after the last reply.

    conv_id, example, n_turns, n_chars (the prefix of the stream), loss_start,
    loss_end (code points in it; null without a target).  Null texts are empty
    turns; rows with a null conv_id are one conversation; repeated rows are turns
    of their own; an empty table gives no rows.
    """
    target = F.col("role") == "assistant"
    start = F.col("n_chars") - F.char_length("piece") + F.col("body_start")
    return numbered(pieces).filter(target | F.col("last")).select(
        "conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("n_turns")).alias("example"), "n_turns", "n_chars",
        F.when(target, start).alias("loss_start"), F.when(target, start + F.col("body_chars")).alias("loss_end"),
    )


def expand(pieces: DataFrame, rows: DataFrame) -> DataFrame:
    """The text of each example.  Its size is the square of a conversation's; for short ones."""
    turns = pieces.groupBy("conv_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "piece"))), lambda x: x["piece"])).alias("stream"))
    return rows.join(turns, rows.conv_id.eqNullSafe(turns.conv_id)).select(rows["*"], F.substr("stream", F.lit(1), F.col("n_chars").cast("int")).alias("text"))


#: What an example says besides its place in the stream.
_RANGES = ("example", "n_chars", "loss_start", "loss_end")
_HEAD = re.compile(re.escape(OPEN + INST) + r"(.*?)" + re.escape(END_INST), re.S)
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads each piece and then the examples that end with it, and keeps running digests.

    Masked text and sizes are those of the examples: slices of the stream by
    their ranges.  An example that is no prefix of whole turns, masks anything
    but its last reply, or is missing or there twice is an error.
    """
    now: tuple | None = None
    done: list[tuple] = []
    turns = loss = None
    n = loss_chars = at = total = made = 0
    piece, role, body, due = "", "", (0, 0), False

    def wrong(what: str):
        raise ValueError(f"conversation {now[0]}, turn {n}: {what}")

    def ended():
        if due:
            wrong("a turn without its example")
        done.append((now[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), total))

    for batch in batches:
        for conv, own, example, n_turns, n_chars, start, end in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now[0] != conv:
                if now is not None:
                    ended()
                now, turns, loss, n, loss_chars, at, total, made = (conv,), hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0, 0
                role, due = "", False
            if own is not None:
                if due and role == "assistant":
                    wrong("a reply without its example")
                head = _HEAD.match(own)
                piece, role, text = own, unescape(head[1]), unescape(own[head.end() : -len(CLOSE)])
                body, due = (head.end(), len(own) - len(CLOSE)), True
                if (start, end) != body or n_chars != at + len(own):
                    wrong("a text that is not where its turn says")
                turns.update(f"{role}\n{text}\n".encode())
                n, at = n + 1, at + len(own)
                continue
            before = at - len(piece)
            if not due or (n_turns, n_chars) != (n, at):
                wrong("an example that is no prefix of whole turns")
            if example != made + 1:
                wrong("examples that are not numbered from 1")
            made, due, total = example, False, total + n_chars
            if (role == "assistant") != (start is not None):
                wrong("a mask without a reply, or a reply without a mask")
            if start is not None:
                if (start - before, end - before) != body:
                    wrong("a mask that is not the reply")
                text = unescape(piece[start - before : end - before])
                loss.update(text.encode())
                loss_chars += len(text)
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(_DIGEST.names, r)) for r in done], _DIGEST)
            done.clear()
    if now is not None:
        ended()
        yield pa.RecordBatch.from_pylist([dict(zip(_DIGEST.names, r)) for r in done], _DIGEST)


def digests(pieces: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """What a reader finds in the examples ``rows`` of the formatted output, per conversation.

    ``rows`` are those of :func:`examples` unless given.  Turns are read from
    the stream; masked text and formatted_chars, the sum over the conversation's
    examples, from the examples' ranges over it, and a wrong range is an error.
    Memory is one batch of turns, whatever the length of a conversation.  Rows
    with a null conv_id are one conversation; repeated rows are turns of their
    own; a conversation without an assistant turn has an empty loss text.  An
    empty table gives no rows.
    """
    rows = examples(pieces) if rows is None else rows
    none = F.lit(None).cast("long")
    conv = F.col("conv_id").cast("long").alias("conv_id")
    # with their body ranges turns read the columns that examples read, and the text is shuffled once for both
    turns = numbered(pieces).select(conv, "n_turns", "piece", none.alias("example"), "n_chars", F.col("body_start").alias("loss_start"), (F.col("body_start") + F.col("body_chars")).alias("loss_end"))
    ranges = rows.select(conv, "n_turns", F.lit(None).cast("string").alias("piece"), *[F.col(c).cast("long").alias(c) for c in _RANGES])
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = turns.union(ranges).repartition(n, "conv_id").sortWithinPartitions("conv_id", "n_turns", F.col("piece").isNull())
    return stream.select("conv_id", "piece", "example", F.col("n_turns").cast("long"), "n_chars", "loss_start", "loss_end").mapInArrow(
        _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
