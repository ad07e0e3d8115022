"""Relational chat formatting, with Spark expressions only.

One row per conversation.  Turn structs are collected and sorted, adjacent turns of
one role share one block, and everything is concatenated::

    <turn user>
    first text<next/>second text of the same role</turn>
    <turn assistant>
    answer</turn>

Control strings inside texts and roles are escaped so that the format can be read
back: ``\\`` becomes ``\\b`` and the ``<`` of a control string becomes ``\\l`` (in roles
also ``>`` becomes ``\\g`` and a newline ``\\n``).  After that every backslash is
followed by one of these letters and no text holds a control string.

Defined cases: a null text or role counts as empty; a null ``turn`` sorts first; turns
with one number are ordered by role, then text, and repeated rows all stay; rows with a
null ``conv_id`` form one conversation of their own; other columns are ignored.
A conversation is one output value, so its turns do meet in one task; everything
per turn happens before, and all array work is linear in the number of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, OPEN_END, NEXT, CLOSE = "<turn ", ">\n", "<next/>", "</turn>\n"
CONTROL = ("<turn", "</turn", "<next")
LOSS_ROLE = "assistant"


def _swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape_text(c: Column) -> Column:
    c = _swap(c, "\\", "\\b")
    for control in CONTROL:
        c = _swap(c, control, "\\l" + control[1:])
    return c


def unescape_text(c: Column) -> Column:
    return _swap(_swap(c, "\\l", "<"), "\\b", "\\")


def escape_role(c: Column) -> Column:
    for old, new in (("\\", "\\b"), ("<", "\\l"), (">", "\\g"), ("\n", "\\n")):
        c = _swap(c, old, new)
    return c


def unescape_role(c: Column) -> Column:
    for old, new in (("\n", "\\n"), (">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        c = _swap(c, new, old)
    return c


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, n_blocks, formatted, segments`` for each conversation.

    ``segments`` is an array of ``struct<text, loss>`` whose texts concatenate to
    ``formatted``; ``loss`` marks exactly the (escaped) assistant texts.
    """
    each = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    ordered = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def starts(i: Column) -> Column:
        return (i == 0) | (F.get("turns", i - 1)["role"] != F.get("turns", i)["role"])

    def pair(t: Column, i: Column) -> Column:
        header = F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(OPEN_END))
        glue = F.when(i == 0, header).when(starts(i), F.concat(F.lit(CLOSE), header)).otherwise(F.lit(NEXT))
        return F.array(
            F.struct(glue.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape_text(t["text"]).alias("text"), (t["role"] == LOSS_ROLE).alias("loss")),
        )

    tail = F.array(F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")))
    blocks = F.size(F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: starts(i)))
    segmented = ordered.select(
        "conv_id",
        blocks.cast("long").alias("n_blocks"),
        F.concat(F.flatten(F.transform("turns", pair)), tail).alias("segments"),
    )
    return segmented.select(
        "conv_id", "n_blocks", F.array_join(F.col("segments")["text"], "").alias("formatted"), "segments"
    )


def read_back(formatted: Column) -> Column:
    """The array of ``struct<role, text>`` turns that ``formatted`` was made from."""
    blocks = F.split(formatted, CLOSE, -1)

    def block(b: Column) -> Column:
        head = F.substring_index(b, OPEN_END, 1)
        body = b.substr(F.length(head) + len(OPEN_END) + 1, F.length(b))
        role = unescape_role(head.substr(F.lit(len(OPEN) + 1), F.length(head)))
        return F.transform(
            F.split(body, NEXT, -1),
            lambda t: F.struct(role.alias("role"), unescape_text(t).alias("text")),
        )

    return F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), block))


def digests(formatted: DataFrame) -> DataFrame:
    """Digest columns read back from the operator's output."""
    loss = unescape_text(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    back = formatted.select(
        "conv_id", "n_blocks", "formatted", read_back(F.col("formatted")).alias("turns"), loss.alias("loss_text")
    )
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )
