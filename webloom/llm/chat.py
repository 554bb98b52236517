"""Chat formatting by prefix-target expansion, with column expressions only.

The template marks a turn as ``[INST] role [/INST]text</s>``. Control strings
inside roles and texts are escaped, so that a formatted string can be read
back: ``\\`` becomes ``\\e``, and the first character of a control string
``\\l`` (for ``<``) or ``\\b`` (for ``[``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import let, sums_before

OPEN, CLOSE, END = "[INST] ", " [/INST]", "</s>"
TARGET_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Text without control strings, from which ``unescape`` gives the text back."""
    bare = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\e"))
    bare = F.regexp_replace(bare, r"<(?=/?s>)", r"\\l")
    return F.regexp_replace(bare, r"\[(?=/?INST\])", r"\\b")


def unescape(text: Column) -> Column:
    bare = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    return F.replace(bare, F.lit("\\e"), F.lit("\\"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """``(conv_id, formatted)`` of ``rows(conv_id, turn, role, text)``: each conversation as one string.

    Turns stand by turn number, nulls first; ties by role, then text. Null
    roles and texts are empty. Repeated rows are turns of their own. Rows
    without conv_id are one conversation. Other columns are not read.
    """
    turns = rows.select("conv_id", F.struct("turn", "role", "text").alias("t")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("t")).alias("turns"))
    marked = F.transform("turns", lambda t: F.concat(
        F.lit(OPEN), escape(t.role), F.lit(CLOSE), escape(t.text), F.lit(END)))
    return turns.select("conv_id", F.array_join(marked, "").alias("formatted"))


def _pieces(formatted: Column) -> Column:
    """The marked turns of a formatted string, without their end marks."""
    parts = F.split(formatted, END, -1)
    return F.slice(parts, 1, F.size(parts) - 1)


def _role(piece: Column) -> Column:
    return F.substring(F.substring_index(piece, CLOSE, 1), len(OPEN) + 1, 1 << 30)


def _body(piece: Column) -> Column:
    return F.substring(piece, F.length(F.substring_index(piece, CLOSE, 1)) + len(CLOSE) + 1, 1 << 30)


def read_turns(formatted: Column) -> Column:
    """Array of ``(role, text)`` read back from a formatted conversation."""
    return F.transform(_pieces(formatted), lambda p: F.struct(
        unescape(_role(p)).alias("role"), unescape(_body(p)).alias("text")))


def _placed(formatted: Column) -> Column:
    """Array of ``(at, piece)``: the marked turns and the code points before each."""
    return let(_pieces(formatted), lambda pieces: F.zip_with(
        sums_before(F.transform(pieces, lambda p: F.length(p) + len(END))), pieces,
        lambda at, p: F.struct(at.alias("at"), p.alias("piece"))))


def expand(conversations: DataFrame, role: str = TARGET_ROLE) -> DataFrame:
    """Training examples of ``conversations(conv_id, formatted)``: one for every turn of ``role``.

    ``(conv_id, example, context, reply, loss_start, loss_end)``: ``context``
    holds all preceding turns and the mark that opens the reply, ``reply`` the
    turn's text; only it is trainable: code points ``loss_start`` to
    ``loss_end`` (exclusive) of context, reply and end mark together.
    ``example`` is the turn's place in the conversation. One without such a
    turn gives no example; an empty reply gives an empty range. Examples stream
    out of a conversation one by one, without a window or a sort over them.
    """
    turns = conversations.select("conv_id", "formatted", F.posexplode(_placed(F.col("formatted"))).alias("example", "t"))
    turns = turns.filter(_role(F.col("t.piece")) == escape(F.lit(role)))
    reply = _body(F.col("t.piece"))
    start = F.col("t.at") + F.length("t.piece") - F.length(reply)
    return turns.select("conv_id", "example", F.substring("formatted", F.lit(1), start.cast("int")).alias("context"),
                        reply.alias("reply"), start.alias("loss_start"),
                        (start + F.length(reply)).alias("loss_end"))


def masked(examples: DataFrame) -> Column:
    """The text under the loss mask of an example, unescaped."""
    whole = F.concat(examples["context"], examples["reply"], F.lit(END))
    size = examples["loss_end"] - examples["loss_start"]
    return unescape(F.substring(whole, (examples["loss_start"] + 1).cast("int"), size.cast("int")))


def digest(conversations: DataFrame) -> DataFrame:
    """What the formatted conversations and their examples hold: turns read back from the former, trained text under
    the loss mask of the latter.

    Examples are built whole and read one by one. They are not written first:
    a batch of Spark's Parquet reader holds 4096 of them, each with its prefix.
    """
    examples = expand(conversations)
    turns = read_turns(F.col("formatted"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    whole = conversations.select(
        "conv_id", F.size(_pieces(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
    trained = examples.select(F.col("conv_id").alias("id"), "example", masked(examples).alias("text")).groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("example", "text"))).alias("replies"))
    trained = trained.select("id", F.array_join(F.transform("replies", lambda e: e.text), "").alias("loss"))
    loss = F.coalesce("loss", F.lit(""))
    return whole.join(trained, F.col("conv_id").eqNullSafe(F.col("id")), "left").select(
        "conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
