"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only that reply
is trainable. Turns after the last reply (or a conversation without a reply) end in one more example with
no trainable text, so that the output still holds every turn. The contexts of a conversation of n replies come to
about n / 2 times its text: that is the method's own growth, and a conversation must fit one task with them.

Control strings inside texts and roles are escaped reversibly: & becomes &amp; and <| becomes &lt;| (in
roles also the newline, as &#10;), so that <| appears only where the template puts it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("&#10;"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def prefix_targets(turns: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 0), n_turns, formatted, loss_start and loss_length (code
    points of formatted under the loss mask), last (the example that holds all turns).

    Turns go by turn, a null turn first, then by role and text; repeated rows stay. A null role or text is
    empty; rows of a null conv_id are one conversation. Texts of any length are taken whole. An empty table gives
    no example. Further columns are not used.
    """
    empty = F.lit("")
    each = turns.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    whole = each.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    whole = whole.withColumn(
        "parts",
        F.transform("turns", lambda t: F.struct(F.concat(F.lit(START), escaped_role(t.role), F.lit("\n")).alias("head"), escaped(t.text).alias("body"), (t.role == "assistant").alias("reply"))),
    )
    ends = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: F.element_at("parts", i).reply | (i == F.size("parts")))
    rows = whole.select("conv_id", "parts", F.posexplode(ends).alias("example", "n_turns"))
    shown = lambda parts: F.array_join(F.transform(parts, lambda p: F.concat(p.head, p.body, F.lit(END + "\n"))), "")
    target = F.element_at("parts", F.col("n_turns"))
    rows = rows.select("conv_id", "example", "n_turns", (F.col("n_turns") == F.size("parts")).alias("last"), target.alias("target"), shown(F.slice("parts", 1, F.col("n_turns") - 1)).alias("context"))
    return rows.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.col("n_turns").cast("long").alias("n_turns"),
        F.concat("context", "target.head", "target.body", F.lit(END + "\n")).alias("formatted"),
        (F.char_length("context") + F.char_length("target.head")).cast("long").alias("loss_start"),
        F.when(F.col("target.reply"), F.char_length("target.body")).otherwise(0).cast("long").alias("loss_length"),
        "last",
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example, as an array of role and text."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    pieces = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.substr(p, F.lit(len(START) + 1)))
    return F.transform(
        pieces,
        lambda p: F.struct(unescaped_role(F.substring_index(p, "\n", 1)).alias("role"), unescaped(F.substr(p, F.char_length(F.substring_index(p, "\n", 1)) + 2)).alias("text")),
    )


def read_loss(formatted: Column, start: Column, length: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescaped(F.substr(formatted, (start + 1).cast("int"), length.cast("int")))
