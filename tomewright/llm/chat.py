"""Chat formatting by prefix-target expansion.

Every assistant turn becomes its own example: all preceding turns are context
and only that reply is trainable.  What remains behind the last assistant turn
(or a conversation without one) becomes one closing example that trains
nothing, so the output holds every turn of every conversation.

Template of a turn: ``<turn>`` role line-feed text ``</turn>``.  Inside roles
and texts each backslash is doubled and a backslash is put into every
``<turn>`` / ``</turn>``; a line feed in a role becomes backslash-n.  Hence a
marker in the output is always a real marker, and a single backslash is always
an escape: dropping single backslashes and halving double ones restores the text.

Rows of a conversation are ordered by turn (null last), then role, then text.
Null roles and texts count as empty, repeated rows stay, a null conversation
id is one conversation.  Only the named columns are read, so further columns
may have any name.  A conversation is assembled in one row: its last example
holds all its turns in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>"
_B = "\\"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit(_B), F.lit(_B * 2))
    c = F.replace(c, F.lit("<turn>"), F.lit(f"<{_B}turn>"))
    return F.replace(c, F.lit("</turn>"), F.lit(f"<{_B}/turn>"))


def unescape(c: Column) -> Column:
    parts = F.split(c, r"\\\\", -1)                 # pairs, left to right
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit(_B), F.lit(""))), _B)


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit(f"{_B}n"))


def unescape_role(c: Column) -> Column:
    parts = F.split(c, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit(f"{_B}n"), F.lit("\n")),
                                                               F.lit(_B), F.lit(""))), _B)


def format_conversations(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) -> examples.

    Output: conv_id, example (0, 1, ...), text (the formatted example),
    loss_start, loss_end (code points of ``text`` that are trained; both null
    on a closing example), last (the example holds the whole conversation).
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    conv = rows.select("conv_id", F.struct(
        F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"), blank("role").alias("role"),
        blank("text").alias("text")).alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    conv = conv.select("conv_id", F.transform("t", lambda t: F.struct(
        (t["role"] == "assistant").alias("reply"), F.length(escape(t["text"])).alias("n"),
        F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(CLOSE)).alias("s"))).alias("t"))
    picks = F.filter(F.sequence(F.lit(1), F.size("t")),
                     lambda i: F.get("t", i - 1)["reply"] | (i == F.size("t")))
    ex = conv.select("conv_id", "t", F.posexplode(picks).alias("example", "upto"))
    target = F.get("t", F.col("upto") - 1)
    text = F.array_join(F.transform(F.slice("t", F.lit(1), F.col("upto")), lambda x: x["s"]), "")
    ex = ex.select("conv_id", "example", text.alias("text"), target["reply"].alias("_r"), target["n"].alias("_n"),
                   (F.col("upto") == F.size("t")).alias("last"))
    end = F.length("text") - len(CLOSE)
    return ex.select("conv_id", F.col("example").cast("long").alias("example"), "text",
                     F.when(F.col("_r"), end - F.col("_n")).cast("long").alias("loss_start"),
                     F.when(F.col("_r"), end).cast("long").alias("loss_end"), "last")


def read_turns(text: Column) -> Column:
    """Formatted example -> array of (role, text), unescaped."""
    body = F.regexp_replace(text, f"^{OPEN}|{CLOSE}$", "")
    return F.transform(F.split(body, f"{CLOSE}{OPEN}", -1), lambda t: F.struct(
        unescape_role(F.substring_index(t, "\n", 1)).alias("role"),
        unescape(F.substr(t, F.instr(t, "\n") + 1)).alias("text")))


def read_loss(text: Column, start: Column, end: Column) -> Column:
    """The trained text of an example, unescaped ('' if it trains nothing)."""
    return F.coalesce(unescape(F.substr(text, (start + 1).cast("int"), (end - start).cast("int"))), F.lit(""))
