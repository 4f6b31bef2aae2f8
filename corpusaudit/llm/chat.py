"""Chat formatting with native expressions, and a parser that reads the output back.

Template: every turn is ``<s>[INST] role [/INST]text</s>``. A turn is first rendered as it is and
parsed again; if role or text do not come back identical, their control strings are escaped, and
the escaped form must come back. An escape adds one backslash inside a control string
(``</s>`` to ``<\\/s>``, ``<\\/s>`` to ``<\\\\/s>``), the parser takes one away.

Null roles and texts count as empty. Turns are ordered by (turn, role, text), nulls first, so that
ties have one order; repeated rows are repeated turns. Rows without a conversation id form one
conversation. A formatted conversation is one value: it has to fit into a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<s>[INST] ", " [/INST]", "</s>"
LOSS_ROLE = "assistant"
CONTROL = r"([<\[])(\\*)/(s>|INST\])"
ESCAPED = r"([<\[])\\(\\*)/(s>|INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\/$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2/$3")


def _parse_piece(piece: Column) -> Column:
    body = F.substr(piece, F.lit(len(OPEN) + 1))
    role = F.substring_index(body, CLOSE, 1)
    text = F.substr(body, F.length(role) + len(CLOSE) + 1)
    return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    pieces = F.split(formatted, END, -1)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), _parse_piece)


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE), text, F.lit(END))


def loss_text(formatted: Column, mask: Column) -> Column:
    """The unescaped text under the loss mask."""
    spans = F.transform(mask, lambda m: unescape(F.substr(formatted, m["start"] + 1, m["end"] - m["start"])))
    return F.array_join(spans, "")


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask) of rows (conv_id, turn, role, text). ``mask`` lists the spans
    [start, end) of code points in ``formatted`` that count for the loss: the assistant's texts."""
    rows = turns.select(
        turns["conv_id"].alias("conv_id"),
        turns["turn"].alias("turn"),
        F.coalesce(turns["role"], F.lit("")).alias("role"),
        F.coalesce(turns["text"], F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("nr", F.row_number().over(order))
    turn = F.array(F.struct("role", "text"))
    raw = rows.withColumn("plain", parse(render(F.col("role"), F.col("text"))) == turn)
    raw = raw.withColumn("o_role", F.when(F.col("plain"), F.col("role")).otherwise(escape(F.col("role"))))
    raw = raw.withColumn("o_text", F.when(F.col("plain"), F.col("text")).otherwise(escape(F.col("text"))))
    rendered = render(F.col("o_role"), F.col("o_text"))
    safe = F.when(F.col("plain") | (parse(rendered) == turn), rendered).otherwise(
        F.raise_error(F.lit("a turn cannot be escaped"))
    )
    raw = raw.withColumn("out", safe)
    end = F.sum(F.length("out").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(END)
    placed = raw.select("conv_id", "nr", "role", "o_text", "out", end.alias("end"))
    span = F.when(
        F.col("role") == LOSS_ROLE,
        F.struct((F.col("end") - F.length("o_text")).cast("int").alias("start"), F.col("end").cast("int").alias("end")),
    )
    items = F.array_sort(F.collect_list(F.struct("nr", "out", span.alias("span"))))
    return placed.groupBy("conv_id").agg(items.alias("items")).select(
        "conv_id",
        F.array_join(F.transform("items", lambda i: i["out"]), "").alias("formatted"),
        F.filter(F.transform("items", lambda i: i["span"]), lambda s: s.isNotNull()).alias("mask"),
    )
