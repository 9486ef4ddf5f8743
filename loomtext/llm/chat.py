"""4. Chat formatting: prefix-target expansion, in DataFrame functions only.

A turn is written `### ROLE: TEXT</turn>\\n`. Every assistant turn becomes an example of its own: all
preceding turns as context, then that turn; the loss mask covers the reply's text and nothing else.
Turns after the last assistant turn (all turns, if there is none) make one more example without a
mask, so that a conversation can be read back from its longest example.

Inside roles and texts a backslash becomes `\\b`, `###` becomes `\\h`, `</turn>` becomes `\\e`, and in roles a
colon becomes `\\c`; so an unescaped mark never occurs in them, and `unescape` undoes it exactly.

Defined cases: null text or role is empty; turns are ordered by turn (null first), then role and
text, so ties and repeated rows have a place and each counts. Rows with a null conv_id form one
conversation. An empty table gives no example. Other columns are ignored. A conversation is one row
while it is formatted, as its examples grow with the square of its turns by the method's definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
ASSISTANT = "assistant"


def escape(c: Column, role: bool = False) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\b"))
    c = F.replace(F.replace(c, F.lit("###"), F.lit("\\h")), F.lit("</turn>"), F.lit("\\e"))
    return F.replace(c, F.lit(":"), F.lit("\\c")) if role else c


def unescape(c: Column) -> Column:
    for short, long in (("\\c", ":"), ("\\e", "</turn>"), ("\\h", "###"), ("\\b", "\\")):
        c = F.replace(c, F.lit(short), F.lit(long))
    return c


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example, n_turns, context, target, loss_start, loss_end.

    The example's text is context || target; loss_start and loss_end are code points in it (null for an
    example that trains nothing).
    """
    text = escape(F.coalesce("text", F.lit("")))
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(OPEN), escape(role, role=True), F.lit(AFTER_ROLE))
    turn = F.struct("turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("plain"), F.concat(head, text, F.lit(CLOSE)).alias("line"), F.char_length(head).alias("before"), F.char_length(text).alias("size"))
    turns = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at("turns", i)["role"] == ASSISTANT) | (i == n))
    rows = turns.select("conv_id", "turns", F.posexplode(ends).alias("example", "at"))
    line = lambda part: F.array_join(F.transform(part, lambda t: t["line"]), "")
    last = F.element_at("turns", F.col("at"))
    trains = last["role"] == ASSISTANT
    cut = rows.select("conv_id", "example", F.col("at").alias("n_turns"), line(F.slice("turns", F.lit(1), F.col("at") - 1)).alias("context"), last.alias("last"))
    start = F.char_length("context") + F.col("last.before")
    trains = F.col("last.role") == ASSISTANT
    return cut.select("conv_id", "example", "n_turns", "context", F.col("last.line").alias("target"), F.when(trains, start).alias("loss_start"), F.when(trains, start + F.col("last.size")).alias("loss_end"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns of a formatted text."""
    lines = F.split(formatted, CLOSE)
    lines = F.slice(lines, F.lit(1), F.size(lines) - 1)

    def turn(x: Column) -> Column:
        at = F.instr(x, AFTER_ROLE)
        return F.struct(unescape(F.substring(x, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"), unescape(F.substring(x, at + len(AFTER_ROLE), F.char_length(x))).alias("text"))

    return F.transform(lines, turn)


def trained(formatted: Column, start: Column, end: Column) -> Column:
    """The unescaped text under an example's loss mask."""
    return unescape(F.substring(formatted, start + 1, end - start))


def read_back(made: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), trained (the masked texts in order), formatted_chars."""
    text = F.concat("context", "target")
    mask = F.struct("example", F.when(F.col("loss_start").isNotNull(), trained(text, F.col("loss_start"), F.col("loss_end"))).alias("text"))
    got = made.select("conv_id", "n_turns", text.alias("text"), mask.alias("mask"), F.char_length(text).cast("long").alias("chars")).groupBy("conv_id").agg(F.max_by("text", "n_turns").alias("longest"), F.array_sort(F.collect_list("mask")).alias("masks"), F.sum("chars").alias("formatted_chars"))
    return got.select("conv_id", parse(F.col("longest")).alias("turns"), F.filter(F.transform("masks", lambda m: m["text"]), lambda t: t.isNotNull()).alias("trained"), "formatted_chars")
