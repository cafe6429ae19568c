r"""Chat formatting by prefix-target expansion.

A conversation becomes one training example for each assistant turn: all turns before it as context, and that reply
alone under the loss mask. Turns after the last reply make one more example without a target, so that the output holds every turn.

A turn is ``### Role: `` + text + ``</turn>`` + line end. Texts are escaped so that no control string can be read in them: a backslash
becomes ``\s``, ``#`` becomes ``\h`` and ``<`` becomes ``\l``; the three replacements undone in turn give the text back. Roles other than user, assistant and system
are written ``### @role: ``, with ``:`` as ``\c`` besides.

An example of a conversation of n turns repeats up to n - 1 of them: that growth is the method's, not a join's. Only DataFrame expressions.

Null text is empty, a null role is the empty role, rows of a null id are one conversation. Turns are ordered by number; rows of
the same number by role and text, repeated rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"
ROLES = ("user", "assistant", "system")


def escape(text: Column) -> Column:
    for a, b in (("\\", "\\s"), ("#", "\\h"), ("<", "\\l")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in (("\\l", "<"), ("\\h", "#"), ("\\s", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def header(role: Column) -> Column:
    name = F.when(role.isin(*ROLES), F.initcap(role)).otherwise(F.concat(F.lit("@"), F.replace(escape(role), F.lit(":"), F.lit("\\c"))))
    return F.concat(F.lit("### "), name, F.lit(": "))


def examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each example: conv, example (1, 2, ...), is_last, formatted, loss_start, loss_chars (0 without a target)."""
    t = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    t = t.select("conv", F.struct("turn", "role", "text").alias("t"))
    convs = t.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    parts = convs.select("conv", F.transform("ts", lambda x: F.struct(x["role"].alias("role"), header(x["role"]).alias("head"), escape(x["text"]).alias("body"))).alias("ps"))
    replies = F.filter(F.sequence(F.lit(1), F.size("ps")), lambda i: F.element_at("ps", i)["role"] == "assistant")
    ends = F.when(F.coalesce(F.array_max("replies"), F.lit(0)) == F.size("ps"), F.col("replies")).otherwise(F.concat("replies", F.array(F.size("ps"))))
    each = parts.withColumn("replies", replies).withColumn("ends", ends).select("conv", "ps", "replies", F.size("ends").alias("n"), F.posexplode("ends").alias("pos", "end"))
    last = F.element_at("ps", F.col("end"))
    context = F.array_join(F.transform(F.slice("ps", F.lit(1), F.col("end") - 1), lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    each = each.select("conv", (F.col("pos") + 1).cast("long").alias("example"), (F.col("pos") + 1 == F.col("n")).alias("is_last"), (last["role"] == "assistant").alias("target"), context.alias("context"), last.alias("p"))
    return each.select(
        F.col("conv").alias(conv), "example", "is_last",
        F.concat("context", "p.head", "p.body", F.lit(END)).alias("formatted"),
        F.when(F.col("target"), F.length("context") + F.length("p.head")).otherwise(F.lit(0)).cast("long").alias("loss_start"),
        F.when(F.col("target"), F.length("p.body")).otherwise(F.lit(0)).cast("long").alias("loss_chars"),
    )


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> read back from an example."""
    marked = F.filter(F.split(formatted, END), lambda x: x != "")

    def one(x: Column) -> Column:
        cut = F.locate(": ", x)
        name = F.substring(x, F.lit(5), cut - 5)
        own = unescape(F.replace(F.substring(name, F.lit(2), F.length(name)), F.lit("\\c"), F.lit(":")))
        role = F.when(F.startswith(name, F.lit("@")), own).otherwise(F.lower(name))
        return F.struct(role.alias("role"), unescape(F.substring(x, cut + 2, F.length(x))).alias("text"))

    return F.transform(marked, one)


def loss_text(formatted: Column, start: Column, chars: Column) -> Column:
    """What is under an example's loss mask, unescaped."""
    return unescape(F.substring(formatted, start.cast("int") + 1, chars.cast("int")))
