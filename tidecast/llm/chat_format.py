"""Chat formatting by prefix-target expansion.

Each assistant turn becomes one example: all turns before it as context, then
the reply, and only the reply's characters are trainable.  Turns that no reply
follows (the end of a conversation, or one without any assistant turn) are put
out as one more example with an empty loss span, so no turn is lost.

The template is ``<turn:ROLE>TEXT</turn>`` and a line feed.  In role and text
``&``, ``<`` and ``>`` are written ``&amp;``, ``&lt;``, ``&gt;``; a control
string can therefore not occur inside them and reading back is exact.

Defined results: null text and null role count as empty; turns are ordered by
turn (null first), then role, then text, and repeated rows stay repeated turns;
rows without conv_id form one conversation; an empty table gives no rows; other
columns are not read.  An example is one string, so a conversation must fit a
task's memory; all text is otherwise handled in place by the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"


def escape(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in ((">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def format_examples(conversations: DataFrame, trainable_role: str = "assistant") -> DataFrame:
    """conv_id, example (0-based), text, loss_start, loss_end (code points, end exclusive)."""
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    marked = whole.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(F.lit("<turn:"), escape(t["role"]), F.lit(">"), escape(t["text"]), F.lit(END))).alias("parts"),
        F.transform("turns", lambda t: t["role"] == trainable_role).alias("is_target"),
        F.transform("turns", lambda t: F.length(escape(t["text"]))).alias("chars"),
        F.size("turns").alias("n"),
    )
    ends = F.filter(
        F.sequence(F.lit(1), F.col("n")),
        lambda i: F.element_at("is_target", i) | (i == F.col("n")),
    )
    one = marked.select("conv_id", "parts", "is_target", "chars", F.posexplode(ends).alias("example", "upto"))
    one = one.select(
        "conv_id", "example",
        F.array_join(F.slice("parts", F.lit(1), F.col("upto")), "").alias("text"),
        F.element_at("is_target", F.col("upto")).alias("trained"),
        F.element_at("chars", F.col("upto")).alias("chars"),
    )
    end = F.length("text") - F.lit(len(END))
    return one.select(
        "conv_id", "example", "text",
        F.when(F.col("trained"), end - F.col("chars")).otherwise(end).alias("loss_start"),
        end.alias("loss_end"),
    )


def read_turns(text: Column) -> Column:
    """The array of (role, text) that a formatted example holds."""
    parts = F.split(text, END)
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, len("<turn:") + 1, 2147483647), ">", 1)).alias("role"),
            unescape(F.substring_index(p, ">", -1)).alias("text"),
        ),
    )


def read_loss(text: Column, start: Column, end: Column) -> Column:
    """The characters under the loss mask, as they were before escaping."""
    return unescape(F.substring(text, start + 1, end - start))


def conversation_digests(examples: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted examples."""
    read = examples.select(
        "conv_id", "example", "text", F.length("text").cast("bigint").alias("size"),
        read_loss(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
    )
    g = read.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("last"),
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum("size").alias("formatted_chars"),
    )
    g = g.select(
        "conv_id", read_turns(F.col("last")).alias("turns"),
        F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars",
    )
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return g.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
