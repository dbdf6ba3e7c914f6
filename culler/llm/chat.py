"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one example: all turns before it are context and its text alone is
trainable. A conversation that doesn't end with an assistant turn gives one more example, with all turns
and nothing to train on, so that no turn is lost.

Template, per turn: ``<|im_start|>`` role ``\\n`` text ``<|im_end|>\\n``. Control strings inside a text are
escaped reversibly: each ``<``, backslashes, ``|`` gets one backslash more (``<|`` becomes ``<\\|``), so no
text holds ``<|`` afterwards; reading back takes one backslash away. In a role, backslash and line feed are
escaped as well, since a line feed ends it.

Scale: one shuffle, by conversation; a conversation's turns meet in one row, as a model's input
must hold them anyway. Examples are cut from that row one at a time after the explode.

Defined cases: a null text or role is empty; turns are ordered by (turn, role, text), nulls first; repeated
rows are repeated turns; a null conv_id is one conversation; further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape_text(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # the pair \\ is set aside first, so that the n after it isn't taken for a line feed's
    plain = F.replace(F.replace(unescape_text(role), F.lit("\\\\"), F.lit("\n\\")), F.lit("\\n"), F.lit("\n\n"))
    return F.replace(F.replace(plain, F.lit("\n\n"), F.lit("\n")), F.lit("\n\\"), F.lit("\\"))


def prefix_targets(turns: DataFrame) -> DataFrame:
    """conv_id, example (from 0), target (index of the trained turn, null for the closing example),
    text, loss_start, loss_end: the code points [loss_start, loss_end) of text are trainable."""
    clean = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                         F.coalesce(F.col("text"), F.lit("")).alias("text"))
    conversations = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    body = lambda t: escape_text(t["text"])
    head = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
    rendered = conversations.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(head(t), body(t), F.lit(END + "\n")).alias("piece"),
                                                F.char_length(body(t)).alias("n"))).alias("turns"))
    last = F.size("turns") - 1
    targets = F.filter(F.transform("turns", lambda t, i: F.when((t["role"] == TRAINED_ROLE) | (i == last), i)), lambda i: i.isNotNull())
    examples = rendered.select("conv_id", "turns", F.posexplode(targets).alias("example", "upto"))
    t = F.element_at("turns", F.col("upto") + 1)
    trained = t["role"] == TRAINED_ROLE
    examples = examples.select(
        "conv_id", "example", F.when(trained, F.col("upto")).alias("target"),
        F.array_join(F.slice(F.transform("turns", lambda x: x["piece"]), F.lit(1), F.col("upto") + 1), "").alias("text"),
        F.when(trained, t["n"]).otherwise(F.lit(0)).alias("n"))
    end = F.char_length("text") - len(END) - 1
    return examples.select("conv_id", "example", "target", "text", (end - F.col("n")).alias("loss_start"), end.alias("loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """What the formatted examples hold, parsed from their texts alone: conv_id, turns
    array<struct<role, text>>, loss array<string> (the text under each example's mask), formatted_chars."""
    masked = F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    found = examples.select("conv_id", "example", "text", unescape_text(masked).alias("loss"))
    whole = found.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("text"), F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("loss"),
        F.sum(F.char_length("text").cast("long")).alias("formatted_chars"))
    parts = F.filter(F.split("text", r"<\|im_start\|>", -1), lambda p: p != "")
    turn = lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape_text(F.substring(p, F.instr(p, "\n") + 1, F.char_length(p) - F.instr(p, "\n") - len(END) - 1)).alias("text"))
    return whole.select("conv_id", F.transform(parts, turn).alias("turns"), F.transform("loss", lambda x: x["loss"]).alias("loss"), "formatted_chars")
