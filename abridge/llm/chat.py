"""Chat formatting by prefix-target expansion: one example for each assistant turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abridge.llm.common import text_of

# A turn is  <s>[ROLE]\n text </s>\n ; texts never hold "<" or "[" because both are escaped.
OPEN, MID, CLOSE = "<s>[", "]\n", "</s>\n"
# (raw, escaped) in the order in which they are escaped; undone in the reverse order.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"), ("]", "&rsqb;"))


def escape(c: Column) -> Column:
    for raw, esc in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(esc))
    return c


def unescape(c: Column) -> Column:
    for raw, esc in reversed(ESCAPES):
        c = F.replace(c, F.lit(esc), F.lit(raw))
    return c


def chat_examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """One example for each assistant turn: (conv_id, example, n_context, text, loss_start, loss_length).

    ``text`` is the formatted conversation up to and with the target reply; ``loss_start`` (from 0)
    and ``loss_length`` count code points and mask exactly the reply's escaped text. Turns after the
    last reply (or all, without a reply) go into one last example whose mask is empty, so nothing is lost.
    Turns are ordered by (turn, role, text), repeated rows stay; null role or text counts as empty, rows
    with a null conversation id form one conversation. An empty table gives no example.
    """
    t = turns.select(F.col(conv_col).alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text")).alias("t"))
    conv = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = lambda x: F.concat(F.lit(OPEN), escape(x["role"]), F.lit(MID))
    conv = conv.withColumn("parts", F.transform("turns", lambda x: F.struct(
        F.concat(head(x), escape(x["text"]), F.lit(CLOSE)).alias("text"),
        F.length(head(x)).alias("lead"), F.length(escape(x["text"])).alias("length"),
        (x["role"] == F.lit(target_role)).alias("target"))))
    # Ends of the turns in the formatted conversation, by one running pass.
    ends = F.aggregate("parts", F.array().cast("array<int>"), lambda acc, p: F.concat(acc, F.array(
        F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(p["text"]))))
    conv = conv.select("conv_id", "parts", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("whole"),
                       ends.alias("ends"))
    marks = F.transform("parts", lambda p, i: F.struct(
        i.alias("turn"), F.get("ends", i).alias("end"),
        F.when(p["target"], F.get("ends", i) - F.length(p["text"]) + p["lead"]).otherwise(0).alias("loss_start"),
        F.when(p["target"], p["length"]).otherwise(0).alias("loss_length"),
        (p["target"] | (i == F.size("parts") - 1)).alias("used")))
    marks = F.filter(marks, lambda m: m["used"])
    one = conv.select("conv_id", "whole", F.posexplode(marks).alias("example", "m"))
    return one.select("conv_id", "example", F.col("m.turn").alias("n_context"),
                      F.expr("substring(whole, 1, m.end)").alias("text"),
                      F.col("m.loss_start").alias("loss_start"), F.col("m.loss_length").alias("loss_length"))


def read_turns(text: Column) -> Column:
    """Array of (role, text) read back from a formatted text."""
    pieces = F.filter(F.split(text, CLOSE, -1), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(OPEN) + 1, 1 << 30), MID, 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, MID) + F.lit(len(MID)))).alias("text")))


def masked_text(text: Column, start: Column, length: Column) -> Column:
    return unescape(F.substr(text, start + 1, length))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: turns and their digest, the trainable text and its
    digest, and the characters of all examples."""
    e = examples.select("conv_id", "example", F.length("text").alias("n"),
                        masked_text(F.col("text"), F.col("loss_start"), F.col("loss_length")).alias("loss"),
                        read_turns(F.col("text")).alias("turns"))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    e = e.withColumns({"n_turns": F.size("turns").cast("long"), "turns_sha256": F.sha2(line.cast("binary"), 256)})
    g = e.groupBy("conv_id").agg(
        F.max(F.struct("example", "n_turns", "turns_sha256")).alias("last"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))),
                                 lambda x: x["loss"]), "").alias("loss"),
        F.sum("n").alias("formatted_chars"))
    return g.select("conv_id", "last.n_turns", "last.turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
                    F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
