"""Task samples built from the driver tables.

One long ``samples`` table keyed by ``(task, sample_id)``:
``task, sample_id, grp, prompt, reference, question, answer``.

* reconstruction: every document; ``grp`` = source.
* summarization: every document; the reference summary is the non-blank line
  with index ``h mod n_lines`` where ``h`` = first 8 hex digits of
  ``md5(doc_id)``.
* qa: each user turn that follows a turn and is answered by an assistant
  turn: context (prompt) = the previous turn, question = the user turn,
  answer = the assistant turn. ``grp`` = role of the previous turn.
* reasoning: prompt = the user turn, question = its first sentence,
  answer = the last line of the assistant turn (``final_answer``).

Neighbouring turns are found by equi joins on ``(conv_id, turn)``, so a
very long conversation spreads over many tasks instead of one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abridge.functions.metrics import strip_ws
from abridge.session import spread
from abridge.sources.tables import read_table

TASKS = ("reconstruction", "summarization", "qa", "reasoning")
# Fixed value: sample_id = conv_id * TURN_BASE + turn; rows that would not fit fail.
TURN_BASE = 1_000_000
CONV_LIMIT = (1 << 63) // TURN_BASE - 1
SAMPLE_COLS = ["task", "sample_id", "grp", "prompt", "reference", "question", "answer"]


def md5_bucket(key) -> Column:
    """First 8 hex digits of md5(key as string) as a bigint in [0, 2^32)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(k.cast("string")), 1, 8), 16, 10).cast("bigint")


def nonblank_lines(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(t, "\n"), lambda line: line.rlike(r"\S"))


def final_answer(text) -> Column:
    """``final_answer``: last line of a multi-line solution, else the whole text."""
    t = strip_ws(text)
    return F.when(t.contains("\n"), F.element_at(F.split(t, "\n"), -1)).otherwise(t)


def first_sentence(text) -> Column:
    """``synth_qa`` question: text before the first '.', else the first 50 characters."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(t.contains("."), F.substring_index(t, ".", 1)).otherwise(F.substring(t, 1, 50))


def summary_line(doc_id, text) -> Column:
    lines = nonblank_lines(text)
    return F.when(F.size(lines) > 0,
                  F.element_at(lines, (F.pmod(md5_bucket(doc_id), F.size(lines)) + 1).cast("int")))


def document_samples(docs: DataFrame, tasks=("reconstruction", "summarization")) -> DataFrame:
    """Both document tasks from one scan: each document is exploded to the tasks asked for."""
    reference = {"reconstruction": F.lit(None).cast("string"), "summarization": summary_line("doc_id", "text")}
    shapes = F.array(*[F.struct(F.lit(t).alias("task"), r.alias("reference")) for t, r in reference.items() if t in tasks])
    none = F.lit(None).cast("string")
    return (docs.select("doc_id", "text", "source", F.explode(shapes).alias("s"))
            .select("s.task", F.col("doc_id").alias("sample_id"), F.col("source").alias("grp"),
                    F.col("text").alias("prompt"), "s.reference", none.alias("question"), none.alias("answer")))


def document_rows(spark: SparkSession, sf_dir: str, tasks=("reconstruction", "summarization")) -> DataFrame:
    """Document tasks with a row a document (``sample_id, prompt, reference``): both read the same prompt."""
    reference = summary_line("doc_id", "text") if "summarization" in tasks else F.lit(None).cast("string")
    docs = read_table(spark, sf_dir, "documents")
    return spread(docs.select(F.col("doc_id").alias("sample_id"), F.col("text").alias("prompt"), reference.alias("reference")), "sample_id")


def conversation_samples(conv: DataFrame) -> DataFrame:
    c = conv.select("conv_id", "turn", "role", "text")
    user = c.where(F.col("role") == "user").select(
        "conv_id", F.col("turn").alias("q_turn"), F.col("text").alias("q_text"))
    prev = c.select("conv_id", (F.col("turn") + 1).alias("q_turn"),
                    F.col("role").alias("p_role"), F.col("text").alias("p_text"))
    nxt = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("q_turn"), F.col("text").alias("a_text"))
    pairs = user.join(nxt, ["conv_id", "q_turn"])
    fits = F.col("q_turn").between(0, TURN_BASE - 1) & F.col("conv_id").between(0, CONV_LIMIT)
    sid = F.when(fits, F.col("conv_id") * F.lit(TURN_BASE) + F.col("q_turn")).otherwise(
        F.raise_error(F.lit("conversation id or turn too large for a sample id")).cast("bigint")).alias("sample_id")
    qa = pairs.join(prev, ["conv_id", "q_turn"]).select(
        F.lit("qa").alias("task"), sid, F.col("p_role").alias("grp"),
        F.col("p_text").alias("prompt"), F.lit(None).cast("string").alias("reference"),
        F.col("q_text").alias("question"), F.col("a_text").alias("answer"))
    reasoning = pairs.select(
        F.lit("reasoning").alias("task"), sid, F.lit("user").alias("grp"),
        F.col("q_text").alias("prompt"), F.lit(None).cast("string").alias("reference"),
        first_sentence("q_text").alias("question"), final_answer("a_text").alias("answer"))
    return qa.unionByName(reasoning)


def build_samples(spark: SparkSession, sf_dir: str, tasks=TASKS, distribute: bool = True) -> DataFrame:
    """``src_samples``: the four task shapes as one long table.

    ``distribute`` hash-partitions the samples on ``(task, sample_id)`` so
    the candidate work is spread over all cores (see :func:`spread`).
    """
    parts = []
    if {"reconstruction", "summarization"} & set(tasks):
        parts.append(document_samples(read_table(spark, sf_dir, "documents"), tasks))
    if {"qa", "reasoning"} & set(tasks):
        parts.append(conversation_samples(read_table(spark, sf_dir, "conversations")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    unknown = set(tasks) - set(TASKS)
    if unknown:
        raise ValueError(f"unknown task(s) {sorted(unknown)}")
    out = out.where(F.col("task").isin(list(tasks))).select(*SAMPLE_COLS)
    return spread(out, "task", "sample_id") if distribute else out
