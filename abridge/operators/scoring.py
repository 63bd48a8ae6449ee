"""Task evaluation of candidates: ``eval_*`` and ``primary_score``.

Without a model the evaluation side uses the fallbacks of the reference:
reconstruction scores the compressed text itself against the original;
QA answers with the compressed context as the reader output; reasoning
answers with the last line of the compressed prompt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abridge.functions.metrics import OVERLAP_SCHEMA, exact_match, finish_rouge, overlaps, rouge_columns, set_f1, set_tokens, token_ids
from abridge.functions.tokens import rouge_tokens
from abridge.sources.samples import final_answer

ROUGE_TASKS = ("reconstruction", "summarization")


def score(cands: DataFrame, text_col: str = "compressed", compat_self_summary: bool = False) -> DataFrame:
    """Add rouge1/2/L, bertscore, em, f1 and ``primary_score`` columns.

    * reconstruction: candidate vs the original prompt.
    * summarization: candidate vs the reference line; a missing reference
      gives NULL scores (``compat_self_summary`` scores the text against itself).
    * qa: em/f1 of the predicted answer (``pred`` column if present, else the
      candidate text) against ``answer``; reasoning: em of ``final_answer``.
    """
    task = F.col("task")
    ref_text = (F.when(task == "reconstruction", F.col("prompt"))
                 .when(task == "summarization",
                       F.coalesce(F.col("reference"), F.col(text_col)) if compat_self_summary
                       else F.col("reference")))
    cand_text = F.when(task.isin(*ROUGE_TASKS) & ref_text.isNotNull(), F.col(text_col))
    pred = F.col("pred") if "pred" in cands.columns else F.col(text_col)
    if "ref_ids" in cands.columns and not compat_self_summary:
        cols = rouge_columns(None, rouge_tokens(cand_text), ref_ids=F.col("ref_ids"),
                             n_ref=F.size("ref_rt").cast("bigint"))
    else:
        cols = rouge_columns(rouge_tokens(ref_text), rouge_tokens(cand_text))
    df = cands.select("*", *cols)
    return _task_metrics(finish_rouge(df), pred)


def score_arrays(df: DataFrame, rouge_asked: bool = True) -> DataFrame:
    """Score the ``grid`` of :func:`~abridge.operators.candidates.candidate_arrays`: one row a candidate and style.

    A sample's candidates are scored in one call, its reference is sent once, and only then the array is exploded; the
    styles that share a candidate come last. A candidate made of the prompt's tokens in order (every rule but the
    abbreviations) is a subsequence of the prompt. ``rouge_asked``: whether a ROUGE task can occur; if none does, no candidate
    is cut into ROUGE tokens or sent to Python, and the counts are null, as for every other task.
    """
    task = F.col("task")
    if not rouge_asked:
        df = df.drop("ref_ids", "ref_rt").withColumn("_gold", F.when(task == "qa", set_tokens("answer"))).withColumn("g", F.explode("grid"))
        df = df.drop("grid").select("*", "g.*").drop("g")
        none = F.lit(None).cast("bigint")
        ov = F.lit(None).cast(OVERLAP_SCHEMA)
        df = df.withColumns({"n_ref": none, "ov": ov, "n_cand": none, "n_ref2": F.lit(0).cast("bigint"), "n_cand2": F.lit(0).cast("bigint")})
        return _finish_scores(df)
    rouge = task.isin(*ROUGE_TASKS)
    ids = F.transform("grid", lambda g: F.when(rouge, token_ids(rouge_tokens(g["compressed"]))))
    ruled = "rule" in df.schema["grid"].dataType.elementType.names
    sub = F.transform("grid", lambda g: (task == "reconstruction") & (g["rule"] != "abbrev") if ruled else F.lit(False))
    df = df.withColumn("_ids", ids).withColumn("_gold", F.when(task == "qa", set_tokens("answer")))
    df = df.withColumn("_ov", overlaps(F.when(rouge, F.col("ref_ids")), "_ids", sub))
    ov = F.col("_ov")
    rows = F.transform("grid", lambda g, i: F.struct(g.alias("g"), F.size(F.get("_ids", i)).cast("bigint").alias("n_cand"), F.when(
        ov.isNotNull(), F.struct(*[F.get(ov[m], i).alias(m) for m in ("hit1", "hit2", "lcs")])).alias("ov")))
    df = df.withColumn("n_ref", F.when(rouge, F.size("ref_rt").cast("bigint"))).withColumn("n_ref", F.when(F.col("n_ref") >= 0, F.col("n_ref")))
    df = df.withColumn("_r", F.explode(rows)).drop("grid", "_ids", "_ov", "ref_ids", "ref_rt")
    df = df.select("*", "_r.g.*", F.col("_r.ov").alias("ov"), F.when(rouge, F.col("_r.n_cand")).alias("n_cand")).drop("_r")
    zero = F.lit(0).cast("bigint")
    df = df.withColumns({"n_ref2": F.greatest(F.col("n_ref") - 1, zero), "n_cand2": F.greatest(F.col("n_cand") - 1, zero)})
    return _finish_scores(df)


def _finish_scores(df: DataFrame) -> DataFrame:
    """Metrics of exploded candidates with their overlaps; the styles that share a candidate come last."""
    df = _task_metrics(finish_rouge(df), F.col("pred") if "pred" in df.columns else F.col("compressed"), "_gold").drop("_gold")
    return df.withColumn("style", F.explode("styles")).drop("styles") if "styles" in df.columns else df


def _task_metrics(df: DataFrame, pred, gold: str | None = None) -> DataFrame:
    """``gold``: the column of the answer's token set where it is made already."""
    task = F.col("task")
    rouge_ok = task.isin(*ROUGE_TASKS) & F.col("n_ref").isNotNull()
    for m in ("rouge1", "rouge2", "rougeL", "bertscore"):
        df = df.withColumn(m, F.when(rouge_ok, F.col(m)))
    df = df.withColumns({"_g": F.col(gold) if gold else F.when(task == "qa", set_tokens("answer")), "_p": F.when(task == "qa", set_tokens(pred))})
    # The second array is the one that is hashed: the answer, not the long candidate.
    df = df.withColumn("_both", F.size(F.array_intersect("_p", "_g")))
    df = (df.withColumn("em", F.when(task == "qa", exact_match("answer", pred))
                        .when(task == "reasoning", exact_match("answer", final_answer(pred))))
            .withColumn("f1", F.when(task == "qa", set_f1("_g", "_p", "_both"))).drop("_g", "_p", "_both"))
    return df.withColumn("primary_score", primary_score())


def primary_score():
    """reconstruction: rougeL; summarization: mean of three ROUGE; qa: f1; reasoning: em."""
    t = F.col("task")
    return (F.when(t == "reconstruction", F.col("rougeL"))
             .when(t == "summarization", (F.col("rouge1") + F.col("rouge2") + F.col("rougeL")) / 3.0)
             .when(t == "qa", F.col("f1"))
             .when(t == "reasoning", F.col("em")))
