"""Registered scoring and sweep queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from abridge.functions.metrics import exact_match, finish_rouge, rouge_columns, rouge_id_columns, token_f1, token_ids
from abridge.functions.stem import with_stem_ids
from abridge.functions.tokens import rouge_tokens
from abridge.operators.catalog import RATIOS, STYLE_NAMES
from abridge.operators.places import scored_documents
from abridge.operators.scoring import ROUGE_TASKS
from abridge.operators.sweep import avg_metrics_all, pivot_long, primary_series, scored_grid, to_long
from abridge.plans import sql as S
from abridge.plans.registry import query
from abridge.session import spread
from abridge.sources.samples import build_samples, document_rows
from abridge.sources.tables import read_table


def r6(c):
    return F.round(c, 6)


ALL_METHODS = STYLE_NAMES + ["selective-context"]


# --------------------------------------------------------------------------- ROUGE on pairs
@query("rouge_pairs", sql=f"""
WITH p AS (
  SELECT 'next_doc' AS kind, a.doc_id AS pair_id, {S.rouge_tok('a.text')} AS rt, {S.rouge_tok('b.text')} AS ct
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1
  UNION ALL
  SELECT 'benchmark', d.doc_id, {S.rouge_tok('d.text')}, {S.rouge_tok('m.text')}
  FROM documents d JOIN benchmark m ON m.item_id = d.doc_id
),
{S.rouge_hits_cte('p', 'kind, pair_id', 'rt', 'ct')}
SELECT kind, pair_id, coalesce(hit1, 0) AS hit1, coalesce(hit2, 0) AS hit2,
       len(rt)::BIGINT AS n_ref, len(ct)::BIGINT AS n_cand,
       round({S.fmeasure('coalesce(hit1, 0)', 'len(rt)', 'len(ct)')}, 6) AS rouge1,
       round({S.fmeasure('coalesce(hit2, 0)', 'greatest(len(rt) - 1, 0)', 'greatest(len(ct) - 1, 0)')}, 6) AS rouge2
FROM p LEFT JOIN h1 USING (kind, pair_id) LEFT JOIN h2 USING (kind, pair_id)
""", operators=("rouge1", "rouge2", "ngram_overlap", "rouge_tokens"))
def q_rouge_pairs(spark, sf):
    """ROUGE-1/2 on pairs that are not prefixes: next document, and the benchmark item of equal id."""
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    b = read_table(spark, sf, "benchmark").select("item_id", "text")
    nxt = d.alias("a").join(d.alias("b"), F.col("b.doc_id") == F.col("a.doc_id") + 1).select(
        F.lit("next_doc").alias("kind"), F.col("a.doc_id").alias("pair_id"),
        F.col("a.text").alias("ref"), F.col("b.text").alias("cand"))
    bm = d.join(b, F.col("item_id") == F.col("doc_id")).select(
        F.lit("benchmark").alias("kind"), F.col("doc_id").alias("pair_id"),
        d["text"].alias("ref"), b["text"].alias("cand"))
    p = nxt.unionByName(bm)
    s = finish_rouge(p.select("kind", "pair_id", *rouge_columns(rouge_tokens("ref"), rouge_tokens("cand"))))
    return s.select("kind", "pair_id", "hit1", "hit2", "n_ref", "n_cand",
                    r6(F.col("rouge1")).alias("rouge1"), r6(F.col("rouge2")).alias("rouge2"))


@query("rougeL_pairs", sql=f"""
WITH p AS (SELECT a.doc_id AS pair_id, {S.rouge_tok('a.text')} AS rt, {S.rouge_tok('b.text')} AS ct
           FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
l AS (SELECT *, {S.lcs('rt', 'ct')} AS lcs FROM p)
SELECT pair_id, lcs, len(rt)::BIGINT AS n_ref, len(ct)::BIGINT AS n_cand,
       round({S.fmeasure('lcs', 'len(rt)', 'len(ct)')}, 6) AS rougeL, round({S.fmeasure('lcs', 'len(rt)', 'len(ct)')}, 6) AS bertscore
FROM l
""", operators=("rougeL", "bertscore"))
def q_rougeL_pairs(spark, sf):
    """ROUGE-L (LCS) on next-document pairs; checked against a DP brute force in tests."""
    d = read_table(spark, sf, "documents").select("doc_id", token_ids(rouge_tokens("text")).alias("ids"))
    # A pair is much work for its bytes: tasks are not merged by bytes.
    p = d.alias("a").join(d.alias("b"), F.col("b.doc_id") == F.col("a.doc_id") + 1).select(
        F.col("a.doc_id").alias("pair_id"), F.col("a.ids").alias("ref"), F.col("b.ids").alias("cand"))
    s = finish_rouge(spread(p, "pair_id").select("pair_id", *rouge_id_columns("ref", "cand")))
    return s.select("pair_id", "lcs", "n_ref", "n_cand", r6(F.col("rougeL")).alias("rougeL"),
                    r6(F.col("bertscore")).alias("bertscore"))


@query("rouge_stemmed", sql=f"""
WITH d AS (SELECT doc_id, {S.rouge_tok('text')} AS t FROM documents),
tok AS (SELECT unnest(t) AS g FROM d),
{S.stem_cte('tok', 'st')},
x AS (SELECT doc_id, list(coalesce(st.stem, u.g) ORDER BY i) AS t
      FROM (SELECT doc_id, unnest(t) AS g, generate_subscripts(t, 1) AS i FROM d) u LEFT JOIN st ON st.g = u.g GROUP BY doc_id),
p AS (SELECT a.doc_id AS pair_id, coalesce(xa.t, []) AS rt, coalesce(xb.t, []) AS ct FROM d a JOIN d b ON b.doc_id = a.doc_id + 1
      LEFT JOIN x xa ON xa.doc_id = a.doc_id LEFT JOIN x xb ON xb.doc_id = b.doc_id),
{S.rouge_hits_cte('p', 'pair_id', 'rt', 'ct')}
SELECT p.pair_id, len(rt)::BIGINT AS n_ref, len(ct)::BIGINT AS n_cand, coalesce(hit1, 0) AS hit1, coalesce(hit2, 0) AS hit2,
       round({S.fmeasure('coalesce(hit1, 0)', 'len(rt)', 'len(ct)')}, 6) AS rouge1,
       round({S.fmeasure('coalesce(hit2, 0)', 'greatest(len(rt) - 1, 0)', 'greatest(len(ct) - 1, 0)')}, 6) AS rouge2
FROM p LEFT JOIN h1 USING (pair_id) LEFT JOIN h2 USING (pair_id)
""", operators=("rouge_tokens", "porter_stem", "rouge1", "rouge2"))
def q_rouge_stemmed(spark, sf):
    """ROUGE-1/2 of next-document pairs on stems; each distinct token is stemmed once."""
    d = spread(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    stems = with_stem_ids(d, ["doc_id"], {"ids": rouge_tokens("text")})
    p = stems.alias("a").join(stems.alias("b"), F.col("b.doc_id") == F.col("a.doc_id") + 1).select(
        F.col("a.doc_id").alias("pair_id"), F.col("a.ids").alias("ref"), F.col("b.ids").alias("cand"))
    s = finish_rouge(p.select("pair_id", *rouge_id_columns("ref", "cand", lcs=False)))
    return s.select("pair_id", "n_ref", "n_cand", "hit1", "hit2", r6(F.col("rouge1")).alias("rouge1"), r6(F.col("rouge2")).alias("rouge2"))


# --------------------------------------------------------------------------- EM / F1
@query("qa_metrics", sql=f"""
WITH {S.SAMPLES_CTE}
SELECT task, sample_id, {S.exact_match('answer', 'question')} AS em_question,
       round({S.token_f1('answer', 'prompt')}, 6) AS f1_context,
       round({S.token_f1('answer', 'question')}, 6) AS f1_question,
       {S.exact_match('answer', S.final_answer('answer'))} AS em_final
FROM samples WHERE task IN ('qa', 'reasoning')
""", operators=("exact_match", "token_f1", "token_intersect", "distinct_tokens"))
def q_qa_metrics(spark, sf):
    s = build_samples(spark, sf, ("qa", "reasoning"), distribute=False)
    from abridge.sources.samples import final_answer
    return s.select("task", "sample_id", exact_match("answer", "question").alias("em_question"),
                    r6(token_f1("answer", "prompt")).alias("f1_context"),
                    r6(token_f1("answer", "question")).alias("f1_question"),
                    exact_match("answer", final_answer("answer")).alias("em_final"))


# --------------------------------------------------------------------------- task evaluation
def _eval_sql(task, methods, select):
    return f"""
WITH {S.SAMPLES_CTE},
base AS (SELECT * FROM samples WHERE task = '{task}'),
{S.candidates_cte('base', RATIOS, methods)}
{select}"""


def _scored(spark, sf, task, methods):
    if task in ROUGE_TASKS:
        return scored_documents(document_rows(spark, sf, (task,)), (task,), RATIOS, methods)
    return scored_grid(build_samples(spark, sf, (task,)), RATIOS, methods, rouge_asked=False)


def _rouge_sql(task: str, cols: str) -> str:
    return f"""
WITH {S.scored_cte((task,), ALL_METHODS, RATIOS)}
SELECT sample_id, ratio, style, {cols} FROM sc WHERE n_ref IS NOT NULL"""


_ROUGE = ", ".join(f"round({m}, 6) AS {m}" for m in ("rouge1", "rouge2", "rougeL", "bertscore"))


@query("eval_reconstruction", sql=_rouge_sql("reconstruction", f"n_ref, n_cand, {_ROUGE}"),
       operators=("eval_reconstruction", "rougeL", "bertscore", "join_scores"))
def q_eval_reconstruction(spark, sf):
    s = _scored(spark, sf, "reconstruction", ALL_METHODS)
    return s.select("sample_id", "ratio", "style", "n_ref", "n_cand",
                    *[r6(F.col(m)).alias(m) for m in ("rouge1", "rouge2", "rougeL", "bertscore")])


@query("eval_summarization", sql=_rouge_sql(
    "summarization", f"n_ref, n_cand, lcs, {_ROUGE}, round(primary_score, 6) AS primary_score"),
       operators=("eval_summarization", "rougeL", "primary_score"))
def q_eval_summarization(spark, sf):
    s = _scored(spark, sf, "summarization", ALL_METHODS).where(F.col("n_ref").isNotNull())
    return s.select("sample_id", "ratio", "style", "n_ref", "n_cand", "lcs",
                    *[r6(F.col(m)).alias(m) for m in ("rouge1", "rouge2", "rougeL", "bertscore", "primary_score")])


@query("eval_qa", sql=_eval_sql("qa", ALL_METHODS, f"""
SELECT sample_id, ratio, style, {S.exact_match('answer', 'compressed')} AS em,
       round({S.token_f1('answer', 'compressed')}, 6) AS f1
FROM cands"""), operators=("eval_qa", "exact_match", "token_f1"))
def q_eval_qa(spark, sf):
    s = _scored(spark, sf, "qa", ALL_METHODS)
    return s.select("sample_id", "ratio", "style", "em", r6(F.col("f1")).alias("f1"))


@query("eval_reasoning", sql=_eval_sql("reasoning", ALL_METHODS, f"""
SELECT sample_id, ratio, style, {S.exact_match('answer', S.final_answer('compressed'))} AS em
FROM cands"""), operators=("eval_reasoning", "final_answer"))
def q_eval_reasoning(spark, sf):
    s = _scored(spark, sf, "reasoning", ALL_METHODS)
    return s.select("sample_id", "ratio", "style", "em")
