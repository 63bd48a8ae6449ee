"""Registered queries of the second request round and of the error channel."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from abridge.functions.tokens import ws_tokens
from abridge.operators.candidates import candidates
from abridge.operators.errors import error_report, split_errors
from abridge.operators.requests import eval_request
from abridge.operators.responses import ResponseStore, score_answers
from abridge.plans import sql as S
from abridge.plans.registry import query
from abridge.session import ensure_checkpoint_dir
from abridge.sources.samples import build_samples, final_answer, md5_bucket
from abridge.functions.text import TMPL_QA, TMPL_REASON, TMPL_RECONSTRUCT

TASKS = ("reconstruction", "qa", "reasoning")
RATIO, METHODS = 0.25, ["loc-begin", "loc-all"]
SILENT, BLANK = 7, 11  # the stand-in reader fails on one request in 7 and says nothing on one in 11
METRICS = ("rouge1", "rouge2", "rougeL", "em", "f1")


def r6(c):
    return F.round(c, 6)


def reader(requests):
    """Stand-in reader: two thirds of a text it is to reconstruct, the last sentence of a context, the last line of a prompt."""
    task, draw = F.col("task"), md5_bucket("request_id")
    tok = ws_tokens("compressed")
    part = F.array_join(F.slice(tok, F.lit(1), (F.size(tok) - F.floor(F.size(tok) / 3)).cast("int")), " ")
    said = (F.when(task == "reconstruction", F.concat(F.lit("Sure.\nReconstructed text: "), part, F.lit("\n")))
            .when(task == "qa", F.concat(F.lit("  "), F.substring_index("compressed", ". ", -1), F.lit("\n")))
            .otherwise(F.concat(F.lit("I read: "), F.translate("question", "\n", " "), F.lit("\n"), final_answer("compressed"))))
    return requests.where(draw % SILENT != 0).select("request_id", F.when(draw % BLANK == 0, F.lit(" \n")).otherwise(said).alias("response"))


def ask_reader(cands, store, run):
    asked = eval_request(cands).select(F.col("eval_request_id").alias("request_id"), "task", "compressed", "question")
    return store.fill(asked, reader, run)


def scored_answers(spark, sf):
    """Candidates of three tasks, scored by what the reader said about them."""
    c = candidates(build_samples(spark, sf, TASKS), [RATIO], METHODS)
    store = ResponseStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/responses-{uuid.uuid4().hex}")
    ask_reader(c, store, "first")
    return score_answers(c, store)


def _answers_sql() -> str:
    request = f"""CASE task WHEN 'reconstruction' THEN {S.render(TMPL_RECONSTRUCT, compressed='compressed')}
        WHEN 'qa' THEN {S.render(TMPL_QA, compressed='compressed', question='question')}
        ELSE {S.render(TMPL_REASON, compressed='compressed', question='question')} END"""
    tok = S.ws_tok("compressed")
    part = f"array_to_string({tok}[1:len({tok}) - len({tok}) // 3], ' ')"
    last = "string_split(compressed, '. ')[-1]"
    said = f"""CASE task WHEN 'reconstruction' THEN 'Sure.' || chr(10) || 'Reconstructed text: ' || {part} || chr(10)
        WHEN 'qa' THEN '  ' || {last} || chr(10)
        ELSE 'I read: ' || replace(question, chr(10), ' ') || chr(10) || {S.final_answer('compressed')} END"""
    key = "task, sample_id, style"
    rouge = "a.task = 'reconstruction'"
    return f"""{S.SAMPLES_CTE},
base AS (SELECT * FROM samples WHERE task IN ('reconstruction', 'qa', 'reasoning')),
{S.candidates_cte('base', [RATIO], METHODS)},
asked AS (SELECT *, md5({request}) AS request_id FROM cands),
said AS (SELECT *, CASE WHEN {S.md5_bucket('request_id')} % {SILENT} = 0 THEN NULL WHEN {S.md5_bucket('request_id')} % {BLANK} = 0 THEN ' ' || chr(10)
                        ELSE {said} END AS response FROM asked),
read AS (SELECT *, nullif(CASE task WHEN 'reconstruction' THEN {S.parse_reconstruction('response')} ELSE {S.strip('response')} END, '') AS parsed FROM said),
a AS (SELECT *, CASE WHEN response IS NULL THEN 'no response' WHEN parsed IS NULL THEN 'empty answer' ELSE 'answer' END AS answer_source,
             coalesce(parsed, compressed) AS answer_text FROM read),
p AS (SELECT {key}, {S.rouge_tok('prompt')} AS rt, {S.rouge_tok('answer_text')} AS ct FROM a WHERE task = 'reconstruction'),
{S.lcs_cte('p', key, 'rt', 'ct', 'pl')},
{S.rouge_hits_cte('p', key, 'rt', 'ct')},
scored AS (SELECT a.*,
  CASE WHEN {rouge} THEN {S.fmeasure('coalesce(hit1, 0)', 'len(rt)', 'len(ct)')} END AS rouge1,
  CASE WHEN {rouge} THEN {S.fmeasure('coalesce(hit2, 0)', 'greatest(len(rt) - 1, 0)', 'greatest(len(ct) - 1, 0)')} END AS rouge2,
  CASE WHEN {rouge} THEN {S.fmeasure('coalesce(lcs, 0)', 'len(rt)', 'len(ct)')} END AS rougeL,
  CASE a.task WHEN 'qa' THEN {S.exact_match('answer', 'answer_text')} WHEN 'reasoning' THEN {S.exact_match('answer', S.final_answer('answer_text'))} END AS em,
  CASE a.task WHEN 'qa' THEN {S.token_f1('answer', 'answer_text')} END AS f1
  FROM a LEFT JOIN p USING ({key}) LEFT JOIN pl USING ({key}) LEFT JOIN h1 USING ({key}) LEFT JOIN h2 USING ({key}))"""


@query("eval_answers", sql=f"""
WITH {_answers_sql()}
SELECT task, sample_id, ratio, style, answer_source, {", ".join(f"round({m}, 6) AS {m}" for m in METRICS)} FROM scored
""", operators=("eval_reconstruction", "eval_qa", "eval_reasoning", "parse_reconstruction", "tmpl_reconstruct", "tmpl_qa", "tmpl_reason"))
def q_eval_answers(spark, sf):
    """Scores from parsed answers; without a usable answer the compressed text counts."""
    s = scored_answers(spark, sf)
    return s.select("task", "sample_id", "ratio", "style", "answer_source", *[r6(F.col(m)).alias(m) for m in METRICS])


def _reasons():
    return {"no response": F.col("answer_source") == "no response", "empty answer": F.col("answer_source") == "empty answer",
            "no label": F.coalesce(F.col("answer"), F.when(F.col("task") == "reconstruction", F.col("quality").cast("string"))).isNull()}


def error_split(spark, sf):
    """Good rows, failed rows and counts of the reader's answers; a reconstruction's label is its document's quality."""
    s = scored_answers(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy(F.col("doc_id").alias("sample_id")).agg(F.max("quality").alias("quality"))
    s = s.join(labels.withColumn("task", F.lit("reconstruction")), ["task", "sample_id"], "left")
    s = s.select("task", "sample_id", "ratio", "style", "answer", "answer_source", "quality", *METRICS)
    return split_errors(s, _reasons(), f"{ensure_checkpoint_dir(spark).rstrip('/')}/errors-{uuid.uuid4().hex}")


_ERRORS_SQL = f"""WITH {_answers_sql()},
marked AS (SELECT scored.*, CASE WHEN answer_source <> 'answer' THEN answer_source
                        WHEN coalesce(answer, CASE WHEN task = 'reconstruction' THEN quality::VARCHAR END) IS NULL THEN 'no label' END AS error
           FROM scored LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = sample_id AND task = 'reconstruction')"""


@query("drop_errors", sql=f"""{_ERRORS_SQL}
SELECT task, style, count(*) AS n, {", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS)} FROM marked WHERE error IS NULL GROUP BY task, style
""", operators=("drop_errors",))
def q_drop_errors(spark, sf):
    """Mean scores without the rows that failed."""
    good, _, _ = error_split(spark, sf)
    return good.groupBy("task", "style").agg(F.count(F.lit(1)).alias("n"), *[r6(F.avg(m)).alias(m) for m in METRICS])


@query("error_report", sql=f"""{_ERRORS_SQL}
SELECT task, style, error, count(*) AS n FROM marked WHERE error IS NOT NULL GROUP BY task, style, error
""", operators=("drop_errors",))
def q_error_report(spark, sf):
    """The rows that failed, counted by reason."""
    return error_report(error_split(spark, sf)[1], ["task", "style"])
