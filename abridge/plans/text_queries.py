"""Registered text queries (sources, tokens, compressors, metrics)."""

from __future__ import annotations

from pyspark.sql import functions as F

from abridge.functions.metrics import finish_rouge, rouge_columns
from abridge.functions.pieces import cut_pieces, with_pieces
from abridge.functions.tokens import n_tokens, rouge_tokens, target_tokens, truncate_tokens, ws_tokens
from abridge.plans import sql as S
from abridge.plans.registry import query
from abridge.session import spread
from abridge.sources.samples import build_samples
from abridge.sources.tables import dataset_row_counts, read_table


def r6(c):
    return F.round(c, 6)


# --------------------------------------------------------------------------- minimum slice
@query("rouge_prefix", sql=f"""
WITH d AS (SELECT doc_id, lang, text, {S.ws_tok('text')} AS tok FROM documents),
b AS (SELECT *, {S.target('len(tok)', '0.25')} AS tgt FROM d),
c AS (SELECT doc_id, lang, text AS ref,
             CASE WHEN len(tok) <= tgt THEN text ELSE array_to_string(tok[1:tgt], ' ') END AS cand FROM b),
r AS (SELECT doc_id, lang, {S.rouge_tok('ref')} AS rt, {S.rouge_tok('cand')} AS ct FROM c),
{S.rouge_hits_cte('r', 'doc_id', 'rt', 'ct')},
s AS (
  SELECT r.doc_id, lang,
         {S.fmeasure('coalesce(hit1, 0)', 'len(rt)', 'len(ct)')} AS r1,
         {S.fmeasure('coalesce(hit2, 0)', 'greatest(len(rt) - 1, 0)', 'greatest(len(ct) - 1, 0)')} AS r2,
         {S.fmeasure('len(ct)', 'len(rt)', 'len(ct)')} AS rl
  FROM r LEFT JOIN h1 USING (doc_id) LEFT JOIN h2 USING (doc_id))
SELECT lang, count(*) AS n_docs, round(avg(r1), 6) AS rouge1, round(avg(r2), 6) AS rouge2,
       round(avg(rl), 6) AS rougeL
FROM s GROUP BY lang
""", operators=("count_tokens", "target_tokens", "truncate_tokens", "comp_prefix", "rouge_tokens",
                "rouge1", "rouge2", "rougeL", "ngram_overlap", "avg_metrics"))
def q_rouge_prefix(spark, sf):
    """Minimum slice: prefix at ratio 0.25 scored against the document, mean per language."""
    d = spread(read_table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id")
    d = d.withColumn("tok", ws_tokens("text")).withColumn("n", n_tokens("tok"))
    d = d.withColumn("target", target_tokens("n", F.lit(0.25)))
    d = d.withColumn("cand", truncate_tokens("text", "tok", "target"))
    s = d.select("lang", *rouge_columns(rouge_tokens("text"), rouge_tokens("cand"), subsequence=True))
    s = finish_rouge(s)
    return (s.groupBy("lang")
            .agg(F.count(F.lit(1)).alias("n_docs"), r6(F.avg("rouge1")).alias("rouge1"),
                 r6(F.avg("rouge2")).alias("rouge2"), r6(F.avg("rougeL")).alias("rougeL")))


# --------------------------------------------------------------------------- sources
@query("src_dataset", sql="""
SELECT * FROM (VALUES
 ('benchmark', (SELECT count(*) FROM benchmark)), ('conversations', (SELECT count(*) FROM conversations)),
 ('customer', (SELECT count(*) FROM customer)), ('documents', (SELECT count(*) FROM documents)),
 ('embeddings', (SELECT count(*) FROM embeddings)), ('events', (SELECT count(*) FROM events)),
 ('labels', (SELECT count(*) FROM labels)), ('lineitem', (SELECT count(*) FROM lineitem)),
 ('nation', (SELECT count(*) FROM nation)), ('orders', (SELECT count(*) FROM orders)),
 ('pages', (SELECT count(*) FROM pages)), ('part', (SELECT count(*) FROM part)),
 ('region', (SELECT count(*) FROM region)), ('supplier', (SELECT count(*) FROM supplier))
) AS t(table_name, n_rows)
""")
def q_src_dataset(spark, sf):
    return dataset_row_counts(spark, sf)


@query("src_samples", sql=f"WITH {S.SAMPLES_CTE} SELECT * FROM samples",
       operators=("src_samples", "synth_qa", "final_answer", "join_labels"))
def q_src_samples(spark, sf):
    return build_samples(spark, sf)


@query("count_tokens", sql=f"""
SELECT doc_id, len({S.ws_tok('text')})::BIGINT AS n_tokens, len({S.rouge_tok('text')})::BIGINT AS n_rouge_tokens,
       {S.target('len(' + S.ws_tok('text') + ')', '0.1')} AS target_10,
       {S.target('len(' + S.ws_tok('text') + ')', '0.1', False)} AS target_10_floor0
FROM documents""", operators=("count_tokens", "target_tokens", "target_tokens_floor0"))
def q_count_tokens(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", n_tokens(ws_tokens("text")).alias("n_tokens"),
                                                   n_tokens(rouge_tokens("text")).alias("n_rouge_tokens"))
    return d.select("*", target_tokens("n_tokens", F.lit(0.1)).alias("target_10"),
                    target_tokens("n_tokens", F.lit(0.1), False).alias("target_10_floor0"))


# --------------------------------------------------------------------------- compressors
from abridge.operators.candidates import candidates  # noqa: E402
from abridge.operators.catalog import RATIOS  # noqa: E402


def _comp_sql(methods, task="reconstruction"):
    return f"""
WITH {S.SAMPLES_CTE},
base AS (SELECT * FROM samples WHERE task = '{task}'),
{S.candidates_cte('base', RATIOS, methods)}
SELECT sample_id, ratio, style, target, len({S.ws_tok('compressed')})::BIGINT AS n_out, compressed
FROM cands"""


def _comp_query(name, methods, operators):
    def fn(spark, sf):
        s = build_samples(spark, sf, ("reconstruction",))
        c = candidates(s, RATIOS, methods)
        return c.select("sample_id", "ratio", "style", "target",
                        n_tokens(ws_tokens("compressed")).alias("n_out"), "compressed")
    fn.__name__ = f"q_{name.replace('-', '_')}"
    fn.__doc__ = f"Rule compressor query {name}: {', '.join(methods)} at every ratio."
    query(name, sql=_comp_sql(methods), operators=operators)(fn)


_comp_query("comp_loc", ["loc-begin", "loc-mid", "loc-end", "loc-all"], ("comp_loc", "comp_prefix"))
_comp_query("comp_random_window", ["random"], ("comp_random_window",))
_comp_query("comp_sentences", ["selective", "readable"], ("comp_sentences", "running_tokens"))
_comp_query("comp_extractive", ["extractive"], ("comp_extractive",))
_comp_query("comp_format_aware", ["format-aware"], ("comp_extractive",))
_comp_query("comp_abbrev", ["unreadable"], ("comp_abbrev",))
_comp_query("comp_fallback_styles", ["abstractive", "for_qa", "selective-context"],
            ("comp_style", "comp_prefix", "target_tokens_floor0"))


@query("count_pieces", operators=("count_tokens", "truncate_tokens"))
def q_count_pieces(spark, sf):
    """Every document's length in pieces of the BPE tokenizer file, and its cut to a quarter of them, spacing kept.

    No SQL states the merges; tests hold counts and cuts of all documents against the tokenizer itself.
    """
    d = with_pieces(spread(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id"), ["doc_id"], "text")
    d = d.withColumn("target", target_tokens("n_pieces", F.lit(0.25))).withColumn("cut", cut_pieces(F.col("target")))
    return d.select("doc_id", "n_pieces", "target", F.least("target", "n_pieces").alias("n_cut"),
                    F.char_length("cut").cast("bigint").alias("cut_chars"), F.md5("cut").alias("cut_md5"))
