"""Registered adaptation queries (style sampling, demonstrations, inference, comparisons)."""

from __future__ import annotations

from pyspark.sql import functions as F

from abridge.functions.tokens import actual_ratio, n_tokens, ws_tokens
from abridge.operators.adapt import (GKEY, adapt_infer_split, adaptation, demo_arrays, inference,
                                     style_ranking, top_demos)
from abridge.operators.candidates import candidates
from abridge.operators.catalog import RATIOS, STYLE_NAMES
from abridge.operators.report import method_detail, task_summary
from abridge.operators.scoring import score
from abridge.operators.sweep import scored_grid
from abridge.plans.registry import query
from abridge.sources.samples import SAMPLE_COLS, build_samples
from abridge.session import cut_lineage

ADAPT_SIZE = 10
N_TOTAL = 5
FULL = [("full", N_TOTAL // 2, N_TOTAL - N_TOTAL // 2)]
# Ablation configs: (name, style draws, few-shot tries) per prompt; truncation has no adaptation.
ABLATION = [("style_only", 2, 0), ("icl_only", 0, 2), ("full", 1, 2)]


def r6(c):
    return F.round(c, 6)


def labelled(samples):
    """Only prompts that can be scored take part (Q5)."""
    return samples.where(F.coalesce("reference", "answer",
                                    F.when(F.col("task") == "reconstruction", F.col("prompt"))).isNotNull())


def run_adaptation(spark, sf, task="qa", adapt_size=ADAPT_SIZE, ratios=RATIOS, configs=FULL):
    """(infer samples, adapt candidates, demonstrations, style statistics, all samples)."""
    s = build_samples(spark, sf, (task,))
    roles = cut_lineage(adapt_infer_split(labelled(s).select("task", "grp", "sample_id"), adapt_size))
    keys = ["task", "grp", "sample_id"]
    adapt_samples = cut_lineage(s.join(roles.where("is_adapt").select(*keys), keys, "left_semi").select(*SAMPLE_COLS))
    infer_samples = s.join(roles.where("is_infer").select(*keys), keys, "left_semi").select(*SAMPLE_COLS)
    cand = cut_lineage(scored_grid(adapt_samples, ratios, STYLE_NAMES, corpus=s)
                       .select("task", "sample_id", "ratio", "style", "prompt", "compressed",
                               F.round("primary_score", 12).alias("score")))
    demos, stats = adaptation(cand, roles, ratios, adapt_size=adapt_size, configs=configs)
    return infer_samples, cand, demos, stats, s


def run_inference(spark, sf, task="qa", ratios=RATIOS, configs=FULL):
    infer_samples, cand, demos, _, s = run_adaptation(spark, sf, task, ratios=ratios, configs=configs)
    arr = demo_arrays(demos, cand.select("task", "sample_id", "ratio", "style", "prompt", "compressed"))
    return score(inference(infer_samples, arr, ratios, configs, corpus=s)), demos, infer_samples, s


def _inference_sql(select: str, ratios=RATIOS, config=FULL[0], more_methods=()) -> str:
    from abridge.plans import sql as S
    return f"WITH {S.inference_sql('qa', ratios, ADAPT_SIZE, *config, more_methods=more_methods)}\n{select}"


def _adapt_sql(select: str, task: str = "qa", ratios=RATIOS) -> str:
    from abridge.plans import sql as S
    return f"WITH {S.adaptation_sql(task, ratios, ADAPT_SIZE, FULL[0][1], FULL[0][2])}\n{select}"


@query("adaptation", sql=_adapt_sql("""
SELECT config, task, ratio, grp, iteration, sample_id, style_used, round(score, 6) AS score, round(ca, 6) AS ca
FROM demos"""), operators=("adaptation", "sample_style", "running_style_state",
                                          "running_pool", "icl_demos", "ca_min", "best_candidate",
                                          "adapt_infer_split"))
def q_adaptation(spark, sf):
    """Demonstration pool of every (task, ratio, grp) group after M rounds (qa task, F1)."""
    _, _, demos, _, _ = run_adaptation(spark, sf)
    return demos.select(*GKEY, "iteration", "sample_id", "style_used",
                        r6(F.col("score")).alias("score"), r6(F.col("ca")).alias("ca"))


@query("adaptation_reasoning", sql=_adapt_sql("""
SELECT config, task, ratio, grp, iteration, sample_id, style_used, round(score, 6) AS score, round(ca, 6) AS ca
FROM demos""", "reasoning", [0.25]), operators=("adaptation", "ca_mid"))
def q_adaptation_reasoning(spark, sf):
    """Adaptation bound to reasoning (exact match; advantage over the median)."""
    _, _, demos, _, _ = run_adaptation(spark, sf, "reasoning", ratios=[0.25])
    return demos.select(*GKEY, "iteration", "sample_id", "style_used",
                        r6(F.col("score")).alias("score"), r6(F.col("ca")).alias("ca"))


@query("adaptation_summarization", sql=_adapt_sql("""
SELECT config, task, ratio, grp, iteration, sample_id, style_used, round(score, 6) AS score, round(ca, 6) AS ca
FROM demos""", "summarization", [0.25]), operators=("adaptation", "eval_summarization"))
def q_adaptation_summarization(spark, sf):
    """Adaptation bound to summarization (hashed reference line; primary = mean of 3 ROUGE)."""
    _, _, demos, _, _ = run_adaptation(spark, sf, "summarization", ratios=[0.25])
    return demos.select(*GKEY, "iteration", "sample_id", "style_used",
                        r6(F.col("score")).alias("score"), r6(F.col("ca")).alias("ca"))


@query("style_stats", sql=_adapt_sql("""
SELECT config, task, ratio, grp, style, round(perf_sum, 6) AS perf_sum, n,
       round(CASE WHEN n > 0 THEN perf_sum / n ELSE 0.0 END, 6) AS avg_perf
FROM stats"""), operators=("style_stats", "style_weights"))
def q_style_stats(spark, sf):
    _, _, _, stats, _ = run_adaptation(spark, sf)
    return stats.select(*GKEY, "style", r6(F.col("perf_sum")).alias("perf_sum"), "n",
                        r6(F.col("avg_perf")).alias("avg_perf"))


def _analysis_sql() -> str:
    from abridge.plans import sql as S
    return f"""WITH {S.adaptation_sql('qa', [0.25], ADAPT_SIZE, FULL[0][1], FULL[0][2])}
SELECT config, task, ratio, grp, rank, style, round(avg_perf, 6) AS avg_perf, n FROM (
  SELECT *, row_number() OVER (PARTITION BY config, task, ratio, grp ORDER BY avg_perf DESC, style) AS rank
  FROM (SELECT *, CASE WHEN n > 0 THEN perf_sum / n ELSE 0.0 END AS avg_perf FROM stats))
WHERE rank <= 10"""


@query("style_analysis", sql=_analysis_sql(), operators=("style_analysis", "rank_styles"))
def q_style_analysis(spark, sf):
    """Styles ranked by mean winning score per group (first 10)."""
    _, _, _, stats, _ = run_adaptation(spark, sf, ratios=[0.25])
    return style_ranking(stats).select(*GKEY, F.col("rank").cast("bigint").alias("rank"), "style",
                                       r6(F.col("avg_perf")).alias("avg_perf"), "n")


@query("top_demos", sql=_adapt_sql("""
SELECT config, task, ratio, grp, rank, iteration, sample_id, style_used, round(ca, 6) AS ca FROM (
  SELECT *, row_number() OVER (PARTITION BY config, task, ratio, grp ORDER BY ca DESC, iteration) AS rank FROM demos)
WHERE rank <= 2"""), operators=("top_demos", "task_settings"))
def q_top_demos(spark, sf):
    _, _, demos, _, _ = run_adaptation(spark, sf)
    return top_demos(demos).select(*GKEY, F.col("rank").cast("bigint").alias("rank"), "iteration", "sample_id", "style_used",
                                   r6(F.col("ca")).alias("ca"))


@query("inference", sql=_inference_sql("""
SELECT config, task, ratio, grp, sample_id, request_id, source, target, n_out, round(f1, 6) AS f1, round(f1, 6) AS primary_score
FROM inf"""), operators=("inference", "tmpl_few_shot", "compress_batch"))
def q_inference(spark, sf):
    """Infer-role prompts compressed with the top-S demonstrations, scored."""
    inf = run_inference(spark, sf)[0]
    return inf.select(*GKEY, "sample_id", "request_id", "source", "target",
                      n_tokens(ws_tokens("compressed")).alias("n_out"), r6(F.col("f1")).alias("f1"),
                      r6(F.col("primary_score")).alias("primary_score"))


_ACHIEVED = "CASE WHEN n_tok > 0 THEN n_out / n_tok::DOUBLE ELSE 0.0 END"


@query("ratio_sweep", sql=_inference_sql(f"""
SELECT task, ratio, count(*) AS n, round(avg({_ACHIEVED}), 6) AS avg_ratio, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1
FROM inf GROUP BY task, ratio"""), operators=("ratio_sweep", "avg_ratio", "actual_ratio"))
def q_ratio_sweep(spark, sf):
    """Per ratio: mean achieved ratio and mean quality of the adaptive method on infer prompts."""
    inf = run_inference(spark, sf)[0]
    inf = inf.withColumn("achieved", actual_ratio(n_tokens(ws_tokens("compressed")), "n_tok"))
    return inf.groupBy("task", "ratio").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("achieved")).alias("avg_ratio"),
        r6(F.avg("em")).alias("em"), r6(F.avg("f1")).alias("f1"))


_PER_CONFIG = "SELECT config, task, ratio, count(*) AS n, round(avg(f1), 6) AS f1, round(avg(em), 6) AS em FROM {} GROUP BY ALL"
_TRUNCATED = ("(SELECT 'truncation' AS config, sc.task, sc.ratio, sc.f1, sc.em FROM sc JOIN keys USING (sample_id, ratio) "
              "WHERE sc.style = 'loc-begin')")


@query("ablation", sql=" UNION ALL ".join(
    f"SELECT * FROM ({_inference_sql(_PER_CONFIG.format('inf'), [0.25], c)})" for c in ABLATION)
    + f" UNION ALL SELECT * FROM ({_inference_sql(_PER_CONFIG.format(_TRUNCATED), [0.25])})", operators=("ablation",))
def q_ablation(spark, sf):
    """style_only / icl_only / full side by side (config column) plus truncation, all on the infer prompts."""
    inf, _, infer_samples, _ = run_inference(spark, sf, ratios=[0.25], configs=ABLATION)
    cols = [r6(F.avg("f1")).alias("f1"), r6(F.avg("em")).alias("em")]
    adaptive = inf.groupBy("config", "task", "ratio").agg(F.count(F.lit(1)).alias("n"), *cols)
    trunc = score(candidates(infer_samples, [0.25], ["loc-begin"])).groupBy("task", "ratio").agg(
        F.count(F.lit(1)).alias("n"), *cols).withColumn("config", F.lit("truncation"))
    return adaptive.unionByName(trunc)


_METHODS = ["selective-context", "random", "selective"]


@query("method_comparison", sql=_inference_sql(f"""
, every AS (SELECT task, ratio, 'adaptive' AS method, n_tok, n_out, em, f1 FROM inf
  UNION ALL SELECT sc.task, sc.ratio, sc.style, sc.n_tok, len(regexp_extract_all(sc.compressed, '\\S+')), sc.em, sc.f1
  FROM sc JOIN keys USING (sample_id, ratio) WHERE sc.style IN ({", ".join(f"'{m}'" for m in _METHODS)}))
SELECT task, ratio, method, count(*) AS n, round(avg({_ACHIEVED}), 6) AS avg_ratio, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1,
       CASE WHEN method = 'adaptive' THEN (SELECT count(*) FROM demos) ELSE 0 END AS num_demonstrations
FROM every GROUP BY task, ratio, method""", [0.25], more_methods=_METHODS),
       operators=("method_comparison", "method_summary", "comp_random_window", "comp_sentences"))
def q_method_comparison(spark, sf):
    """Adaptive vs truncation vs random vs selective on the same infer prompts (qa, F1)."""
    inf, demos, infer_samples, s = run_inference(spark, sf, ratios=[0.25])
    adaptive = inf.select("task", "sample_id", "ratio", "n_tok", "compressed", "em", "f1") \
        .withColumn("method", F.lit("adaptive"))
    base = score(candidates(infer_samples, [0.25], _METHODS, corpus=s))
    base = base.select("task", "sample_id", "ratio", "n_tok", "compressed", "em", "f1",
                       F.col("style").alias("method"))
    allm = adaptive.unionByName(base).withColumn(
        "achieved", actual_ratio(n_tokens(ws_tokens("compressed")), "n_tok"))
    n_demos = demos.groupBy("task", "ratio").agg(F.count(F.lit(1)).alias("num_demonstrations"))
    out = allm.groupBy("task", "ratio", "method").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("achieved")).alias("avg_ratio"),
        r6(F.avg("em")).alias("em"), r6(F.avg("f1")).alias("f1"))
    return (out.join(n_demos, ["task", "ratio"], "left")
            .withColumn("num_demonstrations", F.when(F.col("method") == "adaptive", F.col("num_demonstrations"))
                        .otherwise(F.lit(0))))


@query("prompt_ratios", sql=_inference_sql(f"""
SELECT task, ratio, grp, sample_id, n_tok, n_out, round({_ACHIEVED}, 6) AS achieved FROM inf"""), operators=("avg_ratio", "actual_ratio"))
def q_prompt_ratios(spark, sf):
    """The achieved ratio of every inferred prompt, which ``ratio_sweep`` averages."""
    inf = run_inference(spark, sf)[0].withColumn("n_out", n_tokens(ws_tokens("compressed")))
    return inf.select("task", "ratio", "grp", "sample_id", "n_tok", "n_out", r6(actual_ratio("n_out", "n_tok")).alias("achieved"))


def _summary_sql() -> str:
    by_ratio = _inference_sql(f"SELECT task, 3 AS part, ratio::VARCHAR AS name, '  ' || ratio::VARCHAR || ': actual=' || "
                              f"printf('%.3f', round(avg({_ACHIEVED}), 3)) AS line FROM inf GROUP BY task, ratio", RATIOS, ABLATION[-1])
    by_config = [_inference_sql(f"SELECT task, 5 AS part, config AS name, '  ' || config || ': ratio=' || "
                                f"printf('%.3f', round(avg({_ACHIEVED}), 3)) AS line FROM inf GROUP BY task, config", [0.25], c) for c in ABLATION]
    heads = "".join(f" UNION ALL SELECT DISTINCT task, {i}, '', {line} FROM body" for i, line in (
        (0, "upper(task) || ':'"), (1, f"'{'-' * 40}'"), (2, "'Compression Ratio Analysis:'"), (4, "'Ablation Study Results:'")))
    return f"""WITH body AS ({" UNION ALL ".join(f"SELECT * FROM ({q})" for q in [by_ratio, *by_config])}),
every AS (SELECT * FROM body{heads})
SELECT task, row_number() OVER (PARTITION BY task ORDER BY part, name) - 1 AS line_no, line FROM every"""


@query("report_summary", sql=_summary_sql(), operators=("report_text", "avg_ratio"))
def q_report_summary(spark, sf):
    """The printed summary of a task: achieved ratio by target ratio and by configuration, over one adaptation."""
    inf = run_inference(spark, sf, configs=ABLATION)[0]
    inf = cut_lineage(inf.select("config", "task", "ratio", actual_ratio(n_tokens(ws_tokens("compressed")), "n_tok").alias("achieved")))
    mean = F.avg("achieved").alias("avg_ratio")
    return task_summary(inf.where(F.col("config") == ABLATION[-1][0]).groupBy("task", "ratio").agg(mean),
                        inf.where(F.col("ratio") == 0.25).groupBy("task", "config").agg(mean))


@query("report_methods", sql=_inference_sql(f"""
, every AS (SELECT task, ratio, 'adaptive' AS method, sample_id, n_tok, n_out, em, f1, compressed FROM inf
  UNION ALL SELECT sc.task, sc.ratio, sc.style, sample_id, sc.n_tok, len(regexp_extract_all(sc.compressed, '\\S+')), sc.em, sc.f1, sc.compressed
  FROM sc JOIN keys USING (sample_id, ratio) WHERE sc.style IN ({", ".join(f"'{m}'" for m in _METHODS)})),
per AS (SELECT task, ratio, method, [upper(method) || ':', '  Average Ratio: ' || printf('%.3f', round(avg({_ACHIEVED}), 3)),
    '  Quality Metrics: em=' || printf('%.3f', round(avg(em), 3)) || ', f1=' || printf('%.3f', round(avg(f1), 3)),
    CASE WHEN method = 'adaptive' THEN '  Demonstrations Used: ' || (SELECT count(*) FROM demos) END,
    '  Example Compression: ' || arg_min(substr(compressed, 1, 100), sample_id) || '...'] AS lines
  FROM every GROUP BY task, ratio, method),
kept AS (SELECT task, ratio, method, list_filter(lines, lambda x: x IS NOT NULL) AS lines FROM per)
SELECT task, ratio, method, unnest(range(len(lines)))::BIGINT AS line_no, unnest(lines) AS line FROM kept""", [0.25], more_methods=_METHODS),
       operators=("report_text", "method_summary"))
def q_report_methods(spark, sf):
    """The printed detail of every method: ratio, quality, demonstrations used, an example."""
    inf, demos, infer_samples, s = run_inference(spark, sf, ratios=[0.25])
    cols = ["task", "ratio", "sample_id", "n_tok", "compressed", "em", "f1"]
    rows = inf.select(*cols, F.lit("adaptive").alias("method")).unionByName(
        score(candidates(infer_samples, [0.25], _METHODS, corpus=s)).select(*cols, F.col("style").alias("method")))
    rows = rows.withColumn("achieved", actual_ratio(n_tokens(ws_tokens("compressed")), "n_tok"))
    return method_detail(rows, ["em", "f1"], demos.select("task", "ratio", F.lit("adaptive").alias("method")))
