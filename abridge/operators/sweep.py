"""Result cubes: scored grids, long results, pivots, series and text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abridge.operators.candidates import candidate_arrays
from abridge.operators.catalog import TASK_METRICS
from abridge.operators.scoring import score_arrays

METRIC_COLS = ["rouge1", "rouge2", "rougeL", "bertscore", "em", "f1"]


def scored_grid(samples: DataFrame, ratios, methods, seed: int = 42, corpus: DataFrame | None = None,
                rouge_asked: bool = True) -> DataFrame:
    """Candidates for every (sample, ratio, method) with all task metrics; ``rouge_asked``: see :func:`score_arrays`."""
    return score_arrays(candidate_arrays(samples, ratios, methods, seed=seed, corpus=corpus), rouge_asked)


def to_long(scored: DataFrame, keys=("ratio", "task", "style")) -> DataFrame:
    """One row per (keys, metric) with the metric set of the row's task."""
    t = F.col("task")
    entries = []
    for m in METRIC_COLS:
        tasks = [k for k, ms in TASK_METRICS.items() if m in ms]
        entries.append(F.when(t.isin(*tasks), F.struct(F.lit(m).alias("metric"),
                                                         F.col(m).cast("double").alias("value"))))
    arr = F.filter(F.array(*entries), lambda x: x.isNotNull())
    return scored.select(*keys, F.explode(arr).alias("mv")).select(*keys, "mv.metric", "mv.value")


def avg_metrics_all(long: DataFrame, keys=("ratio", "task", "style")) -> DataFrame:
    """``avg_metrics_all``: sum of values (a failed evaluation counts 0) / number of rows."""
    return (long.groupBy(*keys, "metric")
            .agg((F.sum(F.coalesce(F.col("value"), F.lit(0.0))) / F.count(F.lit(1))).alias("value")))


def means_first(scored: DataFrame, keys=("ratio", "task", "style")) -> DataFrame:
    """``scored`` with one row per key, its metrics being those of :func:`avg_metrics_all`: rows are summed before any is made long."""
    return scored.groupBy(*keys).agg(*[(F.sum(F.coalesce(F.col(m), F.lit(0.0))) / F.count(F.lit(1))).alias(m) for m in METRIC_COLS])


def avg_metrics(scored: DataFrame, keys=("ratio", "task", "style"), metrics=METRIC_COLS) -> DataFrame:
    """``avg_metrics``: mean of each metric (NULLs ignored) per key."""
    return scored.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics],
                                     F.count(F.lit(1)).alias("n"))


def pivot_long(results_long: DataFrame, tasks=None) -> DataFrame:
    """``pivot_long``: rows (ratio, style), columns ``<task>_<metric>`` (mean)."""
    tasks = tasks or list(TASK_METRICS)
    values = [f"{t}_{m}" for t in tasks for m in TASK_METRICS[t]]
    return (results_long.withColumn("task_metric", F.concat_ws("_", "task", "metric"))
            .groupBy("ratio", "style").pivot("task_metric", values).agg(F.avg("value")))


def ratio_col(r: float) -> str:
    return "ratio_" + str(r).replace(".", "_")


def primary_series(results_long: DataFrame, ratios, primary=None) -> DataFrame:
    """``primary_series``: one primary metric per task, value per (task, style) x ratio, 0 if missing."""
    primary = primary or {"reconstruction": "rougeL", "summarization": "rougeL", "qa": "f1",
                          "reasoning": "em"}
    sel = F.create_map(*[x for k, v in primary.items() for x in (F.lit(k), F.lit(v))])
    p = (results_long.where(F.col("metric") == F.element_at(sel, F.col("task")))
         .groupBy("task", "style").pivot("ratio", [float(r) for r in ratios]).agg(F.avg("value")))
    for r in ratios:
        p = p.withColumnRenamed(str(float(r)), ratio_col(r))
    return p.select("task", "style", *[F.coalesce(F.col(ratio_col(r)), F.lit(0.0)).alias(ratio_col(r))
                                       for r in ratios])
