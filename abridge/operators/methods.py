"""Method sweep: model x ratio x compression method, with each method's own request, parser, budget and fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abridge.functions.text import parse_compression, parse_lingua, parse_vanilla
from abridge.operators.requests import answer_calls, request_text

# The compared methods in table order, and the request each sends (none: selective-context).
METHODS = ["selective-context", "LLM-Lingua", "vanilla", "adaptive"]
REQUEST_KIND = {"LLM-Lingua": "lingua", "vanilla": "vanilla", "adaptive": "style"}
PARSER = {"LLM-Lingua": parse_lingua, "vanilla": parse_vanilla, "adaptive": parse_compression}
# Metrics of the method table, grouped in this order.
PIVOT_METRICS = ["rouge1", "rouge2", "rougeL", "bertscore"]


def method_calls(df: DataFrame, models, style: str = "for_reconstruction") -> DataFrame:
    """``df``, a row a sample with ``budgets`` (array of ratio, target), with ``calls``: budget x model x method.

    ``request_id`` is null where no model is asked; a request is rendered once for all models.
    """
    asked = F.transform("budgets", lambda b: F.struct(b["ratio"].alias("ratio"), b["target"].alias("target"), *[
        F.md5(request_text(kind, b["target"], F.lit(style))).alias(kind) for kind in REQUEST_KIND.values()]))
    none = F.lit(None).cast("string")
    calls = F.transform(asked, lambda b: F.array(*[
        F.struct(b["ratio"].alias("ratio"), b["target"].alias("target"), F.lit(m).alias("model"), F.lit(x).alias("method"),
                 (b[REQUEST_KIND[x]] if x in REQUEST_KIND else none).alias("request_id")) for m in models for x in METHODS]))
    return df.withColumn("calls", F.flatten(calls))


def compress_with(calls: DataFrame, completions: DataFrame | None) -> DataFrame:
    """``comp_vanilla``, ``comp_lingua``, style: response -> own parser -> budget; the prefix where none came.

    ``calls``: :func:`method_calls`; ``completions``: (model, request_id, response), None where ``with_answers`` has brought them
    (by ``model|request_id``). Adds ``response``, ``compressed`` and
    ``source`` (rule / completion / fallback) to every call.
    """
    def parse(c: Column) -> Column:
        parsed = F.lit(None).cast("string")
        for method, parser in PARSER.items():
            parsed = F.when(c["method"] == method, parser(c["response"])).otherwise(parsed)
        return parsed

    return answer_calls(calls, completions, parse, ids=("model", "request_id"))


def pivot_method(results: DataFrame, ratios, keys=("model", "method")) -> DataFrame:
    """``pivot_method``: a row a method, columns metric x ratio (metrics grouped), for each model."""
    cells = [(m, r) for m in PIVOT_METRICS for r in ratios]
    return results.groupBy(*keys).agg(*[
        F.avg(F.when(F.col("ratio") == float(r), F.col(m))).alias(cell_name(m, r)) for m, r in cells])


def cell_name(metric: str, ratio: float) -> str:
    return f"{metric}_{str(ratio).replace('.', '_')}"
