"""Grid expansion and candidate generation.

The grid (ratios x methods) is a literal array; a sample's candidates are one array computed from it, exploded
last. Tokens of the original are computed once per sample; no grid row is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abridge.functions.tokens import n_tokens, once, rouge_tokens, target_tokens, ws_tokens
from abridge.functions.metrics import token_ids
from abridge.operators.catalog import BASELINE_RULE, STYLE_NAMES, STYLE_RULE
from abridge.operators.compress import compress_by, with_parts, with_scores


def rule_of(method: str) -> str:
    if method in STYLE_RULE:
        return STYLE_RULE[method]
    if method in BASELINE_RULE:
        return BASELINE_RULE[method]
    if method in STYLE_NAMES or method == "icl":
        return "prefix"          # model-only style / few-shot try without a response: prefix fallback
    raise ValueError(f"unknown style or method {method!r}")


def with_tokens(samples: DataFrame) -> DataFrame:
    """Whitespace tokens of the prompt and ROUGE tokens of the scoring reference.

    Computed once per sample, before the grid explode multiplies rows.
    """
    t = F.col("task")
    ref = (F.when(t == "reconstruction", F.col("prompt"))
            .when(t == "summarization", F.col("reference")))
    return (once(samples, tok=ws_tokens("prompt")).withColumn("n_tok", n_tokens("tok"))
            .withColumn("ref_rt", rouge_tokens(ref))
            .withColumn("ref_ids", token_ids("ref_rt")))


def add_targets(df: DataFrame) -> DataFrame:
    """``target_tokens`` of each row's ratio."""
    return df.withColumn("target", target_tokens("n_tok", "ratio"))


def grid_array(ratios, methods, floor0_methods=()) -> F.Column:
    """``grid_cross``: ratio x method as a literal array (ratio, style, rule, min_one)."""
    return F.array(*[F.struct(F.lit(float(r)).alias("ratio"), F.lit(m).alias("style"), F.lit(rule_of(m)).alias("rule"),
                              F.lit(m not in floor0_methods).alias("min_one"))
                     for r in ratios for m in methods])


def cells(ratios, methods, floor0_methods=()) -> list[tuple[float, str, bool, list[str]]]:
    """The distinct (ratio, rule, min_one) of the grid, each with its methods: one text serves all methods of a cell."""
    out: dict = {}
    for r in ratios:
        for m in methods:
            out.setdefault((float(r), rule_of(m), m not in floor0_methods), []).append(m)
    return [(*cell, styles) for cell, styles in out.items()]


def cell_array(ratios, methods, floor0_methods=()) -> F.Column:
    """:func:`cells` as a literal array (ratio, rule, min_one, styles)."""
    return F.array(*[F.struct(F.lit(r).alias("ratio"), F.lit(rule).alias("rule"), F.lit(min_one).alias("min_one"),
                              F.array(*[F.lit(m) for m in styles]).alias("styles"))
                     for r, rule, min_one, styles in cells(ratios, methods, floor0_methods)])


def _budget(ratio: F.Column, min_one: F.Column) -> F.Column:
    return F.when(min_one, target_tokens("n_tok", ratio, True)).otherwise(target_tokens("n_tok", ratio, False))


def budget_arrays(samples: DataFrame, ratios, methods, floor0_methods=("selective-context",)) -> DataFrame:
    """:func:`candidate_arrays` without the texts: what the requests of a sample need."""
    cell = lambda g: F.struct(g["ratio"].alias("ratio"), g["styles"].alias("styles"), g["rule"].alias("rule"),
                              _budget(g["ratio"], g["min_one"]).alias("target"))
    return with_tokens(samples).withColumn("grid", F.transform(cell_array(ratios, methods, floor0_methods), cell))


def candidate_arrays(samples: DataFrame, ratios, methods, seed: int = 42,
                     floor0_methods=("selective-context",), corpus: DataFrame | None = None) -> DataFrame:
    """One row a sample: its columns, tokens, and ``grid``, the array of all its candidates.

    Methods that share a rule and a budget share an entry, which names them in ``styles``. No grid row is shuffled: what a rule needs is joined to the sample before. ``corpus``: samples whose document
    frequencies drive the extractive rule (default: ``samples`` themselves).
    """
    rules = {rule_of(m) for m in methods}
    df = with_parts(with_tokens(with_scores(samples, rules, corpus)), rules)

    def make(g: F.Column) -> F.Column:
        t = _budget(g["ratio"], g["min_one"])
        return F.struct(g["ratio"].alias("ratio"), g["styles"].alias("styles"), g["rule"].alias("rule"), t.alias("target"),
                        compress_by(g["rule"], t, g["ratio"], rules, seed).alias("compressed"))

    return once(df, grid=F.transform(cell_array(ratios, methods, floor0_methods), make)).drop("parts")


def candidates(samples: DataFrame, ratios, methods, seed: int = 42,
               floor0_methods=("selective-context",), corpus: DataFrame | None = None) -> DataFrame:
    """Rule candidates for the whole grid: one row per (task, sample_id, ratio, style)."""
    rules = {rule_of(m) for m in methods}
    df = with_parts(with_tokens(with_scores(samples, rules, corpus)), rules)
    df = df.withColumn("g", F.explode(grid_array(ratios, methods, floor0_methods))).select("*", "g.*").drop("g")
    df = df.withColumn("target", _budget(F.col("ratio"), F.col("min_one"))).drop("min_one")
    return df.withColumn("compressed", compress_by(F.col("rule"), F.col("target"), F.col("ratio"), rules, seed)).drop("parts")
