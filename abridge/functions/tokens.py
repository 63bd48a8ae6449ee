"""Token columns: counting, budgets, truncation (all JVM-side expressions).

Default tokenizer (decision Q1): a token is a maximal run of non-whitespace,
i.e. Python's ``str.split()`` on the supported inputs. ROUGE tokens follow
the ROUGE tokenizer: lower-case, maximal runs of ``[a-z0-9]``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokenizer patterns (same strings are used in the DuckDB oracle).
WS_TOKEN = r"\S+"
ROUGE_TOKEN = r"[a-z0-9]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` with ``cols`` made once a row: a generator holds them, so no later expression (a lambda, say) repeats their work."""
    held = df.withColumn("_once", F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
    return held.withColumns({n: F.col(f"_once.{n}") for n in cols}).drop("_once")


def ws_tokens(text) -> Column:
    """Whitespace tokens of ``text`` (array<string>)."""
    return F.regexp_extract_all(_c(text), F.lit(WS_TOKEN), 0)


def rouge_tokens(text) -> Column:
    """ROUGE tokens: ``[a-z0-9]+`` runs of the lower-cased text."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(ROUGE_TOKEN), 0)


def n_tokens(tokens) -> Column:
    return F.size(_c(tokens)).cast("bigint")


def count_tokens(text) -> Column:
    """``count_tokens``: number of whitespace tokens of a text."""
    return n_tokens(ws_tokens(text))


def target_tokens(n, ratio, min_one: bool = True) -> Column:
    """``target_tokens`` = max(1, int(n*ratio)); ``min_one=False`` is ``target_tokens_floor0``."""
    t = F.floor(_c(n).cast("double") * _c(ratio).cast("double")).cast("bigint")
    return F.greatest(F.lit(1).cast("bigint"), t) if min_one else t


def truncate_tokens(text, tokens, target) -> Column:
    """``truncate_tokens``: first ``target`` tokens joined by a space; text unchanged if short."""
    tok = _c(tokens)
    return (F.when(F.size(tok) <= _c(target), _c(text))
            .otherwise(F.array_join(F.slice(tok, F.lit(1), _c(target).cast("int")), " ")))


def actual_ratio(c_tokens, n_tokens_) -> Column:
    """Achieved ratio, 0 when the original is empty."""
    n = _c(n_tokens_)
    return F.when(n > 0, _c(c_tokens).cast("double") / n).otherwise(F.lit(0.0))


def cap_tokens(text, tokens, cap: int = 1000) -> Column:
    """``cap_tokens``: texts longer than ``cap`` tokens are cut to ``cap`` tokens."""
    return truncate_tokens(text, tokens, F.lit(cap))
