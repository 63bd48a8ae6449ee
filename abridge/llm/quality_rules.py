"""Quality rules: a threshold table compiled into one projection of native expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abridge.llm.common import text_of

SYMBOLS = "#*$%&|<>"
SPACE = r"[\x20\x09-\x0D]"  # what words do not hold

# Frequent function words of the corpus languages (fixed values).
STOP_WORDS = (
    "the of and to in is it that was for on with as from by this an be are at "
    "le la les des et un une en du que qui dans elle il est pour sur au ne pas "
    "der die das und ist von zu den mit sich nicht ein eine auf im dem "
    "el los las y de que en una por con para no se su es lo del al"
).split()
STOP_FORMS = sorted({form for x in STOP_WORDS for form in (x, x.capitalize())})


@dataclass(frozen=True)
class Rule:
    """A document fails if ``metric`` is outside [least, most]; it applies from ``min_words`` on."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None
    min_words: int = 0


# Production thresholds. Integer arithmetic keeps the base rules exact: ratios are in percent.
BASE_RULES = (
    Rule("too_short", "n_words", least=10),
    Rule("repeated_windows", "repeat_excess", most=0),
)
RULES = (
    Rule("symbol_ratio", "symbol_ratio", most=0.10),
    Rule("mean_word_length", "mean_word_length", least=2.0, most=20.0),
    Rule("stop_word_ratio", "stop_word_ratio", least=0.01, min_words=50),
    Rule("duplicate_lines", "dup_line_ratio", most=0.30),
    Rule("exclaim_ratio", "exclaim_ratio", most=0.5),
)



def _metrics() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "n_words": F.col("n_words"),
        "repeat_excess": 100 * F.col("n_repeat_words") - 20 * F.col("n_words"),
        "symbol_ratio": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "mean_word_length": F.col("word_chars") / n,
        "stop_word_ratio": F.col("n_stop_words") / n,
        # Two repeats are let pass, so that a text of a few lines is not judged by one of them.
        "dup_line_ratio": F.greatest(F.col("n_dup_lines") - 2, F.lit(0)) / F.greatest(F.col("n_lines"), F.lit(1)),
        "exclaim_ratio": F.col("n_exclaims") / n,
    }


def failed(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression: does the row break any of ``rules``?"""
    m = _metrics()
    tests = []
    for r in rules:
        x = m[r.metric]
        out = [x < F.lit(r.least)] if r.least is not None else []
        out += [x > F.lit(r.most)] if r.most is not None else []
        tests.append((F.col("n_words") >= F.lit(r.min_words)) & reduce(Column.__or__, out))
    return reduce(Column.__or__, tests)


def _with_window_hashes(df: DataFrame, w: int) -> DataFrame:
    """Add ``_h``, the hashes of all ``w``-word windows, from ``_ids``, the words' hashes.

    Hashes of m words and of the m words after them make those of 2m words, so a few passes suffice. Each
    step is a projection of its own because a lambda would evaluate an inlined array for every element.
    """
    pair = lambda a, b, shift: F.zip_with(
        a, F.slice(b, F.lit(shift + 1), F.greatest(F.size(b), F.lit(1))), lambda x, y: F.xxhash64(x, y))
    m, df = 1, df.withColumn("_h", F.col("_ids"))
    for digit in bin(w)[3:]:
        df, m = df.withColumn("_h", pair(F.col("_h"), F.col("_h"), m)), 2 * m
        if digit == "1":
            df, m = df.withColumn("_h", pair(F.col("_h"), F.col("_ids"), m)), m + 1
    n = F.size("_ids")
    return df.withColumn("_h", F.when(n > w, F.slice("_h", F.lit(1), n - (w - 1))).otherwise(F.array().cast("array<long>")))


def _repeat_words(w: int) -> Column:
    """Words covered by ``w``-word windows that occur twice or more.

    ``_sorted`` holds (hash, start) of each window in hash order, so equal windows are neighbours; starts of windows with
    an equal neighbour are put in order and their spans united.
    """
    s = F.col("_sorted")
    same = lambda x, i: F.coalesce(x["h"] == F.get(s, i)["h"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-w).alias("last"))
    return F.aggregate(starts, zero, lambda acc, p: F.struct(
        (acc["n"] + F.least(F.lit(w), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"])


def quality_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES,
                  base_rules: tuple[Rule, ...] = BASE_RULES, window: int = 5) -> DataFrame:
    """All columns of ``docs`` plus the counts and the verdict; no shuffle, no user function.

    Null or empty text: all counts 0, ``base_failed`` true (too short), ``kept`` false.
    Rows are judged one by one, so repeated rows get equal verdicts; an empty table gives an
    empty table. Input columns named like an output column are replaced by it.
    ``window`` words make a repeated window; windows are compared by 64-bit hashes within
    one document.
    """
    clash = ["word_chars", "n_words", "n_symbols", "n_dup_lines", "n_lines", "n_stop_words", "n_exclaims",
             "n_repeat_words", "base_failed", "kept"]
    out = docs.drop(*[c for c in clash if c != text_col])
    text = text_of(text_col)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    size = lambda c: F.size(c).cast("long")
    without = lambda chars: reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), chars, text)
    out = out.withColumns({"_words": F.array_remove(F.split(text, SPACE, -1), ""), "_lines": lines})
    words = F.col("_words")
    out = out.withColumns({
        "n_words": size(words),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(without(SYMBOLS))).cast("long"),
        "n_lines": size("_lines"),
        "n_dup_lines": size("_lines") - size(F.array_distinct("_lines")),
        "n_stop_words": size(F.filter(words, lambda x: x.isin(STOP_FORMS))),
        "n_exclaims": (F.length(text) - F.length(without("!"))).cast("long"),
        "_ids": F.transform(words, lambda x: F.xxhash64(x)),
    })
    out = _with_window_hashes(out, window)
    # Most texts repeat no window; only the others are sorted.
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    out = out.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_h", lambda x, i: F.struct(
        x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    out = out.withColumn("n_repeat_words", _repeat_words(window).cast("long"))
    out = out.withColumn("base_failed", failed(base_rules))
    return out.withColumn("kept", ~F.col("base_failed") & ~failed(rules)).drop(
        "_words", "_lines", "_ids", "_h", "_sorted")
