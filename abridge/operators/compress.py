"""Rule compressors (text in, at most ``target`` whitespace tokens out).

A rule is an expression of the budget over one sample row (``prompt``, ``tok``
whitespace tokens, ``n_tok``), so a sample's whole grid of candidates is one array made in one
projection. What a rule takes from the sample whatever the budget (sentences, lines, abbreviations) is made
once a sample (``with_parts``). Only ``extractive`` needs corpus statistics (document frequency): the weights
of a sample's words are joined to it once, before the grid.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abridge.functions.metrics import WS_CHARS, token_ids
from abridge.functions.tokens import once, rouge_tokens, ws_tokens

# English stop words dropped by the abbreviation rule.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have",
    "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was",
    "were", "will", "with",
]

SENT_SEP = r"\. "   # regex for the literal sentence separator ". "


def _int(c: Column) -> Column:
    return c.cast("int")


def _join(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def rule_prefix(t: Column) -> Column:
    return _join(F.slice("tok", F.lit(1), _int(t)))


def rule_middle(t: Column) -> Column:
    return _join(F.slice("tok", _int(F.floor((F.col("n_tok") - t) / 2) + 1), _int(t)))


def rule_suffix(t: Column) -> Column:
    return _join(F.slice("tok", _int(F.col("n_tok") - t + 1), _int(t)))


def rule_stride(t: Column) -> Column:
    """Even stride: token ``i*n div t`` for i in 0..t-1."""
    return _join(F.transform(F.sequence(F.lit(0).cast("bigint"), t - 1),
                             lambda i: F.get(F.col("tok"), _int(F.floor(i * F.col("n_tok") / t)))))


def rule_window(t: Column, ratio: Column, seed: int) -> Column:
    """``comp_random_window``: contiguous window of ``target`` tokens at a seeded draw, md5 mod (n - t + 1)."""
    key = F.concat_ws("|", F.lit(str(seed)), F.col("task"), F.col("sample_id").cast("string"),
                      F.round(ratio * 1000).cast("bigint").cast("string"))
    draw = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
    start = F.pmod(draw, F.col("n_tok") - t + 1)
    return _join(F.slice("tok", _int(start + 1), _int(t)))


def fitting(sizes: Column, t: Column) -> Column:
    """How many leading entries fit: one ``aggregate`` pass over token counts, linear in sentences."""
    acc0 = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(0).alias("k"), F.lit(True).alias("ok"))
    return F.aggregate(
        sizes, acc0,
        lambda acc, c: F.when(acc["ok"] & (acc["s"] + c <= t),
                              F.struct((acc["s"] + c).alias("s"), (acc["k"] + 1).alias("k"), F.lit(True).alias("ok")))
                        .otherwise(F.struct(acc["s"].alias("s"), acc["k"].alias("k"), F.lit(False).alias("ok"))),
        lambda acc: acc["k"])


def _sentences_text(sents: Column, k: Column) -> Column:
    return F.trim(F.when(k > 0, F.concat(F.array_join(sents, ". "), F.lit(". "))).otherwise(F.lit("")), F.lit(WS_CHARS))


def rule_sentences(t: Column) -> Column:
    """``comp_sentences``: leading sentences while the running token total fits.

    Every kept sentence is followed by ". " and the result is stripped, so a
    text kept whole ends in ".." when it already ended with a dot (Q18).
    """
    k = fitting(F.col("parts.sizes"), t)
    return _sentences_text(F.slice("parts.sents", F.lit(1), k), k)


def rule_lines(t: Column) -> Column:
    """Format-aware: every line keeps its first ``floor(len*t/n)`` tokens; line breaks stay."""
    cut = lambda w: _join(F.slice(w, F.lit(1), _int(F.floor(F.size(w) * t / F.col("n_tok")))))
    lines = F.transform("parts.lines", cut)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def abbreviated(text, tok) -> Column:
    """Tokens without stop words and without inner vowels of longer words; ``tok``: the white-space tokens of ``text``."""
    # Inner vowels of all words go in one pass over the text; a word keeps its first and last character, so tokens stay in line.
    short = ws_tokens(F.regexp_replace(text, r"(?<=\S)[aeiouAEIOU](?=\S)", ""))
    return F.filter(F.zip_with(tok, short, lambda w, s: F.when(~F.lower(w).isin(STOP_WORDS), s)), lambda s: s.isNotNull())


def rule_abbrev(t: Column) -> Column:
    """Unreadable: drop stop words, drop inner vowels of longer words, keep ``target`` tokens."""
    return _join(F.slice("parts.abbr", F.lit(1), _int(t)))


def rule_extractive(t: Column) -> Column:
    """``comp_extractive``: best-ranked sentences while the budget lasts, original order."""
    k = fitting(F.transform("parts.ranked", lambda x: x["ntok"]), t)
    chosen = F.sort_array(F.transform(F.slice("parts.ranked", F.lit(1), k),
                                      lambda x: F.struct(x["pos"].alias("pos"), x["sent"].alias("sent"))))
    return _sentences_text(F.transform(chosen, lambda x: x["sent"]), k)


def compress_by(rule: Column, t: Column, ratio: Column, rules, seed: int = 42) -> Column:
    """The candidate text for ``rule`` and budget ``t`` of a sample row (prompt, tok, n_tok, task, sample_id, parts).

    A text that already fits its budget is kept whole, except by the sentence
    rules, which always re-join their sentences with ". ". ``rules``: the rules that can occur.
    """
    make = {"prefix": rule_prefix, "middle": rule_middle, "suffix": rule_suffix, "stride": rule_stride,
            "window": lambda t: rule_window(t, ratio, seed), "sentences": rule_sentences, "lines": rule_lines,
            "abbrev": rule_abbrev, "extractive": rule_extractive}
    out = F.when((F.col("n_tok") <= t) & ~rule.isin("sentences", "extractive"), F.col("prompt"))
    for name in sorted(set(rules)):
        out = out.when(rule == name, make[name](t))
    return out


def _distinct_ids() -> Column:
    return F.explode(F.array_distinct(token_ids(rouge_tokens("prompt")))).alias("token")


def token_frequencies(corpus: DataFrame) -> DataFrame:
    """``token, df``: in how many prompts a ROUGE token id occurs; a row with a ``weight`` counts as so many prompts."""
    if "weight" in corpus.columns:
        return corpus.select(_distinct_ids(), "weight").groupBy("token").agg(F.sum("weight").alias("df"))
    return corpus.select(_distinct_ids()).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def sample_keys(samples: DataFrame) -> list[str]:
    """Documents whose tasks share a row have no ``task``."""
    return [k for k in ("task", "sample_id") if k in samples.columns]


def word_weights(samples: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """Per sample key: ``words``, its distinct ROUGE token ids with ``ln df``, as far as the corpus has them.

    ``corpus``: prompts, or their :func:`token_frequencies`.
    Document frequency is a partial+final aggregate per token (hot tokens such as "the" are combined map-side). A sample
    asks for each of its tokens once, however often and in however many sentences they occur; of the token->df join a
    task holds its share of the vocabulary, the questions stream by. Ids (xxhash64) and numbers move, no token and no
    sentence does.
    """
    corpus = samples if corpus is None else corpus
    df_tok = corpus if "df" in corpus.columns else token_frequencies(corpus)
    keys = sample_keys(samples)
    found = samples.select(*keys, _distinct_ids()).join(df_tok.hint("shuffle_hash"), "token").select(*keys, "token", F.log(F.col("df").cast("double")).alias("ln_df"))
    # Dealt out by sample first: collecting before would hold nearly every sample in each task of the join.
    return found.repartition(*keys).groupBy(*keys).agg(F.collect_list(F.struct("token", "ln_df")).alias("words"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def sentence_means(ids: pd.Series, sizes: pd.Series, words: pd.Series, values: pd.Series) -> pd.Series:
    """Mean value of each sentence's token ids (``ids`` flat, ``sizes`` by sentence), null without one; ``words`` have ``values``."""
    def means(x, size, word, value):
        if x is None:
            return None
        owner, order = np.repeat(np.arange(len(size)), size), np.argsort(word)
        word, value = np.append(word[order], 0), value[order]
        at = np.searchsorted(word[:-1], x)
        known = (at < len(value)) & (word[at] == x)
        n = np.bincount(owner[known], minlength=len(size))
        total = np.bincount(owner[known], value[at[known]], len(size))
        return [t / k if k else None for t, k in zip(total.tolist(), n.tolist())]

    none = np.zeros(0, np.int64), np.zeros(0)
    return pd.Series([means(x, s, *(none if w is None else (w, v))) for x, s, w, v in zip(ids, sizes, words, values)], dtype=object)


def with_scores(samples: DataFrame, rules, corpus: DataFrame | None = None) -> DataFrame:
    """Add ``scores`` where a rule needs them, one number a sentence in text order; the lowest is the best sentence.

    score = mean(ln df(token)) over the sentence's ROUGE tokens, which ranks sentences exactly like mean idf = ln N -
    mean(ln df) without needing N; a sentence without tokens comes last. One join on the sample key, before any grid row exists.
    """
    if "extractive" not in rules or "scores" in samples.columns:
        return samples
    # By its plan's size alone the side of numbers looks small enough to be sent whole to every executor.
    df = samples.join(word_weights(samples, corpus).hint("merge"), sample_keys(samples), "left")
    df = once(df, _ids=F.transform(F.split("prompt", SENT_SEP), lambda s: token_ids(rouge_tokens(s))))
    means = sentence_means(F.flatten("_ids"), F.transform("_ids", F.size), F.col("words.token"), F.col("words.ln_df"))
    df = df.withColumn("scores", means).drop("_ids", "words")
    return df.withColumn("scores", F.transform("scores", lambda x: F.coalesce(F.round(x, 9), F.lit(1e9))))


def with_parts(df: DataFrame, rules) -> DataFrame:
    """Add ``parts``: what the rules take from a sample (``prompt``, ``tok``, ``scores``) whatever the budget.

    A generator holds it, so it is made once a sample and not again for each cell of the grid.
    """
    size = lambda s: F.size(ws_tokens(s)).cast("bigint")
    sents = F.split("prompt", SENT_SEP)
    need = {"abbrev": lambda: [abbreviated("prompt", "tok").alias("abbr")],
            "sentences": lambda: [sents.alias("sents"), F.transform(sents, size).alias("sizes")],
            "lines": lambda: [F.transform(F.split("prompt", "\n"), ws_tokens).alias("lines")],
            "extractive": lambda: [F.sort_array(F.transform(sents, lambda s, i: F.struct(
                F.get("scores", i).alias("score"), i.alias("pos"), size(s).alias("ntok"), s.alias("sent")))).alias("ranked")]}
    parts = [c for rule in sorted(set(rules) & set(need)) for c in need[rule]()]
    if parts:
        df = df.withColumn("parts", F.explode(F.array(F.struct(*parts))))
    return df.drop("scores")
