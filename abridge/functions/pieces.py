"""Token counts and cuts by a byte-level BPE tokenizer file.

A text is cut into pre-tokens by a regular expression in the JVM. Their merges do not depend on the text around them, so a
task merges each distinct pre-token once, by the tokenizer file; only those of several pieces come back, in the text's own
row, and no row is shuffled. Budgets and cuts then are one running sum over a text's pre-tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abridge.functions.tokens import once

KEPT = 200_000  # merged pre-tokens that a task remembers
SHORT = 64  # characters of those
AT_ONCE = 1 << 18  # pre-tokens that a task holds as Python values, those of one text at least

# Fixed value: the pre-token pattern of byte-level BPE (Unicode white space).
PRE_TOKEN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    """The path of the environment's byte-level tokenizer file."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def added_tokens(path: str) -> list[str]:
    """Strings that the file turns into a token of their own, before anything is merged."""
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def pre_tokens(text: Column, added: list[str]) -> Column:
    """The pre-tokens of a text; put together they are the text."""
    found = lambda t: F.regexp_extract_all(t, F.lit(PRE_TOKEN), 0)
    if not added:
        return found(text)
    names = "|".join(r"\Q" + a + r"\E" for a in added)
    parts = F.filter(F.split(text, f"(?={names})|(?<={names})"), lambda p: p != "")
    apart = F.flatten(F.transform(parts, lambda p: F.when(p.isin(added), F.array(p)).otherwise(found(p))))
    return F.when(text.rlike(names), apart).otherwise(found(text))


def _merged(tokenizer, tokens: list[str]) -> list[tuple[int, list[str]]]:
    """(n, heads) of each token; heads[i]: the text of its first i + 1 pieces, empty for a single piece."""
    return [(len(e.ids), [tokenizer.decode(e.ids[:i], skip_special_tokens=False) for i in range(1, len(e.ids))])
            for e in tokenizer.encode_batch(tokens, add_special_tokens=False)]


def piece_dictionary(tokens: DataFrame, path: str) -> DataFrame:
    """(token, n, heads) of the distinct values of ``token`` that are several pieces; heads[i]: the text of the first i + 1."""
    with open(path, encoding="utf-8") as f:
        model = f.read()  # the file itself need not be on the executors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_str(model)
        for b in batches:
            out = [(token, *m) for token, m in zip(b["token"], _merged(tokenizer, list(b["token"]))) if m[0] > 1]
            yield pd.DataFrame(out, columns=["token", "n", "heads"])

    # a single ASCII character is one piece by construction
    return tokens.where(F.octet_length("token") > 1).select("token").distinct().mapInPandas(run, "token string, n int, heads array<string>")


def _several(pre: pa.ListArray, merged) -> pa.Array:
    """For each row of ``pre``: those of its pre-tokens that are several pieces, as (at, n, heads) in order.

    Python sees the distinct pre-tokens of some rows at a time; ``merged``: their (n, heads). All else stays in Arrow's buffers.
    """
    kind = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("heads", pa.list_(pa.string()))])
    starts, parts, row = pre.offsets.to_numpy(), [], 0
    while row < len(pre):
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + AT_ONCE, "right")) - 1)
        first = starts[row:end + 1] - starts[row]
        found = pre.values.slice(starts[row], first[-1]).dictionary_encode()
        pieces = merged(found.dictionary.to_pylist())
        of, n = found.indices.to_numpy(), np.array([x[0] for x in pieces], np.int32)
        at = np.flatnonzero(n[of] > 1) if len(of) else np.zeros(0, np.int64)
        place = at - first[np.searchsorted(first, at, "right") - 1]
        heads = pa.array([x[1] for x in pieces], pa.list_(pa.string())).take(pa.array(of[at]))
        rows = pa.StructArray.from_arrays([pa.array(place.astype(np.int32)), pa.array(n[of[at]]), heads], fields=list(kind))
        parts.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(at, first).astype(np.int32)), rows))
        row = end
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(kind))


def several_pieces(path: str):
    """A column function: the pre-tokens of a text that are several pieces, as (at, n, heads) in order."""
    with open(path, encoding="utf-8") as f:
        model = f.read()  # the file itself need not be on the executors

    @F.arrow_udf("array<struct<at:int,n:int,heads:array<string>>>")
    def several(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tokenizers import Tokenizer
        tokenizer, known, single = Tokenizer.from_str(model), {}, (1, [])

        def merged(tokens: list[str]) -> list[tuple[int, list[str]]]:
            if len(known) > KEPT:
                known.clear()
            # a single ASCII character is one piece by construction
            new = [t for t in tokens if t not in known and (len(t) > 1 or not t.isascii())]
            made = dict(zip(new, _merged(tokenizer, new)))
            out = [known.get(t) or made.get(t, single) for t in tokens]
            known.update((t, m) for t, m in made.items() if len(t) <= SHORT)  # the heads of a long one are many times its size
            return out

        for pre in batches:
            yield _several(pre, merged)

    return several


def with_pieces(df: DataFrame, keys: list[str], text: str, path: str | None = None) -> DataFrame:
    """``df`` with ``pre`` (pre-tokens), ``multi`` (those of several pieces: at, n, heads, in order) and ``n_pieces``.

    Nothing is joined or shuffled, so ``keys`` need not name a row.
    """
    path = path or default_tokenizer()
    df = once(df, pre=pre_tokens(F.coalesce(F.col(text), F.lit("")), added_tokens(path)))
    df = once(df.withColumn("_multi", several_pieces(path)("pre")), multi=F.col("_multi")).drop("_multi")
    more = F.aggregate(F.transform("multi", lambda m: m["n"] - 1), F.lit(0), lambda s, x: s + x)
    return df.withColumn("n_pieces", (F.size("pre") + more).cast("bigint"))


def cut_pieces(target: Column) -> Column:
    """The text of the first ``target`` pieces of :func:`with_pieces`' row, spacing kept; all of it if it has no more.

    One pass over the pre-tokens of several pieces: where the budget ends before or inside one, the cut is known.
    """
    target = target.cast("int")
    state = F.struct(F.lit(0).alias("more"), F.lit(-1).alias("whole"), F.lit(0).alias("rest"), F.lit(None).cast("string").alias("head"))

    def step(s: Column, m: Column) -> Column:
        before = m["at"] + s["more"]  # pieces before this pre-token
        inside = F.struct(s["more"].alias("more"), m["at"].alias("whole"), (target - before).alias("rest"),
                          F.element_at(m["heads"], F.greatest(target - before, F.lit(1))).alias("head"))
        early = F.struct(s["more"].alias("more"), (target - s["more"]).alias("whole"), F.lit(0).alias("rest"), F.lit(None).cast("string").alias("head"))
        on = F.struct((s["more"] + m["n"] - 1).alias("more"), F.lit(-1).alias("whole"), F.lit(0).alias("rest"), F.lit(None).cast("string").alias("head"))
        return F.when(s["whole"] >= 0, s).when(before >= target, early).when(before + m["n"] > target, inside).otherwise(on)

    end = F.aggregate(F.coalesce("multi", F.array().cast("array<struct<at:int,n:int,heads:array<string>>>")), state, step)
    cut = F.transform(F.array(end), lambda e: F.concat(
        F.array_join(F.slice("pre", F.lit(1), F.when(e["whole"] >= 0, e["whole"]).otherwise(F.greatest(target - e["more"], F.lit(0)))), ""),
        F.when(e["rest"] > 0, e["head"]).otherwise("")))
    return F.when(F.col("n_pieces") <= target, F.array_join("pre", "")).otherwise(F.element_at(cut, 1))
