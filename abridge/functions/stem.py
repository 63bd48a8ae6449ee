"""Porter stemming of distinct tokens.

Scores are made on stems: a token of more than three characters is replaced by its stem. The suffix machine runs once per
distinct token of a worker, which remembers it; a text's tokens are swapped in its own row, and no row is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Porter's suffix rules with the usual extensions (suffix, replacement), by step; a suffix of
# step 2 and 3 needs a measure of at least 1 before it, of step 4 one of at least 2.
STEP_1A = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
          ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
          ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
          ("logi", "log")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = [("al", ""), ("ance", ""), ("ence", ""), ("er", ""), ("ic", ""), ("able", ""), ("ible", ""), ("ant", ""), ("ement", ""), ("ment", ""),
          ("ent", ""), ("ion", ""), ("ou", ""), ("ism", ""), ("ate", ""), ("iti", ""), ("ous", ""), ("ive", ""), ("ize", "")]
IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning",
             "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
             "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
LEAST_CHARS = 4  # shorter tokens are not stemmed


def shape(word: str) -> str:
    """``c`` or ``v`` for each character; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def measure(s: str) -> int:
    """How often a vowel is followed by a consonant."""
    return s.count("vc")


def short_end(word: str, s: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y at the end; or a word of a vowel and a consonant."""
    return (s[-3:] == "cvc" and word[-1] not in "wxy") or s == "vc"


def _swap(word: str, rules: list[tuple[str, str]], least: int) -> str:
    """The longest suffix of ``rules`` that the word has is replaced, if the measure before it is ``least``."""
    fits = [(old, new) for old, new in rules if word.endswith(old)]
    if not fits:
        return word
    old, new = max(fits, key=lambda r: len(r[0]))
    head = word[:-len(old)]
    if old == "logi":  # its l counts as a part of the stem
        return head + new if measure(shape(word[:-3])) >= least else word
    if old == "ion" and head[-1:] not in ("s", "t"):
        return word
    return head + new if measure(shape(head)) >= least else word


def _step_1(word: str) -> str:
    word = word[:-1] if word.endswith("ies") and len(word) == 4 else _swap(word, STEP_1A, 0)
    if word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        word = word[:-1] if measure(shape(word[:-3])) > 0 else word
    else:
        end = next((e for e in ("ed", "ing") if word.endswith(e) and "v" in shape(word[:-len(e)])), None)
        if end:
            word = word[:-len(end)]
            s = shape(word)
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word[-1:] == word[-2:-1] and s[-1] == "c":
                word = word[:-1] if word[-1] not in "lsz" else word
            elif measure(s) == 1 and short_end(word, s):
                word += "e"
    if word.endswith("y") and len(word) > 2 and shape(word)[-2] == "c":
        word = word[:-1] + "i"
    return word


def stem(word: str) -> str:
    """The stem of a lower-case token; tokens of up to three characters stay."""
    if len(word) < LEAST_CHARS:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = _step_1(word)
    if word.endswith("alli") and measure(shape(word[:-4])) > 0:
        word = word[:-2]  # what is left may have another suffix of this step
    word = _swap(word, STEP_2, 1)
    word = _swap(word, STEP_3, 1)
    word = _swap(word, STEP_4, 2)
    if word.endswith("e"):
        head, s = word[:-1], shape(word[:-1])
        word = head if measure(s) > 1 or (measure(s) == 1 and not short_end(head, s)) else word
    if word.endswith("ll") and measure(shape(word[:-1])) > 1:
        word = word[:-1]
    return word


def stem_dictionary(tokens: DataFrame) -> DataFrame:
    """(token, stem) of the distinct values of ``token`` whose stem differs; the machine sees each once."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame({"token": b["token"], "stem": [stem(t) for t in b["token"]]})
            yield out[out["token"] != out["stem"]]
    known = tokens.where(F.length("token") >= LEAST_CHARS).select("token").distinct()
    return known.mapInPandas(run, "token string, stem string")


KEPT = 1_000_000  # stems that a worker remembers
_KNOWN: dict[str, str] = {}


def stems(tokens: list[str]) -> list[str]:
    """The stem of each token; the machine runs once a distinct token of a worker."""
    if len(_KNOWN) > KEPT:
        _KNOWN.clear()
    for t in tokens:
        if t not in _KNOWN:
            _KNOWN[t] = stem(t)
    return [_KNOWN[t] for t in tokens]


@F.arrow_udf(T.ArrayType(T.StringType()))
def stemmed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The tokens of a text, each replaced by its stem; a batch's distinct tokens are looked up once."""
    for b in batches:
        words = b.flatten().dictionary_encode()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(b).fill_null(0).to_numpy())])
        values = pa.array(stems(words.dictionary.to_pylist()), pa.string()).take(words.indices)
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=b.is_null())


def with_stem_ids(df: DataFrame, keys: list[str], tokens: dict[str, Column]) -> DataFrame:
    """``keys`` and, for each token column, the array of its stems' ids (xxhash64). ``keys`` need not name a row."""
    stems = df.select(*keys, *[stemmed(t).alias(c) for c, t in tokens.items()])
    return stems.select(*keys, *[F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in tokens])
