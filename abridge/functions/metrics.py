"""Scoring columns: ROUGE-1/2/L, exact match, set token F1.

ROUGE counts are row-local. Tokens are hashed JVM-side to 64-bit ids
(``xxhash64``) so the one Arrow UDF below moves fixed-width ints, not strings.
A 64-bit id collision between two different tokens of one pair is the only
way the counts can differ from exact string counts (odds ~ V^2 / 2^65).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abridge.functions.tokens import _c

# Fixed value: the whitespace set stripped by ``strip_ws`` (Python's ASCII set).
WS_CHARS = " \t\n\r\f\x0b"

OVERLAP_SCHEMA = T.StructType([
    T.StructField("hit1", T.LongType()),
    T.StructField("hit2", T.LongType()),
    T.StructField("lcs", T.LongType()),
])

NO_OVERLAP = {"hit1": 0, "hit2": 0, "lcs": 0}


def token_ids(tokens) -> Column:
    """array<string> -> array<bigint> of xxhash64 ids."""
    return F.transform(_c(tokens), lambda t: F.xxhash64(t))


def _bigram_ids(a: np.ndarray) -> np.ndarray:
    if len(a) < 2:
        return a[:0]
    # A pair of ids as one scrambled 64-bit id.
    x, y = a[:-1].astype(np.uint64), a[1:].astype(np.uint64)
    h = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + y
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def lcs_length(a, b, masks: dict | None = None) -> int:
    """LCS length by the bit-parallel row recurrence (rows packed in one int).

    ``V' = (V + (V & M[y])) | (V - (V & M[y]))``; the LCS is the number of
    zero bits of V within ``len(a)`` bits.
    """
    m = len(a)
    if m == 0 or len(b) == 0:
        return 0
    if masks is None:
        masks = _match_masks(a)
    full = (1 << m) - 1
    v = full
    get = masks.get
    for i, y in enumerate(b.tolist() if isinstance(b, np.ndarray) else b):
        pm = get(y)
        if pm is None:
            continue
        u = v & pm
        v = (v + u) | (v - u)  # a carry beyond the m bits changes none below
        if not i & 63:
            v &= full
    return m - (v & full).bit_count()


def pair_lcs(a: np.ndarray, b: np.ndarray) -> int:
    """:func:`lcs_length` of one pair: ids that only one side has, and equal ends, are left out before; steps follow the shorter."""
    a, b = a[np.isin(a, b)], b[np.isin(b, a)]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[len(a) - n:][::-1] != b[len(b) - n:][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    return head + tail + (lcs_length(a, b) if len(a) > len(b) else lcs_length(b, a))


def _match_masks(a) -> dict:
    masks: dict = {}
    for i, x in enumerate(a.tolist() if isinstance(a, np.ndarray) else a):
        masks[x] = masks.get(x, 0) | (1 << i)
    return masks


def is_subsequence(ref: list, cand: list) -> bool:
    """Whether ``cand`` is ``ref`` with entries left out."""
    rest = iter(ref)
    return all(x in rest for x in cand)


def _clipped(ref: np.ndarray, cand: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Clipped hits of ``n`` candidates, whose ids lie one after the other with their candidate's number in ``owner``."""
    known, most = np.unique(ref, return_counts=True)
    at = np.minimum(np.searchsorted(known, cand), len(known) - 1)
    same = known[at] == cand
    key, found = np.unique(owner[same] * len(known) + at[same], return_counts=True)
    return np.bincount(key // len(known), np.minimum(found, most[key % len(known)]), n).astype(np.int64)


def _overlap_arrays(ref, cands, subsequence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Clipped unigram hits, bigram hits and LCS of each candidate against one reference.

    All candidates' ids are counted in one pass; only an LCS that is not known runs by itself. A candidate that is a
    subsequence (``subsequence`` says so, or one linear pass finds it) is its own LCS, and equal candidates share one.
    """
    n = len(cands)
    a = np.asarray(ref, dtype=np.int64)
    ids = [np.zeros(0, np.int64) if c is None else np.asarray(c, dtype=np.int64) for c in cands]
    size = np.array([len(x) for x in ids], np.int64)
    hit1, hit2, lcs = (np.zeros(n, np.int64) for _ in range(3))
    if not len(a) or not size.any():
        return hit1, hit2, lcs
    flat, owner = np.concatenate(ids), np.repeat(np.arange(n), size)
    hit1 = _clipped(a, flat, owner, n)
    if len(a) > 1 and len(flat) > 1:
        whole = owner[:-1] == owner[1:]  # a pair does not reach over two candidates
        hit2 = _clipped(_bigram_ids(a), _bigram_ids(flat)[whole], owner[:-1][whole], n)
    words, masks, known_lcs = a.tolist(), None, {}
    for i in range(n):
        if subsequence[i]:
            lcs[i] = size[i]
        elif hit1[i]:
            same = ids[i].tobytes()
            if same not in known_lcs:
                if hit1[i] == size[i] and is_subsequence(words, ids[i].tolist()):
                    known_lcs[same] = size[i]
                elif n == 1:
                    known_lcs[same] = pair_lcs(a, ids[i])
                else:
                    masks = masks if masks is not None else _match_masks(a)
                    known_lcs[same] = lcs_length(a, ids[i], masks)
            lcs[i] = known_lcs[same]
    return hit1, hit2, lcs


def _overlaps(ref, cands, subsequence) -> list[dict]:
    """:func:`_overlap_arrays`, one record a candidate."""
    return [dict(zip(OVERLAP_SCHEMA.names, map(int, x))) for x in zip(*_overlap_arrays(ref, cands, subsequence))]


@F.pandas_udf(T.StructType([T.StructField(f.name, T.ArrayType(T.LongType())) for f in OVERLAP_SCHEMA]))
def overlaps(ref: pd.Series, cands: pd.Series, subsequence: pd.Series) -> pd.DataFrame:
    """:func:`_overlap_arrays` for each sample, as an array a measure; null without a reference."""
    return pd.DataFrame([(None, None, None) if r is None else _overlap_arrays(r, c, s) for r, c, s in zip(ref, cands, subsequence)],
                        columns=OVERLAP_SCHEMA.names)


@F.pandas_udf(OVERLAP_SCHEMA)
def pair_overlap(ref: pd.Series, cand: pd.Series) -> pd.DataFrame:
    """Clipped unigram hits, clipped bigram hits and LCS of two id arrays."""
    return pd.DataFrame([NO_OVERLAP if a is None else _overlaps(a, [b], [False])[0] for a, b in zip(ref, cand)], columns=OVERLAP_SCHEMA.names)


@F.pandas_udf(OVERLAP_SCHEMA)
def prefix_overlap(ref: pd.Series, cand: pd.Series) -> pd.DataFrame:
    """:func:`pair_overlap` of a candidate that is a subsequence of its reference: no LCS runs."""
    return pd.DataFrame([NO_OVERLAP if a is None else _overlaps(a, [b], [True])[0] for a, b in zip(ref, cand)], columns=OVERLAP_SCHEMA.names)


@F.pandas_udf(OVERLAP_SCHEMA)
def pair_hits(ref: pd.Series, cand: pd.Series) -> pd.DataFrame:
    """:func:`pair_overlap` where no LCS is asked for; it is null."""
    return pd.DataFrame([{**(NO_OVERLAP if a is None else _overlaps(a, [b], [True])[0]), "lcs": None} for a, b in zip(ref, cand)],
                        columns=OVERLAP_SCHEMA.names).astype("Int64")


def f_measure(hits, n_ref, n_cand) -> Column:
    """ROUGE F = 2PR/(P+R) = 2h/(n_ref+n_cand); 0 when there is no hit."""
    h = _c(hits).cast("double")
    return F.when(h > 0, 2.0 * h / (_c(n_ref) + _c(n_cand)).cast("double")).otherwise(F.lit(0.0))


def rouge_columns(ref_tokens, cand_tokens, prefix: str = "", ref_ids=None, n_ref=None, subsequence: bool = False) -> list[Column]:
    """Columns hit1, hit2, lcs, n_ref, n_cand, rouge1, rouge2, rougeL, bertscore.

    ``bertscore`` is the ROUGE-L value (decision Q4). ``ref_ids``/``n_ref``
    may be passed precomputed (once per sample instead of per candidate).
    ``subsequence``: the candidates are subsequences of their references.
    """
    ov = (prefix_overlap if subsequence else pair_overlap)(ref_ids if ref_ids is not None else token_ids(ref_tokens), token_ids(cand_tokens))
    nr = n_ref if n_ref is not None else F.size(_c(ref_tokens)).cast("bigint")
    nc = F.size(_c(cand_tokens)).cast("bigint")
    nr2 = F.greatest(nr - 1, F.lit(0).cast("bigint"))
    nc2 = F.greatest(nc - 1, F.lit(0).cast("bigint"))
    return [ov.alias(prefix + "ov"), nr.alias(prefix + "n_ref"), nc.alias(prefix + "n_cand"),
            nr2.alias(prefix + "n_ref2"), nc2.alias(prefix + "n_cand2")]


def rouge_id_columns(ref_ids, cand_ids, lcs: bool = True) -> list[Column]:
    """The columns of :func:`rouge_columns` for token ids that are made already (stems, for example); ``lcs``: whether it is asked for."""
    nr, nc = (F.size(_c(x)).cast("bigint") for x in (ref_ids, cand_ids))
    zero = F.lit(0).cast("bigint")
    return [(pair_overlap if lcs else pair_hits)(_c(ref_ids), _c(cand_ids)).alias("ov"), nr.alias("n_ref"), nc.alias("n_cand"),
            F.greatest(nr - 1, zero).alias("n_ref2"), F.greatest(nc - 1, zero).alias("n_cand2")]


def finish_rouge(df, prefix: str = ""):
    """Turn the struct from :func:`rouge_columns` into metric columns."""
    p = prefix
    return (df.withColumn(p + "hit1", F.col(p + "ov.hit1"))
              .withColumn(p + "hit2", F.col(p + "ov.hit2"))
              .withColumn(p + "lcs", F.col(p + "ov.lcs"))
              .drop(p + "ov")
              .withColumn(p + "rouge1", f_measure(p + "hit1", p + "n_ref", p + "n_cand"))
              .withColumn(p + "rouge2", f_measure(p + "hit2", p + "n_ref2", p + "n_cand2"))
              .withColumn(p + "rougeL", f_measure(p + "lcs", p + "n_ref", p + "n_cand"))
              .withColumn(p + "bertscore", F.col(p + "rougeL")))


def exact_match(gold, pred) -> Column:
    """1.0 when lower(trim(gold)) == lower(trim(pred)) else 0.0 (whitespace trim)."""
    return (F.lower(strip_ws(gold)) == F.lower(strip_ws(pred))).cast("double")


def strip_ws(x) -> Column:
    """Python ``str.strip()`` for the ASCII whitespace set."""
    return F.trim(_c(x), F.lit(WS_CHARS))


def set_tokens(x) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(x)), F.lit(r"\S+"), 0))


def token_f1(gold, pred) -> Column:
    """Set-based token F1: both empty -> 1, one empty or no overlap -> 0."""
    return set_f1(set_tokens(gold), set_tokens(pred))


def set_f1(g, p, common=None) -> Column:
    """:func:`token_f1` of token sets that are made already; ``common``: the size of their intersection, if known."""
    g, p = _c(g), _c(p)
    ng, np_ = F.size(g).cast("double"), F.size(p).cast("double")
    common = (F.size(F.array_intersect(g, p)) if common is None else _c(common)).cast("double")
    prec, rec = common / np_, common / ng
    return (F.when((ng == 0) & (np_ == 0), F.lit(1.0))
             .when((ng == 0) | (np_ == 0) | (common == 0), F.lit(0.0))
             .otherwise(2.0 * prec * rec / (prec + rec)))
