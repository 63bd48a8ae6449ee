"""ROUGE of a document's whole grid by the places of its tokens: no candidate's text is made or cut into tokens.

Every rule keeps white-space tokens or sentences of the prompt, so a candidate's ROUGE tokens are runs of the prompt's own
(the abbreviations': of the abbreviated tokens'). A prompt is cut into tokens once and a candidate is an array of places. The
rules say the same as the texts of ``compress.py``; a document is counted once for all tasks that score it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abridge.functions.metrics import _match_masks, finish_rouge
from abridge.operators.candidates import cell_array, cells, rule_of
from abridge.operators.compress import STOP_WORDS, with_scores
from abridge.operators.scoring import primary_score

PLACE_RULES = ("prefix", "middle", "suffix", "stride", "sentences", "lines", "abbrev", "extractive")
FLOOR0 = ("selective-context",)
MEASURES = ("hit1", "hit2", "lcs")

# A byte of a prompt is white space (as Java's \\s), part of a ROUGE token (its lower case), or else: SPACE, that letter, OTHER.
SPACE, OTHER = 32, 0
_LETTERS = bytes(SPACE if c in b" \t\n\x0b\f\r" else c | 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else OTHER for c in range(254)) + b"ki"
_APART = bytes(c or SPACE for c in range(256))
STOPS = [x.encode() for x in STOP_WORDS]
_VOWEL = np.isin(np.arange(256), list(b"aeiouAEIOU"))


def _letters(text: bytes) -> tuple[bytes, bytes]:
    """``text`` and its bytes as above. Of other letters only two have an ASCII lower case: the dotted capital I and the Kelvin sign."""
    if text.isascii():
        return text, text.translate(_LETTERS)
    text = text.replace(b"\xff", b"\xfd").replace(b"\xfe", b"\xfd").replace(b"\xc4\xb0", b"\xff\xcc\x87").replace(b"\xe2\x84\xaa", b"\xfe")
    return text, text.translate(_LETTERS)


def _first(kind: np.ndarray) -> np.ndarray:
    """Where a run of True begins."""
    first = kind.copy()
    first[1:] &= ~kind[:-1]
    return first


def _before(first: np.ndarray) -> np.ndarray:
    """How many are True before each place, and in all."""
    return np.concatenate([[0], np.cumsum(first)])


def _starts(sizes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]).astype(np.int64)


def _runs(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The places of all runs [first, end), one after the other."""
    n = end - first
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _fitting(sizes: np.ndarray, t: int) -> int:
    """How many leading entries fit."""
    return int(np.searchsorted(np.cumsum(sizes), t, "right"))


class Document:
    """A prompt's ROUGE tokens as ids from 0 on (``flat``), and for a rule and budget their places."""

    def __init__(self, prompt: bytes, scores, rules) -> None:
        self.ids: dict[bytes, int] = {}
        prompt, letters = _letters(prompt)
        raw, low = np.frombuffer(prompt, np.uint8), np.frombuffer(letters, np.uint8)
        self.flat = self.of(letters)
        space, part = low == SPACE, low > SPACE
        words, tokens = _first(~space), _first(part)
        n_tokens = _before(tokens)
        self.n_tok = int(words.sum())
        self.at = np.append(n_tokens[:-1][words], len(self.flat))
        if "abbrev" in rules:
            self._abbreviate(raw, low, space, words)
        if "lines" in rules:
            self.lines = np.diff(_before(words)[np.concatenate([[0], np.flatnonzero(raw == 10), [len(raw)]])])
        if "sentences" in rules or "extractive" in rules:
            ends = np.flatnonzero((raw[:-1] == 46) & (raw[1:] == 32))
            apart = space.copy()
            apart[ends] = True  # the dot of the separator is no word of its sentence
            ends = np.concatenate([[0], ends, [len(raw)]])
            self.sizes = np.diff(_before(_first(~apart))[ends])
            self.sent_at = n_tokens[ends]
        if "extractive" in rules:
            self.ranked = np.lexsort((np.arange(len(scores)), np.asarray(scores, float)))

    def of(self, letters: bytes) -> np.ndarray:
        """The ids of the ROUGE tokens of a text, by its bytes of :func:`_letters`."""
        ids = self.ids
        return np.array([ids.setdefault(x, len(ids)) for x in letters.translate(_APART).split()], np.int64)

    def _abbreviate(self, raw: np.ndarray, low: np.ndarray, space: np.ndarray, words: np.ndarray) -> None:
        """``short, short_at``: the tokens without stop words and without the vowels within a word."""
        inner = np.zeros(len(raw), bool)
        inner[1:-1] = _VOWEL[raw[1:-1]] & ~space[:-2] & ~space[2:]
        stop = [self.ids[x] for x in STOPS if x in self.ids]
        begin = np.flatnonzero(words)
        size = np.diff(_before(~space)[np.append(begin, len(raw))])
        token = self.flat[np.minimum(self.at[:-1], len(self.flat) - 1)] if len(self.flat) else np.zeros(self.n_tok, np.int64)
        # A stop word is a word of letters alone: one token, as long as the word.
        length = np.diff(_before(low > SPACE)[np.append(begin, len(raw))])
        out = (np.diff(self.at) == 1) & (length == size) & np.isin(token, stop)
        kept = ~inner
        kept[_runs(begin[out], begin[out] + size[out])] = False
        left = low[kept]
        self.short = self.of(left.tobytes())
        self.short_at = np.append(_before(_first(left > SPACE))[:-1][_first(left != SPACE)], len(self.short))

    def whole(self, rule: str, t: int) -> bool:
        """A text that fits its budget is kept, except by the sentence rules."""
        return self.n_tok <= t and rule not in ("sentences", "extractive")

    def leading(self, rule: str, t: int) -> int | None:
        """How many ROUGE tokens a candidate has that is a head of the prompt; None if it need not be one."""
        if self.whole(rule, t):
            return len(self.flat)
        if rule == "prefix":
            return int(self.at[max(t, 0)])
        if rule == "sentences":
            return int(self.sent_at[_fitting(self.sizes, t)])
        return None

    def places(self, rule: str, t: int) -> np.ndarray:
        """The places of any other rule's candidate but the abbreviations'."""
        n, at = self.n_tok, self.at
        if rule == "middle":
            start = (n - t) // 2
            return np.arange(at[start], at[start + t])
        if rule == "suffix":
            return np.arange(at[n - t], at[n])
        if rule == "stride":
            i = np.floor(np.arange(t) * n / t).astype(np.int64)
            return _runs(at[i], at[i + 1])
        if rule == "lines":
            start = _starts(self.lines)[:-1]
            return _runs(at[start], at[start + np.floor(self.lines * t / n).astype(np.int64)])
        if rule == "extractive":
            chosen = np.sort(self.ranked[:_fitting(self.sizes[self.ranked], t)])
            return _runs(self.sent_at[chosen], self.sent_at[chosen + 1])
        raise ValueError(f"no places for rule {rule!r}")


def _pairs(ids: np.ndarray, base: int) -> np.ndarray:
    """Neighbours as one number each; ``base``: above all ids."""
    return ids[:-1] * base + ids[1:]


def _clipped(ref: np.ndarray, cand: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Clipped hits of ``n`` candidates, whose entries have their candidate's number in ``owner``."""
    known, most = np.unique(ref, return_counts=True)
    at = np.minimum(np.searchsorted(known, cand), len(known) - 1)
    same = known[at] == cand
    found = np.bincount(owner[same] * len(known) + at[same], minlength=n * len(known)).reshape(n, -1)
    return np.minimum(found, most).sum(1)


def _lcs_of_heads(m: int, masks: dict, ids: list[int], sizes) -> dict[int, int]:
    """The LCS of a reference of ``m`` ids (``masks``) with the first n of ``ids``, for each n of ``sizes``; it has all ``ids``."""
    full = v = (1 << m) - 1
    out, done = {}, 0
    for size in sorted(set(sizes)):
        for y in ids[done:size]:
            u = v & masks[y]
            v = ((v + u) | (v - u)) & full
        done, out[size] = size, m - v.bit_count()
    return out


def _owners(parts: list[np.ndarray]) -> np.ndarray:
    return np.repeat(np.arange(len(parts)), [len(x) for x in parts])


def _own_overlaps(doc: Document, heads: set[int], short: set[int], placed: list[np.ndarray]):
    """``hit1, hit2, lcs`` by size of the heads and of the abbreviations' heads, and of each of ``placed``, against the prompt itself.

    All but the abbreviations are subsequences of it, so their tokens are hits and their own LCS, and the pairs within a run are hits.
    """
    a, base = doc.flat, len(doc.ids)
    of_heads = {s: (s, max(s - 1, 0), s) for s in heads}
    runs = [not len(p) or int(p[-1]) - int(p[0]) + 1 == len(p) for p in placed]
    asked = [a[p] for p, run in zip(placed, runs) if not run]
    sizes = sorted(s for s in short if s)
    parts = [doc.short[:s] for s in sizes]
    one = _clipped(a, np.concatenate(parts), _owners(parts), len(parts)).tolist() if parts and len(a) else [0] * len(parts)
    pairs = [_pairs(x, base) for x in asked + parts]
    two = _clipped(_pairs(a, base), np.concatenate(pairs), _owners(pairs), len(pairs)).tolist() if len(a) > 1 and pairs else [0] * len(pairs)
    rest = iter(two)
    of_placed = [(len(p), max(len(p) - 1, 0) if run else next(rest), len(p)) for p, run in zip(placed, runs)]
    of_short = {0: (0, 0, 0)}
    if sizes:
        flag, mine = np.zeros(base, bool), np.zeros(base, bool)
        cand = doc.short[:sizes[-1]]
        flag[a], mine[cand] = True, True
        both = flag[cand]
        ends = dict(zip(sizes, _before(both)[sizes].tolist()))
        ref = a[mine[a]]
        lcs = _lcs_of_heads(len(ref), _match_masks(ref), cand[both].tolist(), ends.values())
        of_short |= {s: (x, y, lcs[ends[s]]) for s, x, y in zip(sizes, one, rest)}
    return of_heads, of_short, of_placed


def _other_overlaps(doc: Document, ref: np.ndarray, heads: set[int], short: set[int], placed: list[np.ndarray]):
    """:func:`_own_overlaps` against another text's ids."""
    flag, base = np.zeros(len(doc.ids), bool), len(doc.ids)
    flag[ref] = True
    masks = _match_masks(ref)

    def of(ids: np.ndarray, sizes: set[int]) -> tuple[list[int], list[np.ndarray], dict[int, int]]:
        sizes = sorted(sizes)
        ids = ids[:sizes[-1]] if sizes else ids[:0]
        both = flag[ids]
        ends = _before(both)[sizes].tolist()
        known = ids[both]
        lcs = _lcs_of_heads(len(ref), masks, known.tolist(), ends)
        return sizes, [known[:e] for e in ends], {s: lcs[e] for s, e in zip(sizes, ends)}

    head_sizes, head_ids, head_lcs = of(doc.flat, heads)
    short_sizes, short_ids, short_lcs = of(getattr(doc, "short", ref[:0]), short)
    asked = [doc.flat[p] for p in placed]
    known = [x[flag[x]] for x in asked]
    lcs = [_lcs_of_heads(len(ref), masks, x.tolist(), [len(x)])[len(x)] for x in known]
    parts = head_ids + short_ids + known
    one = _clipped(ref, np.concatenate(parts), _owners(parts), len(parts)).tolist() if parts and len(ref) else [0] * len(parts)
    two = [0] * len(parts)
    if len(ref) > 1 and parts:
        pairs = [_pairs(x, base) for x in [doc.flat[:s] for s in head_sizes] + [doc.short[:s] for s in short_sizes] + asked]
        two = _clipped(_pairs(ref, base), np.concatenate(pairs), _owners(pairs), len(pairs)).tolist()
    hits = iter(zip(one, two))
    of_heads = {s: (*next(hits), head_lcs[s]) for s in head_sizes}
    of_short = {s: (*next(hits), short_lcs[s]) for s in short_sizes}
    return of_heads, of_short, [(*next(hits), x) for x in lcs]


def overlaps_by_place(doc: Document, refs: list[np.ndarray | None], targets: list[tuple[str, int]]) -> tuple[list[int], list]:
    """``(n_cand, overlaps)`` of a document's grid; overlaps: for each reference its ``hit1, hit2, lcs``, each a list over the grid.

    A reference of None is the prompt itself. Candidates that are heads of the prompt, or of its abbreviation, go by their size.
    """
    kinds, heads, short, placed = [], set(), set(), []
    for rule, t in targets:
        if (size := doc.leading(rule, t)) is not None:
            kinds.append((0, size))
            heads.add(size)
        elif rule == "abbrev":
            kinds.append((1, size := int(doc.short_at[min(t, len(doc.short_at) - 1)])))
            short.add(size)
        else:
            kinds.append((2, len(placed)))
            placed.append(doc.places(rule, t))
    n_cand = [at if kind < 2 else len(placed[at]) for kind, at in kinds]
    out = []
    for ref in refs:
        found = _own_overlaps(doc, heads, short, placed) if ref is None else _other_overlaps(doc, ref, heads, short, placed)
        out.append(list(zip(*[found[kind][at] for kind, at in kinds])))
    return n_cand, out


def budget(n: int, ratio: float, min_one: bool) -> int:
    t = int(np.floor(float(n) * ratio))
    return max(1, t) if min_one else t


def _grid_udf(grid, tasks):
    """A column function (prompt, reference: binary; scores): ``n_cand`` and, for each task, ``n_ref`` and arrays of the measures."""
    rules = {rule for _, rule, _, _ in grid}
    schema = "n_cand array<bigint>, " + ", ".join(f"{t}_ref bigint, " + ", ".join(f"{t}_{m} array<bigint>" for m in MEASURES) for t in tasks)
    names = ["n_cand"] + [f"{t}_{x}" for t in tasks for x in ("ref", *MEASURES)]

    def no_prompt(t, reference) -> list:
        if t == "reconstruction" or reference is None:
            return [None] * 4
        return [len(_letters(reference)[1].translate(_APART).split()), *[[0] * len(grid)] * 3]

    def row(prompt, reference, scores) -> list:
        if prompt is None:  # some rules make an empty text of it
            own = [[0 if rule in ("sentences", "extractive", "stride") else None for _, rule, _, _ in grid]]
            return own + [x for t in tasks for x in no_prompt(t, reference)]
        doc = Document(prompt, scores, rules)
        lines = None if reference is None else doc.of(_letters(reference)[1])
        asked = [t for t in tasks if t == "reconstruction" or lines is not None]
        n_cand, found = overlaps_by_place(doc, [None if t == "reconstruction" else lines for t in asked],
                                          [(rule, budget(doc.n_tok, ratio, min_one)) for ratio, rule, min_one, _ in grid])
        of = dict(zip(asked, found))
        out = [n_cand]
        for t in tasks:
            out += [len(doc.flat if t == "reconstruction" else lines), *of[t]] if t in of else [None] * 4
        return out

    @F.pandas_udf(schema)
    def overlaps(prompt: pd.Series, reference: pd.Series, scores: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([row(*x) for x in zip(prompt, reference, scores)], columns=names, dtype=object)
        return found.astype({f"{t}_ref": "Int64" for t in tasks})

    return overlaps


def scored_documents(docs: DataFrame, tasks, ratios, methods, corpus: DataFrame | None = None) -> DataFrame:
    """The rows of ``scored_grid`` without texts, for the ROUGE ``tasks`` of documents (``sample_id, prompt, reference``).

    ``corpus``: as for ``with_scores``; by default each document counts once.
    """
    rules = {rule_of(m) for m in methods}
    if not rules <= set(PLACE_RULES):
        raise ValueError(f"no places for the rules {sorted(rules - set(PLACE_RULES))}")
    grid = cells(ratios, methods, FLOOR0)
    df = with_scores(docs, rules, corpus)
    scores = F.col("scores") if "scores" in df.columns else F.lit(None).cast("array<double>")
    found = _grid_udf(grid, tasks)(F.col("prompt").cast("binary"), F.col("reference").cast("binary"), scores)
    df = df.select("sample_id", found.alias("_o"))
    o = F.col("_o")

    def cell(t: str):
        def make(g: Column, i: Column) -> Column:
            at = lambda name: F.get(o[name], i)
            ov = F.when(o[f"{t}_ref"].isNotNull(), F.struct(*[at(f"{t}_{m}").alias(m) for m in MEASURES]))
            return F.struct(F.lit(t).alias("task"), g["ratio"].alias("ratio"), g["styles"].alias("styles"), o[f"{t}_ref"].alias("n_ref"),
                            at("n_cand").alias("n_cand"), ov.alias("ov"))
        return make

    made = F.concat(*[F.transform(cell_array(ratios, methods, FLOOR0), cell(t)) for t in tasks])
    df = df.select("sample_id", F.explode(made).alias("r")).select("sample_id", "r.*")
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("double")
    df = finish_rouge(df.withColumns({"n_ref2": F.greatest(F.col("n_ref") - 1, zero), "n_cand2": F.greatest(F.col("n_cand") - 1, zero)}))
    df = df.withColumns({m: F.when(F.col("n_ref").isNotNull(), F.col(m)) for m in ("rouge1", "rouge2", "rougeL", "bertscore")})
    df = df.withColumns({"em": none, "f1": none})
    return df.withColumn("primary_score", primary_score()).withColumn("style", F.explode("styles")).drop("styles")
