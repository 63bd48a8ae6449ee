"""Removal of repeated passages by a difference-cover sample of the suffixes.

For a passage of L bytes only the order of suffixes by their first L bytes matters, and of that order only which
neighbours agree. A difference cover D modulo v has, for any two positions, a shift below v that puts both into
the sample. So the job has three steps:

1. Sampled suffixes (offset modulo v in D) get names, fingerprints of their first ``L - v + 1`` bytes. Shards of
   the name space sort them; a name next to an equal one is repeated. No other sample can lie in a repeated
   passage at the shift that its partner shares. This step only leaves out, so its names are short: equal strings
   have equal names, and a chance match costs a look in step 2.
2. The remaining suffixes that can begin a repeated passage are those fewer than v bytes before a repeated
   sample. They are merged: each gets the name of its first L bytes, made from the same prefix sums as the
   sample's, and shards sort these and compare neighbours. This step decides, so its names have twice the bits of
   the input's size and ``SAFETY_BITS`` more.
3. Bytes covered by repeated passages are removed, document by document.

The cover is Colbourn and Ling's: v = 24 r^2 + 36 r + 13 with 6 r + 4 elements.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abridge.llm import blocks as B
from abridge.llm.common import Scratch, text_of

LENGTH = 400
PRIME = np.uint64((1 << 31) - 1)
SHIFT = np.uint64(31)
STEP_BITS = 15
STEP = 1 << STEP_BITS  # bytes whose powers are tabled
SAMPLE_BITS = 10     # bits of a sample's name beyond the input's size: one sample in 2**SAMPLE_BITS is kept in vain
SAFETY_BITS = 20     # bits of a passage's name beyond the number of pairs: false matches stay below 2**-SAFETY_BITS


def difference_cover(r: int) -> tuple[int, np.ndarray]:
    """(v, D): every residue modulo v is a difference of two elements of D."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.cumsum([0, *steps])


def cover_for(length: int) -> tuple[int, np.ndarray]:
    """The largest cover whose samples still name at least half the passage."""
    r = 0
    while 24 * (r + 1) ** 2 + 36 * (r + 1) + 13 <= length // 2:
        r += 1
    return difference_cover(r) if length // 2 >= 13 else (1, np.zeros(1, np.int64))


def _fold(x: np.ndarray) -> np.ndarray:
    """Modulo 2^31 - 1 in place, not yet canonical: 2^31 counts as 1."""
    high = x >> SHIFT
    x &= PRIME
    x += high
    return x


@lru_cache(maxsize=64)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, _fold(_fold(out * np.uint64(pow(base, len(out), int(PRIME)))))])
    return out[:n]


class Names:
    """Fingerprints of the substrings of a byte string: polynomials modulo 2^31 - 1 at random points.

    Each point gives a word of 31 bits. The points are drawn for each run, so no text can be built to collide.
    """

    def __init__(self, data: np.ndarray, points: list[int]):
        self.data, self.points, self.sums = data, points, {}

    def _sums(self, point: int) -> np.ndarray:
        if point not in self.sums:
            out = np.zeros(len(self.data) + 1, np.uint32)
            low = _powers(point, STEP)
            for at in range(0, len(self.data), STEP):
                part = self.data[at:at + STEP]
                x = _fold(low[:len(part)] * np.uint64(pow(point, at, int(PRIME))))
                x *= part
                x = np.cumsum(_fold(x)) + np.uint64(out[at])
                out[at + 1:at + 1 + len(part)] = _fold(_fold(x))
            self.sums[point] = out
        return self.sums[point]

    def _word(self, point: int, at: np.ndarray, length: int) -> np.ndarray:
        sums, back = self._sums(point), pow(point, -1, int(PRIME))
        far = _powers(pow(back, STEP, int(PRIME)), 1 << (len(self.data) // STEP).bit_length())
        near, out = _powers(back, STEP), np.empty(len(at), np.uint64)
        for lo in range(0, len(at), STEP):
            a = at[lo:lo + STEP]
            x = _fold(sums[a + length] + np.uint64(2 * PRIME) - sums[a])
            x *= _fold(near[a & (STEP - 1)] * far[a >> STEP_BITS])
            x = _fold(_fold(x))
            x[x >= PRIME] -= PRIME
            out[lo:lo + STEP] = x
        return out

    def _pair(self, points: list[int], at: np.ndarray, length: int) -> np.ndarray:
        first, second = (self._word(p, at, length) for p in points)
        return B.mix64(first | (second << np.uint64(32)))

    def short(self, at: np.ndarray, length: int) -> np.ndarray:
        """62 bits by the first two points."""
        return self._pair(self.points[:2], at, length)

    def long(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """124 bits by all four points, as two numbers."""
        rest = self._pair(self.points[2:], at, length)
        return B.mix64(self._pair(self.points[:2], at, length) ^ rest), rest


def low_bytes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def from_low_bytes(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(n, width)
    return out.view("<u8").reshape(-1)


def in_order(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): the order by (key, check), and where in it another pair begins."""
    def changes(x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])

    order = np.argsort(keys, kind="stable")
    new, other = changes(keys[order]), changes(checks[order])
    if (other & ~new).any():  # equal keys of different strings
        order = np.lexsort((checks, keys))
        new, other = changes(keys[order]), changes(checks[order])
    return order, new | other


def distinct(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, checks, count, index) of the distinct pairs in order."""
    order, new = in_order(keys, checks)
    first = np.flatnonzero(new)
    index = np.empty(len(keys), np.int64)
    index[order] = np.cumsum(new) - 1
    return keys[order][first], checks[order][first], np.diff(first, append=len(keys)), index


def sampled(bounds: np.ndarray, v: int, cover: np.ndarray, need: int) -> np.ndarray:
    """Positions in the sample with ``need`` bytes left in their document."""
    out = []
    for a, b in zip(bounds, bounds[1:]):
        n = b - a - need + 1
        if n > 0:
            at = (np.arange(0, n, v)[:, None] + cover).ravel()
            out.append(a + at[at < n])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def starts_near(samples: np.ndarray, bounds: np.ndarray, v: int, length: int) -> np.ndarray:
    """Starts of passages that hold one of ``samples`` fewer than v bytes on."""
    n = int(bounds[-1])
    mark = np.zeros(n + 1, np.int32)
    doc = np.searchsorted(bounds, samples, side="right") - 1
    np.add.at(mark, np.maximum(samples - v + 1, bounds[doc]), 1)
    np.add.at(mark, samples + 1, -1)
    at = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
    return at[at + length <= bounds[np.searchsorted(bounds, at, side="right")]]


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                      with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256[, kept]) for each row.

    ``spans`` are the maximal runs [start, end) of bytes (UTF-8) covered by strings of ``length`` bytes that also start
    anywhere else, in another document or the same; ``kept`` is what is left, which may cut a character.
    Every copy loses the passage, the first too, and passages never cross documents. Null texts are empty; texts shorter
    than ``length`` lose nothing. A null id stays null; rows with equal ids are documents of their own. Other columns are
    not used; an empty table gives an empty one. Strings are compared by fingerprints at points drawn for each run, whose
    bits grow with the input, so that fewer than 2**-SAFETY_BITS chance matches are expected in a run; bytes are not compared.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    v, cover = cover_for(length)
    short = length - v + 1

    def encode(batch: pa.RecordBatch) -> dict[str, object]:
        texts = batch.column(1)
        size = [len(x) for x in texts.to_pylist()]
        return {"ids": B.squeeze(batch.column(0).to_numpy()), "bounds": B.squeeze(np.cumsum([0, *size])),
                "data": b"".join(texts.to_pylist())}

    table = B.text_blocks(docs.select(B.id_or_least(id_col), text_of(text_col).cast("binary")), scratch,
                          {"ids": "binary", "bounds": "binary", "data": "binary"}, encode)
    shards = B.shard_count(table)
    bits = int(table.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]).bit_length()
    points = [secrets.randbelow(int(PRIME) - 2) + 2 for _ in range(4)]
    coarse = np.uint64((1 << 64) - (1 << 8 * max(0, (64 - bits - SAMPLE_BITS) // 8)))
    check_bytes = min(8, max(0, -(-(2 * bits + SAFETY_BITS - 64) // 8)))

    def read(row) -> tuple[np.ndarray, Names]:
        return B.expand(row.bounds, np.int64), Names(np.frombuffer(row.data, np.uint8), points)

    def sample_names(names: Names, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        keys = names.short(at, short) & coarse
        return keys, np.zeros(len(keys), np.uint64), 0

    def passage_names(names: Names, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        keys, checks = names.long(at, length)
        keep = 8 * check_bytes
        return keys, checks & np.uint64((1 << keep) - 1), check_bytes

    def question(block: str, step: int, keys: np.ndarray, checks: np.ndarray, width: int) -> pd.DataFrame:
        keys, checks, count, _ = distinct(keys, checks)
        return pd.DataFrame([(s, block, step, B.squeeze_sorted(keys[x]), low_bytes(checks[x], width),
                              B.squeeze(np.packbits(count[x] > 1))) for s, x in B.shard_slices(keys, shards)],
                            columns=["shard", "block", "step", "names", "checks", "twice"])

    asked = "shard long, block string, step int, names binary, checks binary, twice binary"

    def answer(g: pd.DataFrame) -> pd.DataFrame:
        names = [B.expand_sorted(x) for x in g["names"]]
        checks = np.concatenate([from_low_bytes(x, len(k), len(x) // len(k)) for x, k in zip(g["checks"], names)])
        twice = np.concatenate([np.unpackbits(B.expand(x, np.uint8), count=len(k)) for x, k in zip(g["twice"], names)])
        order, new = in_order(np.concatenate(names), checks)
        alone = new & np.append(new[1:], True)
        hit = np.empty(len(order), bool)
        hit[order] = ~alone
        hit |= twice.astype(bool)
        cut = np.cumsum([len(x) for x in names])[:-1]
        return pd.DataFrame({"block": g["block"], "step": g["step"], "shard": g["shard"],
                             "hits": [B.squeeze(np.packbits(x)) for x in np.split(hit, cut)]})

    answered = "block string, step int, shard long, hits binary"

    def hits(a: pd.DataFrame, step: int, keys: np.ndarray, checks: np.ndarray, _: int) -> np.ndarray:
        """Which of the names are repeated."""
        keys, _, _, index = distinct(keys, checks)
        rows = a[a["step"] == step].sort_values("shard")["hits"]
        bits = [np.unpackbits(B.expand(x, np.uint8), count=s.stop - s.start)
                for x, (_, s) in zip(rows, B.shard_slices(keys, shards), strict=True)]
        return (np.concatenate(bits) if bits else np.zeros(0, np.uint8)).astype(bool)[index]

    def ask_samples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                bounds, names = read(row)
                yield question(row.block, 1, *sample_names(names, sampled(bounds, v, cover, short)))

    def candidates(row, a: pd.DataFrame) -> tuple[np.ndarray, Names, np.ndarray]:
        bounds, names = read(row)
        at = sampled(bounds, v, cover, short)
        at = at[hits(a, 1, *sample_names(names, at))]
        return bounds, names, starts_near(at, bounds, v, length)

    def ask_rest(b: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for row in b.itertuples():
            _, names, at = candidates(row, a)
            parts.append(question(row.block, 2, *passage_names(names, at)))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["shard", "block", "step", "names", "checks", "twice"])

    def finish(b: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in b.itertuples():
            bounds, names, at = candidates(row, a)
            data, at = names.data, at[hits(a, 2, *passage_names(names, at))]
            mark = np.zeros(len(data) + 1, np.int32)
            mark[at] += 1
            mark[at + length] -= 1
            gone = np.cumsum(mark[:-1]) > 0
            for doc, lo, hi in zip(B.expand(row.ids, np.int64), bounds, bounds[1:]):
                g = gone[lo:hi]
                edge = np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                kept = data[lo:hi][~g].tobytes()
                out.append((doc, hi - lo, int(g.sum()), len(edge), edge.tolist(), hashlib.sha256(kept).hexdigest())
                           + (kept,) * with_text)
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"]
                            + ["kept"] * with_text)

    first = scratch.store(B.by_shard(table.mapInPandas(ask_samples, asked), answer, answered), "first")
    rest = B.by_shard(B.with_answers(table, first, ask_rest, asked), answer, answered)
    both = first.unionByName(scratch.store(rest, "rest"))
    done = B.with_answers(table, both, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, "
                          "spans array<array<long>>, kept_sha256 string" + ", kept binary" * with_text)
    done = done.withColumn("doc_id", B.least_as_null(F.col("doc_id")))
    result = Scratch(docs.sparkSession, "suffixes-result").store(done, "documents")
    scratch.drop()
    return result
