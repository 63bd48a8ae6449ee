"""Quality classifier: linear hinge loss on n-gram indicators scaled by class log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abridge.llm.common import text_of

GRAM_BITS = 16           # byte 4-grams are hashed to so many bits
SHAPES = 1024            # further indicators: length and variety of the text
FEATURES = (1 << GRAM_BITS) + SHAPES
MAX_TRAINING = 8000      # labelled rows that are fitted at most, a seeded sample
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12


def indicators(data: bytes, seen: np.ndarray) -> np.ndarray:
    """Distinct features of a text. ``seen`` is a zeroed bool scratch array of 2**GRAM_BITS.

    Byte 4-grams, and one feature for each of: the length class, and the share of distinct 4-grams in it.
    """
    n = len(data)
    if n >= 4:
        a = np.frombuffer(data, np.uint8).astype(np.uint32)
        h = a[:-3] * np.uint32(0x9E3779B1)
        h += a[1:-2] * np.uint32(0x85EBCA77)
        h += a[2:-1] * np.uint32(0xC2B2AE3D)
        h += a[3:] * np.uint32(0x27D4EB2F)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h >>= np.uint32(32 - GRAM_BITS)
        seen[h] = True
        grams = np.flatnonzero(seen)
        seen[grams] = False
    else:
        grams = np.zeros(0, np.int64)
    length = min(15, n.bit_length())
    variety = min(31, int(32 * len(grams) / max(1, n)))
    shape = (1 << GRAM_BITS) + np.array([length, 32 + 32 * length + variety])
    return np.concatenate([grams, shape]).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """score = sigmoid(slope * margin + shift); margin = weights over the unit-length scaled indicators."""

    weights: np.ndarray  # float32, already times the ratios
    square: np.ndarray   # float32, the ratios' squares, for the length
    bias: float
    slope: float
    shift: float

    def margins(self, features: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[f].sum() / np.sqrt(self.square[f].sum() + 1e-12) + self.bias
                         for f in features])

    def score(self, features: list[np.ndarray]) -> np.ndarray:
        z = np.clip(self.slope * self.margins(features) + self.shift, -30, 30)
        return 1 / (1 + np.exp(-z))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    p, q = np.full(FEATURES, SMOOTHING), np.full(FEATURES, SMOOTHING)
    for f, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[f] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray,
                            epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """L2-regularised squared hinge loss; the bias is one more feature with value 1."""
    w, bias = np.zeros(FEATURES), 0.0
    alpha = np.zeros(len(rows))
    diag = 0.5 / cost
    norms = np.array([v @ v + 1.0 for v in values]) + diag
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            f, v = rows[i], values[i]
            g = y[i] * (w[f] @ v + bias) - 1 + diag[i] * alpha[i]
            new = max(alpha[i] - g / norms[i], 0.0)
            step = (new - alpha[i]) * y[i]
            if step:
                w[f] += step * v
                bias += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic fit of the labels on the margins, with slightly softened targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    b = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (p - t) + 1e-3 * (b - [1.0, 0.0]))
        b -= step
        if np.abs(step).max() < 1e-6:
            break
    return float(b[0]), float(b[1])


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fit on indicator rows and 0/1 labels. A single class (or no row) gives a constant score."""
    y = np.where(labels > 0, 1.0, -1.0)
    if len(set(y)) < 2:
        share = (float((y > 0).sum()) + 1) / (len(y) + 2)
        return Model(np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32), 0.0, 0.0,
                     float(np.log(share / (1 - share))))
    ratio = log_count_ratios(rows, y)
    values = [ratio[f] / np.sqrt((ratio[f] ** 2).sum() + 1e-12) for f in rows]
    half = len(y) / 2
    cost = np.where(y > 0, COST * half / (y > 0).sum(), COST * half / (y < 0).sum())
    # Margins for the calibration come from models that have not seen the row.
    fold = np.arange(len(y)) % 3
    out = np.zeros(len(y))
    for k in range(3):
        inn = np.flatnonzero(fold != k)
        if len(set(y[inn])) < 2:
            continue
        w, b = dual_coordinate_descent([rows[i] for i in inn], [values[i] for i in inn], y[inn], cost[inn])
        for i in np.flatnonzero(fold == k):
            out[i] = w[rows[i]] @ values[i] + b
    slope, shift = calibrate(out, y)
    w, b = dual_coordinate_descent(rows, values, y, cost)
    return Model((w * ratio).astype(np.float32), (ratio ** 2).astype(np.float32), b, slope, shift)


def training_rows(docs: DataFrame, labels: DataFrame, eligible: Column, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "quality",
                  max_rows: int = MAX_TRAINING) -> tuple[list[np.ndarray], np.ndarray]:
    """Indicators and labels of a seeded sample of at most ``max_rows`` labelled rows.

    Null labels are passed over, of repeated label rows the smallest label holds. The sample's ids (bounded) are
    broadcast, so the texts of the other rows stay where they are.
    """
    known = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
             .where("_label is not null and _id is not null").groupBy("_id").agg(F.min("_label").alias("_label")))
    known = known.where(eligible).orderBy(F.xxhash64(F.lit("train"), "_id"), "_id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("_d"), text_of(text_col).cast("binary").alias("_t"))
    rows = rows.join(F.broadcast(known), F.col("_d") == F.col("_id")).select("_id", "_label", "_t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(1 << GRAM_BITS, bool)
        for b in batches:
            yield pd.DataFrame({"_id": b["_id"], "_label": b["_label"],
                                "_f": [indicators(bytes(x), seen).tobytes() for x in b["_t"]]})

    got = rows.mapInPandas(run, "_id long, _label int, _f binary").dropDuplicates(["_id"]).collect()
    got.sort(key=lambda r: r["_id"])
    return ([np.frombuffer(bytes(r["_f"]), np.int32) for r in got],
            np.array([r["_label"] for r in got], dtype=float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          carry: bool = False) -> DataFrame:
    """``docs`` (with ``carry`` all columns, else the id) plus ``score``, the probability of label 1.

    Null and empty texts have only the length feature and get its score. The model has a fixed size
    (two arrays of :data:`FEATURES` floats) and travels with the function.
    """
    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen = np.zeros(1 << GRAM_BITS, bool)
        for t in texts:
            yield pd.Series(model.score([indicators(bytes(x), seen) for x in t]))

    cols = [c for c in docs.columns if c != "score"] if carry else [id_col]
    return docs.select(*cols, scored(text_of(text_col).cast("binary")).alias("score"))
