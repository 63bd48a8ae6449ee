"""Connected components by alternating large and small stars, with union in place before and at the end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abridge.llm.common import Scratch

HELD = 1 << 20  # edges that one task joins at a time, 16 MB


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node of each one's component) of the edges a - b."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = where[:len(a)], where[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            return nodes, nodes[label]
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges from each node to the smallest it reaches by the edges of this task, ``HELD`` at a time."""
    def stars(held: list[pd.DataFrame]) -> pd.DataFrame:
        nodes, low = least_labels(np.concatenate([x["u"] for x in held]), np.concatenate([x["v"] for x in held]))
        return pd.DataFrame({"u": nodes, "v": low})

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= HELD:
            yield stars(held)
            held, size = [], 0
    if held:
        yield stars(held)


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(a, b) long edges -> (node, component), component = the smallest node reached.

    Each task first joins what its own edges connect. Then each step replaces edges by edges to the smallest
    neighbour; the number of edges never grows and the number of steps is logarithmic in practice. When no more than
    ``HELD`` edges are left, one task joins them; else it ends when a step changes nothing. Self-loops keep single nodes.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = scratch.store(e.mapInPandas(_forest, "u long, v long").distinct(), f"{name}-0")
    state, step = e.count(), 0
    if state <= HELD:
        return _finish(e, scratch, name)
    while True:
        step += 1
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v >= u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        e = scratch.store(small.select("x.u", "x.v").distinct(), f"{name}-{step}")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        if now[0] <= HELD:
            return _finish(e, scratch, name)
        state = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def _finish(e: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """At most ``HELD`` edges, joined in one task."""
    done = scratch.store(e.coalesce(1).mapInPandas(_whole, "u long, v long"), f"{name}-end")
    return done.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = list(batches)
    if held:
        nodes, low = least_labels(np.concatenate([x["u"] for x in held]), np.concatenate([x["v"] for x in held]))
        yield pd.DataFrame({"u": nodes, "v": low})
