"""Near-duplicate vectors against brute force, and the components."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold):
    ok = [k for k, (_, v, _) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = {k: np.asarray(rows[k][1], np.float32).astype(np.float64) for k in ok}
    ident = [float("-inf") if i is None else i for i, _, _ in rows]
    links, top = [set() for _ in rows], list(range(len(rows)))

    def find(a):
        while top[a] != a:
            a = top[a]
        return a
    for a in ok:
        for b in ok:
            if a < b and len(x[a]) == len(x[b]) and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= threshold:
                links[a].add(b)
                links[b].add(a)
                top[find(a)] = find(b)
    low = {}
    for k in range(len(rows)):
        low[find(k)] = min(low.get(find(k), ident[k]), ident[k])
    back = lambda i: None if i == float("-inf") else i
    return sorted(((i, len(links[k]), back(low[find(k)]), low[find(k)] == ident[k]) for k, (i, _, _) in enumerate(rows)), key=repr)


def vectors(seed=4):
    r = np.random.default_rng(seed)
    rows = [list(map(float, r.standard_normal(16).astype(np.float32))) for _ in range(150)]
    for spread in (0.02, 0.1, 0.25):  # tight, wide and loose families
        base = r.standard_normal(16)
        rows += [list(map(float, (base + spread * r.standard_normal(16)).astype(np.float32))) for _ in range(60)]
    rows += [rows[3]] * 40 + [[2 * x for x in rows[4]]] * 2 + [[-x for x in rows[5]]]
    rows += [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, rows[6][:15], rows[6][:15], [1e-30] * 16, [1e30] * 16]
    ids = list(range(7, 7 + len(rows)))
    random.Random(1).shuffle(ids)
    out = [(i, v, 1) for i, v in zip(ids, rows)]
    return out + [(None, rows[3], 2), (None, rows[160], 1), out[0], out[0], (out[1][0], rows[200], 1)]


def answer(df, **more):
    from abridge.llm.embedding_passes import embedding_duplicates
    return sorted(map(tuple, embedding_duplicates(df, **more).collect()), key=repr)


@pytest.mark.parametrize("tile,held", [(2048, 1 << 20), (16, 10)])
def test_near_vectors(spark, monkeypatch, tile, held):
    """Families whole and in tiles, components in one task and by stars; clashing column names."""
    from abridge.llm import components as C, embedding_passes as P
    monkeypatch.setattr(P, "TILE", tile)
    monkeypatch.setattr(C, "HELD", held)
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df = df.withColumns({c: F.lit("x") for c in ("n_links", "component_id", "kept", "node", "vec", "id", "family", "k1", "pass", "key")})
    assert answer(df, miss=1e-6) == brute(rows, 0.9)


def test_tight_family_needs_no_product(spark, monkeypatch):
    """Whole tiles are decided by their angles."""
    from abridge.llm import embedding_passes as P
    monkeypatch.setattr(P, "TILE", 8)
    monkeypatch.setattr(P, "_linked", None)  # a product would raise
    r = np.random.default_rng(0)
    base = r.standard_normal(16)
    rows = [(i, list(map(float, (base + 0.01 * r.standard_normal(16)).astype(np.float32))), 0) for i in range(100)]
    assert answer(spark.createDataFrame(rows, SCHEMA)) == [(i, 99, 0, i == 0) for i in sorted(range(100), key=lambda i: repr((i, 99, 0, i == 0)))]


def test_windows_reach_over_borders(spark, monkeypatch):
    """Many parts: equal keys lie on both sides of a border."""
    from abridge.llm import embedding_passes as P
    monkeypatch.setattr(P, "PART_ROWS", 40)
    rows = [(i, v, 0) for i, (_, v, _) in enumerate(vectors(9)) if v and len(v) == 16]
    assert answer(spark.createDataFrame(rows, SCHEMA), window=8, miss=1e-9) == brute(rows, 0.9)


def test_small_tables(spark):
    assert answer(spark.createDataFrame([], SCHEMA)) == []
    assert answer(spark.createDataFrame([(1, None, 0), (2, [0.0], 0)], SCHEMA)) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert answer(spark.createDataFrame([(2, [1.0], 0), (1, [3.0], 0)], SCHEMA)) == [(1, 1, 1, True), (2, 1, 1, False)]
    with pytest.raises(TypeError):
        answer(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<float>"))


def test_recall_of_pairs_at_the_threshold(spark):
    """Single pairs just above the threshold among many other vectors: at least 0.9 of them are found."""
    r = np.random.default_rng(2)
    x = r.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.standard_normal((6000, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.905 * x + math.sqrt(1 - 0.905 ** 2) * z
    rows = [(i, list(map(float, v.astype(np.float32))), 0) for i, v in enumerate(np.concatenate([x, y[:1000]]))]
    got = answer(spark.createDataFrame(rows, SCHEMA).repartition(8))
    assert all(n == 0 or c == i % 6000 for i, n, c, _ in got)
    assert sum(n for _, n, _, _ in got) / 2000 >= 0.9


@pytest.mark.parametrize("held", [1 << 20, 5])
def test_components(spark, monkeypatch, held):
    from abridge.llm import components as C
    from abridge.llm.common import Scratch
    monkeypatch.setattr(C, "HELD", held)
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1100)] + [(-5, -5)]
    top = {}

    def find(a):
        top.setdefault(a, a)
        while top[a] != a:
            a = top[a]
        return a
    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    got = sorted(map(tuple, C.connected_components(df, Scratch(spark, "cc")).collect()))
    assert got == sorted((a, find(a)) for a in top)
