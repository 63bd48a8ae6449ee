"""Near-duplicate vectors by sorted projection passes.

1. Equal vectors become one row with a weight, so a vector that is everywhere costs one row.
2. In each pass a vector's key is the concatenation of 64 random sign hashes. The rows are sorted by key and each is
   compared with the ``WINDOW`` rows before it; pairs that reach the threshold join the union of all passes. The
   number of passes follows from the table's size, so that a pair at the threshold is missed as rarely at any size.
3. What the union connects is a family. Its links are counted whole: by one product for a small family. A large one is
   put in order of the angle to one of its vectors and cut into tiles: rows whose angles add up to less than the
   threshold's are linked and those whose angles differ by more are not, whole tiles at a time (the triangle
   inequality on the sphere); only tiles in between are multiplied.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abridge.llm.common import Scratch, numbered, shuffle_partitions
from abridge.llm.components import connected_components, least_labels

WINDOW = 32
MISS = 0.05          # share of the pairs at the threshold that all passes may miss
BITS = 64            # hashes in a key
SEED = 20
ROUND = 4            # passes whose copies of the vectors are sorted at once
PART_ROWS = 1 << 16  # rows of a sorted part, if there are more than the shuffle partitions hold
TILE = 2048          # rows of a product
SLACK = 1e-9         # angles nearer to a bound are not decided without a product
NO_ID = -(1 << 63)


def n_passes(rows: int, threshold: float, window: int, miss: float) -> int:
    """Passes after which a pair at the threshold has met with probability 1 - miss.

    In a pass it meets if the leading log2(rows / window) hashes agree, each with probability 1 - angle / pi.
    """
    bits = max(0.0, math.log2(max(1, rows) / window))
    meets = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-meets))) if meets < 1 else 1


def unit(vectors) -> np.ndarray:
    """Rows of length 1 in double precision."""
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(dim: int, passes: range):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = {p: np.random.default_rng([SEED, dim, p]).standard_normal((dim, BITS)) for p in passes}
        weight = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
        for batch in batches:
            if not len(batch):
                continue
            x = unit(batch["vec"])
            for p, plane in planes.items():
                key = ((x @ plane > 0) * weight).sum(axis=1, dtype=np.uint64) ^ np.uint64(1 << 63)  # in order as a long
                yield pd.DataFrame({"pass": p, "key": key.view(np.int64), "node": batch["node"], "vec": batch["vec"]})
    return run


def _near(node: np.ndarray, turn: np.ndarray, x: np.ndarray, fresh: int, window: int, threshold: float) -> pd.DataFrame:
    """Edges that connect what the windows of the rows from ``fresh`` on link; rows of one pass only."""
    a, b = [], []
    for s in range(1, min(window, len(node) - 1) + 1):
        start = max(fresh, s)
        hit = np.einsum("ij,ij->i", x[start:], x[start - s:len(x) - s]) >= threshold
        hit &= turn[start:] == turn[start - s:len(x) - s]
        at = np.flatnonzero(hit) + start
        a.append(node[at])
        b.append(node[at - s])
    a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
    if not len(a):
        return pd.DataFrame({"a": a, "b": b})
    nodes, low = least_labels(a, b)
    return pd.DataFrame({"a": nodes, "b": low})[nodes != low]


def _windows(window: int, threshold: float):
    """Over sorted rows: edges, and the first and last rows of the part (``border``, the part before it)."""
    def border(rows: pd.DataFrame, part: int) -> pd.DataFrame:
        return rows[["pass", "node", "vec"]].assign(border=part, place=np.arange(len(rows)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        first, tail, x_tail = None, None, None
        for batch in batches:
            if not len(batch):
                continue
            x = unit(batch["vec"])
            rows = batch if tail is None else pd.concat([tail, batch], ignore_index=True)
            x = x if tail is None else np.concatenate([x_tail, x])
            yield _near(rows["node"].to_numpy(), rows["pass"].to_numpy(), x, 0 if tail is None else len(tail), window, threshold)
            first = rows if first is None or len(first) < window else first
            first = first.head(window) if len(first) >= window else first
            tail, x_tail = rows.tail(window), x[-window:]
        if tail is not None:
            yield border(first.head(window), part - 1).assign(place=lambda r: r["place"] + window)
            yield border(tail, part)

    columns = {"a": "Int64", "b": "Int64", "border": "Int64", "place": "Int64", "pass": "Int64", "node": "Int64", "vec": object}

    def typed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in run(batches):
            yield out.reindex(columns=list(columns)).astype(columns).astype({"vec": object}).where(lambda r: r.notna(), None)
    return typed


def _edges(reps: DataFrame, dim: int, threshold: float, window: int, miss: float, scratch: Scratch, name: str) -> DataFrame:
    """Edges (a, b) between the nodes of ``reps`` (node, vec) that the windows of all passes link."""
    rows = reps.count()
    total = n_passes(rows, threshold, window, miss)
    limit, kind = shuffle_partitions(reps.sparkSession), reps.schema["vec"].dataType.simpleString()
    found = []
    for start in range(0, total, ROUND):
        passes = range(start, min(total, start + ROUND))
        n = rows * len(passes)
        parts = max(1, min(limit, n // (8 * window)), n // PART_ROWS)
        keyed = reps.mapInPandas(_keys(dim, passes), f"pass int, key long, node long, vec {kind}")
        keyed = keyed.repartitionByRange(parts, "pass", "key", "node").sortWithinPartitions("pass", "key", "node").drop("key")
        out = scratch.store(keyed.mapInPandas(
            _windows(window, threshold), f"a long, b long, border int, place int, pass int, node long, vec {kind}"), f"{name}-{start}")

        def across(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("place").reset_index(drop=True)
            fresh = int((g["place"] < window).sum())  # the rows behind the border
            return _near(g["node"].to_numpy(), g["pass"].to_numpy(), unit(g["vec"]), fresh, window, threshold)

        # a border has at most 2 windows of rows
        borders = out.where("border is not null").groupBy("border").applyInPandas(across, "a long, b long")
        found.append(out.where("a is not null").select("a", "b").unionByName(scratch.store(borders, f"{name}-borders-{start}")))
    return reduce(DataFrame.unionByName, found)


def _linked(x: np.ndarray, y: np.ndarray, weight: np.ndarray, threshold: float) -> np.ndarray:
    """For each row of x the weight of the rows of y that it is linked with."""
    return (x @ y.T >= threshold).astype(np.float64) @ weight


def _link_counts(members: DataFrame, threshold: float, scratch: Scratch, name: str) -> DataFrame:
    """(node, linked): the weight of all rows that a row is linked with, its own too; members: (family, node, n, vec)."""
    size = members.groupBy("family").agg(F.count(F.lit(1)).alias("rows"))
    members = scratch.store(members.join(size, "family"), f"{name}-members")
    schema = "node long, linked long"

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, f in g.groupby("family"):
            x = unit(f["vec"])
            np_links = np.rint(_linked(x, x, f["n"].to_numpy(np.float64), threshold))
            out.append(pd.DataFrame({"node": f["node"], "linked": np_links.astype(np.int64)}))
        return pd.concat(out)

    small = members.where(F.col("rows") <= TILE)
    bins = -(-(small.count()) // TILE) or 1
    done = [scratch.store(small.withColumn("_bin", F.pmod(F.xxhash64("family"), F.lit(bins))).groupBy("_bin")
                          .applyInPandas(whole, schema), f"{name}-small")]
    large = members.where(F.col("rows") > TILE)
    if large.isEmpty():
        return done[0]
    kind = members.schema["vec"].dataType.simpleString()
    pivot = large.groupBy("family").agg(F.min_by("vec", "node").alias("pivot"))

    def angles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                cos = np.einsum("ij,ij->i", unit(b["vec"]), unit(b["pivot"]))
                yield b.drop(columns=["pivot", "rows"]).assign(angle=np.arccos(np.clip(cos, -1, 1)))

    placed = large.join(pivot, "family").select("family", "node", "n", "vec", "rows", "pivot").mapInPandas(
        angles, f"family long, node long, n long, vec {kind}, angle double")
    placed = numbered(placed, ["family", "angle", "node"], scratch, f"{name}-placed")
    start = placed.groupBy("family").agg(F.min("at").alias("_start"))
    placed = placed.join(start, "family").withColumn("tile", F.expr(f"(at - _start) div {TILE}")).drop("at", "_start")
    placed = scratch.store(placed, f"{name}-tiles")
    tiles = placed.groupBy("family", "tile").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.sum("n").alias("n"))
    bound = math.acos(threshold)

    def plan(g: pd.DataFrame) -> pd.DataFrame:
        """For each tile the weight of the tiles that are surely linked and the later tiles to be multiplied with."""
        g = g.sort_values("tile").reset_index(drop=True)
        before = np.concatenate([[0], np.cumsum(g["n"].to_numpy())])
        sure = np.searchsorted(g["high"].to_numpy(), bound - SLACK - g["high"].to_numpy(), side="right")
        ends = np.searchsorted(g["low"].to_numpy(), g["high"].to_numpy() + bound + SLACK, side="right")
        todo = [list(range(max(i, sure[i]), ends[i])) for i in range(len(g))]
        return pd.DataFrame({"family": g["family"], "tile": g["tile"], "sure": before[sure], "todo": todo})

    # a row a tile
    planned = scratch.store(tiles.groupBy("family").applyInPandas(plan, "family long, tile long, sure long, todo array<long>"), f"{name}-plan")
    sure = placed.join(planned.select("family", "tile", "sure"), ["family", "tile"]).select("node", F.col("sure").alias("linked"))
    pairs = planned.select("family", "tile", F.explode("todo").alias("other"))
    key, row = ["family", "tile", "other"], ["node", "n", "vec"]
    anew = lambda df, cols: df.select(*(F.col(c).alias(c) for c in cols))  # noqa: E731  columns of their own for the cogroup
    left = placed.join(pairs, ["family", "tile"]).select(*key, *row)
    right = anew(placed.withColumnRenamed("tile", "other"), ["family", "other", *row])
    right = right.join(anew(pairs, key), ["family", "other"]).select(*key, *row)

    def product(k, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = unit(a["vec"]), unit(b["vec"])
        out = [pd.DataFrame({"node": a["node"], "linked": np.rint(_linked(x, y, b["n"].to_numpy(np.float64), threshold)).astype(np.int64)})]
        if k[1] != k[2]:
            out.append(pd.DataFrame({"node": b["node"], "linked": np.rint(_linked(y, x, a["n"].to_numpy(np.float64), threshold)).astype(np.int64)}))
        return pd.concat(out)

    products = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(product, schema)
    done.append(sure.unionByName(scratch.store(products, f"{name}-products")).groupBy("node").agg(F.sum("linked").alias("linked")))
    return reduce(DataFrame.unionByName, done)


def embedding_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9,
                         window: int = WINDOW, miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row: near duplicates by cosine in double precision.

    n_links counts the other rows with a cosine of at least ``threshold`` (0 < threshold < 1) that were found, component_id is the
    smallest id reachable by them, kept says whether it is the row's own. No pair below the threshold counts.
    All links within what the passes connect are found; a pair of vectors with no such connection is missed
    with a probability of at most about ``miss``. Vectors that are null, empty or zero, or hold null or
    non-finite components, link with nothing, and vectors of different lengths not with each other. Repeated rows are rows of
    their own that link with each other; a null id counts as the least. Ids are whole numbers, other types raise.
    Further columns are not used, whatever their names. An empty table gives an empty one.
    """
    kind = vectors.schema[id_col].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise TypeError(f"ids must be whole numbers, not {kind}")
    scratch = Scratch(vectors.sparkSession, "passes")
    vec = F.col(vec_col)
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(~bad & F.exists(vec, lambda x: x != 0), F.lit(False))
    every = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.when(good, vec).alias("vec"))
    keys = [F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit("second"), "vec").alias("k2")]
    reps = every.where("vec is not null").groupBy(*keys).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))
    reps = scratch.store(reps.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("vec")}), "reps")
    edges = []
    for dim in sorted(r[0] for r in reps.select("dim").distinct().collect()):
        edges.append(_edges(reps.where(F.col("dim") == dim).select("node", "vec"), dim, threshold, window, miss, scratch, f"dim-{dim}"))
    nodes = reps.select("k1", "k2", "id", "n", "node").withColumns({"_linked": F.col("n"), "_low": F.col("id")})
    if edges:
        family = connected_components(reduce(DataFrame.unionByName, edges), scratch, "families")
        family = scratch.store(family.withColumnRenamed("component", "family"), "families")
        members = reps.join(family, "node").select("family", "node", "n", "vec", "dim")
        counts = [_link_counts(members.where(F.col("dim") == d[0]).drop("dim"), threshold, scratch, f"links-{d[0]}")
                  for d in members.select("dim").distinct().collect()]
        if counts:
            low = family.join(reps.select("node", "id"), "node").groupBy("family").agg(F.min("id").alias("component"))
            known = family.join(low, "family").join(reduce(DataFrame.unionByName, counts), "node").drop("family")
            nodes = reps.select("k1", "k2", "id", "n", "node").join(known, "node", "left").select(
                "k1", "k2", F.coalesce("linked", "n").alias("_linked"), F.coalesce("component", "id").alias("_low"))
    rows = every.select("id", *[F.when(F.col("vec").isNotNull(), k).alias(k_name) for k, k_name in zip(keys, ("k1", "k2"))])
    done = rows.join(nodes.select("k1", "k2", "_linked", "_low"), ["k1", "k2"], "left").select(
        F.nullif("id", F.lit(NO_ID)).alias("vec_id"), F.coalesce(F.col("_linked") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.nullif(F.coalesce("_low", "id"), F.lit(NO_ID)).alias("component_id"), (F.coalesce("_low", "id") == F.col("id")).alias("kept"))
    result = Scratch(vectors.sparkSession, "passes-result").store(done.withColumnRenamed("vec_id", id_col), "rows")
    scratch.drop()
    return result
