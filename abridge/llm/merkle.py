"""Merkle manifest of a table: leaf places by bitmap ranks, levels by keyed slot arrays.

1. Leaf digests are made in one projection; after that only ids and digests move.
2. The ids of a group become a bitmap of 64-bit words, of which only those with a bit are kept; the words of all tasks
   are merged by OR before and after the shuffle. A directory of counts in four levels (word, 2^20 ids, 2^34, 2^48)
   gives the rank of a word, the bits below an id the rest. So a leaf's place comes from a look-up, no group is sorted.
3. A leaf goes into the slot array of its key (group, place div 512), which holds three levels of the tree. The
   arrays' tops are the leaves of the next pass; a pass has a 512th of the rows of the one before it.
4. From the top down each array hands its leaves the siblings on their way to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abridge.llm.common import Scratch, numbered, shuffle_partitions

FAN = 8        # children of a node
LEVELS = 3     # levels of a slot array
SLOTS = FAN ** LEVELS
STEP = 14      # bits of a word's number that one level of the directory resolves
NO_ID = -(1 << 57) - 1  # the word of null ids, below all others
COPIES = 4096  # rows of one piece of equal rows


def digest_field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*(digest_field(v) for v in values)), 256)


def _h(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(nodes: list[str], whole: bool) -> list[list[str]]:
    """The levels over the nodes of a slot array; ``whole`` if it holds a whole tree, which ends at one node."""
    levels = [nodes]
    while (len(levels[-1]) > 1) if whole else (len(levels) <= LEVELS):
        last = levels[-1]
        levels.append([_h(last[i:i + FAN]) for i in range(0, len(last), FAN)])
    return levels


def _sides(levels: list[list[str]], slot: int) -> str:
    """Siblings on the way from a slot to the array's top: ``left|right;`` for each level."""
    out = []
    for nodes in levels[:-1]:
        first = slot - slot % FAN
        out.append("".join(nodes[first:slot]) + "|" + "".join(nodes[slot + 1:first + FAN]) + ";")
        slot //= FAN
    return "".join(out)


def fold(leaf: str, way: str) -> str:
    """The root that a leaf and the siblings on its way give."""
    for level in way.split(";")[:-1]:
        left, right = level.split("|")
        leaf = _h([left, leaf, right])
    return leaf


def _before(df: DataFrame, group: list[str], order: str, count: str = "n") -> Column:
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(w), F.lit(0))


def rank_words(words: DataFrame) -> DataFrame:
    """words (g, w, bits, n, more) with ``base``, the rows of the group in lesser words, and ``total``, those of the group.

    The windows hold at most 2^14 rows (2^16 at the top), however many ids a group has.
    """
    levels = [words.select("g", F.col("w").alias("k"), "n")]
    for _ in range(3):
        up = levels[-1].select("g", F.shiftright("k", STEP).alias("k"), "n")
        levels.append(up.groupBy("g", "k").agg(F.sum("n").alias("n")))
    top = levels[-1]
    directory = top.select("g", "k", _before(top, ["g"], "k").alias("base"), F.sum("n").over(Window.partitionBy("g")).alias("total"))
    for level in levels[-2::-1]:
        level = level.withColumn("up", F.shiftright("k", STEP))
        level = level.withColumn("within", _before(level, ["g", "up"], "k"))
        directory = level.join(directory.withColumnRenamed("k", "up"), ["g", "up"]).select(
            "g", "k", (F.col("base") + F.col("within")).alias("base"), "total")
    return words.drop("n").join(directory.withColumnRenamed("k", "w"), ["g", "w"])


def leaf_places(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """leaves (g, id, leaf, bad) with ``at``, the place in the group, and ``total``, the group's leaves.

    Places ascend by id, null first; rows of one id ascend by leaf, and equal rows take places in any order.
    """
    bit = F.coalesce(F.col("id").bitwiseAND(F.lit(63)), F.lit(0)).cast("int").alias("b")
    keyed = leaves.withColumns({"w": F.coalesce(F.shiftright("id", 6), F.lit(NO_ID)), "b": bit})
    words = keyed.groupBy("g", "w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("bits"), F.count(F.lit(1)).alias("n"))
    words = scratch.store(words, "words")
    doubled = words.where(F.col("n") > F.bit_count("bits"))
    repeats = not doubled.isEmpty()
    if repeats:
        more = (keyed.join(doubled.select("g", "w"), ["g", "w"], "left_semi").groupBy("g", "w", "b")
                .agg((F.count(F.lit(1)) - 1).alias("more")).where("more > 0")
                .groupBy("g", "w").agg(F.collect_list(F.struct("b", "more")).alias("more")))  # at most 64 entries
        words = words.join(more, ["g", "w"], "left")
    else:
        words = words.withColumn("more", F.lit(None).cast("array<struct<b:int,more:bigint>>"))
    at = F.col("base") + F.expr("bit_count(bits & ~shiftleft(-1L, b))")
    at += F.expr("coalesce(aggregate(filter(more, x -> x.b < b), 0L, (s, x) -> s + x.more), 0L)")
    rows = keyed.join(rank_words(words), ["g", "w"]).withColumns(
        {"at": at, "again": F.expr("coalesce(exists(more, x -> x.b = b), false)")})
    if not repeats:
        return rows.select("g", "at", "total", "id", "leaf", "bad")
    rows = scratch.store(rows.select("g", "at", "total", "id", "leaf", "bad", "again"), "ranked")
    # Rows of a repeated id: equal ones are counted, different ones are put in order by 4,096 ranges of their digest.
    same = rows.where("again").groupBy("g", "at", "total", "id", "leaf").agg(F.first("bad").alias("bad"), F.count(F.lit(1)).alias("n"))
    same = scratch.store(same.withColumn("p", F.substring("leaf", 1, 3)), "same")
    ranges = same.groupBy("g", "at", "p").agg(F.sum("n").alias("n"))
    ranges = ranges.select("g", "at", "p", _before(ranges, ["g", "at"], "p").alias("start"))
    same = same.withColumn("within", _before(same, ["g", "at", "p"], "leaf")).join(ranges, ["g", "at", "p"])
    pieces = same.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    pieces = pieces.repartition(shuffle_partitions(leaves.sparkSession), "g", "at", "leaf", "piece")
    last = F.least(F.col("piece") + COPIES, F.col("n")) - 1
    copies = pieces.withColumn("copy", F.explode(F.sequence(F.col("piece"), last)))
    copies = copies.withColumn("at", F.col("at") + F.col("start") + F.col("within") + F.col("copy"))
    cols = ["g", "at", "total", "id", "leaf", "bad"]
    return rows.where("not again").select(cols).unionByName(copies.select(cols))


def slot_arrays(nodes: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """Passes of slot arrays (g, run, total, leaf, id, bad: arrays by slot; top) over nodes (g, at, total, id, leaf, bad).

    The last pass has one array a group, whose top is the group's root.
    """
    def reduce(g: pd.DataFrame) -> pd.DataFrame:
        place = (g["at"] % SLOTS).to_numpy()
        slots = {c: [None] * len(g) for c in ("leaf", "id", "bad")}
        for c, out in slots.items():
            for i, v in zip(place, g[c]):
                out[i] = v
        top = _levels(slots["leaf"], g["total"].iloc[0] <= SLOTS)[-1][0]
        return pd.DataFrame({"g": g["g"].iloc[:1], "run": g["at"].iloc[:1] // SLOTS, "total": g["total"].iloc[:1],
                             **{c: [v] for c, v in slots.items()}, "top": [top]})

    n = shuffle_partitions(nodes.sparkSession)
    out, most = [], None
    while most is None or most > 1:
        nodes = nodes.withColumn("id", F.col("id").cast("string"))  # as text: pandas would make nulls doubles
        # a key holds at most 512 rows
        arrays = nodes.groupBy("g", F.expr(f"at div {SLOTS}").alias("run")).applyInPandas(
            reduce, "g string, run long, total long, leaf array<string>, id array<string>, bad array<string>, top string")
        arrays = scratch.store_bucketed(arrays, f"{name}_{len(out)}", ["g", "run"], n)
        out.append(arrays)
        nodes = arrays.select("g", F.col("run").alias("at"), F.expr(f"(total + {SLOTS - 1}) div {SLOTS}").alias("total"),
                              F.lit(None).cast("string").alias("id"), F.col("top").alias("leaf"), F.lit(None).cast("string").alias("bad"))
        most = nodes.agg(F.max("total")).first()[0] or 1
    return out


def _down(arrays: DataFrame, ways: DataFrame) -> DataFrame:
    """(g, run, way, subroot, root) of the nodes in ``arrays``, from those (g, run, ...) of the arrays' own tops."""
    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                levels = _levels(list(r.leaf), r.total <= SLOTS)
                out += [(r.g, r.run * SLOTS + i, _sides(levels, i) + r.way, r.subroot, r.root, leaf) for i, leaf in enumerate(r.leaf)]
            yield pd.DataFrame(out, columns=["g", "run", "way", "subroot", "root", "leaf"])

    return arrays.select("g", "run", "total", "leaf").join(ways, ["g", "run"]).mapInPandas(
        nodes, "g string, run long, way string, subroot string, root string, leaf string")


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang",
                    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
                    found: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified): the manifest of a table and a check against it.

    A leaf is the SHA-256 of a row's ``fields``. Leaves of a group ascend by id; every eight consecutive nodes become
    one until a group has one node, its subroot, and the subroots, by group, likewise become the root. ``found``
    says what a reader finds in place of a column: folded_root is the root that the found row and the siblings give,
    ``verified`` whether it is the right one.

    A null group is a group, before all others; null ids come first in theirs. Null fields are told from empty ones. Rows
    of one id ascend by leaf, and of equal rows each is a leaf of its own. Ids are whole numbers, other types raise.
    Further columns are not used, whatever their names. An empty table gives an empty one.
    """
    kind = docs.schema[id_col].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise TypeError(f"ids must be whole numbers, not {kind}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    group = F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0"))  # null is before all others
    leaf = leaf_digest([F.col(c) for c in fields])
    bad = leaf_digest([(found or {}).get(c, F.col(c)) for c in fields])
    leaves = docs.select(group.alias("g"), F.col(id_col).cast("long").alias("id"), leaf.alias("leaf"), bad.alias("bad"))
    leaves = scratch.store(leaves.withColumn("bad", F.nullif("bad", "leaf")), "leaves")
    trees = slot_arrays(leaf_places(leaves, scratch), scratch, "leaves")
    # The tree over the groups: its leaves are their subroots.
    tops = numbered(trees[-1].select("g", "top"), ["g"], scratch, "tops")
    n_groups = tops.count()
    over = slot_arrays(tops.select(F.lit("").alias("g"), "at", F.lit(n_groups).cast("long").alias("total"),
                                   F.col("g").alias("id"), F.col("top").alias("leaf"), F.lit(None).cast("string").alias("bad")), scratch, "groups")
    ways = over[-1].select("g", "run", F.lit("").alias("way"), F.lit("").alias("subroot"), F.col("top").alias("root"))
    for arrays in over[::-1]:
        ways = _down(arrays, ways).drop("leaf")
    ways = tops.select("g", "at", F.col("top").alias("subroot")).join(
        ways.select(F.col("run").alias("at"), "way", "root"), "at").select("g", F.lit(0).cast("long").alias("run"), "way", "subroot", "root")
    for k, arrays in enumerate(trees[:0:-1]):
        ways = scratch.store(_down(arrays, ways).drop("leaf"), f"ways-{k}")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                levels = _levels(list(r.leaf), r.total <= SLOTS)
                for i, (one, node, other) in enumerate(zip(r.id, r.leaf, r.bad)):
                    way = _sides(levels, i) + r.way
                    proof = _h([way.replace("|", "").replace(";", "")])
                    out.append((one, node, r.subroot, r.root, proof, fold(other or node, way)))
            yield pd.DataFrame(out, columns=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    done = trees[0].drop("top").join(ways, ["g", "run"]).mapInPandas(
        verify, "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    done = done.withColumn("id", F.col("id").cast("long")).withColumn("verified", F.col("folded_root") == F.col("root"))
    result = Scratch(spark, "merkle-result").store(done.withColumnRenamed("id", id_col), "manifest")
    scratch.drop()
    return result
