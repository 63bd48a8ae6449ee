"""Prefix trie of conversations: double-array tries by prefix shard, shared upper nodes merged globally.

1. Conversations are rebuilt in one pass over the sorted turns (a turn is the 128-bit digest of role and text) and written as
   segments of at most ``SEG`` turns; a segment hangs on the node where the one before it ends. Equal segments are counted.
2. Band by band, the deepest first, segments go to the shard of a prefix: the shortest prefix of 1, 2, 4, ... turns
   that does not weigh more than ``SHARD_TURNS``. Hot prefixes so are split further down, whatever they share above.
3. A task packs the BASE and CHECK arrays of its shards over dense turn ids, traverses its segments and sums up subtrees.
4. Nodes above the shards are met by segments of many shards: their counts are merged by their path digest, and
   their subtrees' sums are added level by level. A band's roots hand their sums to the band above.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abridge.llm.common import Scratch, shuffle_partitions, text_of

SEG = 256                # turns of a segment; a power of 2
MARKS = [1 << i for i in range(SEG.bit_length())]  # prefix lengths that may become a shard
SHARD_TURNS = 1 << 18    # a shard's segments have no more turns, or it is split
BIN_TURNS = 1 << 17      # turns of the shards that one task handles together
FAMILY = 100             # conversations of a hundred begin like its first
TRIES = 32               # free cells tried for a node of several children before it goes to the end of the arrays
ROOT = bytes(16)
NODE = ("path binary, parent binary, depth int, local int, conv_id long, parent_conv_id long, n_convs long, "
        "n_children long, n_leaves long, saved_tokens long")


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of the SHA-256 of role and text; the role's length keeps them apart."""
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def step(path: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(path + turn, digest_size=16).digest()


def borrowed_turns(conv_id: int) -> int:
    """Turns that a conversation takes from the first of its hundred."""
    return zlib.crc32(str(conv_id).encode()) % 6


class _Segments:
    """Segments of one conversation after the other."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def open(self, conv_id: int) -> None:
        self.conv_id, self.band, self.path = conv_id, 0, ROOT
        self._clear()

    def _clear(self) -> None:
        self.root, self.turns, self.sizes, self.marks = self.path, [], [], []

    def _emit(self, ends: bool) -> None:
        self.rows.append((self.conv_id, self.band, self.root, len(self.turns), b"".join(self.turns),
                          np.array(self.sizes, np.uint32).tobytes(), self.marks, self.path, ends))

    def add(self, turn: bytes, size: int) -> None:
        if len(self.turns) == SEG:
            self._emit(False)
            self.band += 1
            self._clear()
        self.path = step(self.path, turn)
        self.turns.append(turn)
        self.sizes.append(size)
        if len(self.turns) & (len(self.turns) - 1) == 0:
            self.marks.append(self.path)

    def close(self) -> None:
        self._emit(True)

    def take(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        return pd.DataFrame(rows, columns=["conv_id", "band", "root", "m", "turns", "sizes", "marks", "end", "ends"])


def _rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments of the rebuilt conversations; the rows come sorted, the first conversation of a hundred before the others."""
    out = _Segments()
    family = conv_id = None
    first: list[tuple[bytes, int]] = []
    place = skip = 0
    for batch in batches:
        for fam, conv, turn, size in zip(batch["family"].tolist(), batch["conv_id"].tolist(), batch["turn"], batch["size"].tolist()):
            turn = bytes(turn)
            if conv != conv_id:
                if conv_id is not None:
                    out.close()
                if fam != family:
                    family, first = fam, []
                conv_id, place = conv, 0
                out.open(conv)
                skip = 0 if conv == fam else borrowed_turns(conv)
                for t in first[:skip]:
                    out.add(*t)
            place += 1
            if conv == fam and place < 6:
                first.append((turn, size))
            if place > skip:
                out.add(turn, size)
        yield out.take()
    if conv_id is not None:
        out.close()
        yield out.take()


def _end_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, ends_sha256) from (end, conv_id) in order; a node's ids run through the hash and are not held."""
    path, h = None, None
    for batch in batches:
        out = []
        for end, conv in zip(batch["end"], batch["conv_id"].tolist()):
            end = bytes(end)
            if end != path:
                if path is not None:
                    out.append((path, h.hexdigest()))
                path, h = end, hashlib.sha256(str(conv).encode())
            else:
                h.update(b",%d" % conv)
        yield pd.DataFrame(out, columns=["path", "ends_sha256"])
    if path is not None:
        yield pd.DataFrame([(path, h.hexdigest())], columns=["path", "ends_sha256"])


class DoubleArray:
    """BASE and CHECK over dense symbol ids: the child of cell s by symbol x is ``BASE[s] + x`` if its CHECK is s."""

    def __init__(self) -> None:
        self.base = np.zeros(1024, np.int64)
        self.check = np.full(1024, -1, np.int64)
        self.check[0] = -2  # the root's cell
        self.top = 1        # cells from here on are free

    def _room(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def insert(self, parents: np.ndarray, symbols: np.ndarray) -> None:
        """Place the children of cells without children; (parent, symbol) are distinct and ascending."""
        cut = np.flatnonzero(np.diff(parents, prepend=-1))
        size = np.diff(np.append(cut, len(parents)))
        holes = np.flatnonzero(self.check[:self.top] == -1)
        for a, k in zip(cut[size > 1].tolist(), size[size > 1].tolist()):
            s = symbols[a:a + k]
            cells = None
            for f in holes[:TRIES]:
                trial = s + (f - s[0])
                if trial[-1] < self.top and (self.check[trial] == -1).all():
                    cells = trial
                    break
            if cells is None:
                cells = s + (self.top - s[0])
                self.top = int(cells[-1]) + 1
                self._room(self.top)
            self.base[parents[a]] = cells[0] - s[0]
            self.check[cells] = parents[a]
        one = cut[size == 1]
        holes = np.flatnonzero(self.check[:self.top] == -1)[:len(one)]
        cells = np.concatenate([holes, np.arange(self.top, self.top + len(one) - len(holes))])
        self.top += len(one) - len(holes)
        self._room(self.top)
        self.base[parents[one]] = cells - symbols[one]
        self.check[cells] = parents[one]

    def follow(self, cells: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        found = self.base[cells] + symbols
        if (self.check[found] != cells).any():
            raise AssertionError("a sequence left its trie")
        return found


def shard_nodes(segments: pd.DataFrame) -> pd.DataFrame:
    """The nodes of shards from their top node on, from segments (turns, sizes, m, q, cut, ...).

    The first symbol of a segment is its shard's top, then come its turns after the ``q``-th.
    """
    k = len(segments)
    q, m = segments["q"].to_numpy(), segments["m"].to_numpy()
    cuts = [bytes(x) for x in segments["cut"]]
    turns = [bytes(x) for x in segments["turns"]]
    sizes = [np.frombuffer(x, np.uint32) for x in segments["sizes"]]
    weight, conv = segments["n"].to_numpy(), segments["conv_id"].to_numpy()
    length = m - q + 1
    dense: dict[bytes, int] = {}
    trie = DoubleArray()
    state = np.zeros(k, np.int64)
    levels = []  # (cells, parents' cells, a segment of each)
    for level in range(int(length.max())):
        live = np.flatnonzero(length > level)
        live = live[np.argsort(state[live], kind="stable")]
        at = [(int(q[i]) + level - 1) * 16 for i in live]
        symbols = np.fromiter((dense.setdefault(cuts[i] if level == 0 else turns[i][a:a + 16], len(dense) + 1)
                               for i, a in zip(live, at)), np.int64, len(live))
        width = len(dense) + 1
        key, some = np.unique(state[live] * width + symbols, return_index=True)
        trie.insert(key // width, key % width)
        state[live] = trie.follow(state[live], symbols)
        levels.append((state[live[some]], key // width, live[some], live, state[live].copy()))
    n = np.zeros(trie.top, np.int64)
    low = np.full(trie.top, np.iinfo(np.int64).max)
    children, leaves, saved = (np.zeros(trie.top, np.int64) for _ in range(3))
    for _, _, _, live, cells in levels:
        np.add.at(n, cells, weight[live])
        np.minimum.at(low, cells, conv[live])
    grafted = np.flatnonzero(segments["g_children"].notna().to_numpy())
    for i in grafted:
        children[state[i]] += int(segments["g_children"].iloc[i])
        leaves[state[i]] += int(segments["g_leaves"].iloc[i])
        saved[state[i]] += int(segments["g_saved"].iloc[i])
    for level in range(len(levels) - 1, -1, -1):
        cells, parents, some = levels[level][:3]
        leaves[cells[children[cells] == 0]] = 1
        size = np.array([sizes[i][q[i] + level - 1] for i in some], np.int64)
        saved[cells] += (n[cells] - 1) * size
        if level:
            np.add.at(children, parents, 1)
            np.add.at(leaves, parents, leaves[cells])
            np.add.at(saved, parents, saved[cells])
    paths: dict[int, bytes] = {}
    out = []
    for level, (cells, parents, some, _, _) in enumerate(levels):
        for cell, up, i in zip(cells.tolist(), parents.tolist(), some.tolist()):
            if level == 0:
                path, parent, parent_conv = cuts[i], bytes(segments["root"].iloc[i]), None
                for j in range(int(q[i]) - 1):
                    parent = step(parent, turns[i][16 * j:16 * j + 16])
            else:
                a = (int(q[i]) + level - 1) * 16
                parent, parent_conv = paths[up], low[up]
                path = step(parent, turns[i][a:a + 16])
            paths[cell] = path
            local = int(q[i]) + level
            out.append((path, parent, int(segments["band"].iloc[i]) * SEG + local, local, low[cell], parent_conv, n[cell],
                        children[cell], leaves[cell], saved[cell]))
    done = pd.DataFrame(out, columns=[c.split()[0] for c in NODE.split(", ")])
    done["parent_conv_id"] = done["parent_conv_id"].astype("Int64")
    return done


def _upper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each node above the shard of a segment, or for each of its nodes if it has no shard."""
    for batch in batches:
        out = []
        for r in batch.itertuples():
            path, size = bytes(r.root), np.frombuffer(r.sizes, np.uint32)
            for j in range(min(r.q - 1, r.m)):
                parent, path = path, step(path, bytes(r.turns[16 * j:16 * j + 16]))
                out.append((path, parent, r.band * SEG + j + 1, j + 1, int(size[j]), r.conv_id, r.n))
        yield pd.DataFrame(out, columns=["path", "parent", "depth", "local", "size", "conv_id", "n_convs"])


def _shards(segments: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Segments with ``cut``, their shard's path (null: none), and ``q``, its length (without a shard, m + 1)."""
    active, parts = segments, []
    for j, q in enumerate(MARKS):
        parts.append(active.where(F.col("m") < q).withColumns({"cut": F.lit(None).cast("binary"), "q": F.col("m") + 1}))
        marked = active.where(F.col("m") >= q).withColumns({"cut": F.element_at("marks", j + 1), "q": F.lit(q)})
        hot = marked.groupBy("cut").agg(F.sum("m").alias("_w")).where(F.col("_w") > SHARD_TURNS).select("cut")
        hot = scratch.store(hot, f"{name}-hot-{q}")
        if q == SEG or hot.isEmpty():  # at SEG turns a prefix has at most two distinct segments
            parts.append(marked)
            break
        parts.append(marked.join(hot, "cut", "left_anti").select(marked.columns))
        active = marked.join(hot, "cut", "left_semi").select(segments.columns)
    return scratch.store(reduce(DataFrame.unionByName, parts), f"{name}-shards")


def _sums(kids: DataFrame) -> DataFrame:
    return kids.groupBy(F.col("parent").alias("path")).agg(
        F.count(F.lit(1)).alias("g_children"), F.sum("n_leaves").alias("g_leaves"), F.sum("saved_tokens").alias("g_saved"))


def _band(segments: DataFrame, below: DataFrame | None, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(nodes of a band, the sums of their roots); ``below`` are the sums of the band under it."""
    shards = _shards(segments, scratch, name)
    deep = shards.where("cut is not null")
    if below is None:
        deep = deep.withColumns({c: F.lit(None).cast("long") for c in ("g_children", "g_leaves", "g_saved")})
    else:  # only what goes on below its last turn takes them
        deep = deep.withColumn("_on", F.when(~F.col("ends"), F.col("end"))).join(
            below.withColumnRenamed("path", "_on"), "_on", "left").drop("_on")
    turns = deep.agg(F.coalesce(F.sum(F.col("m") - F.col("q") + 1), F.lit(0))).first()[0]
    bins = max(shuffle_partitions(segments.sparkSession), -(-turns // BIN_TURNS))
    nodes = deep.withColumn("_bin", F.pmod(F.xxhash64("cut"), F.lit(bins))).groupBy("_bin").applyInPandas(shard_nodes, NODE)
    nodes = scratch.store(nodes, f"{name}-nodes")
    upper = shards.where("q > 1").select("root", "turns", "sizes", "m", "q", "band", "conv_id", "n").mapInPandas(
        _upper, "path binary, parent binary, depth int, local int, size long, conv_id long, n_convs long")
    upper = upper.groupBy("path").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("local").alias("local"),
                                      F.first("size").alias("size"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    upper = scratch.store(upper, f"{name}-upper")
    tops = nodes.where("parent_conv_id is null")
    kids = None
    for d in range(upper.agg(F.max("local")).first()[0] or 0, 0, -1):
        under = tops.where(F.col("local") == d + 1)
        under = under if kids is None else under.unionByName(kids)
        some = upper.where(F.col("local") == d).join(_sums(under), "path", "left")
        kids = scratch.store(some.select(
            "path", "parent", "depth", "local", "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
            F.coalesce("g_children", F.lit(0)).alias("n_children"), F.coalesce("g_leaves", F.lit(1)).alias("n_leaves"),
            (F.coalesce("g_saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens")), f"{name}-upper-{d}")
        nodes = nodes.unionByName(kids)
    first = tops.where("local = 1")
    return nodes, scratch.store(_sums(first if kids is None else first.unionByName(kids)), f"{name}-roots")


def conversation_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text") -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256), see the queries' contract.

    Conversation c is rebuilt from the first crc32(c) mod 6 turns of conversation ``c - c % 100`` (the remainder has c's
    sign) and its own turns after as many. Turns are in order of ``turn``, null first; turns of one number, wholly
    repeated rows too, are turns of their own in the order of their digest. Null roles and texts are empty. Rows
    without a conversation id belong to no conversation. Ids are whole numbers, other types raise. Further columns
    are not used, whatever their names. An empty table gives no node, not even a root. Turns are told apart by 128 bits.
    """
    kind = turns.schema[conv_col].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise TypeError(f"ids must be whole numbers, not {kind}")
    scratch = Scratch(turns.sparkSession, "trie")
    parts = shuffle_partitions(turns.sparkSession)
    conv, role, text = F.col(conv_col).cast("long"), text_of(role_col), text_of(text_col)
    rows = turns.where(conv.isNotNull()).select(
        (conv - conv % FAMILY).alias("family"), conv.alias("conv_id"), F.col(turn_col).alias("place"),
        turn_digest(role, text).alias("turn"), F.length(text).cast("long").alias("size"))
    rows = rows.repartition(parts, "family").sortWithinPartitions(
        "family", F.col("conv_id") != F.col("family"), "conv_id", F.col("place").asc_nulls_first(), "turn")
    raw = scratch.store(rows.drop("place").mapInPandas(
        _rebuild, "conv_id long, band int, root binary, m int, turns binary, sizes binary, marks array<binary>, end binary, ends boolean"), "raw")
    ends = raw.where("ends").select("end", "conv_id").repartition(parts, "end").sortWithinPartitions("end", "conv_id")
    ends = ends.mapInPandas(_end_digests, "path binary, ends_sha256 string")
    carried = [F.first(c).alias(c) for c in ("band", "root", "m", "turns", "sizes", "marks")]
    segments = raw.groupBy("end", "ends").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), *carried)
    segments = scratch.store(segments, "segments")
    nodes, below = [], None
    for band in range(segments.agg(F.max("band")).first()[0] or 0, -1, -1):
        some, below = _band(segments.where(F.col("band") == band), below, scratch, f"band-{band}")
        nodes.append(some)
    top = raw.where("band = 0").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    zero = F.lit(bytearray(ROOT))
    top = top.withColumn("path", zero).join(below, "path", "left").select(
        "path", F.lit(None).cast("binary").alias("parent"), F.lit(0).alias("depth"), F.lit(0).alias("local"), "conv_id",
        F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("g_children", F.lit(0)).alias("n_children"),
        F.coalesce("g_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("g_saved", F.lit(0)).alias("saved_tokens"))
    every = scratch.store(reduce(DataFrame.unionByName, [*nodes, top]), "nodes")
    # Parents beyond a shard are upper nodes, ends of a band or the root.
    loose = F.col("parent_conv_id").isNull()
    heads = every.where(loose | (F.col("local") == SEG)).select(F.col("path").alias("parent"), F.col("conv_id").alias("_conv"))
    found = every.where(loose).join(heads, "parent", "left").withColumn("parent_conv_id", F.col("_conv")).drop("_conv")
    every = every.where(~loose).unionByName(found).join(ends, "path", "left")
    done = every.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
                        "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
    result = Scratch(turns.sparkSession, "trie-result").store(done, "nodes")
    scratch.drop()
    return result
