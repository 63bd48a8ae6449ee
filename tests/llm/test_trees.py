"""Conversation trie and Merkle manifest against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

TURNS = "conv_id long, turn long, role string, text string"
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(set)
    for key in members:
        if key:
            kids[key[:-1]].add(key)
    leaves, saved = defaultdict(int), defaultdict(int)
    for key, m in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not kids[key]
            saved[key[:d]] += (len(m) - 1) * len(key[-1][1]) if key else 0
    out = []
    for key, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(key))
        out.append((min(m), len(key), min(members[key[:-1]]) if key else None, len(m), len(kids[key]), leaves[key],
                    saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def odd_turns(seed=3):
    r = random.Random(seed)
    say = lambda: (r.choice(["user", "assistant", None]), r.choice(["ok", "Ünï", "a", "a", "", None, "x" * 50]))
    rows = []
    start = [say() for _ in range(12)]
    for c in list(range(95, 330, 3)) + [100, 200, 300, -1, -100, -107, 10 ** 12]:
        talk = start[:r.randrange(12)] + [say() for _ in range(r.randrange(1, 9))]
        rows += [(c, i, *t) for i, t in enumerate(talk)]
    rows += [(700 + i, j, "user", f"same {j}") for i in range(30) for j in range(20)]   # equal conversations
    rows += [(900 + i, j, "user", f"same {j}" if j < 18 else f"{i}") for i in range(40) for j in range(19)]
    rows += [(5000, j, "user", f"long {j}") for j in range(70)] + [(5100, j, "user", f"long {j}") for j in range(64)]
    rows += [(5200, None, "user", "first"), (5200, 3, "user", "tie"), (5200, 3, "assistant", "tie"), (5200, 3, "user", "tie")]
    rows += [(None, 0, "user", "nobody"), (5200, 3, "user", "tie"), (5300, 0, "user", "word " * 40_000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seg,weight,tries", [(256, 1 << 18, 32), (16, 1 << 18, 1), (4, 40, 2), (64, 150, 32)])
def test_trie(spark, monkeypatch, seg, weight, tries):
    """Whole, in many bands, with hot prefixes split far down, with few tries for a place in the arrays."""
    from abridge.llm import conversation_trie as T
    monkeypatch.setattr(T, "SEG", seg)
    monkeypatch.setattr(T, "MARKS", [1 << i for i in range(seg.bit_length())])
    monkeypatch.setattr(T, "SHARD_TURNS", weight)
    monkeypatch.setattr(T, "TRIES", tries)
    rows = odd_turns()
    turns = spark.createDataFrame(rows, TURNS).repartition(4)
    turns = turns.withColumns({c: F.lit("x") for c in COLS[1:] + ["family", "place", "size", "band", "root", "m", "marks", "path", "q", "cut"]})
    got = T.conversation_trie(turns)
    assert got.columns == COLS
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rows)


def test_trie_small_tables(spark):
    from abridge.llm.conversation_trie import conversation_trie
    assert conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    turnless = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)  # its hundred has no first conversation
    rows = [(turnless, 0, "user", "gone")]
    assert sorted(map(tuple, conversation_trie(spark.createDataFrame(rows, TURNS)).collect()), key=repr) == brute_trie(rows)
    with pytest.raises(TypeError):
        conversation_trie(spark.createDataFrame([("a", 0, "user", "x")], "conv_id string, turn int, role string, text string"))


def test_double_array_holds_what_was_put_in():
    import numpy as np
    from abridge.llm.conversation_trie import DoubleArray
    r = random.Random(1)
    trie, cells, at = DoubleArray(), {(): 0}, [()]
    for _ in range(6):
        pairs = sorted({(cells[k], r.randrange(1, 500)) for k in at for _ in range(r.choice([1, 1, 2, 9]))})
        parents, symbols = (np.array(x) for x in zip(*pairs))
        trie.insert(parents, symbols)
        name = {v: k for k, v in cells.items()}
        at = []
        for p, s, cell in zip(parents, symbols, trie.follow(parents, symbols)):
            at.append((*name[p], s))
            cells[at[-1]] = int(cell)
    assert len(set(cells.values())) == len(cells)
    for key, cell in cells.items():
        here = 0
        for s in key:
            here = int(trie.follow(np.array([here]), np.array([s]))[0])
        assert here == cell


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_manifest(rows, found):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, lang, source, n: sha("".join(map(field, (i, source, lang, n, t))))
    groups = defaultdict(list)
    for i, t, lang, source, n in rows:
        one = leaf(i, t, lang, source, n)
        groups[(lang is not None, (lang or "").encode())].append(((i is not None, i or 0), one, leaf(i, found(i, t), lang, source, n), i))

    def tree(nodes):
        ways, where = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, at in enumerate(where):
                first = at - at % 8
                ways[k].append((nodes[first:at], nodes[at + 1:first + 8]))
                where[k] = at // 8
            nodes = [sha("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
        return nodes[0], ways

    keys = sorted(groups)
    parts = {k: sorted(groups[k], key=lambda x: x[:2]) for k in keys}
    trees = {k: tree([x[1] for x in parts[k]]) for k in keys}
    root, over = tree([trees[k][0] for k in keys]) if keys else (None, [])
    out = []
    for k, up in zip(keys, over):
        for (_, one, other, i), way in zip(parts[k], trees[k][1]):
            way = way + up
            cur = other
            for left, right in way:
                cur = sha("".join([*left, cur, *right]))
            out.append((i, one, trees[k][0], root, sha("".join("".join(a + b) for a, b in way)), cur, cur == root))
    return sorted(out, key=repr)


def tamper(i, t):
    if t is None or i is None or zlib.crc32(str(i).encode()) % 3:
        return t
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def manifest(spark, df):
    from abridge.llm.common import lower_ascii
    from abridge.llm.merkle import merkle_manifest
    from abridge.llm.queries import id_crc
    text = F.when(F.col("text").isNotNull() & (id_crc("doc_id") % 3 == 0), lower_ascii("text")).otherwise(F.col("text"))
    return sorted(map(tuple, merkle_manifest(df, found={"text": text}).collect()), key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_manifest(spark, docs, rows, clashing):
    for d in (docs, clashing):
        assert manifest(spark, d) == brute_manifest(rows, tamper)
    assert not all(r[-1] for r in brute_manifest(rows, tamper))


@pytest.mark.parametrize("n", [0, 1, 8, 9, 512, 513, 5000])
def test_manifest_sizes(spark, n):
    """From no leaf to three passes; ids of all signs and widths, many groups, a null group, null fields."""
    r = random.Random(n)
    ids = r.sample(range(-3000, 6000), n // 2) + [r.randrange(-(1 << 63), 1 << 63) for _ in range(n - n // 2)]
    rows = [(i, r.choice(["A", None, "", "Long " * 9]), "en" if k % 3 else r.choice([None, "", "-", "é", "z", "\U0001f600"]),
             r.choice([None, "-", "s"]), r.choice([None, 3])) for k, i in enumerate(ids)]
    assert manifest(spark, spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute_manifest(rows, tamper)


def test_manifest_repeated_and_null_ids(spark, monkeypatch):
    from abridge.llm import merkle as M
    monkeypatch.setattr(M, "COPIES", 7)
    r = random.Random(2)
    rows = [(r.choice([5, 5, 5, 6, 63, 64, None, -1, 1 << 40]), r.choice("ABCDEFGHIJ") * r.randrange(3), "en", "s", 1) for _ in range(700)]
    rows += [(5, "A", "en", "s", 1)] * 90
    assert manifest(spark, spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute_manifest(rows, tamper)
    with pytest.raises(TypeError):
        M.merkle_manifest(spark.createDataFrame([("a", "t", "en", "s", 1)], SCHEMA.replace("doc_id long", "doc_id string")))
