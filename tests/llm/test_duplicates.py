"""Jaccard classes, components and repeated passages against brute force."""

import hashlib
import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_classes(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard_classes(docs, rows, clashing, no_docs, k, percent):
    from abridge.llm.jaccard_join import jaccard_classes
    want = brute_classes([(r[0], r[1]) for r in rows], k, percent)
    assert any(a != c for a, _, c in want)
    for d in (docs, clashing):
        assert sorted(map(tuple, jaccard_classes(d, k=k, percent=percent).collect())) == want
    assert jaccard_classes(no_docs).count() == 0


@pytest.mark.parametrize("tile", [1500, 25])
def test_large_family_in_tiles(spark, monkeypatch, tile):
    """A family of near copies, some only linked through others, whole and dealt out in tiles."""
    from abridge.llm import jaccard_join as J
    monkeypatch.setattr(J, "TILE_ROWS", tile)
    monkeypatch.setattr(J, "PIVOTS", 2)
    r = random.Random(11)
    base = [f"b{i}" for i in range(80)]
    texts = []
    for i in range(110):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
            w[r.randrange(80)] = f"e{r.randrange(200)}"
        texts.append(" ".join(w))
    for i in range(12):
        base[5 * i] = f"drift{i}"
        texts.append(" ".join(base))
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, J.jaccard_classes(d, k=3, percent=90).collect()))
    want = brute_classes(rows, 3, 90)
    assert got == want and 2 < len({c for _, _, c in want}) < 100


def test_jaccard_repeated_and_null_ids(spark):
    from abridge.llm.jaccard_join import jaccard_classes
    rows = [(5, "a b c d"), (5, "x y z w"), (6, "x y z w"), (4, "a b c d"), (None, "lone words here"), (None, None)]
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(5, 2, 4), (5, 2, 4), (6, 2, 4), (4, 2, 4), (None, 1, None), (None, 0, None)], key=str)


def test_components(spark):
    from abridge.llm.common import Scratch
    from abridge.llm.components import connected_components
    r = random.Random(2)
    chain = list(range(100, 180))
    r.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(1, 2), (2, 3), (9, 9), (3, 1)] + [(7, i) for i in range(500, 540)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()))
    want = {i: 100 for i in chain} | {1: 1, 2: 1, 3: 1, 9: 9, 7: 7} | {i: 7 for i in range(500, 540)}
    assert got == want


def brute_passages(rows, length):
    data = {k: (t or "").encode() for k, (_, t) in enumerate(rows)}
    seen = {}
    for b in data.values():
        for j in range(len(b) - length + 1):
            seen[b[j:j + length]] = seen.get(b[j:j + length], 0) + 1
    out = []
    for k, (i, _) in enumerate(rows):
        b = data[k]
        gone = [False] * len(b)
        for j in range(len(b) - length + 1):
            if seen[b[j:j + length]] > 1:
                gone[j:j + length] = [True] * length
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length,block", [(400, None), (400, 2000), (60, 300), (7, 500)])
def test_repeated_passages(spark, docs, rows, clashing, monkeypatch, length, block):
    from abridge.llm import blocks
    from abridge.llm.suffix_dedup import repeated_passages
    if block:
        monkeypatch.setattr(blocks, "BLOCK_BYTES", block)
        monkeypatch.setattr(blocks.text_blocks, "__defaults__", ("blocks", block))
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    use = [r for r in rows if len(r[1] or "") < 20_000] if length < 400 else rows
    d = (clashing if block else docs).where(f"doc_id in ({','.join(str(r[0]) for r in use)})")
    got = repeated_passages(d, length=length).select(cols)
    want = brute_passages([(r[0], r[1]) for r in use], length)
    assert sorted(map(tuple, got.collect()), key=str) == want and any(x[2] for x in want)


def test_repeated_passages_within_one_document_and_empty(spark, no_docs):
    from abridge.llm.suffix_dedup import repeated_passages
    r = random.Random(4)
    p = "".join(r.choice("abcdé ") for _ in range(300))
    rows = [(1, p + "mid" + p), (None, "q" * 900), (2, "zz" + p[:150] + "k"), (2, None)]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), length=200, with_text=True)
    want = brute_passages(rows, 200)
    assert sorted((tuple(x)[:4] + (x["kept_sha256"],) for x in got.collect()), key=str) == want
    assert repeated_passages(no_docs).count() == 0


def test_passages_built_to_collide_stay(spark):
    """Thue-Morse words have equal sums of powers modulo 2**64, whatever the base; no 400 bytes repeat here."""
    from abridge.llm.suffix_dedup import repeated_passages

    def word(k, a, b):
        return "".join(b if bin(i).count("1") % 2 else a for i in range(1 << k))

    one = (word(8, "\\", "%") + "x" * 5 + word(7, "-", "Y")).ljust(400, "x")
    two = (word(8, "%", "\\") + "x" * 5 + word(7, "Y", "-")).ljust(400, "x")
    rows = [(1, one), (2, two), (3, one[:399]), (4, two[:399])]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_removed")
    assert sorted(map(tuple, got.collect())) == [(1, 0), (2, 0), (3, 0), (4, 0)]
    rows.append((5, "ab" + one))
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_removed")
    assert sorted(map(tuple, got.collect())) == [(1, 400), (2, 0), (3, 0), (4, 0), (5, 400)]


def test_fingerprints_are_polynomials_and_names_keep_their_checks():
    import numpy as np

    from abridge.llm import suffix_dedup as S
    r = np.random.default_rng(1)
    data = r.integers(0, 256, 100_000).astype(np.uint8)
    data[70_000:70_900] = data[100:1000]
    prime, points = int(S.PRIME), [2, 777, 99_999, int(S.PRIME) - 1]
    names = S.Names(data, points)
    at = np.array([0, 5, S.STEP - 1, S.STEP, 99_600])
    for point in points:
        want = [sum(int(c) * pow(point, i, prime) for i, c in enumerate(data[a:a + 400].tolist())) % prime for a in at]
        assert names._word(point, at, 400).tolist() == want
    at = np.arange(100, 601)
    for x, y in zip(names.long(at, 400), names.long(at + 69_900, 400)):
        assert (x == y).all() and len(set(x.tolist())) == len(at)
    keys, checks = np.array([7, 3, 7, 7, 3], np.uint64), np.array([1, 0, 2, 1, 0], np.uint64)
    k, c, count, index = S.distinct(keys, checks)  # one key, two strings
    assert (k.tolist(), c.tolist(), count.tolist()) == ([3, 7, 7], [0, 1, 2], [2, 2, 1]) and index.tolist() == [1, 0, 2, 1, 0]
    assert S.from_low_bytes(S.low_bytes(checks, 3), 5, 3).tolist() == checks.tolist()
    assert S.from_low_bytes(S.low_bytes(checks, 0), 5, 0).tolist() == [0] * 5


@pytest.mark.parametrize("r", [0, 1, 2, 3])
def test_difference_cover(r):
    from abridge.llm.suffix_dedup import cover_for, difference_cover
    v, d = difference_cover(r)
    assert len({(int(a) - int(b)) % v for a in d for b in d}) == v and d.max() < v
    assert cover_for(400)[0] <= 200


def test_pipeline_near_dedup_leaves_one_row_of_each_class(spark):
    from corpus_pipeline import near_dedup
    a, b = "a b c d e f g h i j k l m n o p", "q r s t u v w x y z 1 2 3 4 5 6"
    near = a + " " + a.replace("p", "p2")
    rows = [(5, a), (5, b), (6, b.upper()), (4, a.upper()), (None, "lone words here"), (None, near), (None, near.upper()),
            (9, near + " end"), (None, None), (None, "q q q q q q"), (None, "Q q q q q q"), (7, b)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    d.count()
    got = near_dedup(spark, d, "")
    assert got.columns == d.columns
    kept = sorted(((i, (t or "").lower()) for i, t in got.collect()), key=str)
    assert kept == sorted([(4, a), (5, b), (None, "lone words here"), (9, near + " end"), (None, ""), (None, "q q q q q q")],
                          key=str)


@pytest.mark.parametrize("copies", [1, 3_000])
def test_pipeline_dedup_leaves_one_row_of_each_group(spark, copies):
    """Repeated rows and null ids, also of texts that are dealt over several ranges."""
    from corpus_pipeline import dedup
    rows = [(5, "Same"), (5, "same"), (4, "SAME"), (None, "same"), (None, "no id"), (None, "No id"), (7, "one"),
            (5, "other"), (None, None), (None, "")] * copies
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    d.count()
    got = dedup(spark, d, "")
    assert got.columns == d.columns
    assert sorted(((i, (t or "").lower()) for i, t in got.collect()), key=str) == sorted(
        [(5, "same"), (None, "no id"), (7, "one"), (5, "other"), (None, "")], key=str)
