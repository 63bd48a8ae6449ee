"""The quality classifier against a model in plain Python, and the pipeline stage by stage against brute force."""

import math
import random
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_duplicates import brute_classes, lower


def plain_features(text):
    """4-byte runs hashed to 16 bits, the length class, and the share of distinct runs in it."""
    data, mask, grams = text.encode(), 0xFFFFFFFF, set()
    for i in range(len(data) - 3):
        h = sum(b * k for b, k in zip(data[i:i + 4], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))) & mask
        h ^= h >> 15
        grams.add(((h * 0x2C1B3C6D) & mask) >> 16)
    length = min(15, len(data).bit_length())
    variety = min(31, int(32 * len(grams) / max(1, len(data))))
    return grams | {65536 + length, 65536 + 32 + 32 * length + variety}


def plain_model(texts, labels):
    """Naive Bayes ratios, dual steps one row at a time, margins of thirds calibrated: text -> score."""
    n_features = 65536 + 1024
    feats = [sorted(plain_features(t)) for t in texts]
    y = [1 if x > 0 else -1 for x in labels]
    count = {1: Counter(), -1: Counter()}
    for f, c in zip(feats, y):
        count[c].update(f)
    total = {c: n_features + sum(count[c].values()) for c in count}
    ratio = lambda f: math.log((count[1][f] + 1) / total[1]) - math.log((count[-1][f] + 1) / total[-1])

    def scaled(f):
        v = [ratio(x) for x in f]
        size = math.sqrt(sum(x * x for x in v) + 1e-12)
        return [x / size for x in v]

    values = [scaled(f) for f in feats]
    cost = [len(y) / 2 / y.count(c) for c in y]

    def steps(some):
        w, bias, alpha = Counter(), 0.0, [0.0] * len(some)
        order = np.random.default_rng(7)
        for _ in range(12):
            most = 0.0
            for k in order.permutation(len(some)):
                i = some[k]
                slack = 0.5 / cost[i]
                g = y[i] * (sum(w[f] * v for f, v in zip(feats[i], values[i])) + bias) - 1 + slack * alpha[k]
                new = max(alpha[k] - g / (sum(v * v for v in values[i]) + 1 + slack), 0.0)
                move = (new - alpha[k]) * y[i]
                if move:
                    for f, v in zip(feats[i], values[i]):
                        w[f] += move * v
                    bias += move
                    alpha[k] = new
                    most = max(most, abs(move))
            if most < 1e-3:
                break
        return w, bias

    margin = [0.0] * len(y)
    for third in range(3):
        w, b = steps([i for i in range(len(y)) if i % 3 != third])
        for i in range(third, len(y), 3):
            margin[i] = sum(w[f] * v for f, v in zip(feats[i], values[i])) + b
    pos, neg = y.count(1), y.count(-1)
    target = [(pos + 1) / (pos + 2) if c > 0 else 1 / (neg + 2) for c in y]
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = [1 / (1 + math.exp(-max(-30, min(30, slope * m + shift)))) for m in margin]
        h = [q * (1 - q) + 1e-6 for q in p]
        a, b, d = sum(k * m * m for k, m in zip(h, margin)) + 1e-3, sum(k * m for k, m in zip(h, margin)), sum(h) + 1e-3
        g1 = sum(m * (q - t) for m, q, t in zip(margin, p, target)) + 1e-3 * (slope - 1)
        g2 = sum(q - t for q, t in zip(p, target)) + 1e-3 * shift
        det = a * d - b * b
        s1, s2 = (d * g1 - b * g2) / det, (a * g2 - b * g1) / det
        slope, shift = slope - s1, shift - s2
        if max(abs(s1), abs(s2)) < 1e-6:
            break
    w, bias = steps(list(range(len(y))))

    def score(text):
        f = sorted(plain_features(text))
        z = slope * (sum(w[x] * v for x, v in zip(f, scaled(f))) + bias) + shift
        return 1 / (1 + math.exp(-max(-30, min(30, z))))
    return score


def test_classifier_equals_a_plain_model(spark):
    from pyspark.sql import functions as F

    from abridge.llm.nb_svm import fit, score, training_rows
    r = random.Random(6)
    words = ["the", "cat", "looked", "naïve", "of", "and", "river", "stone"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(4, 14))) + ("" if i % 2 else " buy now!! $$ click") for i in range(50)]
    labels = [i % 2 if i % 9 else 1 - i % 2 for i in range(50)]
    d = spark.createDataFrame(list(enumerate(texts + ["", "a", "é", "漢字" * 300])), "doc_id long, text string")
    lab = spark.createDataFrame([(i, x, 0) for i, x in enumerate(labels)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x["score"] for x in score(d, fit(*training_rows(d, lab, F.lit(True)))).collect()}
    plain = plain_model(texts, labels)
    for row in d.collect():
        assert got[row["doc_id"]] == pytest.approx(plain(row["text"]), abs=1e-4), row["text"][:40]


def write_tables(spark, docs, labels):
    from abridge.llm.common import shared_folder
    folder = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline_stage_by_stage(spark, rows):
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    from abridge.llm.nb_svm import fit, score, training_rows
    from abridge.llm.queries import id_crc, table, tokenizer_path
    from abridge.llm.mixing import mix
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_parts string, whole string, _row string"
    more = [(None, "one", "en", "a", 1), (None, "One", "en", "b", 1), (5, "five five", "en", "a", 1), (5, "five FIVE", "en", "a", 1)]
    docs = spark.createDataFrame([(*r, "k", "p", "w", "r") for r in rows + more], schema).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, len(rows), 2)], "doc_id long, quality int, toxic int")
    folder = write_tables(spark, docs, labels)
    now, seen = table(spark, folder, "documents"), {}
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == docs.columns, name
        path = f"{folder}/{name}"
        now.write.parquet(path)
        now = spark.read.parquet(path)
        seen[name] = [tuple(r) for r in now.collect()]
    model = fit(*training_rows(docs, labels, id_crc("_id") % 3 != 1))
    good = [tuple(r)[:-1] for r in score(table(spark, folder, "documents"), model, carry=True).collect() if r["score"] >= P.REJECT_BELOW]
    assert Counter(seen["quality_classifier"]) == Counter(good) and 0 < len(good) < docs.count()
    groups = {}
    for r in good:
        groups.setdefault(lower(r[1]), []).append(r)
    least = lambda r: -1 if r[0] is None else r[0]
    assert len(seen["exact_dedup"]) == len(groups)
    for r in seen["exact_dedup"]:
        assert least(r) == max(map(least, groups[lower(r[1])]))
    entry = seen["exact_dedup"]
    classes = brute_classes([(i, r[1]) for i, r in enumerate(entry)], P.SHINGLE, P.PERCENT)
    of = {lower(entry[i][1]): c for i, _, c in classes}
    assert len(seen["ngram_jaccard_join"]) == len(set(of.values()))
    first = {}
    for i, _, c in classes:
        first.setdefault(c, []).append(entry[i][0] if entry[i][0] is not None else float("inf"))
    for r in seen["ngram_jaccard_join"]:
        assert (r[0] if r[0] is not None else float("inf")) == min(first[of[lower(r[1])]])
    copies = Counter()
    for r in mix(spark.createDataFrame(seen["ngram_jaccard_join"], schema)).collect():
        copies[tuple(r)[:len(docs.columns)]] += r["copies"]
    assert Counter(seen["source_mixing"]) == +copies
    packed = P.STAGES[-1][1](spark, now, folder).collect()
    whole = P.run(spark, folder).collect()
    piece = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(piece, whole)) == Counter(map(piece, packed))
    t = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in seen["source_mixing"]:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want[(r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    short = Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in whole if r["length"] <= 1024 and r["piece"] == 0 and r["start"] == 0)
    assert all(short[k] >= n for k, n in want.items() if k[1] <= 1024)
    assert sum(r["length"] for r in whole) == sum(k[1] * n for k, n in want.items())
    used = Counter()
    for r in whole:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024


def test_pipeline_of_empty_tables(spark, no_docs):
    import corpus_pipeline as P
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert P.run(spark, write_tables(spark, no_docs, labels)).count() == 0
