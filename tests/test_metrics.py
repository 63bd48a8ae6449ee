"""ROUGE / LCS / EM / F1: goldens, brute force and properties."""

import random

import numpy as np
from pyspark.sql import functions as F

from abridge.functions.metrics import exact_match, finish_rouge, lcs_length, rouge_columns, token_f1
from abridge.functions.tokens import rouge_tokens


def dp_lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(cur[-1], prev[j + 1]))
        prev = cur
    return prev[-1]


def test_lcs_bit_parallel_matches_dp():
    rng = random.Random(7)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randrange(0, 90))]
        b = [rng.randrange(6) for _ in range(rng.randrange(0, 90))]
        assert lcs_length(np.array(a), np.array(b)) == dp_lcs(a, b)


def _words(n, tag):
    return " ".join(f"{tag}w{i}" for i in range(n))


def test_prefix_golden_scores(spark):
    """Published selective-context numbers follow from prefixes of 53/54/48-word texts."""
    texts = [_words(53, "a"), _words(54, "b"), _words(48, "c")]
    cases = {  # ratio: (prompts used, prefix lengths, expected mean rougeL, expected mean rouge2)
        0.25: (2, [14, 13], 0.40298507, 0.38461538),
        0.1: (3, [6, 5, 5], 0.18718687, None),
        0.5: (3, [27, 27, 25], 0.67553272, None),
    }
    for ratio, (n, lens, exp_l, exp_2) in cases.items():
        rows = [(t, " ".join(t.split()[:k])) for t, k in zip(texts[:n], lens)]
        df = spark.createDataFrame(rows, "ref string, cand string")
        s = finish_rouge(df.select(*rouge_columns(rouge_tokens("ref"), rouge_tokens("cand"))))
        got = s.agg(F.avg("rougeL").alias("l"), F.avg("rouge1").alias("r1"), F.avg("rouge2").alias("r2")).first()
        assert abs(got.l - exp_l) < 1e-7 and abs(got.r1 - exp_l) < 1e-7
        if exp_2 is not None:
            assert abs(got.r2 - exp_2) < 1e-7


def test_rouge_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = ["alpha", "beta", "gamma", "delta", "eps", "Zeta!", "eta,", "x1"]
    rows = []
    for _ in range(60):
        rows.append((" ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 40))),
                     " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 40)))))
    df = spark.createDataFrame(rows, "ref string, cand string")
    got = finish_rouge(df.select("ref", "cand", *rouge_columns(rouge_tokens("ref"), rouge_tokens("cand")))).collect()
    import re
    from collections import Counter
    for g in got:
        a = re.findall("[a-z0-9]+", g.ref.lower())
        b = re.findall("[a-z0-9]+", g.cand.lower())
        h1 = sum((Counter(a) & Counter(b)).values())
        h2 = sum((Counter(zip(a, a[1:])) & Counter(zip(b, b[1:]))).values())
        assert (g.hit1, g.hit2, g.lcs) == (h1, h2, dp_lcs(a, b))
        f = lambda h, x, y: 0.0 if h == 0 else 2 * h / (x + y)
        assert abs(g.rouge1 - f(h1, len(a), len(b))) < 1e-12
        assert 0.0 <= g.rougeL <= 1.0 and g.bertscore == g.rougeL


def test_em_f1_cases(spark):
    rows = [("Paris", "paris "), ("The cat sat", "the CAT"), ("a b", "c d"), ("", ""), ("", "x"),
            ("x y", "x y")]
    df = spark.createDataFrame(rows, "g string, p string")
    got = df.select(exact_match("g", "p").alias("em"), token_f1("g", "p").alias("f1")).collect()
    assert [r.em for r in got] == [1.0, 0.0, 0.0, 1.0, 0.0, 1.0]
    f1 = [r.f1 for r in got]
    assert f1[0] == 1.0 and abs(f1[1] - 0.8) < 1e-12 and f1[2] == 0.0 and f1[3] == 1.0 and f1[4] == 0.0


def test_pair_lcs_equals_the_table():
    """Ids of one side, equal ends and the shorter side first change no length; long rows carry beyond their bits."""
    import numpy as np
    from abridge.functions.metrics import lcs_length, pair_lcs
    r = np.random.default_rng(2)

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        return row[-1]

    for _ in range(60):
        a, b = (r.integers(0, r.integers(1, 12), r.integers(0, 150)) for _ in range(2))
        b = np.concatenate([a[:5], b, a[-4:]]) if r.random() < 0.5 else b
        assert pair_lcs(a, b) == pair_lcs(b, a) == lcs_length(a, b) == table(a.tolist(), b.tolist())
