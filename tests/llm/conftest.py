import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Output columns of the operators, as extra input columns.
CLASH = ("kept keep_id group_size n_words base_failed size source_size target taken copies piece start length offset "
         "sequence_id score held_out component_id n_removed text_sha256 leaf g id at w b bits bad root top run total "
         "whole last_draw n_parts _bucket _head").split()


def corpus(seed: int = 5, n: int = 60) -> list[tuple]:
    """Small documents with every odd case: nulls, blanks, ties, repeats, near copies, one very long text."""
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(60)] + ["Été", "naïve", "漢字", "A", "B&C", "x|y", "the", "of", "and"]
    words = lambda k: [r.choice(vocabulary) for _ in range(k)]
    texts: list[str | None] = [None, "", " \n\t ", "one", "One two", "one  two", "\x0bone two  three", "é" * 3]
    base = words(120)
    for i in range(n - 30):
        texts.append(r.choice([" ", " ", "\n", "  "]).join(words(r.choice([3, 9, 40, 150]))))
    for i in range(12):  # near copies of one text: a chain of edits
        w = list(base)
        w[r.randrange(len(w))] = f"edit{i}"
        texts.append(" ".join(w))
        base = w if i % 3 == 0 else base
    texts += [" ".join(base).upper(), " ".join(base), " ".join(base)] + [" ".join(["spam", "ham"] * 40)]
    texts.append("\n".join(" ".join(words(30)) for _ in range(900)))
    texts.append("pre " + texts[-1][:5000] + " post")
    return [(i, t, "en", [None, "a", "b", "ü", "c"][i % 5] if i % 3 else "a", 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, docs):
    from pyspark.sql import functions as F
    return docs.withColumns({c: F.lit("x") for c in CLASH})
