"""Scores by places against the scores of the candidates' texts."""

import pytest
from pyspark.sql import functions as F

from abridge.operators.catalog import RATIOS, STYLE_NAMES

METHODS = STYLE_NAMES + ["selective-context"]
TEXTS = [
    "The quick brown fox. It jumped over the lazy dog. A dog, it was. The end.",
    "one line of the text\nanother line, it's Longer than that\n\n  third   line\twith tabs. Ends here", "", " ", ".", ". . . a. b", "- -- ---",
    "a . b . c d. e f g h i j k l m. n", "and the of it is", "The the THE the. the The", None, "İİ xİyİ aİe Kelvin K oKo. Éa eÉe straße  nb sp a b",
    "e.g. a-b-c foo_bar x1y2 3.14. Aeiou aeiou AEIOU ae i o u. I/O and/or", "x " * 40 + "y. " + "z q " * 30, "repeat me. repeat me. repeat me. repeat me",
]


def documents(spark):
    refs = ["the dog. It was lazy", None, "line the TEXT it's", ""]
    rows = [(i, t, refs[i % 4]) for i, t in enumerate(TEXTS)] + [(3, "twice the id. another text of it", "another id")]
    return spark.createDataFrame(rows, "sample_id long, prompt string, reference string").repartition(1)


@pytest.mark.parametrize("task", ["reconstruction", "summarization"])
def test_places_score_like_texts(spark, task):
    from abridge.operators.places import scored_documents
    from abridge.operators.sweep import scored_grid
    docs = documents(spark)
    none = F.lit(None).cast("string")
    long = docs.select(F.lit(task).alias("task"), "sample_id", none.alias("grp"), "prompt", "reference", none.alias("question"), none.alias("answer"))
    cols = ["task", "sample_id", "ratio", "style", "n_ref", "n_cand", "hit1", "hit2", "lcs", "rouge1", "rouge2", "rougeL", "bertscore", "em", "f1", "primary_score"]
    want = sorted(map(repr, scored_grid(long, RATIOS, METHODS).select(cols).collect()))
    got = sorted(map(repr, scored_documents(docs, [task], RATIOS, METHODS).select(cols).collect()))
    assert got == want


def test_both_tasks_share_a_document(spark):
    """One row a document gives both tasks' rows, and its prompt is read once."""
    from abridge.operators.places import scored_documents
    both = scored_documents(documents(spark), ["reconstruction", "summarization"], RATIOS, METHODS)
    one = [scored_documents(documents(spark), [t], RATIOS, METHODS).select(both.columns) for t in ("reconstruction", "summarization")]
    assert sorted(map(repr, both.collect())) == sorted(map(repr, one[0].unionByName(one[1]).collect()))


def test_sweep_makes_no_candidate_texts_of_documents(spark):
    """The texts of a document's grid are several times the document; scores need none of them."""
    from abridge.operators.places import scored_documents
    df = scored_documents(documents(spark), ["reconstruction", "summarization"], RATIOS, METHODS)
    assert "compressed" not in df.columns
    assert "array_join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_unknown_rule(spark):
    from abridge.operators.places import scored_documents
    with pytest.raises(ValueError, match="window"):
        scored_documents(documents(spark), ["reconstruction"], RATIOS, ["random"])


def test_means_first(spark):
    from abridge.operators.sweep import avg_metrics_all, means_first, to_long
    rows = [(0.1, "qa", "s", None, None, None, None, 1.0, 0.5), (0.1, "qa", "s", None, None, None, None, None, 0.25), (0.1, "reconstruction", "s", 0.5, 0.0, 0.5, 0.5, None, None)]
    df = spark.createDataFrame(rows, "ratio double, task string, style string, rouge1 double, rouge2 double, rougeL double, bertscore double, em double, f1 double")
    want = sorted(map(tuple, avg_metrics_all(to_long(df)).collect()))
    assert sorted(map(tuple, avg_metrics_all(to_long(means_first(df))).collect())) == want
