"""Sentence scores move a word of a sample once (F33), and no candidate is cut for a ROUGE that no task asks for (F34)."""

import math
import subprocess
import sys

from pyspark.sql import functions as F

from tests.conftest import SF001

COLS = "task string, sample_id long, grp string, prompt string, reference string, question string, answer string"


def test_queries_are_listed_without_a_session():
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], check=True)


def samples(spark, texts):
    return spark.createDataFrame([("reconstruction", i, "g", t, None, None, None) for i, t in texts], COLS)


def test_scores_are_means_of_ln_df(spark):
    from abridge.operators.compress import with_scores
    texts = [(1, "the cat. the the dog. ?!"), (2, "The end"), (3, ""), (4, None), (None, "the cat"), (5, "x. y"), (5, "x. y")]
    got = sorted(((r.sample_id or 0, r.scores) for r in with_scores(samples(spark, texts), {"extractive"}).collect()), key=repr)
    ln = lambda *df: round(sum(map(math.log, df)) / len(df), 9)
    # the: 1, 2 and the row without an id; cat: 1 and that row; x, y: both rows of 5
    assert got == [(0, [1e9]), (1, [ln(3, 2), ln(3, 3, 1), 1e9]), (2, [ln(3, 1)]), (3, [1e9]), (4, None), (5, [ln(2), ln(2)]), (5, [ln(2), ln(2)])]
    other = samples(spark, [(9, "cat dog")])  # words that the corpus lacks count for nothing
    got = {r.sample_id: r.scores for r in with_scores(samples(spark, texts[:2]), {"extractive"}, other).collect()}
    assert got == {1: [0.0, 0.0, 1e9], 2: [1e9]}


def test_a_word_of_a_sample_is_asked_for_once(spark):
    from abridge.operators.compress import with_scores
    df = with_scores(samples(spark, [(1, "a b. a a. b a")]), {"extractive"})
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.count("explode(array_distinct(") == 2
    # Nothing is collected by sample before it is dealt out by sample, and the side that the join holds is the vocabulary.
    assert "RepartitionByExpression [task" in plan.split("Aggregate [task", 1)[1].split("Join", 1)[0]
    assert "strategy=shuffle_hash" in plan


def test_no_rouge_without_a_rouge_task(spark):
    from abridge.plans.eval_queries import q_eval_qa, q_eval_reasoning
    for q in (q_eval_qa, q_eval_reasoning):
        plan = q(spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
        assert "overlaps(" not in plan


def test_metrics_without_rouge_equal_those_beside_it(spark):
    from abridge.operators.catalog import RATIOS, STYLE_NAMES
    from abridge.operators.sweep import scored_grid
    rows = [(t, i, "g", p, None, "q", a) for t in ("qa", "reasoning") for i, (p, a) in enumerate(
        [("a b c. d e\nf", "f"), ("", ""), (None, "x"), ("one two", None), ("Yes", "yes "), ("p q. r s. t u v w", "s t r")])]
    df = spark.createDataFrame(rows, COLS)
    with_it, without = (scored_grid(df, RATIOS, STYLE_NAMES, rouge_asked=x) for x in (True, False))
    assert set(with_it.columns) == set(without.columns)
    cols = [c for c in without.columns if c not in ("tok", "n_ref2", "n_cand2")]
    assert sorted(map(repr, without.select(cols).collect())) == sorted(map(repr, with_it.select(cols).collect()))


def test_abbreviations_equal_the_rule_word_by_word(spark):
    from abridge.functions.tokens import ws_tokens
    from abridge.operators.compress import STOP_WORDS, abbreviated
    texts = ["The aeiou I a of OF ao aoi oAe\n\tbee  see aa ééaé \U0001f600a\U0001f600 áab", "", " ", "and", "x" * 3 + " Ohio's end."]
    short = lambda w: w if len(w) < 3 else w[0] + "".join(c for c in w[1:-1] if c not in "aeiouAEIOU") + w[-1]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").withColumn("tok", ws_tokens("t"))
    for r in df.select("t", "tok", abbreviated("t", "tok").alias("got")).collect():
        assert r.got == (None if r.t is None else [short(w) for w in r.tok if w.lower() not in STOP_WORDS])


def test_the_answer_is_hashed_and_not_the_candidate(spark):
    from abridge.plans.eval_queries import q_eval_qa
    assert "array_intersect(_p" in q_eval_qa(spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
