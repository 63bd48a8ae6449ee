"""Requests of a sample as one array: what comes back, and that no text is sent whole to the driver."""

from pyspark.sql import functions as F

SAMPLES = [("reconstruction", 1, "w1 w2 w3. w4 w5 w6. w7 w8 w9 w10"), ("reconstruction", 1, "w1 w2 w3. w4 w5 w6. w7 w8 w9 w10"),
           ("reconstruction", 2, "one"), ("reconstruction", 3, ""), ("reconstruction", 4, None), ("reconstruction", None, "a b c d e f g h")]


def samples(spark):
    df = spark.createDataFrame(SAMPLES, "task string, sample_id long, prompt string")
    return df.selectExpr("task", "sample_id", "'g' AS grp", "prompt", "NULL::string AS reference", "NULL::string AS question", "NULL::string AS answer")


def calls_of(c):
    from abridge.operators.requests import request_text
    calls = F.transform("grid", lambda g: F.transform(g["styles"], lambda s: F.struct(
        g["ratio"].alias("ratio"), g["target"].alias("target"), s.alias("style"), F.md5(request_text("style", g["target"], s)).alias("request_id"))))
    return c.withColumn("calls", F.flatten(calls))


def test_one_entry_for_all_methods_of_a_rule(spark):
    from abridge.operators.candidates import candidate_arrays, candidates
    from abridge.operators.catalog import RATIOS, STYLE_NAMES
    methods = [*STYLE_NAMES, "selective-context"]
    c = candidate_arrays(samples(spark), RATIOS, methods)
    assert {r.n for r in c.select(F.size("grid").alias("n")).collect()} == {9 * len(RATIOS)}  # eight rules, the prefix with two budgets
    cols = ["sample_id", "ratio", "style", "rule", "target", "compressed"]
    rows = c.select("sample_id", F.explode("grid").alias("g")).select("sample_id", "g.*").withColumn("style", F.explode("styles")).select(cols)
    want = candidates(samples(spark), RATIOS, methods).select(cols)
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, want.collect()))


def test_answered_calls_equal_joined_rows(spark):
    from abridge.functions.text import parse_compression
    from abridge.operators.candidates import candidate_arrays, candidates
    from abridge.operators.requests import answer_calls, join_completions, standin_completions, with_request
    rows = with_request(candidates(samples(spark), [0.25, 0.5], ["loc-mid", "abstractive"]))
    said = standin_completions(rows).localCheckpoint()
    cols = ["sample_id", "ratio", "style", "request_id", "response", "compressed"]
    want = join_completions(rows, said).select(cols).collect()
    df = answer_calls(calls_of(candidate_arrays(samples(spark), [0.25, 0.5], ["loc-mid", "abstractive"])), said,
                      lambda c: parse_compression(c["response"]))
    got = df.select("sample_id", F.explode("calls").alias("c")).select("sample_id", "c.*")
    assert sorted(map(repr, got.select(cols).collect())) == sorted(map(repr, want))
    sources = {(r.sample_id, r.style): r.source for r in got.where("ratio = 0.5").collect()}
    assert sources == {(i, s): "rule" if i == 4 else "completion" if s == "loc-mid" and i else "fallback"
                       for i in (1, 2, 3, 4, None) for s in ("loc-mid", "abstractive")}


def test_answers_and_sentence_scores_are_not_broadcast(spark):
    from abridge.functions.text import parse_compression
    from abridge.operators.candidates import candidate_arrays
    from abridge.operators.requests import answer_calls
    c = candidate_arrays(samples(spark), [0.5], ["extractive"])
    said = spark.createDataFrame([], "request_id string, response string")
    out = answer_calls(calls_of(c), said, lambda x: parse_compression(x["response"])).select("calls")
    plan = out._jdf.queryExecution().sparkPlan().toString()
    # The words' frequencies may be sent; a sample's answers and scores may not.
    assert not [x for x in plan.split("\n") if "BroadcastHashJoin" in x and "sample_id" in x.split("],")[0]]


def test_parsers_strip_a_response_once(spark):
    from abridge.functions.text import parse_lingua, parse_vanilla
    df = spark.createDataFrame([("  Compressed: a b\n\nrest ",), (" plain text ",), (None,), ("Compressed (about 3): x  y\n",)], "r string")
    got = [tuple(x) for x in df.select(parse_vanilla("r"), parse_lingua("r")).collect()]
    assert got == [("a b", "a b"), ("plain text", "plain text"), (None, None), ("Compressed (about 3): x  y", "x  y")]


def test_subsequences_need_no_lcs(monkeypatch):
    import numpy as np
    from abridge.functions import metrics
    runs = []
    lcs = metrics.lcs_length
    monkeypatch.setattr(metrics, "lcs_length", lambda *a: runs.append(1) or lcs(*a))
    ref = np.array([1, 2, 3, 2, 5])
    cands = [np.array(x) for x in ([2, 2, 5], [1, 5], [5, 1], [5, 1], [1, 9], [7])]
    assert metrics._overlap_arrays(ref, cands, [False] * 6)[2].tolist() == [3, 2, 1, 1, 1, 0]
    assert len(runs) == 2  # equal candidates share one


def test_search_makes_its_targets_once(spark):
    from abridge.operators.geo import sssp
    edges = spark.createDataFrame([("m", i, i + 1, 1.0) for i in range(5)], "mesh_id string, src long, dst long, w double")
    src = spark.createDataFrame([("m", 0)], "mesh_id string, source long")
    made = spark.sparkContext.accumulator(0)

    def count(rows):
        for x in rows:
            made.add(len(x))
            yield x

    targets = spark.createDataFrame([("m", 0, 3)], "mesh_id string, source long, target long")
    targets = targets.mapInPandas(count, targets.schema)
    assert {r.vid: r.d for r in sssp(edges, src, targets=targets).collect()}[3] == 3.0
    assert made.value == 1


def test_answers_by_prompt_equal_answers_by_request(spark):
    from abridge.functions.text import parse_compression
    from abridge.operators.candidates import budget_arrays, candidate_arrays
    from abridge.operators.requests import answer_calls, said_map, standin_answers, text_id, with_answers
    ratios, styles = [0.25, 0.5], ["loc-mid", "unreadable", "abstractive"]
    grid = candidate_arrays(samples(spark), ratios, styles)
    said = grid.select(F.explode(standin_answers("grid")).alias("e")).select(F.col("e.id").alias("request_id"), "e.response")
    said = said.where("response is not null").dropDuplicates(["request_id"])
    parse = lambda c: parse_compression(c["response"])
    rows = lambda df: sorted(map(repr, df.select("sample_id", F.explode("calls").alias("c")).select("sample_id", "c.*").collect()))
    want = rows(answer_calls(calls_of(grid), said.localCheckpoint(), parse))
    answers = grid.select(text_id().alias("text_id"), said_map(standin_answers("grid")).alias("said"))
    df = calls_of(budget_arrays(with_answers(samples(spark), answers), ratios, styles))
    assert rows(answer_calls(df, None, parse)) == want
    assert any("source='completion'" in x for x in want) and any("source='fallback'" in x for x in want)


def test_an_answer_moves_once_and_prompts_move_alone(spark):
    """The registered joins deal an answer's text out once, by its prompt; no tokens, requests or ids are dealt out with a prompt."""
    import re
    import __spark_entry__ as e
    d = "/root/testdata/sf0.001"
    for name in ("join_completions", "method_texts", "method_sweep"):
        plan = e.queries()[name](spark, d)._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange hashpartitioning\([^)]*request_id", plan)
        assert len(re.findall(r"Exchange hashpartitioning\(text_id", plan)) == 2


def test_first_answer_of_an_id_counts(spark):
    from abridge.operators.requests import said_map
    df = spark.createDataFrame([([("a", "1"), ("b", None), ("a", "2"), ("c", "3")],), ([],)], "e array<struct<id:string,response:string>>")
    assert [r.m for r in df.select(said_map(F.col("e")).alias("m")).collect()] == [{"a": "1", "c": "3"}, {}]
