"""Response store, second request round and error channel."""

import uuid

from pyspark.sql import functions as F


def store_at(spark):
    from abridge.operators.responses import ResponseStore
    from abridge.session import ensure_checkpoint_dir
    return ResponseStore(spark, f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")


def requests(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "request_id string")


def test_store_asks_only_what_is_new(spark):
    store = store_at(spark)
    asked = []

    def model(df):
        asked.append(sorted(r[0] for r in df.select("request_id").collect()))
        return df.where("request_id <> 'bad'").select("request_id", F.concat(F.lit("re "), "request_id").alias("response"))

    assert store.fill(requests(spark, ["a", "b", "b", "bad", None]), model, "r1") == 3
    assert store.fill(requests(spark, ["a", "b", "bad"]), model, "r2") == 0
    assert store.fill(requests(spark, ["a", "c"]), model, "r1") == 1  # a run that goes on keeps its rows
    assert store.fill(requests(spark, ["bad"]), model, "r3", retry=True) == 1
    assert asked == [["a", "b", "bad"], [], ["c"], ["bad"]]
    want = [("a", "re a"), ("b", "re b"), ("bad", None), ("c", "re c")]
    assert sorted(map(tuple, store.read().collect())) == want


def test_rerun_asks_nothing_and_scores_alike(spark):
    from abridge.operators.candidates import candidates
    from abridge.operators.responses import score_answers
    from abridge.plans.answer_queries import METHODS, TASKS, ask_reader
    from abridge.sources.samples import build_samples
    c = candidates(build_samples(spark, "/root/testdata/sf0.001", TASKS), [0.25], METHODS)
    store = store_at(spark)
    n = ask_reader(c, store, "one")
    first = score_answers(c, store).select("task", "sample_id", "style", "answer_source", "rougeL", "f1", "em")
    assert 0 < n <= c.count() and store.read().count() == n
    rows = sorted(first.collect(), key=repr)
    assert ask_reader(c, store, "two") == 0
    assert sorted(first.collect(), key=repr) == rows
    assert {r["answer_source"] for r in rows} == {"answer", "no response", "empty answer"}


def test_parsed_answer_or_fallback(spark):
    from abridge.operators.requests import eval_request
    from abridge.operators.responses import score_answers
    rows = [("qa", 1, 0.5, "x", "ctx", "q1", "Paris", None, "the context"), ("qa", 2, 0.5, "x", "ctx", "q2", "Rome", None, "rome"),
            ("reasoning", 3, 0.5, "x", "p", "q3", "42", None, "nothing"), ("reconstruction", 4, 0.5, "x", "a b c d", None, None, None, "a b")]
    c = spark.createDataFrame(rows, "task string, sample_id long, ratio double, style string, prompt string, question string, answer string, "
                                    "reference string, compressed string")
    ids = {r["sample_id"]: r["eval_request_id"] for r in eval_request(c).collect()}
    said = spark.createDataFrame([(ids[1], " paris \n"), (ids[3], "think\n42"), (ids[4], "Reconstructed text: a b c d")], "request_id string, response string")
    store = store_at(spark)
    store.fill(requests(spark, ids.values()), lambda df: said, "r")
    got = {r["sample_id"]: r for r in score_answers(c, store).collect()}
    assert (got[1]["em"], got[1]["answer_source"]) == (1.0, "answer")
    assert (got[2]["em"], got[2]["answer_source"]) == (1.0, "no response")  # the compressed text itself
    assert got[3]["em"] == 1.0
    assert got[4]["rougeL"] == 1.0 and got[4]["answer_text"] == "a b c d"


def test_token_arrays_are_not_moved(spark):
    """Prompts meet their responses without their tokens, which are several times the text; scores are those of the whole row."""
    from abridge.operators.candidates import candidates
    from abridge.operators.responses import answered, score_answers
    from abridge.sources.samples import SAMPLE_COLS
    s = spark.createDataFrame([("reconstruction", 1, "g", "a b c d", None, None, None)],
                              "task string, sample_id long, grp string, prompt string, reference string, question string, answer string").select(*SAMPLE_COLS)
    c = candidates(s, [0.5], ["loc-begin"])
    store = store_at(spark)
    assert not {"tok", "ref_rt", "ref_ids"} & set(answered(c, store).columns)
    row = score_answers(c, store).first()
    assert (row["n_ref"], row["n_cand"], row["lcs"], row["answer_source"]) == (4, 2, 2, "no response")


def test_errors_leave_with_a_reason_in_one_pass(spark):
    from abridge.operators.errors import error_report, split_errors
    from abridge.session import ensure_checkpoint_dir
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i, "" if i % 3 == 0 else "t") for i in range(60)], "id int, v int, s string")
    good, bad, n = split_errors(df, {"no value": F.col("v").isNull(), "empty": F.col("s") == "", "never": F.col("v") > 1000},
                                f"{ensure_checkpoint_dir(spark)}/split-{uuid.uuid4().hex}")
    assert n == {"rows": 60, "failed": 28, "no value": 12, "empty": 16, "never": 0}
    assert good.count() + bad.count() == n["rows"] and good.columns == df.columns
    assert {r["id"] for r in good.collect()} == {i for i in range(60) if i % 5 and i % 3}
    assert sorted(map(tuple, error_report(bad, []).collect())) == [("empty", 16), ("no value", 12)]
    empty = split_errors(df.limit(0), {"x": F.col("v") > 0}, f"{ensure_checkpoint_dir(spark)}/split-{uuid.uuid4().hex}")
    assert empty[2]["rows"] == 0 and empty[0].count() == 0


def test_both_sides_of_the_query_add_up(spark):
    from abridge.plans.answer_queries import error_split
    good, bad, n = error_split(spark, "/root/testdata/sf0.001")
    assert good.count() + bad.count() == n["rows"] and bad.count() == n["failed"] == n["no response"] + n["empty answer"] + n["no label"]
