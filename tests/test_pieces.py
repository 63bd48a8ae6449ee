"""Counts and cuts by the tokenizer file, against the file itself on whole documents."""

import pytest
from pyspark.sql import functions as F

ODD = ["", " ", "\n\n  a", "a  b   c\t\td \n", "it's we'll I'd 'tis", "naïve Été 漢字漢字 \U0001f600\U0001f468‍\U0001f469", "x" * 5000, " " * 3000 + "y",
       "<|endoftext|>", "a <|endoftext|> b!<|endoftext|><|endoftext|>c", "<|endo<|endoftext|>", "1234567 ٣٤٥ ½", "a b  c\u0085d​e", None,
       "\x00\x01", "é", "tail   ", "\r\n\r\nx", "don't" * 50]


def check(spark, rows):
    from tokenizers import Tokenizer

    from abridge.functions.pieces import cut_pieces, default_tokenizer, with_pieces
    t = Tokenizer.from_file(default_tokenizer())
    df = spark.createDataFrame(list(enumerate(rows)), "k long, text string").repartition(4)
    budgets = [0.1, 0.25, 0.5, 0.93]
    got = with_pieces(df, ["k"], "text")
    got = got.select("k", "n_pieces", *[cut_pieces(F.floor(F.col("n_pieces") * b)).alias(f"c{i}") for i, b in enumerate(budgets)],
                     cut_pieces(F.lit(1)).alias("one"), cut_pieces(F.lit(10 ** 6)).alias("all")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r["k"]] or ""
        ids = t.encode(text, add_special_tokens=False).ids
        assert r["n_pieces"] == len(ids), text[:80]
        for i, b in enumerate(budgets):
            n = int(len(ids) * b)
            want = text if len(ids) <= n else t.decode(ids[:n], skip_special_tokens=False)
            assert r[f"c{i}"] == want, (text[:80], n)
        assert r["all"] == text
        assert r["one"] == (text if len(ids) <= 1 else t.decode(ids[:1], skip_special_tokens=False))


def test_odd_texts(spark):
    check(spark, ODD)


def test_all_documents(spark):
    check(spark, [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()])


def test_each_distinct_pre_token_is_merged_once(spark):
    from abridge.functions.pieces import default_tokenizer, piece_dictionary
    df = spark.createDataFrame([(w,) for w in [" the", " the", " unbelievableness", " unbelievableness", "a"]], "token string")
    got = piece_dictionary(df, default_tokenizer()).collect()
    assert [r["token"] for r in got] == [" unbelievableness"] and got[0]["n"] == len(got[0]["heads"]) + 1


def test_empty_table(spark):
    from abridge.functions.pieces import with_pieces
    assert with_pieces(spark.createDataFrame([], "k long, text string"), ["k"], "text").count() == 0


def test_query_on_documents(spark):
    from abridge.plans import load_all
    from abridge.plans.registry import REGISTRY
    load_all()
    rows = REGISTRY["count_pieces"].fn(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(r["n_cut"] <= r["target"] or r["n_pieces"] <= r["target"] for r in rows)


def test_rows_are_not_shuffled_and_keys_may_repeat(spark):
    from abridge.functions.pieces import with_pieces
    df = spark.createDataFrame([(1, "unbelievableness"), (1, "a unbelievableness"), (None, "unbelievableness")], "k long, text string")
    got = with_pieces(df, ["k"], "text")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    n = {(r["k"], r["text"]): r["n_pieces"] for r in got.collect()}
    assert n[1, "unbelievableness"] == n[None, "unbelievableness"] > 1 and len(n) == 3


def test_few_pre_tokens_at_once_are_python_values(monkeypatch):
    """A batch of long texts is not turned into Python strings and records as a whole."""
    import pyarrow as pa

    from abridge.functions import pieces
    monkeypatch.setattr(pieces, "AT_ONCE", 4)
    asked = []

    def merged(tokens):
        asked.append(len(tokens))
        return [(len(t), [t[:i] for i in range(1, len(t))]) for t in tokens]

    rows = [["a", "bc", "a"], [], ["bc", "def", "bc", "x", "yz"], ["q"], [], ["a", "bc"]]
    whole = pa.array([["dropped"], *rows], pa.list_(pa.string()))
    got = pieces._several(whole.slice(1), merged).to_pylist()
    assert got == [[{"at": i, "n": len(t), "heads": [t[:j] for j in range(1, len(t))]} for i, t in enumerate(r) if len(t) > 1] for r in rows]
    assert max(asked) <= 4 and len(asked) > 2
    assert pieces._several(whole.slice(0, 0), merged).to_pylist() == []
