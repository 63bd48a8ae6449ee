"""Parsers search a response once, and what is read of a prompt is read once a sample (F24)."""

import sys

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001

TEXTS = [None, "", " ", "\n\n", "plain text ", "Compressed:", "Compressed: \n\n a\n\nb", "x Compressed: a b\n\nOutput: c\n", "Output: a \n", "OUTPUT: a",
         "Compressed (about 3): x  y\n", "Compressed (a) Compressed (b): x\nCompressed: y\n\n z", "Compressed (open: a\n", "here's it: compressed text: Q\r\n\r\nR\n\n",
         "Reconstructed: a\n\nb\n", "original TEXT:\t a Reconstructed text: b", "\x85 a\x1c　", "a\n\n\n", "Compressed: a\n\n\n", "Compressed Text: x\x0b\n"]


def by_regex(t, patterns, default):
    """The definition: group 1 of the first pattern that matches."""
    out = default
    for p in reversed(patterns):
        out = F.when(t.rlike(p), F.regexp_extract(t, p, 1)).otherwise(out)
    return out


def regex_strip(x):
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def test_first_match_equals_the_patterns(spark):
    from abridge.functions import text as T
    df = spark.createDataFrame([(x,) for x in TEXTS], "r string")
    kinds = (T.COMPRESSION_PATTERNS, T.RECONSTRUCTION_PATTERNS, T.VANILLA_PATTERNS, T.LINGUA_PATTERNS)
    cols = [f(x) for k in kinds for f, x in ((T.py_strip, T.first_match("r", k, F.lit("none"))), (regex_strip, by_regex(F.col("r"), k, F.lit("none"))))]
    for r in df.select("r", *[c.alias(str(i)) for i, c in enumerate(cols)]).collect():
        assert r[1::2] == r[2::2], r


def test_strip_takes_all_white_space(spark):
    from abridge.functions.text import py_strip
    chars = spark.createDataFrame([(chr(i),) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000], "c string")
    x = F.concat("c", F.lit("a"), "c", F.lit("b"), "c")
    assert chars.where(py_strip(x) != regex_strip(x)).count() == 0
    assert chars.where(py_strip(x) == F.concat(F.lit("a"), "c", F.lit("b"))).count() == 25


@pytest.mark.parametrize("name", ["parse_vanilla", "parse_lingua", "parse_reconstruction"])
def test_no_pattern_runs_twice_over_a_response(spark, name):
    from abridge.functions import text as T
    df = spark.createDataFrame([("a",)], "r string")
    plan = df.select(getattr(T, name)("r"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp_extract" not in plan and "rlike" not in plan


def test_lead_ins_are_found_as_by_the_pattern(spark):
    from abridge.functions import text as T
    heads = ["here's", "The compressed", "I've compressed", "I\u2019ve compressed", "This is", "THE", "Then", " the", "x The", "Compressed: the"]
    df = spark.createDataFrame([(h + t,) for h in heads for t in ("", " a: b", "\n a: b: c", " a", ":", " Output: the q: r")], "r string")
    body = regex_strip(by_regex(regex_strip(F.col("r")), T.VANILLA_PATTERNS, regex_strip(F.col("r"))))
    want = regex_strip(F.regexp_replace(body, T.VANILLA_LEAD_IN, ""))
    assert [x for x in df.select("r", T.parse_vanilla("r"), want).collect() if x[1] != x[2]] == []


def test_a_prompt_is_parsed_once_a_sample(spark):
    from abridge.plans.request_queries import q_parse_responses
    plan = q_parse_responses(spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(grid") < plan.index("Reconstructed text: ")  # the parser is below the grid
