"""Exact split ranges, sketch profiles and previews."""

import hashlib

import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_split_ranges_are_exact(spark, n):
    from abridge.sources.prep import split_ranges
    df = spark.range(n).select(F.col("id").alias("k"), F.lit("x").alias("position_of"))
    ranges = {"a": (0, 700), "b": (700, 701), "c": (1500, 2900), "d": (2990, None)}
    order = sorted(range(n), key=lambda k: (hashlib.md5(f"42|{k}".encode()).hexdigest(), k))
    want = {(k, p, s) for p, k in enumerate(order) for s, (a, b) in ranges.items() if p >= a and (b is None or p < b)}
    got = [(r["k"], r["position"], r["split"]) for r in split_ranges(df, "k", ranges).collect()]
    assert len(got) == len(want) and set(got) == want


def test_ranges_are_disjoint_unless_asked(spark):
    from abridge.sources.prep import split_ranges
    df = spark.range(50).withColumnRenamed("id", "k")
    with pytest.raises(ValueError):
        split_ranges(df, "k", {"test": (0, 20), "adapt": (10, 15)})
    got = split_ranges(df, "k", {"test": (0, 20), "adapt": (10, 15)}, overlap=True)
    assert sorted(map(tuple, got.groupBy("split").count().collect())) == [("adapt", 5), ("test", 20)]
    assert split_ranges(spark.range(400).withColumnRenamed("id", "k"), "k").groupBy("k").count().where("count > 1").count() == 0


def test_split_has_no_sort_of_all_rows_in_one_task(spark):
    """The only window without partitions is over bucket counts."""
    from abridge.sources.prep import split_ranges
    plan = split_ranges(spark.range(10).withColumnRenamed("id", "k"), "k")._jdf.queryExecution().optimizedPlan().toString()
    alone = [line for line in plan.splitlines() if "Window" in line and "row_number" in line]
    assert alone and all("[_b" in line for line in alone)


def test_repeated_keys_take_a_place_each(spark):
    from abridge.sources.prep import split_ranges
    df = spark.createDataFrame([(k % 5,) for k in range(100)], "k int")
    got = split_ranges(df, "k", {"a": (0, 33), "b": (33, None)})
    assert sorted(r["position"] for r in got.collect()) == list(range(100))
    assert got.where("split = 'a'").count() == 33


def test_sketch_profile_within_its_error(spark):
    from abridge.sources.prep import QUANTILES, profile_columns, profile_sketches
    df = spark.range(30_000).select("id", (F.col("id") % 700).cast("int").alias("few"), F.when(F.col("id") % 4 > 0, F.md5(F.col("id").cast("string"))).alias("text"),
                                    (F.col("id") / 3).alias("real"), F.array("id", "id").alias("list"), F.lit(None).cast("string").alias("none"),
                                    (F.col("id") % 2 == 0).alias("flag"))
    got = {r["column_name"]: r for r in profile_sketches(df, "t").collect()}
    exact = {r["column_name"]: r for r in profile_columns(df, "t").collect()}
    assert set(got) == set(exact)
    for c, e in exact.items():
        g = got[c]
        assert (g["data_type"], g["n_rows"], g["n_nulls"]) == (e["data_type"], e["n_rows"], e["n_nulls"])
        assert abs(g["n_distinct"] - e["n_distinct"]) <= 0.049 * e["n_distinct"] + 1, c
    assert all(abs(v - q * 29_999) <= 0.03 * 30_000 for v, q in zip(got["id"]["quantiles"], QUANTILES))
    assert got["text"]["quantiles"] == [32.0] * 5 and got["list"]["quantiles"] == [2.0] * 5
    assert got["none"]["quantiles"] is None and got["flag"]["quantiles"] is None
    empty = profile_sketches(df.limit(0), "t").collect()
    assert all(r["n_rows"] == 0 and r["n_distinct"] == 0 and r["quantiles"] is None for r in empty)


def test_profile_moves_no_values(spark):
    from abridge.sources.prep import profile_sketches
    plan = profile_sketches(spark.range(10), "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SinglePartition" in plan
