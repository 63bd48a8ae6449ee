"""Nothing is cut: searches end when complete, streams read folders, demonstrations decide texts."""

import itertools

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001


def test_long_chain_is_walked_to_its_end_and_a_guard_raises(spark):
    from abridge.operators.geo import sssp
    edges = spark.range(130).select(F.lit("m").alias("mesh_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("w"))
    src = spark.createDataFrame([("m", 0)], "mesh_id string, source long")
    with pytest.raises(RuntimeError):
        sssp(edges.where("src < 7"), src, max_rounds=3)
    short = sssp(edges.where("src < 12"), src)
    assert sorted((r["vid"], r["d"], r["hops"]) for r in short.collect()) == [(i, float(i), i) for i in range(13)]


def test_a_round_moves_no_edge_and_the_edge_table_is_dropped(spark):
    from abridge.operators.geo import sssp, steps
    from abridge.session import bucketed, cut_lineage
    edges = spark.range(500).select(F.lit("m").alias("mesh_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("w"))
    frontier = cut_lineage(spark.range(9).select(F.lit("m").alias("mesh_id"), F.lit(0).cast("long").alias("source"), F.col("id").alias("vid"),
                                                 F.lit(0.0).alias("d"), F.lit(0).cast("long").alias("hops")))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    before = {t.name for t in spark.catalog.listTables()}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        with bucketed(edges, "mesh_id", "src") as e:
            moved = steps(frontier, e)
            assert sorted(r["vid"] for r in moved.collect()) == list(range(1, 10))
            plan = moved._jdf.queryExecution().executedPlan().toString()
            assert plan.split("Initial Plan")[0].count("Exchange") == 1  # the frontier's
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    src = spark.createDataFrame([("m", 495)], "mesh_id string, source long")
    assert sorted((r["vid"], r["d"]) for r in sssp(edges, src).collect()) == [(495 + i, float(i)) for i in range(6)]
    assert {t.name for t in spark.catalog.listTables()} == before


def test_knn_with_one_dense_cell_and_far_points(spark):
    from abridge.operators.geo import knn_edges
    pts = [(i, (i % 10) * 1e-4, (i // 10) * 1e-4, 0.0) for i in range(60)] + [(100 + i, 10.0 ** i, 0.0, 5.0) for i in range(4)]
    rows = [("a", *p) for p in pts] + [("b", 1, 0.0, 0.0, 0.0), ("b", 2, 0.0, 0.0, 0.0), ("c", 1, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "mesh_id string, vid long, x double, y double, z double")
    got = {}
    for r in knn_edges(df, k=3).collect():
        got.setdefault((r["mesh_id"], r["src"]), []).append((r["rank"], r["dst"]))
    for m, vid, *p in rows:
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(p, q)) ** 0.5, 9), v) for n, v, *q in rows if n == m and v != vid)[:3]
        assert [d for _, d in sorted(got.get((m, vid), []))] == [v for _, v in near]


def test_stream_reads_a_folder_of_parts_and_goes_on_after_a_restart(spark, tmp_path):
    from abridge.sources.tables import read_table
    from abridge.streaming.style_stats import batch_style_stats, run_stream_style_stats
    events = read_table(spark, SF001, "events")
    folder = str(tmp_path / "events.parquet")
    events.where("event_id % 2 = 0").repartition(3).write.parquet(folder)
    run = lambda: {r["event_type"]: (r["n"], round(r["perf_sum"], 6))
                   for r in run_stream_style_stats(spark, str(tmp_path), run_id=str(tmp_path.name)).collect()}
    want = lambda df: {r["event_type"]: (r["n"], round(r["perf_sum"], 6))
                       for r in batch_style_stats(df, "event_type", "value").collect()}
    assert run() == want(events.where("event_id % 2 = 0"))
    events.where("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(folder)
    assert run() == want(events)


def test_demonstrations_decide_the_text(spark):
    from abridge.plans.adapt_queries import run_inference
    inf, _, infer_samples, _ = run_inference(spark, SF001, ratios=[0.25])
    rows = inf.select("source", "compressed", F.array_join(F.slice("tok", F.lit(1), F.col("target").cast("int")), " ").alias("cut")).collect()
    assert len(rows) == infer_samples.count()
    assert any(r["source"] == "completion" and r["compressed"] != r["cut"] for r in rows)


def test_overlaps_equal_brute_force():
    import random
    from collections import Counter

    from abridge.functions.metrics import _overlaps
    r = random.Random(8)
    for _ in range(60):
        a = [r.randrange(9) for _ in range(r.randrange(0, 25))]
        b = [r.randrange(9) for _ in range(r.randrange(0, 25))]
        grams = lambda x, n: Counter(zip(*(x[i:] for i in range(n))))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        got = _overlaps(a, [b], [False])[0]
        assert got == {"hit1": sum((grams(a, 1) & grams(b, 1)).values()), "hit2": sum((grams(a, 2) & grams(b, 2)).values()),
                       "lcs": row[-1]}


def test_sample_ids_that_would_clash_fail(spark):
    from abridge.sources.samples import conversation_samples
    turns = [(1, 2_000_000 + i, role, "x y.") for i, role in itertools.islice(enumerate(["user", "assistant"]), 2)]
    conv = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="too large"):
        conversation_samples(conv).collect()
