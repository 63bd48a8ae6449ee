"""Compressors, sinks, streaming twin and registry contract."""

import os
import tempfile

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_registry_contract(spark):
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 40
    df = E.entry(spark)
    assert df.count() > 0 and set(df.columns) == {"lang", "n_docs", "rouge1", "rouge2", "rougeL"}


def test_budget_properties(spark):
    from abridge.operators.candidates import candidates
    from abridge.operators.catalog import RATIOS, STYLE_NAMES
    from abridge.sources.samples import build_samples
    from abridge.functions.tokens import n_tokens, ws_tokens
    c = candidates(build_samples(spark, SF, ("reconstruction",)), RATIOS, STYLE_NAMES + ["random", "selective"])
    c = c.withColumn("n_out", n_tokens(ws_tokens("compressed")))
    assert c.where(F.col("target") < 1).count() == 0
    over = c.where((F.col("n_out") > F.col("target")) & (F.col("n_tok") > F.col("target")))
    assert over.count() == 0


def test_stream_equals_batch(spark):
    from abridge.sources.tables import read_table
    from abridge.streaming.style_stats import batch_style_stats, run_stream_style_stats
    s = run_stream_style_stats(spark, SF).orderBy("event_type").collect()
    b = batch_style_stats(read_table(spark, SF, "events"), "event_type", "value").orderBy("event_type").collect()
    assert [(r.event_type, r.n) for r in s] == [(r.event_type, r.n) for r in b]
    assert all(abs(x.perf_sum - y.perf_sum) < 1e-6 for x, y in zip(s, b))


def test_sinks_roundtrip(spark):
    from abridge.sources.sinks import sink_json_report, sink_long, sink_pivot_csv, src_csv
    d = tempfile.mkdtemp(prefix="abridge-sink-")
    df = spark.createDataFrame([(0.25, "qa", "loc-begin", "f1", 0.5), (0.5, "qa", "loc-end", "f1", 0.25)],
                               "ratio double, task string, style string, metric string, value double")
    sink_long(df, d + "/long")
    assert spark.read.parquet(d + "/long").count() == 2
    sink_long(df.where("ratio = 0.5").withColumn("value", F.lit(1.0)), d + "/long")
    back = {r.ratio: r.value for r in spark.read.parquet(d + "/long").collect()}
    assert back == {0.25: 0.5, 0.5: 1.0}
    sink_pivot_csv(df.withColumn("model", F.lit("LLaMA-2 13B")), d + "/pivot")
    assert os.path.isdir(d + "/pivot/_part=LLaMA_2_13B")
    p = sink_json_report(df, d)
    assert spark.read.json(p).count() == 2
    df.write.option("header", True).csv(d + "/csv")
    assert src_csv(spark, d + "/csv", "ratio double, task string, style string, metric string, value double").count() == 2


def test_adapt_split_small_groups(spark):
    from abridge.operators.adapt import adapt_infer_split
    rows = [("t", "g1", i) for i in range(5)] + [("t", "g2", i) for i in range(15)]
    df = spark.createDataFrame(rows, "task string, grp string, sample_id long")
    r = {(x.grp, x.sample_id): (x.is_adapt, x.is_infer) for x in adapt_infer_split(df, 10).collect()}
    assert all(v == (True, True) for k, v in r.items() if k[0] == "g1")
    assert sum(1 for k, v in r.items() if k[0] == "g2" and v == (True, False)) == 10
    assert sum(1 for k, v in r.items() if k[0] == "g2" and v == (False, True)) == 5
