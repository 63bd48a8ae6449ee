"""Printed tables, summaries and details: order of lines, missing values, tasks without a part."""

from abridge.operators.report import method_detail, result_tables, table_header, task_summary


def test_tables_have_all_lines_in_order(spark):
    rows = [(0.5, "qa", "b", "f1", 0.0625), (0.5, "qa", "a", "em", 1.0), (0.5, "qa", "base", "f1", 0.5), (0.25, "qa", "a", "f1", 0.2),
            (0.5, "qa", "not asked for", "f1", 0.9)]
    long = spark.createDataFrame(rows, "ratio double, task string, style string, metric string, value double")
    got = [(x.ratio, x.line_no, x.line) for x in result_tables(long, ["b", "a"], ["base"]).orderBy("ratio", "line_no").collect()]
    half = [x[1:] for x in got if x[0] == 0.5]
    assert [n for n, _ in half] == list(range(8))
    assert half[0][1] == "COMPRESSION RATIO: 0.5" and half[1][1] == table_header() and half[2][1] == "-" * 80
    assert half[3][1].startswith("b" + " " * 15) and "0.063" in half[3][1]
    assert half[4][1].startswith("a" + " " * 15) and "1.000" in half[4][1] and half[5][1] == "baselines:"
    assert half[6][1].startswith("base ") and half[7][1] == "Table: Results at compression ratio 0.5"
    assert [n for r, n, _ in got if r == 0.25] == [0, 1, 2, 4, 5, 7]  # only styles that have results
    assert result_tables(long.limit(0), ["a"], ["base"]).count() == 0


def test_summary_of_a_task_without_an_ablation(spark):
    ratios = spark.createDataFrame([("qa", 0.5, 0.4996), ("qa", 0.25, 0.2), ("sum", 0.5, None)], "task string, ratio double, avg_ratio double")
    ablation = spark.createDataFrame([("qa", "icl", 0.3)], "task string, config string, avg_ratio double")
    lines = {}
    for x in task_summary(ratios, ablation).orderBy("task", "line_no").collect():
        lines.setdefault(x.task, []).append(x.line)
    assert lines["qa"] == ["QA:", "-" * 40, "Compression Ratio Analysis:", "  0.25: actual=0.200", "  0.5: actual=0.500",
                           "Ablation Study Results:", "  icl: ratio=0.300"]
    assert lines["sum"][:3] == ["SUM:", "-" * 40, "Compression Ratio Analysis:"]


def test_detail_shows_demonstrations_only_where_used(spark):
    rows = [("qa", 0.5, "m", 2, 0.5, "late", 1.0), ("qa", 0.5, "m", 1, 0.25, "x" * 150, 0.0), ("qa", 0.5, "n", 1, 0.1, None, 0.5)]
    df = spark.createDataFrame(rows, "task string, ratio double, method string, sample_id long, achieved double, compressed string, f1 double")
    demos = spark.createDataFrame([("qa", 0.5, "m")] * 3, "task string, ratio double, method string")
    lines = {}
    for x in method_detail(df, ["f1"], demos).orderBy("method", "line_no").collect():
        lines.setdefault(x.method, []).append(x.line)
    assert lines["m"] == ["M:", "  Average Ratio: 0.375", "  Quality Metrics: f1=0.500", "  Demonstrations Used: 3",
                          "  Example Compression: " + "x" * 100 + "..."]
    assert lines["n"] == ["N:", "  Average Ratio: 0.100", "  Quality Metrics: f1=0.500", "  Example Compression: ..."]
