"""Text reports as ordered line tables ``(ratio, section, line_no, line)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abridge.operators.catalog import TASK_METRICS


def title_case(c):
    """``title_case``: 'for_qa' -> 'For Qa'."""
    return F.initcap(F.translate(c, "_", " "))


def report_lines(results_long: DataFrame, baselines) -> DataFrame:
    """Per ratio: one header line, then one line per style (baselines last).

    Each line: ``%-20s`` method name, then ``task/metric=%.3f`` cells in a fixed
    task/metric order, missing cells shown as ``-``. Line numbers come from a
    window over the (small) per-ratio style rows.
    """
    order = [(t, m) for t, ms in TASK_METRICS.items() for m in ms]
    wide = (results_long.withColumn("k", F.concat_ws("/", "task", "metric"))
            .groupBy("ratio", "style").pivot("k", [f"{t}/{m}" for t, m in order]).agg(F.first("value")))
    cells = [F.coalesce(F.format_string(f"{t[:5]}/{m}=%.3f", F.col(f"`{t}/{m}`")), F.lit(f"{t[:5]}/{m}=-"))
             for t, m in order]
    is_base = F.col("style").isin(*baselines)
    body = wide.select("ratio", F.when(is_base, "baseline").otherwise("style").alias("section"),
                       F.col("style"),
                       F.concat_ws(" ", F.format_string("%-20s", title_case(F.col("style"))), *cells).alias("line"))
    w = Window.partitionBy("ratio").orderBy(F.col("section").desc(), "style")
    body = body.withColumn("line_no", F.row_number().over(w).cast("bigint"))
    header = (results_long.select("ratio").distinct()
              .select("ratio", F.lit("header").alias("section"), F.lit(None).cast("string").alias("style"),
                      F.format_string("Compression ratio %.2f", F.col("ratio")).alias("line"),
                      F.lit(0).cast("bigint").alias("line_no")))
    return body.unionByName(header).select("ratio", "section", "line_no", "line")


def three(c):
    """A number with three decimals, rounded half away from zero."""
    return F.format_string("%.3f", F.round(c, 3))


def result_tables(results_long: DataFrame, styles, baselines) -> DataFrame:
    """``(ratio, line_no, line)``: per ratio a title, a column header, the styles, the baselines and a caption.

    Rows come in the order of ``styles`` and ``baselines``; a missing value shows as 0.000.
    """
    order = [(t, m) for t, ms in TASK_METRICS.items() for m in ms]
    names, n = [*styles, *baselines], len(styles)
    wide = (results_long.where(F.col("style").isin(names)).withColumn("k", F.concat_ws("/", "task", "metric"))
            .groupBy("ratio", "style").pivot("k", [f"{t}/{m}" for t, m in order]).agg(F.first("value")))
    place = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("style"))
    cells = [F.concat(three(F.coalesce(F.col(f"`{t}/{m}`"), F.lit(0.0))), F.lit(" " * 6)) for t, m in order]
    body = wide.select("ratio", (place + 2 + (place > n).cast("int")).cast("bigint").alias("line_no"),
                       F.concat(F.format_string("%-15s ", F.col("style")), *cells).alias("line"))
    ratio = F.col("ratio").cast("string")
    heads = F.array(*[F.struct(F.lit(i).cast("bigint").alias("line_no"), line.alias("line")) for i, line in (
        (0, F.concat(F.lit("COMPRESSION RATIO: "), ratio)), (1, F.lit(table_header())), (2, F.lit("-" * 80)), (n + 3, F.lit("baselines:")),
        (n + len(baselines) + 4, F.concat(F.lit("Table: Results at compression ratio "), ratio)))])
    frame = results_long.select("ratio").distinct().select("ratio", F.inline(heads))
    return body.unionByName(frame)


def table_header() -> str:
    return f"{'Style':<15} " + "".join(f"{m:<10} " for ms in TASK_METRICS.values() for m in ms)


def task_summary(ratios: DataFrame, ablation: DataFrame) -> DataFrame:
    """``(task, line_no, line)``: a task's achieved ratio for each target ratio and for each configuration.

    ``ratios``: ``task, ratio, avg_ratio``; ``ablation``: ``task, config, avg_ratio``. A task may lack either part.
    """
    def part(df: DataFrame, at: int, title: str, name, cell: str) -> DataFrame:
        rows = df.select("task", F.lit(at + 1).alias("part"), name.alias("name"),
                         F.concat(F.lit("  "), name, F.lit(f": {cell}="), three(F.col("avg_ratio"))).alias("line"))
        return rows.unionByName(df.select("task").distinct().select("task", F.lit(at).alias("part"), F.lit("").alias("name"), F.lit(title).alias("line")))

    body = part(ratios, 2, "Compression Ratio Analysis:", F.col("ratio").cast("string"), "actual").unionByName(
        part(ablation, 4, "Ablation Study Results:", F.col("config"), "ratio"))
    title = F.array(*[F.struct(F.lit(i).alias("part"), line.alias("line")) for i, line in (
        (0, F.concat(F.upper("task"), F.lit(":"))), (1, F.lit("-" * 40)))])
    heads = body.select("task").distinct().select("task", F.lit("").alias("name"), F.inline(title))
    w = Window.partitionBy("task").orderBy("part", "name")  # a line for each ratio and configuration
    return body.unionByName(heads).select("task", (F.row_number().over(w) - 1).cast("bigint").alias("line_no"), "line")


def method_detail(rows: DataFrame, metrics, demos: DataFrame, example: int = 100) -> DataFrame:
    """``(task, ratio, method, line_no, line)``: ratio, quality, demonstrations and an example of every method.

    ``rows``: ``task, ratio, method, sample_id, achieved, compressed`` and the ``metrics``; the example is the text of the first
    ``sample_id``. ``demos``: ``task, ratio, method``, one row a demonstration used; a method without any has no such line.
    """
    keys = ["task", "ratio", "method"]
    used = demos.groupBy(*keys).agg(F.count(F.lit(1)).alias("used"))
    per = rows.groupBy(*keys).agg(F.avg("achieved").alias("achieved"), *[F.avg(m).alias(m) for m in metrics],
                                  F.min_by(F.substring("compressed", 1, example), "sample_id").alias("example")).join(used, keys, "left")
    quality = F.concat_ws(", ", *[F.concat(F.lit(f"{m}="), three(F.col(m))) for m in metrics])
    lines = F.array_compact(F.array(
        F.concat(F.upper("method"), F.lit(":")), F.concat(F.lit("  Average Ratio: "), three(F.col("achieved"))),
        F.concat(F.lit("  Quality Metrics: "), quality), F.concat(F.lit("  Demonstrations Used: "), F.col("used").cast("string")),
        F.concat(F.lit("  Example Compression: "), F.coalesce("example", F.lit("")), F.lit("..."))))
    return per.select(*keys, F.posexplode(lines).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("bigint"))
