"""Result sinks: long table (partitioned), wide/pivot CSV, JSON report, CSV read-back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sink_long(results_long: DataFrame, path: str, fmt: str = "parquet") -> None:
    """``sink_long_csv``: long results partitioned by (ratio, task); only the written
    partitions are replaced (dynamic partition overwrite), so a grid cell can be
    rewritten without touching the others."""
    w = (results_long.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("ratio", "task"))
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


def sink_csv(df: DataFrame, path: str) -> None:
    """``sink_wide_csv``: one CSV dataset with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def sanitize(name_col) -> F.Column:
    """Space and '-' become '_' (file-name form of a model name)."""
    return F.translate(name_col, " -", "__")


def sink_pivot_csv(df: DataFrame, path: str, by: str = "model") -> None:
    """``sink_pivot_csv``: one CSV folder per ``by`` value (sanitized name)."""
    df.withColumn("_part", sanitize(F.col(by))).write.mode("overwrite").partitionBy("_part") \
        .option("header", True).csv(path)


def sink_json_report(df: DataFrame, base: str, ts_col=None) -> str:
    """``sink_json_report``: rows as JSON under ``<base>/report_<yyyyMMdd_HHmmss>``."""
    spark = df.sparkSession
    stamp = spark.range(1).select(F.date_format(ts_col if ts_col is not None else F.current_timestamp(),
                                                "yyyyMMdd_HHmmss")).first()[0]
    path = f"{base.rstrip('/')}/report_{stamp}"
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
    return path


def src_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``src_csv``: read a results CSV back with a declared schema."""
    return spark.read.option("header", True).schema(schema).csv(path)


def filter_model(df: DataFrame, model: str, keys=("model", "ratio", "method")) -> DataFrame:
    """``filter_model``: rows of one model, metric columns = all columns but the keys."""
    metrics = [c for c in df.columns if c not in keys]
    return df.where(F.col("model") == model).select(*[k for k in keys if k in df.columns], *metrics)
