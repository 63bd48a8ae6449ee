"""``drop_errors``: failed rows leave with a reason, in the pass that keeps the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def with_error(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """``df`` with ``error``: the first reason whose condition holds (null conditions do not), null for a good row."""
    error = F.lit(None).cast("string")
    for name, holds in reversed(reasons.items()):
        error = F.when(F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(error)
    return df.withColumn("error", error)


def split_errors(df: DataFrame, reasons: dict[str, Column], path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(good rows, failed rows with ``error``, counts): one pass over ``df``, written under ``path`` by ``failed``.

    Counts are observed while the rows are written: ``rows``, ``failed`` and one for each reason. They need no pass of
    their own, and rows = good + failed.
    """
    marked = with_error(df, reasons).withColumn("failed", F.col("error").isNotNull())
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows"), F.count("error").alias("failed"),
              *[F.count(F.when(F.col("error") == r, 1)).alias(r) for r in reasons]]
    marked.observe(seen, *counts).write.mode("overwrite").partitionBy("failed").parquet(path)
    back = df.sparkSession.read.schema(marked.schema).parquet(path)
    return back.where("not failed").drop("failed", "error"), back.where("failed").drop("failed"), dict(seen.get)


def error_report(failed: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows failed for each key and reason."""
    return failed.groupBy(*keys, "error").agg(F.count(F.lit(1)).alias("n"))
