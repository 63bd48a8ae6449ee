"""Measured runs: a method's rows are written once, and how long that took is a row of a timing table."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from abridge.sources.prep import timing_stats

SCHEMA = "method string, run int, seconds double, rows long"


class TimedRuns:
    """Results and timings under ``path``; both are tables, so a later session can summarise them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def run(self, method: str, df: DataFrame, repeats: int = 1) -> DataFrame:
        """Write ``df`` as the method's result, ``repeats`` times over, each timed; returns the written rows.

        Rows are observed while they are written. A run is timed as a whole job, scan and shuffles included.
        """
        for run in range(repeats):
            seen = Observation()
            start = time.monotonic()
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{self.path}/result/{method}")
            took = time.monotonic() - start
            row = self.spark.createDataFrame([(method, run, took, seen.get["rows"])], SCHEMA)
            row.write.mode("overwrite").parquet(f"{self.path}/timing/{method}-{run}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/result/{method}")

    def timings(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/timing/*")


def method_summary(scored: DataFrame, keys: list[str], metrics: list[str], primary: str = "primary_score",
                   timings: DataFrame | None = None, demos: DataFrame | None = None) -> DataFrame:
    """``method_summary``: per key with ``method``: n, mean achieved ratio, mean metrics, mean primary metric, time, demonstrations.

    ``demos``: (keys without method, method, ...) one row a demonstration; a method without any has 0.
    """
    out = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("achieved").alias("avg_ratio"), *[F.avg(m).alias(m) for m in metrics],
                                    F.avg(primary).alias("primary_metric"))
    if demos is not None:
        out = out.join(demos.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_demonstrations")), keys, "left")
        out = out.withColumn("num_demonstrations", F.coalesce("num_demonstrations", F.lit(0).cast("bigint")))
    if timings is not None:
        t = timing_stats(timings, "method", "seconds").select("method", F.col("mean").alias("seconds"), F.col("std").alias("seconds_std"))
        out = out.join(t, "method", "left")
    return out
