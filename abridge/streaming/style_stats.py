"""``stream_style_stats``: running per-key sum / count / mean over a stream of score rows.

Structured Streaming in update mode; every micro-batch's updated keys are
appended (with the batch id) to a table in the shared checkpoint folder,
and the final state is the latest row per key. The stream's own checkpoint
lives next to it, so a job restarted with its run id resumes where it stopped. No watermark
is needed: the state is one row per key (13 styles / a handful of event
types), not per event.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from abridge.session import ensure_checkpoint_dir
from abridge.sources.tables import TABLE_SCHEMAS, table_path


def is_folder(spark: SparkSession, path: str) -> bool:
    """Is ``path`` a folder, in whatever store Spark reads it from?"""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def running_stats(stream: DataFrame, key: str, value: str) -> DataFrame:
    return stream.groupBy(key).agg(F.sum(value).alias("perf_sum"), F.count(F.lit(1)).alias("n"),
                                   F.avg(value).alias("avg_perf"))


def run_stream_style_stats(spark: SparkSession, sf_dir: str, table: str = "events", key: str = "event_type",
                           value: str = "value", run_id: str | None = None) -> DataFrame:
    """Run the stream to completion (``availableNow``) and return the final per-key table.

    The table may be one file or a folder of parts; one file makes one micro-batch. A run with the ``run_id`` of an
    earlier one goes on from its checkpoint and reads only what is new; without one the run starts afresh.
    """
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = run_id or uuid.uuid4().hex
    out_path = f"{base}/stream_style_stats/{run}/updates"
    ckpt = f"{base}/stream_style_stats/{run}/checkpoint"
    path = table_path(sf_dir, table)
    reader = spark.readStream.schema(TABLE_SCHEMAS[table]).option("maxFilesPerTrigger", 1)
    if is_folder(spark, path):
        src = reader.parquet(path)
    else:  # a stream reads folders: the parent, narrowed to the file
        src = reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    agg = running_stats(src, key, value)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("append").parquet(out_path)

    q = (agg.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    upd = spark.read.parquet(out_path)
    w = Window.partitionBy(key).orderBy(F.col("batch_id").desc())
    return upd.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "batch_id")


def batch_style_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """The batch twin: must equal the stream's final table."""
    return running_stats(df, key, value)
