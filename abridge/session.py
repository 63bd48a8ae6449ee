"""Session helpers: a local session for tests/bench and checkpoint handling."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "abridge") -> SparkSession:
    """Local session for tests and the bench (cluster jobs bring their own)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it gets a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
        conf_dir = tempfile.mkdtemp(prefix="abridge-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize ``df`` to the reliable checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as compressed Parquet in the checkpoint folder: what :func:`cut_lineage` is to numbers, for many texts."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, *keys: str) -> Iterator[DataFrame]:
    """``df`` as a table bucketed by ``keys`` in the warehouse, dropped at the end.

    Joins on the keys read it in place: a step of an iteration moves only its other side. Written once, the table cuts
    lineage and survives lost executors.
    """
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"bucketed_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).format("parquet").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def scan_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, by the planner's statistics; no job runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def spread(df: DataFrame, *keys: str, per_core: int = 4) -> DataFrame:
    """Deal ``df`` out by ``keys`` where its scan is too coarse to keep the cores busy.

    Text rows are few bytes but much work each, and a small table is one file with one row group. A scan of at least
    ``per_core`` splits a core is left as it is, so no text is shuffled where there is much of it. Sizes come from
    the plan and the count from settings: no job runs.
    """
    spark = df.sparkSession
    tasks = per_core * spark.sparkContext.defaultParallelism
    if scan_bytes(df) >= tasks * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes():
        return df
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), tasks), *keys)
