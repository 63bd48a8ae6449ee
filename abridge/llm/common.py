"""Shared pieces of the training-data operators: words, shared storage, hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A word is a run without the six ASCII space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_of(col: str | Column) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def lower_ascii(col: str | Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text_of(col), UPPER, UPPER.lower())


def by_place(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named by their place, so that no column that an operator adds can clash with them, and the new names."""
    new = {c: f"in_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*new.values()), new


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it gets a scratch folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
        folder = tempfile.mkdtemp(prefix="abridge-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder for one job; ``drop`` deletes them.

    Written tables cut lineage and survive lost executors.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: list[str] = []

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def store_bucketed(self, df: DataFrame, name: str, key: str | list[str], n: int) -> DataFrame:
        """Store ``df`` bucketed by ``key``: joins and groupings on it need no shuffle of the table."""
        table = f"{name}_{uuid.uuid4().hex}"
        (df.write.bucketBy(n, key).option("path", f"{self.folder}/{name}").option("compression", "zstd")
         .format("parquet").saveAsTable(table))
        self.tables.append(table)
        return self.spark.table(table)

    def drop(self) -> None:
        for t in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list[str], scratch: Scratch, name: str, col: str = "at") -> DataFrame:
    """``df`` with its places from 0 in the order of the columns ``order``, without a sort in one task.

    The rows are sorted by ranges and stored; the sizes of the sorted parts (one row a partition) shift them.
    """
    rows = scratch.store(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    part = rows.withColumn("_part", F.shiftright("_at", 33))
    sizes = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (part.join(F.broadcast(starts), "_part").withColumn(col, F.col("_start") + local)
            .drop("_part", "_start", "_at"))


def hot_keys(df: DataFrame, key: str, id_col: str, per_partition: int = 100) -> DataFrame | None:
    """Keys that hold more than about a quarter of one shuffle partition's rows.

    A deterministic sample of about ``per_partition`` rows a partition is counted by
    key (rows are drawn by id and key, so null and repeated ids do not draw all rows at once); the result (key, n_parts) has at most ``4 * partitions`` rows, so it may be
    broadcast. None if there are no such keys.
    """
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    step = max(1, df.count() // (per_partition * parts))
    least = max(2, per_partition // 4)
    found = (df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col), F.col(key)), F.lit(step)) == 0)
             .groupBy(key).count().where(F.col("count") >= least).collect())
    if not found:
        return None
    return spark.createDataFrame([(r[0], -(-r[1] // least)) for r in found],
                                 f"{key} {df.schema[key].dataType.simpleString()}, n_parts int")
