"""Table scans with declared schemas (no inference) and the row-count source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SCHEMAS: dict[str, str] = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                 "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                 "l_returnflag string, l_linestatus string, l_shipdate timestamp"),
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp, o_orderpriority string"),
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
             "p_retailprice double"),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, fmt: str = "parquet") -> DataFrame:
    """Load a saved dataset by path with its declared schema (``src_dataset``)."""
    reader = spark.read.schema(TABLE_SCHEMAS[name])
    if fmt == "parquet":
        return reader.parquet(table_path(sf_dir, name))
    if fmt == "json":
        return reader.json(f"{sf_dir.rstrip('/')}/{name}.json")
    if fmt == "csv":
        return reader.option("header", True).csv(f"{sf_dir.rstrip('/')}/{name}.csv")
    raise ValueError(f"unknown format {fmt!r}")


def dataset_row_counts(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> DataFrame:
    """``src_dataset``: one row per table with its row count.

    Each count is a partial+final aggregate over its own scan; with an empty
    projection the parquet reader only touches row-group metadata.
    """
    names = names or sorted(TABLE_SCHEMAS)
    parts = [read_table(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(n).alias("table_name"), "n_rows") for n in names]
    return reduce(DataFrame.unionByName, parts)
