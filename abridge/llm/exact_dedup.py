"""Exact dedup by content sort: range-partition, sort, compare neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abridge.llm.common import by_place, hot_keys, lower_ascii

PREFIX = 32  # characters of the normalised text that the sampled splitters see


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "min", digest: bool = False) -> DataFrame:
    """All columns of ``docs`` plus keep_id, group_size, kept (and text_sha256 with ``digest``).

    Rows whose texts are equal after lower-casing A-Z form a group; the row with the smallest
    (``keep="min"``) or largest (``"max"``) id stays. Null texts count as empty and equal each
    other. Repeated ids: every row that bears the kept id is kept. An empty table gives an empty one.
    Input columns named like an output column are replaced by it.

    Method: rows are range-partitioned by sampled splitters over (first characters, hash) of the
    normalised text, which bounds the splitters' size; Spark's external sort then puts equal texts
    next to each other and the window's group boundaries are full comparisons of neighbouring texts.
    The text is shuffled once. A text that fills more than a part of one partition is dealt over
    several adjacent ranges by a salt; the heads of these ranges (a bounded number) are compared again.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    extra = ["keep_id", "group_size", "kept"] + ["text_sha256"] * digest
    rows, named = by_place(docs)
    back = [F.col(n).alias(c) for c, n in named.items() if c not in extra or c in (id_col, text_col)]
    id_col, text_col = named[id_col], named[text_col]
    rows = rows.withColumn("_norm", lower_ascii(text_col))
    rows = rows.withColumns({"_prefix": F.substring("_norm", 1, PREFIX), "_hash": F.xxhash64("_norm")})
    hot = hot_keys(rows.select(id_col, "_hash"), "_hash", id_col)
    key = ["_prefix", "_hash"]
    if hot is not None:  # at most four rows a partition
        rows = rows.join(F.broadcast(hot), "_hash", "left")
        rows = rows.withColumn("_salt", F.when(F.col("n_parts").isNull(), F.lit(0)).otherwise(
            1 + F.pmod(F.xxhash64(F.col(id_col)), F.col("n_parts")).cast("int"))).drop("n_parts")
        key.append("_salt")
    dealt = rows.repartitionByRange(*key)
    group = Window.partitionBy(*key, "_norm")  # the ranges hold whole groups, so nothing is shuffled again
    marked = dealt.withColumns({"keep_id": pick(id_col).over(group),
                                "group_size": F.count(F.lit(1)).over(group)})
    if digest:
        marked = marked.withColumn("text_sha256", F.sha2(F.col("_norm").cast("binary"), 256))
    if hot is not None:
        heads = (marked.where((F.col("_salt") > 0) & F.col(id_col).eqNullSafe(F.col("keep_id")))
                 .groupBy("_norm", "_hash", "_salt").agg(F.first("keep_id").alias("_head"), F.first("group_size").alias("_n")))
        whole = Window.partitionBy("_norm")
        # Texts may share ids and so salts: a range is told by its text's hash, its salt and its head (null for null ids).
        heads = heads.select(F.col("_hash").alias("_h"), F.col("_salt").alias("_s"), "_head",
                             pick("_head").over(whole).alias("_keep"), F.sum("_n").over(whole).alias("_size"))
        same = ((F.col("_hash") == F.col("_h")) & (F.col("_salt") == F.col("_s"))
                & F.col("keep_id").eqNullSafe(F.col("_head")))
        marked = (marked.join(heads, same, "left")
                  .withColumns({"keep_id": F.coalesce("_keep", "keep_id"),
                                "group_size": F.coalesce("_size", "group_size")})
                  .drop("_h", "_s", "_head", "_keep", "_size"))
    return marked.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id"))).select(*back, *extra)
