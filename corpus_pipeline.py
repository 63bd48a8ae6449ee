"""Corpus pipeline: quality classifier, exact dedup, near dedup, mixing, packing.

``run`` applies the stages to ``documents``; each stage's rows are written as Parquet to the shared folder and
read again by the next.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abridge.llm import mixing
from abridge.llm.common import Scratch
from abridge.llm.exact_dedup import exact_dedup
from abridge.llm.jaccard_join import jaccard_classes
from abridge.llm.nb_svm import fit, score, training_rows
from abridge.llm.packing import pack_documents
from abridge.llm.queries import id_crc, table, tokenizer_path

SHINGLE, PERCENT = 5, 80  # near duplicates: five words, a Jaccard similarity of 0.8 or more
# A document goes if its probability of good quality is below this; the label is the only thing that is learnt.
REJECT_BELOW = 0.5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def beside(stage: Stage) -> Stage:
    """``stage`` on tables with further columns: it sees them by their place, so none clashes with a name of its own."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        named = [c if c in COLUMNS else f"extra_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*named), sf_dir).toDF(*docs.columns)
    return run


@beside
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Labels of the same rows as in its query are learnt."""
    rows, labels = training_rows(docs, table(spark, sf_dir, "labels"), id_crc("_id") % 3 != 1)
    return score(docs, fit(rows, labels), carry=True).where(F.col("score") >= REJECT_BELOW).select(*docs.columns)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row. ``docs`` is a stored table: each read of it gives the same numbers."""
    return docs.withColumn("_row", F.monotonically_increasing_id())


@beside
def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the largest id (null least), of equal ids the last row."""
    keyed = numbered(docs).withColumn("_key", F.struct("doc_id", "_row"))
    return exact_dedup(keyed, id_col="_key", keep="max").where("kept").select(*docs.columns)


@beside
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the one with the smallest id (null last), of equal ids the first row."""
    keyed = numbered(docs)
    classes = jaccard_classes(keyed, id_col="_row", k=SHINGLE, percent=PERCENT)
    rows = classes.select(F.col("doc_id").alias("_row"), "component_id").join(keyed.select("_row", "doc_id"), "_row")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row"))["_row"]
    heads = rows.groupBy("component_id").agg(head.alias("_head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = rows.join(heads, "component_id").where("_row <> _head").select("_row")
    return keyed.join(gone, "_row", "left_anti").select(*docs.columns)


@beside
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them."""
    return mixing.repeated(mixing.mix(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in the packed sequences."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("quality_classifier", quality), ("exact_dedup", dedup), ("ngram_jaccard_join", near_dedup),
          ("source_mixing", mix), ("best_fit_packing", pack)]
# The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
