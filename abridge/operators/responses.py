"""Second request round: evaluation by parsed responses, with a store that is asked before a model is.

A response is kept under the md5 of its request, so equal requests are asked once, whatever sample, sweep or day they come
from. What the store lacks is found by an anti-join on ids and appended as one partition of the run that asked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abridge.functions.metrics import strip_ws
from abridge.functions.text import parse_reconstruction
from abridge.operators.requests import eval_request
from abridge.operators.scoring import score
from abridge.session import cut_lineage

SCHEMA = "request_id string, response string, run string"


class ResponseStore:
    """Responses (request_id, response) under ``path``; a null response is a call that failed.

    The folder is partitioned by run and written with dynamic partition overwrite: a run that is started again after a
    failure replaces its own partition and no other. Of an id in several runs (two runs at one time) the first run's counts.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def read(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], "request_id string, response string")
        rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        return rows.groupBy("request_id").agg(F.min_by("response", "run").alias("response"))

    def missing(self, requests: DataFrame, retry: bool = False) -> DataFrame:
        """The distinct ``requests`` (request_id, ...) that the store lacks; with ``retry`` also those that failed."""
        known = self.read()
        known = known.where("response is not null") if retry else known
        return requests.where("request_id is not null").dropDuplicates(["request_id"]).join(known.select("request_id"), "request_id", "left_anti")

    def fill(self, requests: DataFrame, answer: Callable[[DataFrame], DataFrame], run: str, retry: bool = False) -> int:
        """Ask ``answer`` (requests -> request_id, response) for what is missing, append it as ``run``; returns how many were asked.

        A request that ``answer`` returns no row for has failed.
        """
        new = self.missing(requests, retry)
        said = new.select("request_id").join(answer(new).select("request_id", "response"), "request_id", "left").withColumn("new", F.lit(True))
        before = self.spark.read.schema(SCHEMA).parquet(self.path).where(F.col("run") == run).drop("run") if self._exists() else None
        if before is not None:  # a run that goes on keeps what it has
            said = said.unionByName(before.join(said.select("request_id"), "request_id", "left_anti").withColumn("new", F.lit(False)))
        staged = cut_lineage(said.withColumn("run", F.lit(run)))  # it reads the partition that it replaces
        asked = staged.where("new").count()  # of what is staged: no text is made again for it
        if asked:
            (staged.drop("new").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(self.path))
        return asked


def parse_answer(response: Column, task: Column) -> Column:
    """``parse_reconstruction`` for reconstructions, else the trimmed response; an empty one is null."""
    said = F.when(task == "reconstruction", parse_reconstruction(response)).otherwise(strip_ws(response))
    return F.when(F.length(said) > 0, said)


def answered(cands: DataFrame, store: ResponseStore, keys=("task", "sample_id", "ratio", "style")) -> DataFrame:
    """``cands`` with ``answer_text``, the parsed response, and ``answer_source`` (answer, no response, empty answer).

    Only ids and responses meet the store; a row's response comes back to it by its key. Without a usable
    response the compressed text stands in, as after a failed call.
    """
    df = eval_request(cands)
    ids = df.select(*keys, F.col("eval_request_id").alias("request_id"))
    said = ids.join(store.read(), "request_id").select(*keys, "response")
    # Token arrays are several times the text: they are made again where they are scored, not moved.
    df = df.drop("eval_request", "eval_request_id", "tok", "ref_rt", "ref_ids").join(said, list(keys), "left")
    df = df.withColumn("_said", parse_answer(F.col("response"), F.col("task")))
    source = F.when(F.col("response").isNull(), "no response").when(F.col("_said").isNull(), "empty answer").otherwise("answer")
    return df.withColumns({"answer_source": source, "answer_text": F.coalesce("_said", "compressed")}).drop("_said", "response")


def score_answers(cands: DataFrame, store: ResponseStore) -> DataFrame:
    """``eval_reconstruction``, ``eval_qa``, ``eval_reasoning`` by what a reader answered about the compressed text."""
    df = answered(cands, store)
    return score(df.withColumn("pred", F.col("answer_text")), text_col="answer_text")
