"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abridge.llm.common import WORD, Scratch, by_place, text_of

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = "mix-1"
BUCKET_HEX = 3  # the first hex digits of a document's draw: 4,096 buckets a source


def word_count(col):
    """Number of words, without an array: every word start is one match."""
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("long")


def water_fill(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Clamping the sources above their cap and resharing the excess by weight until none is above ends at
    ``min(cap, level * weight)``. Sources in order of cap/weight are clamped one after another, so the level
    is the first at which what is left, shared by weight, stays below the next cap. One row a source; the
    two unpartitioned windows see that table only. Null is the last source in code-point order.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_pos") % len(weights) + 1).cast("int"))
    s = sources.withColumn("_pos", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.select("source", "source_size", w.alias("_w"),
                 (F.lit(float(max_epochs)) * F.col("source_size")).alias("_cap"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_cap", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({"_done": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
                       "_wdone": F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
                       "_all": F.sum("source_size").over(every), "_wall": F.sum("_w").over(every)})
    # The level if exactly the sources before this one are clamped; right for the first that stays below its cap.
    s = s.withColumn("_level", (F.col("_all") - F.col("_done")) / (F.col("_wall") - F.col("_wdone")))
    s = s.withColumn("_free", F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level")))
    s = s.withColumn("_level", F.max("_free").over(every))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))
    return s.select("source", "source_size", target.alias("target"))


def mix_plan(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row a source: (source, source_size, target, whole, last_draw).

    Every document is taken ``whole`` times, and once more if its draw is not above ``last_draw``.
    Draws order a source's documents at random but the same at each run; the cut is where the running
    size comes nearest to what the whole repetitions leave. It is found in two steps, by sums of 4,096
    buckets a source and then among the documents of a single bucket, so no source is ever in one task.
    """
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    fill = water_fill(src, weights, max_epochs)
    size = F.col("source_size")
    fill = fill.withColumn("whole", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long"))
    fill = fill.withColumn("_rest", F.col("target") - F.col("whole") * size)
    by = lambda df: Window.partitionBy("source").orderBy(df)
    b = sized.groupBy("source", F.substring("draw", 1, BUCKET_HEX).alias("_bucket")).agg(F.sum("size").alias("_n"))
    b = b.withColumn("_to", F.sum("_n").over(by("_bucket")))
    b = b.join(fill.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    cut = (b.where(F.col("_to") > F.col("_rest")).groupBy("source")
           .agg(F.min_by(F.struct("_bucket", (F.col("_to") - F.col("_n")).alias("_before")), "_bucket").alias("_cut")))
    cut = cut.select(F.col("source").alias("_s"), "_cut._bucket", "_cut._before")
    edge = sized.select("source", "draw", "size", F.substring("draw", 1, BUCKET_HEX).alias("_bucket"))
    edge = edge.join(cut.withColumnRenamed("_bucket", "_b"),
                     F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).drop("_s", "_b")
    edge = edge.withColumn("_to", F.col("_before") + F.sum("size").over(
        Window.partitionBy("source", "_bucket").orderBy("draw")))
    edge = edge.join(fill.select(F.col("source").alias("_s"), "_rest"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # The document that crosses the cut is taken if that comes nearer.
    near = edge.where(F.col("_to") - F.col("size") / 2 <= F.col("_rest")).groupBy("source").agg(F.max("draw").alias("_draw"))
    near = near.select(F.col("source").alias("_s"), "_draw")
    f = fill.join(cut, fill.source.eqNullSafe(cut._s), "left").drop("_s")
    f = f.join(near, f.source.eqNullSafe(near._s), "left").drop("_s")
    # Buckets before the cut sort below its first draw; no cut: everything fits, so nothing is left over.
    last = F.when(F.col("_rest") <= 0, F.lit("")).otherwise(F.coalesce("_draw", "_bucket", F.lit("g")))
    return f.select("source", "source_size", "target", "whole", last.alias("last_draw"))


def draw(id_col: str = "doc_id", seed: str = SEED):
    """Seeded draw: 32 hex digits and, to part equal draws, the id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """All columns of ``docs`` plus size, source_size, target, copies and taken (= copies * size).

    Null text: size 0. Null source: a source of its own, the last. A source without words has target 0 and
    no copies. Repeated ids draw alike. ``copies`` is at most ``max_epochs``. An empty table gives an empty one.
    Input columns named like an output column are replaced by it.
    """
    extra = ["size", "source_size", "target", "copies", "taken"]
    out, named = by_place(docs)
    back = [F.col(n).alias(c) for c, n in named.items() if c not in extra or c in (id_col, text_col, source_col)]
    id_col, text_col, source_col = (named[c] for c in (id_col, text_col, source_col))
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.store(out.select(F.col(source_col).alias("source"), word_count(text_col).alias("size"),
                                     draw(id_col, seed).alias("draw")), "sized")
    plan = scratch.store(mix_plan(sized, weights, max_epochs).withColumnRenamed("source", "_s"), "plan")
    out = out.withColumns({"size": word_count(text_col), "_draw": draw(id_col, seed)})
    out = out.join(plan, F.col(source_col).eqNullSafe(F.col("_s"))).drop("_s")
    out = out.withColumn("copies", F.when(F.col("source_size") > 0, F.col("whole")
                         + (F.col("_draw") <= F.col("last_draw")).cast("long")).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).select(*back, *extra)


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document ``copies`` times."""
    rows, named = by_place(mixed.where(F.col("copies") > 0))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(named["copies"]).cast("int"))))
    return rows.select(*[F.col(n).alias(c) for c, n in named.items() if c not in ("size", "source_size", "target", "copies", "taken")])
