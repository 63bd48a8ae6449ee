"""Data preparation operators: splits, caps, replication, tails, profiles, timing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_sample(df: DataFrame, key: str, seed: int = 42, test_n: int = 200,
                 adapt_from: int = 10, adapt_to: int = 99) -> DataFrame:
    """``split_sample``: seeded shuffle, then exact position ranges.

    Order = ``md5(seed|key)`` (ties by key). Only the first ``test_n``
    positions are needed, so a top-k (per-partition partial sort + merge of
    ``test_n`` rows) replaces a global sort; positions are numbered on those
    ``test_n`` rows only. ``split`` is ``test`` and ``adapt`` flags both.
    """
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    top = df.withColumn("shuffle_key", h).orderBy("shuffle_key", key).limit(test_n)
    w = Window.orderBy("shuffle_key", key)
    return (top.withColumn("position", (F.row_number().over(w) - 1).cast("bigint"))
            .withColumn("in_test", F.lit(True))
            .withColumn("in_adapt", F.col("position").between(adapt_from, adapt_to)))


SPLIT_HEX = 4  # hex digits of the shuffle key that make a bucket: 65,536 buckets
# Default ranges: as large as the reference's, but no row is in two of them.
SPLIT_RANGES = {"test": (0, 200), "adapt": (200, 290)}


def split_ranges(df: DataFrame, key: str, ranges: dict[str, tuple[int, int | None]] | None = None, seed: int = 42,
                 overlap: bool = False) -> DataFrame:
    """``split_sample`` with exact ranges over all rows: ``df`` with ``shuffle_key``, ``position`` and ``split``.

    ``ranges``: split -> (first position, position after the last; None: to the end); rows in none are left out. The
    order is ``md5(seed|key)``, equal ones by key. Positions are exact without a sort in one task: the rows before a bucket
    of the order (its first hex digits) come from the bucket's counts, and ranks are made inside a bucket.
    Ranges that share positions raise unless ``overlap``, where a row comes once for each range it is in.
    """
    ranges = ranges or SPLIT_RANGES
    ends = sorted((a, float("inf") if b is None else b) for a, b in ranges.values())
    if not overlap and any(b > a2 for (_, b), (a2, _) in zip(ends, ends[1:])):
        raise ValueError("ranges share positions")
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    rows = df.withColumn("shuffle_key", h).withColumn("_b", F.substring("shuffle_key", 1, SPLIT_HEX))
    sizes = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most 65,536 rows
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # Buckets that no range reaches are not sorted.
    meets = F.lit(False)
    for a, b in ranges.values():
        here = F.col("_before") + F.col("_n") > a
        meets = meets | (here if b is None else here & (F.col("_before") < b))
    rows = rows.join(F.broadcast(sizes.where(meets).select("_b", "_before")), "_b")
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("shuffle_key", key))
    rows = rows.withColumn("position", (F.col("_before") + rank - 1).cast("bigint")).drop("_b", "_before")
    inside = [F.when((F.col("position") >= a) & (F.lit(True) if b is None else F.col("position") < b), F.lit(name)) for name, (a, b) in ranges.items()]
    return rows.withColumn("split", F.explode(F.filter(F.array(*inside), lambda x: x.isNotNull())))


GROUP_BUCKETS = 64


def first_per_group(df: DataFrame, keys, by: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group, in two steps: of each hash bucket of a group, then of the group.

    A hot group is dealt over the buckets, so its last step sees at most ``GROUP_BUCKETS * n`` rows.
    """
    df = df.withColumn("_b", F.pmod(F.xxhash64(*by), F.lit(GROUP_BUCKETS)))
    for part in ([*keys, "_b"], list(keys)):
        df = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")
    return df.drop("_b")


def cap_per_group(df: DataFrame, keys, order, n: int) -> DataFrame:
    """``cap_samples``: first ``n`` rows per group."""
    return first_per_group(df, keys, list(order), [F.col(c) for c in order], n)


def tail_per_group(df: DataFrame, keys, order_col: str, n: int = 2) -> DataFrame:
    """``tail_rows``: last ``n`` rows per group."""
    return first_per_group(df, keys, [order_col], [F.col(order_col).desc()], n)


def min_rows_filter(df: DataFrame, keys, minimum: int = 12) -> DataFrame:
    """``min_rows_filter``: keep groups with at least ``minimum`` rows (partial count + semi join)."""
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum).drop("_n")
    return df.join(big, list(keys), "left_semi")


def replicate_rows(df: DataFrame, keys, order_col: str, target: int = 12) -> DataFrame:
    """``replicate_rows``: repeat a group's rows in order until it has ``target`` rows.

    Only groups smaller than ``target`` are expanded and numbered (so the
    window over them holds fewer than ``target`` rows each); larger groups
    pass unchanged with a NULL ``rep_pos``.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_n"))
    j = df.join(sizes, list(keys))
    small = j.where(F.col("group_n") < target)
    w = Window.partitionBy(*keys).orderBy(order_col)
    small = (small.withColumn("idx", F.row_number().over(w) - 1)
             .withColumn("copy", F.explode(F.sequence(F.lit(0), (F.lit(target) / F.col("group_n")).cast("int"))))
             .withColumn("rep_pos", F.col("copy") * F.col("group_n") + F.col("idx"))
             .where(F.col("rep_pos") < target).drop("idx", "copy"))
    # groups already at the target pass unchanged, unnumbered (no window over a hot group)
    big = j.where(F.col("group_n") >= target).withColumn("rep_pos", F.lit(None).cast("bigint"))
    return small.unionByName(big).withColumn("rep_pos", F.col("rep_pos").cast("bigint"))


def profile_columns(df: DataFrame, name: str) -> DataFrame:
    """``profile_dataset``: per column its type, row count, null count and distinct count."""
    aggs = []
    for f in df.schema.fields:
        aggs += [F.count(F.when(F.col(f.name).isNull(), 1)).alias(f"{f.name}__nulls"),
                 F.countDistinct(F.col(f.name)).alias(f"{f.name}__distinct")]
    one = df.agg(F.count(F.lit(1)).alias("__rows"), *aggs)
    rows = [one.select(F.lit(name).alias("table_name"), F.lit(f.name).alias("column_name"),
                       F.lit(f.dataType.simpleString()).alias("data_type"),
                       F.col("__rows").alias("n_rows"), F.col(f"{f.name}__nulls").cast("bigint").alias("n_nulls"),
                       F.col(f"{f.name}__distinct").cast("bigint").alias("n_distinct"))
            for f in df.schema.fields]
    return reduce(DataFrame.unionByName, rows)


HLL_LG_K = 12        # registers of the distinct sketch: standard error 1.04 / sqrt(2^12) = 1.6 %
QUANTILES = (0.0, 0.25, 0.5, 0.75, 1.0)
KLL_K = 200          # size of the quantile sketch: rank error about 1.3 %
_NUMBERS = ("byte", "short", "integer", "long", "float", "double")


def profile_sketches(df: DataFrame, name: str) -> DataFrame:
    """``profile_dataset`` at any size: one scan of mergeable sketches, a few kilobytes a column and task.

    Per column: type, rows, nulls, an estimate of the distinct values (HyperLogLog; 3 standard errors are 4.9 %) and
    approximate quantiles (KLL) of a number's value, a text's characters or an array's elements. No value is moved.
    """
    aggs, shown = [F.count(F.lit(1)).alias("__rows")], []
    for i, f in enumerate(df.schema.fields):
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        key = c if kind in ("integer", "long", "string", "binary") else F.to_json(F.struct(c)) if kind in ("array", "map", "struct") else c.cast("string")
        key = F.when(c.isNotNull(), key)
        size = c if kind in _NUMBERS else F.char_length(c) if kind == "string" else F.when(c.isNotNull(), F.size(c)) if kind in ("array", "map") else None
        aggs += [F.count(F.when(c.isNull(), 1)).alias(f"n{i}"), F.hll_sketch_agg(key, F.lit(HLL_LG_K)).alias(f"d{i}")]
        if size is not None:
            aggs.append(F.kll_sketch_agg_double(F.when(~F.isnan(size.cast("double")), size.cast("double")), F.lit(KLL_K)).alias(f"q{i}"))
        shown.append((f, i, size is not None))
    none = F.lit(None).cast("array<double>")

    def quantiles(i: int) -> Column:
        q = F.col(f"q{i}")
        return F.when(F.kll_sketch_get_n_double(q) > 0, F.array(*[F.kll_sketch_get_quantile_double(q, F.lit(x)) for x in QUANTILES]))

    lines = [F.struct(F.lit(name).alias("table_name"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
                      F.col("__rows").alias("n_rows"), F.col(f"n{i}").alias("n_nulls"), F.hll_sketch_estimate(f"d{i}").alias("n_distinct"),
                      (quantiles(i) if sized else none).alias("quantiles")) for f, i, sized in shown]
    return df.agg(*aggs).select(F.explode(F.array(*lines)).alias("x")).select("x.*")


def preview(df: DataFrame, order_col: str, n: int = 3, width: int = 1000) -> DataFrame:
    """``preview``: first ``n`` rows (by ``order_col``) as JSON cut to ``width`` characters."""
    return (df.orderBy(order_col).limit(n)
            .select(F.col(order_col), F.substring(F.to_json(F.struct("*")), 1, width).alias("json")))


def timing_stats(runs: DataFrame, key: str, value: str) -> DataFrame:
    """``timing_stats``: mean and population std of repeated measurements per key."""
    return runs.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
                                 F.stddev_pop(value).alias("std"))
