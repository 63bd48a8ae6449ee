"""Adaptive style selection: sampling, adaptation rounds, demonstrations, inference.

A group is ``(config, task, ratio, grp)``. Adaptation visits the first ``M`` prompts of every group in ``sample_id``
order; round ``i`` draws styles from the group's running style statistics and, once the group's demonstration pool
is not empty, makes few-shot ("icl") tries that see the pool's best ``ICL_DEMOS``. Scores are looked up in the
precomputed candidate ``scores``; the best candidate and its comparative advantage join the pool, and statistics
are updated unless a few-shot try won. The stand-in model answers the j-th few-shot try in the style of the j-th best
demonstration (the last one there is, if the pool is smaller), so the pool decides the text: ``text_style`` is
the style a demonstration's text was made in.

The rounds of a group need nothing but the group: at most ``M`` prompts with one score a style, and a state of one (sum,
count) a style and at most ``M`` demonstrations. So a group is one row and its rounds are one ``aggregate`` over its
prompts: all groups run side by side in one stage, without a round trip to the driver.

Draws are deterministic: ``u`` = first 8 hex digits of
``md5(seed|task|ratio*1000|grp|iteration|slot)`` / 2^32.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abridge.operators.catalog import STYLE_NAMES, TASK_SETTINGS
from abridge.session import cut_lineage
from abridge.sources.prep import cap_per_group

GKEY = ["config", "task", "ratio", "grp"]
N_STYLES = len(STYLE_NAMES)
ICL_DEMOS = 3  # demonstrations that a few-shot try sees


def ratio_key(c="ratio"):
    return F.round(F.col(c) * 1000).cast("bigint").cast("string")


def unit_draw(*parts) -> Column:
    """Uniform draw in [0, 1) from md5 of the '|'-joined parts."""
    key = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def style_name(idx: Column) -> Column:
    """Catalog name of a 0-based style index (literal array lookup, no join)."""
    return F.get(F.array(*[F.lit(s) for s in STYLE_NAMES]), idx)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(xs: Column, kind: str = "double") -> Column:
    return F.aggregate(xs, F.lit(0).cast(kind), lambda a, x: a + x)


def first_slots(n: Column) -> Column:
    """0 .. n - 1; empty where n is 0."""
    return F.slice(F.sequence(F.lit(0), n), F.lit(1), n)


# --------------------------------------------------------------------------- splits
def adapt_infer_split(samples: DataFrame, adapt_size: int, keys=("task", "grp")) -> DataFrame:
    """``adapt_infer_split``: flags ``is_adapt``/``is_infer`` and adapt position ``pos``.

    The first ``adapt_size`` rows of a group (by sample_id) adapt, the rest
    infer; a group smaller than ``adapt_size`` uses all rows for both. The
    first rows are found in two steps and the group size is a partial
    aggregate, so a hot group never sorts whole.
    """
    w = Window.partitionBy(*keys).orderBy("sample_id")
    head = cap_per_group(samples.select(*keys, "sample_id"), keys, ["sample_id"], adapt_size)
    head = head.withColumn("pos", F.row_number().over(w) - 1)
    sizes = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_n"))
    out = (samples.join(head, [*keys, "sample_id"], "left").join(sizes, list(keys)))
    small = F.col("group_n") < adapt_size
    return (out.withColumn("is_adapt", F.col("pos").isNotNull())
               .withColumn("is_infer", F.col("pos").isNull() | small)
               .withColumn("pos", F.col("pos").cast("int")))


# --------------------------------------------------------------------------- advantage / best
def comparative_advantage(scores: Column, kind: Column) -> Column:
    """``ca_min``/``ca_mid`` of a round's scores: max-min or max-median; 0 when <= 1 score."""
    n = F.size(scores)
    median = lambda xs: (F.get(xs, F.floor((n - 1) / 2).cast("int")) + F.get(xs, F.floor(n / 2).cast("int"))) / 2
    low = F.when(kind == "mid", let(F.array_sort(scores), median)).otherwise(F.array_min(scores))
    return F.when(n <= 1, F.lit(0.0)).otherwise(F.array_max(scores) - low)


def best_candidate(tries: Column) -> Column:
    """``best_candidate``: the first slot holding the maximum score; null without tries."""
    return F.array_min(F.transform(tries, lambda t: F.struct(
        (-t["score"]).alias("order"), t["slot"].alias("slot"), t["icl"].alias("icl"), t["style_idx"].alias("style_idx"), t["score"].alias("score"))))


# --------------------------------------------------------------------------- style statistics
def style_weights(sums: Column, counts: Column) -> Column:
    """``style_weights``: w = max(mean, 0.1) (0.1 if unused); the running share of their total, by style index."""
    w = F.zip_with(sums, counts, lambda s, n: F.when(n > 0, F.greatest(s / n, F.lit(0.1))).otherwise(F.lit(0.1)))
    return let(w, lambda x: F.transform(x, lambda _, i: F.round(total(F.slice(x, F.lit(1), i + 1)) / total(x), 12)))


def sample_style(u: Column, shares: Column, uniform: Column) -> Column:
    """``sample_style``: uniform index floor(u*13) during warm-up or without counts,
    else the first style whose running share exceeds u."""
    drawn = F.when(uniform, F.floor(u * N_STYLES).cast("int")).otherwise(F.size(F.filter(shares, lambda c: c <= u)))
    return F.least(drawn, F.lit(N_STYLES - 1))


def running_style_state(state: Column, best: Column) -> tuple[Column, Column]:
    """``running_style_state``: (sums, counts) after a round; a few-shot win does not count, nor does a round without tries."""
    won = lambda i: best.isNotNull() & ~best["icl"] & (best["style_idx"] == i)
    return (F.transform(state["sums"], lambda x, i: F.when(won(i), x + best["score"]).otherwise(x)),
            F.transform(state["counts"], lambda x, i: F.when(won(i), x + 1).otherwise(x)))


def running_pool(demos: Column, size: int = ICL_DEMOS) -> Column:
    """``running_pool``: style indices of the pool's best ``size`` demonstrations by (ca desc, iteration)."""
    ranked = F.array_sort(F.transform(demos, lambda d: F.struct((-d["ca"]).alias("o"), d["iteration"].alias("i"), d["style_idx"].alias("s"))))
    return F.transform(F.slice(ranked, 1, size), lambda d: d["s"])


def icl_tries(pool: Column, n_style: Column, n_icl: Column) -> Column:
    """``icl_demos``: the few-shot tries of a round; none where the pool is empty."""
    n = F.when(F.size(pool) > 0, n_icl).otherwise(F.lit(0))
    return F.transform(first_slots(n), lambda j: F.struct((n_style + j).alias("slot"), F.lit(True).alias("icl"),
                                                          F.get(pool, F.least(j, F.size(pool) - 1)).alias("style_idx")))


# --------------------------------------------------------------------------- adaptation
def _round(state: Column, prompt: Column, warm: float, seed: int, kind: Column) -> Column:
    """The state after one prompt of the group."""
    i, n_style = prompt["pos"], F.col("n_style")
    uniform = (i < warm) | (total(state["counts"], "bigint") == 0)
    draw = lambda slot: unit_draw(F.lit(seed), F.col("task"), ratio_key(), F.col("grp"), i, slot)
    drawn = let(style_weights(state["sums"], state["counts"]), lambda shares: F.transform(first_slots(n_style), lambda slot: F.struct(
        slot.alias("slot"), F.lit(False).alias("icl"), sample_style(draw(slot), shares, uniform).alias("style_idx"))))
    shown = let(running_pool(state["demos"]), lambda pool: icl_tries(pool, n_style, F.col("n_icl")))
    scored = F.transform(F.concat(drawn, shown), lambda t: F.struct(
        t["slot"].alias("slot"), t["icl"].alias("icl"), t["style_idx"].alias("style_idx"), F.get(prompt["scores"], t["style_idx"]).alias("score")))

    def after(tries: Column) -> Column:
        return let(best_candidate(tries), lambda best: close(tries, best))

    def close(tries: Column, best: Column) -> Column:
        demo = F.struct(i.alias("iteration"), prompt["sample_id"].alias("sample_id"), best["icl"].alias("icl"), best["style_idx"].alias("style_idx"),
                        best["score"].alias("score"), comparative_advantage(F.transform(tries, lambda t: t["score"]), kind).alias("ca"))
        sums, counts = running_style_state(state, best)
        demos = F.when(best.isNull(), state["demos"]).otherwise(F.concat(state["demos"], F.array(demo)))
        return F.struct(sums.alias("sums"), counts.alias("counts"), demos.alias("demos"))

    return let(F.filter(scored, lambda t: t["score"].isNotNull()), after)


def adaptation(scores: DataFrame, roles: DataFrame, ratios, adapt_size: int = 10, n_total: int = 5,
               warmup_ratio: float = 0.5, seed: int = 42, configs=None):
    """``adaptation``: run ``adapt_size`` rounds for all groups at once.

    ``scores``: ``task, sample_id, ratio, style, score`` for every style; ``roles``: output of :func:`adapt_infer_split` (with ``grp``).
    ``configs``: ``[(config, n_style, n_icl)]``, run side by side as a group
    column (default: one ``full`` config with ``N//2`` style draws and the
    rest few-shot tries). Returns ``(demonstrations, style_stats)``.
    """
    if configs is None:
        configs = [("full", n_total // 2, n_total - n_total // 2)]
    cfg = F.array(*[F.struct(F.lit(c).alias("config"), F.lit(a).alias("n_style"), F.lit(b).alias("n_icl"))
                    for c, a, b in configs])
    kinds = F.create_map(*[x for t, (_, k) in TASK_SETTINGS.items() for x in (F.lit(t), F.lit(k))])
    adapt = (roles.where("is_adapt").select("task", "grp", "sample_id", "pos")
             .withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios]))))
    by_style = scores.groupBy("task", "sample_id", "ratio").agg(F.array(*[
        F.max(F.when(F.col("style") == s, F.col("score"))) for s in STYLE_NAMES]).alias("scores"))
    adapt = adapt.join(by_style, ["task", "sample_id", "ratio"], "left")
    id_type = roles.schema["sample_id"].dataType.simpleString()
    demo = f"array<struct<iteration:int,sample_id:{id_type},icl:boolean,style_idx:int,score:double,ca:double>>"
    start = F.struct(F.array_repeat(F.lit(0.0), N_STYLES).alias("sums"), F.array_repeat(F.lit(0).cast("bigint"), N_STYLES).alias("counts"),
                     F.array().cast(demo).alias("demos"))
    # At most adapt_size prompts a group.
    groups = adapt.groupBy("task", "ratio", "grp").agg(F.array_sort(F.collect_list(F.struct("pos", "sample_id", "scores"))).alias("prompts"))
    groups = groups.withColumn("c", F.explode(cfg)).select("task", "ratio", "grp", "prompts", "c.*")
    state = F.aggregate("prompts", start, lambda a, x: _round(a, x, warmup_ratio * adapt_size, seed, kinds[F.col("task")]))
    done = cut_lineage(groups.select(*GKEY, state.alias("state")))
    demos = done.select(*GKEY, F.explode("state.demos").alias("d")).select(
        *GKEY, "d.iteration", "d.sample_id", F.when(F.col("d.icl"), F.lit("icl")).otherwise(style_name(F.col("d.style_idx"))).alias("style_used"),
        style_name(F.col("d.style_idx")).alias("text_style"), "d.score", "d.ca")
    stats = done.select(*GKEY, F.posexplode(F.arrays_zip("state.sums", "state.counts")).alias("style_idx", "x")).select(
        *GKEY, "style_idx", style_name(F.col("style_idx")).alias("style"), F.col("x.sums").alias("perf_sum"), F.col("x.counts").alias("n"))
    stats = stats.withColumn("avg_perf", F.when(F.col("n") > 0, F.col("perf_sum") / F.col("n"))
                             .otherwise(F.lit(0.0)))
    return demos, stats


def top_demos(demos: DataFrame, s_col="S") -> DataFrame:
    """``top_demos``: the S best demonstrations per group by (ca desc, iteration asc)."""
    s_map = F.create_map(*[x for t, (s, _) in TASK_SETTINGS.items() for x in (F.lit(t), F.lit(s))])
    w = Window.partitionBy(*GKEY).orderBy(F.col("ca").desc(), F.col("iteration"))
    return (demos.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= s_map[F.col("task")]))


def style_ranking(stats: DataFrame, top: int = 10) -> DataFrame:
    """``rank_styles``: styles by mean performance desc (ties by name), first ``top`` per group."""
    w = Window.partitionBy(*GKEY).orderBy(F.col("avg_perf").desc(), F.col("style"))
    return stats.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def demo_arrays(demos: DataFrame, texts: DataFrame) -> DataFrame:
    """Top-S demonstrations of each group as ``array<struct<rank, original, compressed>>``.

    ``texts``: ``task, sample_id, ratio, style, prompt, compressed`` of the
    adapted candidates. The array holds at most S (<= 3) entries per group.
    """
    td = top_demos(demos).join(texts.withColumnRenamed("style", "text_style"),
                               ["task", "sample_id", "ratio", "text_style"])
    return td.groupBy(*GKEY).agg(F.sort_array(F.collect_list(
        F.struct("rank", F.col("prompt").alias("original"), "compressed", "text_style"))).alias("demos"))


def inference(infer_samples: DataFrame, demo_arr: DataFrame, ratios, configs, corpus: DataFrame | None = None,
              completions_fn=None):
    """``inference``: few-shot request with the group's top-S demos, style ``for_<task>``.

    Returns candidate rows (``compressed``, ``source``, ``request_id``) ready for scoring, one for each prompt, ratio
    and config. Groups without demonstrations have no request and fall back to the prefix, like a failed call.
    The stand-in model answers in the style of the best demonstration shown.
    """
    from abridge.operators.candidates import add_targets, rule_of, with_tokens
    from abridge.operators.compress import compress_by, with_parts, with_scores
    from abridge.operators.requests import join_completions, standin_completions, with_request
    cfg = F.array(*[F.lit(c) for c, _, _ in configs])
    rules = F.create_map(*[F.lit(x) for s in STYLE_NAMES for x in (s, rule_of(s))])
    names = {rule_of(s) for s in STYLE_NAMES}
    df = (with_parts(with_tokens(with_scores(infer_samples, names, corpus)), names)
          .withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
          .withColumn("config", F.explode(cfg)).join(demo_arr, GKEY, "left"))
    df = df.withColumn("answer_style", F.coalesce(F.get(F.col("demos"), F.lit(0))["text_style"], F.lit("loc-begin")))
    df = add_targets(df.withColumn("rule", rules[F.col("answer_style")]))
    df = df.withColumn("compressed", compress_by(F.col("rule"), F.col("target"), F.col("ratio"), names)).drop("parts")
    df = with_request(df.withColumn("style", F.concat(F.lit("for_"), F.col("task"))), "style", demos_col="demos")
    asked = df.where(F.col("demos").isNotNull()).select("request_id", F.col("answer_style").alias("style"), "compressed")
    # Ids alone meet the completions: the request, its demonstrations and token arrays stay behind.
    df = df.drop("request", "demos", "ref_rt", "ref_ids")
    return join_completions(df, completions_fn(asked) if completions_fn else standin_completions(asked))
