"""Model requests and responses as tables (``join_completions``).

The engine never calls a model. A request table holds the rendered prompt
and ``request_id = md5(request)``; a ``completions`` table
``(request_id, response)`` holds whatever a model produced (filled by the
user's own job). ``join_completions`` left-joins responses, parses them,
truncates to the budget and falls back to the prefix rule where no usable
response exists, exactly like a failed call.

For the test tables a rule-backed stand-in model answers every request of a
style that has a rule (wrapped in a labelled response with a lead-in and a
note, so parsers are exercised); styles without a rule get no response.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abridge.functions.text import (TMPL_FEW_SHOT, TMPL_LINGUA_PLAIN, TMPL_LINGUA_TARGET, TMPL_QA,
                                    TMPL_REASON, TMPL_RECONSTRUCT, TMPL_VANILLA, TMPL_ZERO_SHOT,
                                    examples_block, let, parse_compression, parse_lingua, parse_vanilla, render)
from abridge.functions.tokens import once, truncate_tokens, ws_tokens
from abridge.operators.catalog import STYLES, STYLE_RULE

PARSERS = {"style": parse_compression, "vanilla": parse_vanilla, "lingua": parse_lingua,
           "lingua_plain": parse_compression}

# The stand-in model's response wrapper.
STANDIN_PREFIX = "Here's the compressed text:\nCompressed Text: "
STANDIN_SUFFIX = "\n\nNote: produced by a rule."


def instruction_col(style: F.Column | None = None) -> F.Column:
    """``join_style``: style -> instruction, '' when unknown (literal map lookup)."""
    m = F.create_map(*[x for s, i in STYLES for x in (F.lit(s), F.lit(i))])
    return F.coalesce(m[F.col("style") if style is None else style], F.lit(""))


def with_request(df: DataFrame, kind: str = "style", demos_col: str | None = None) -> DataFrame:
    """Render the request of every candidate row and its ``request_id``.

    ``kind``: ``style`` (zero-shot, or few-shot when ``demos_col`` is given),
    ``vanilla``, ``lingua`` (states the target), ``lingua_plain``.
    """
    if kind == "style" and demos_col:
        req = render(TMPL_FEW_SHOT, target="target", instruction=instruction_col(),
                     examples=examples_block(F.col(demos_col)), text="prompt")
    else:
        req = request_text(kind, F.col("target"), F.col("style"))
    return df.withColumn("request", req).withColumn("request_id", F.md5("request"))


def request_text(kind: str, target: F.Column, style: F.Column) -> F.Column:
    """The request of ``kind`` about a sample's ``prompt``, without demonstrations."""
    if kind == "style":
        return render(TMPL_ZERO_SHOT, target=target, instruction=instruction_col(style), text="prompt")
    if kind == "vanilla":
        return render(TMPL_VANILLA, target=target, text="prompt")
    if kind == "lingua":
        return render(TMPL_LINGUA_TARGET, target=target, text="prompt")
    if kind == "lingua_plain":
        return render(TMPL_LINGUA_PLAIN, text="prompt")
    raise ValueError(f"unknown request kind {kind!r}")


def eval_request(df: DataFrame, text_col: str = "compressed") -> DataFrame:
    """Evaluation-side requests: ``tmpl_reconstruct``, ``tmpl_qa``, ``tmpl_reason`` by task."""
    t = F.col("task")
    req = (F.when(t == "reconstruction", render(TMPL_RECONSTRUCT, compressed=text_col))
            .when(t == "qa", render(TMPL_QA, compressed=text_col, question="question"))
            .when(t == "reasoning", render(TMPL_REASON, compressed=text_col, question="question")))
    return df.withColumn("eval_request", req).withColumn("eval_request_id", F.md5("eval_request"))


def standin_completions(cands_with_requests: DataFrame) -> DataFrame:
    """Rule-backed stand-in model: ``(request_id, response)`` for styles with a rule."""
    has_rule = F.col("style").isin(*STYLE_RULE.keys())
    return (cands_with_requests.where(has_rule)
            .select("request_id", F.concat(F.lit(STANDIN_PREFIX), F.col("compressed"),
                                           F.lit(STANDIN_SUFFIX)).alias("response"))
            .dropDuplicates(["request_id"]))


def text_id() -> F.Column:
    """What a sample's requests are about: requests of one prompt, and no others, have its id. Null where no answer can come back."""
    return F.when(F.col("task").isNotNull() & F.col("sample_id").isNotNull(), F.md5("prompt"))


def said_map(entries: F.Column) -> F.Column:
    """``entries``, an array of (id, response), as a map; the first of an id counts, entries that are null or lack a response do not."""
    answered = lambda e: F.filter(e, lambda x: x["response"].isNotNull())
    ids = lambda e: F.transform(e, lambda x: x["id"])
    first = let(answered(entries), lambda e: let(ids(e), lambda k: F.filter(e, lambda x, i: F.array_position(k, x["id"]) == i + 1)))
    return F.map_from_entries(first)


def standin_answers(grid) -> F.Column:
    """:func:`standin_completions` of a sample's ``grid`` as an array of (id, response).

    A rule's texts stand side by side: they have much in common, which the codec of a shuffle finds only if they are near.
    """
    of = lambda rule: F.filter(grid, lambda g: g["rule"] == rule)
    by_rule = F.concat(*map(of, sorted(set(STYLE_RULE.values()))))
    ruled = lambda g: F.filter(g["styles"], lambda s: s.isin(*STYLE_RULE))
    return F.flatten(F.transform(by_rule, lambda g: F.transform(ruled(g), lambda s: F.struct(
        F.md5(request_text("style", g["target"], s)).alias("id"),
        F.concat(F.lit(STANDIN_PREFIX), g["compressed"], F.lit(STANDIN_SUFFIX)).alias("response")))))


def with_answers(samples: DataFrame, answers: DataFrame) -> DataFrame:
    """``samples`` with ``_said``, the answers about its prompt by request id, for :func:`answer_calls`.

    ``answers``: ``text_id`` and ``said``, a row an asked prompt with all its answers. Request and answer meet where their prompt's
    id goes: an answer moves once, beside the prompt's other answers that say much the same, and a prompt moves without tokens,
    requests or ids.
    """
    said = answers.where(F.col("text_id").isNotNull()).dropDuplicates(["text_id"]).withColumnRenamed("said", "_said")
    return samples.withColumn("text_id", text_id()).join(said.hint("merge"), "text_id", "left").drop("text_id")


def join_completions(requests: DataFrame, completions: DataFrame, kind: str = "style") -> DataFrame:
    """Left-join responses, parse, truncate to ``target``; prefix fallback when missing.

    Adds ``compressed`` and ``source`` (``completion`` / ``fallback``). Only request ids and responses are dealt out by
    request; a sample's answers (at most one for each of its requests) come back to it as a map, so no prompt moves for it.
    """
    parse = PARSERS[kind]
    keys = ["task", "sample_id"]
    ids = requests.select(*keys, "request_id").where(F.col("request_id").isNotNull()).distinct()
    said = (ids.join(completions, "request_id").groupBy(*keys)
            .agg(F.map_from_entries(F.collect_list(F.struct("request_id", "response"))).alias("_said")))
    # Tokens are several times the prompt: they are made again behind the join, and only where they are used.
    j = requests.drop("compressed", "tok").join(said.hint("merge"), keys, "left")  # texts: never sent whole to the driver
    j = j.withColumn("response", F.col("_said")[F.col("request_id")]).drop("_said").withColumn("tok", ws_tokens("prompt"))
    parsed = parse(F.col("response"))
    ptok = ws_tokens(parsed)
    from_model = truncate_tokens(parsed, ptok, F.col("target"))
    fallback = truncate_tokens(F.col("prompt"), F.col("tok"), F.col("target"))
    return (j.withColumn("source", F.when(F.col("response").isNotNull(), "completion").otherwise("fallback"))
             .withColumn("compressed", F.when(F.col("response").isNotNull(), from_model).otherwise(fallback)))


def answer_calls(df: DataFrame, completions: DataFrame | None, parse, ids=("request_id",), keys=("task", "sample_id")) -> DataFrame:
    """:func:`join_completions` for samples whose requests are an array: a prompt and its tokens are there once.

    ``df``: a row a sample with ``prompt`` and ``calls``, an array of structs with ``target`` and the columns ``ids``
    that name a completion (``request_id`` null: none is asked for). ``completions``: ``ids`` and ``response``. Ids and
    responses alone are dealt out by request; answers come back to their sample as a map. None: :func:`with_answers` has brought
    them. ``parse``: call with its
    ``response`` -> text. Adds ``response, source, compressed`` to every call.
    """
    name = lambda c: F.concat_ws("|", *[c[i] for i in ids])
    if completions is not None:
        asked = df.select(*keys, F.explode("calls").alias("c")).select(*keys, *[F.col(f"c.{i}").alias(i) for i in ids])
        asked = asked.where(F.col("request_id").isNotNull()).distinct()
        entry = F.struct(F.concat_ws("|", *ids), "response")
        said = asked.join(completions.hint("merge"), list(ids)).groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_said"))
        # Tokens are several times the prompt: they are made again behind the join.
        df = once(df.drop("tok").join(said.hint("merge"), list(keys), "left"), tok=ws_tokens("prompt"))
    fields = df.schema["calls"].dataType.elementType.names

    def add(calls, have, **made):
        return F.transform(calls, lambda c: F.struct(*[c[f].alias(f) for f in have], *[m(c).alias(n) for n, m in made.items()]))

    # One step after the other, so that no parser runs twice over a text.
    calls = add("calls", fields, response=lambda c: F.col("_said")[name(c)])
    calls = add(calls, [*fields, "response"], said=parse)
    calls = add(calls, [*fields, "response", "said"], words=lambda c: ws_tokens(c["said"]))
    source = lambda c: (F.when(c["request_id"].isNull(), "rule").when(c["response"].isNull(), "fallback")
                        .otherwise("completion"))
    text = lambda c: (F.when(c["response"].isNull(), truncate_tokens(F.col("prompt"), F.col("tok"), c["target"]))
                      .otherwise(truncate_tokens(c["said"], c["words"], c["target"])))
    return once(df, calls=add(calls, [*fields, "response"], source=source, compressed=text)).drop("_said")
