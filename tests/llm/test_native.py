"""Quality rules, exact dedup, chat formatting and mixing against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_rules(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {p for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for p in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_quality_rules(docs, rows, clashing, no_docs):
    from abridge.llm.quality_rules import quality_rules
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    want = sorted((r[0], *brute_rules(r[1])) for r in rows)
    assert sorted(map(tuple, quality_rules(docs).select(cols).collect())) == want
    out = quality_rules(clashing)
    assert sorted(map(tuple, out.select(cols).collect())) == want and out.columns.count("kept") == 1
    assert not quality_rules(docs).where("base_failed and kept").count()
    assert quality_rules(no_docs).count() == 0


def test_quality_rules_is_one_projection(docs):
    from abridge.llm.quality_rules import quality_rules
    plan = quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryTableScan")[0] and "Python" not in plan


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(docs, rows, clashing, no_docs, keep):
    from abridge.llm.exact_dedup import exact_dedup
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    pick = {"min": min, "max": max}[keep]
    want = sorted((i, pick(g), len(g), i == pick(g), hashlib.sha256(t.encode()).hexdigest())
                  for t, g in groups.items() for i in g)
    for d in (docs, clashing):
        got = exact_dedup(d, keep=keep, digest=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
        assert sorted(map(tuple, got.collect())) == want
    assert exact_dedup(no_docs).count() == 0


def test_exact_dedup_spreads_a_hot_text(spark):
    from abridge.llm.common import hot_keys
    from abridge.llm.exact_dedup import exact_dedup
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Hot TEXT").otherwise(
        F.concat(F.lit("t"), (F.col("id") / 2).cast("int").cast("string"))).alias("text"))
    hot, = hot_keys(d.withColumn("_hash", F.xxhash64("text")), "_hash", "doc_id").collect()
    assert hot["n_parts"] > 8  # several ranges of several partitions
    got = exact_dedup(d, keep="min")
    hot = got.where("text = 'Hot TEXT'").agg(F.min("keep_id"), F.max("keep_id"), F.min("group_size"), F.max("group_size"),
                                             F.sum(F.col("kept").cast("int"))).first()
    assert tuple(hot) == (0, 0, 6667, 6667, 1)
    assert got.count() == 20_000


def test_exact_dedup_of_a_hot_text_beside_inner_names(spark):
    """Columns that are called like the operator's own, on the path for hot texts too."""
    from abridge.llm.exact_dedup import exact_dedup
    names = ["n_parts", "_norm", "_prefix", "_hash", "_salt", "_h", "_s", "_head", "_keep", "_size", "_n"]
    d = spark.range(5_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "Hot").otherwise(F.col("id").cast("string")).alias("text"),
                                  *[F.lit(n).alias(n) for n in names])
    got = exact_dedup(d, keep="max")
    assert got.columns == ["doc_id", "text", *names, "keep_id", "group_size", "kept"]
    assert got.where(" and ".join(f"{n} = '{n}'" for n in names)).count() == 5_000
    assert got.where("text = 'Hot'").select("keep_id", "group_size").distinct().collect() == [(4998, 2500)]


def test_mix_beside_inner_names(spark, docs):
    from abridge.llm.mixing import mix, repeated
    names = ["whole", "last_draw", "_s", "_draw", "_c", "copy", "draw"]
    got = mix(docs.withColumns({n: F.lit(n) for n in names}))
    assert sorted(got.select(docs.columns + ["taken"]).collect(), key=repr) == sorted(mix(docs).select(docs.columns + ["taken"]).collect(), key=repr)
    assert got.columns == docs.columns + names + ["size", "source_size", "target", "copies", "taken"]
    assert repeated(got).columns == docs.columns + names


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup_of_hot_texts_that_share_ids(spark, keep):
    """Two hot texts with the same ids, null ids among them: the same rows as below the hot limit."""
    from abridge.llm.exact_dedup import exact_dedup
    ids = F.when(F.col("id") % 50 != 0, F.col("id") % 4_000).alias("doc_id")
    d = spark.range(8_000).select(ids, F.when(F.col("id") < 4_000, "hot TEXT").otherwise("Hot edited text").alias("text"))
    got = exact_dedup(d, keep=keep)
    want = 1 if keep == "min" else 3_999
    assert [tuple(r) for r in got.groupBy("text").agg(
        F.count(F.lit(1)), F.min("keep_id"), F.max("keep_id"), F.count("keep_id"), F.min("group_size"), F.max("group_size"),
        F.sum(F.col("kept").cast("int"))).orderBy("text").collect()] == [
            (t, 4_000, want, want, 4_000, 4_000, 4_000, 1) for t in ("Hot edited text", "hot TEXT")]


TURNS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi </s>\n & &amp; [x] <s>[user]\n"), (1, 2, "assistant", "A&lt;B"),
    (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "assistant", "again\n"), (1, 6, "user", "tail"),
    (2, 0, "user", "no reply"), (3, 0, "assistant", "é漢"), (3, 0, "assistant", "é漢"), (4, None, None, None),
    (None, 7, "assistant", "who?"),
]


def test_chat(spark):
    from abridge.llm.chat import chat_examples, masked_text, read_back
    schema = "conv_id long, turn long, role string, text string, loss_start string"
    t = spark.createDataFrame([(*r, "x") for r in TURNS], schema)
    convs = defaultdict(list)
    for c, turn, role, text in TURNS:
        convs[c].append((turn if turn is not None else -1, role or "", text or ""))
    ex = chat_examples(t)
    replies = ex.where("loss_length > 0 or n_context >= 0").count()
    assert replies == sum(sum(x[1] == "assistant" for x in v) + (sorted(v)[-1][1] != "assistant") for v in convs.values())
    n = {r[0]: r[1] for r in ex.groupBy("conv_id").agg(F.sum(F.length("text"))).collect()}
    for r in read_back(ex).collect():
        v = sorted(convs[r["conv_id"]])
        loss = "".join(x[2] for x in v if x[1] == "assistant")
        assert r["n_turns"] == len(v) and r["formatted_chars"] == n[r["conv_id"]]
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[1]}\n{x[2]}\n" for x in v).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        del convs[r["conv_id"]]
    assert not convs
    one = ex.where("conv_id = 1").orderBy("example").select(masked_text(F.col("text"), F.col("loss_start"), F.col("loss_length")))
    assert [r[0] for r in one.collect()] == ["A&lt;B", "", "again\n", ""]
    assert read_back(chat_examples(t.limit(0))).count() == 0


def fill(sizes, weights=(5, 2, 1), cap=3):
    """Clamp and reshare until none is above its cap."""
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    done, left = {}, sum(sizes.values())
    while True:
        rest = [s for s in names if s not in done]
        total = sum(w[s] for s in rest)
        over = [s for s in rest if left * w[s] / total > cap * sizes[s] + 1e-9]
        if not over:
            return done | {s: left * w[s] / total for s in rest}
        for s in over:
            done[s] = cap * sizes[s]
        left = sum(sizes.values()) - sum(done.values())


def test_mixing(docs, rows, clashing, no_docs):
    from abridge.llm.mixing import mix, repeated
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    source = {r[0]: r[3] for r in rows}
    sizes = Counter()
    for i, s in source.items():
        sizes[s] += size[i]
    want = fill(sizes)
    for d in (docs, clashing):
        got = mix(d).select("doc_id", "size", "source_size", "target", "taken").collect()
        taken = Counter()
        assert sorted(r["doc_id"] for r in got) == sorted(size)
        for r in got:
            s = source[r["doc_id"]]
            assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[s]
            assert r["target"] == pytest.approx(want[s]) and r["taken"] <= 3 * r["size"]
            taken[s] += r["taken"]
        for s in sizes:
            assert abs(taken[s] - want[s]) <= max(size[i] for i in size if source[i] == s)
        assert sorted(map(tuple, got)) == sorted(map(tuple, mix(d).select("doc_id", "size", "source_size", "target", "taken").collect()))
    m = mix(docs)
    assert repeated(m).count() == m.agg(F.sum("copies")).first()[0] and repeated(m).columns == docs.columns
    assert mix(no_docs).count() == 0


def test_water_fill_clamps_and_reshares(spark):
    from abridge.llm.mixing import water_fill
    for sizes in ({"a": 1, "b": 50, "c": 3, "d": 400, None: 7}, {"a": 0, None: 0}, {"a": 10}, {"a": 1, "b": 1, "c": 1000}):
        got = {r["source"]: r["target"] for r in water_fill(
            spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got == pytest.approx(fill(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0))
