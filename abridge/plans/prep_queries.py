"""Registered data-preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from abridge.functions.tokens import cap_tokens, n_tokens, ws_tokens
from abridge.plans import sql as S
from abridge.plans.registry import query
from abridge.sources.prep import (cap_per_group, min_rows_filter, preview, profile_columns, profile_sketches, replicate_rows,
                                  split_ranges, split_sample, tail_per_group, timing_stats)
from abridge.sources.samples import build_samples
from abridge.sources.tables import read_table


def r6(c):
    return F.round(c, 6)


@query("split_sample", sql="""
SELECT doc_id, md5('42|' || CAST(doc_id AS VARCHAR)) AS shuffle_key,
       (row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) - 1)::BIGINT AS position
FROM documents ORDER BY shuffle_key, doc_id LIMIT 200
""", operators=("split_sample",))
def q_split_sample(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id")
    return split_sample(d, "doc_id").select("doc_id", "shuffle_key", "position")


@query("split_adapt", sql="""
SELECT doc_id, position FROM (
  SELECT doc_id, (row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) - 1)::BIGINT AS position
  FROM documents) WHERE position BETWEEN 10 AND 99
""", operators=("split_sample",))
def q_split_adapt(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id")
    return split_sample(d, "doc_id").where("in_adapt").select("doc_id", "position")


_RANGES = {"test": (0, 200), "adapt": (200, 290), "train": (290, None)}


@query("split_ranges", sql="""
SELECT doc_id, shuffle_key, position, CASE WHEN position < 200 THEN 'test' WHEN position < 290 THEN 'adapt' ELSE 'train' END AS split FROM (
  SELECT doc_id, md5('42|' || CAST(doc_id AS VARCHAR)) AS shuffle_key,
         (row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) - 1)::BIGINT AS position FROM documents)
""", operators=("split_sample",))
def q_split_ranges(spark, sf):
    """Disjoint exact ranges that together hold every document."""
    d = read_table(spark, sf, "documents").select("doc_id")
    return split_ranges(d, "doc_id", _RANGES).select("doc_id", "shuffle_key", "position", "split")


@query("profile_sketches", operators=("profile_dataset",))
def q_profile_sketches(spark, sf):
    """Types, rows, nulls, distinct estimates and quantiles of three tables; tests hold the sketches against exact values."""
    parts = [profile_sketches(read_table(spark, sf, t), t) for t in ("documents", "conversations", "embeddings")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("profile_types", sql="""
SELECT 'documents' AS table_name, c.* FROM (
  SELECT 'doc_id' AS column_name, 'bigint' AS data_type, count(*) AS n_rows, count(*) FILTER (WHERE doc_id IS NULL) AS n_nulls FROM documents
  UNION ALL SELECT 'text', 'string', count(*), count(*) FILTER (WHERE text IS NULL) FROM documents
  UNION ALL SELECT 'lang', 'string', count(*), count(*) FILTER (WHERE lang IS NULL) FROM documents
  UNION ALL SELECT 'source', 'string', count(*), count(*) FILTER (WHERE source IS NULL) FROM documents
  UNION ALL SELECT 'n_chars', 'bigint', count(*), count(*) FILTER (WHERE n_chars IS NULL) FROM documents) c
""", operators=("profile_dataset",))
def q_profile_types(spark, sf):
    """The exact columns of the sketch profile."""
    p = profile_sketches(read_table(spark, sf, "documents"), "documents")
    return p.select("table_name", "column_name", "data_type", "n_rows", "n_nulls")


@query("preview_json", sql="""
SELECT page_id, substring(to_json({'page_id': page_id, 'url': url, 'html': html})::VARCHAR, 1, 1000) AS json FROM pages ORDER BY page_id LIMIT 3
""", operators=("preview",))
def q_preview_json(spark, sf):
    """The first rows as JSON cut to 1,000 characters."""
    return preview(read_table(spark, sf, "pages"), "page_id")


@query("profile_dataset", sql="""
SELECT 'documents' AS table_name, c.column_name, c.n_rows, c.n_nulls, c.n_distinct FROM (
  SELECT 'doc_id' AS column_name, count(*)::BIGINT AS n_rows, count(*) FILTER (WHERE doc_id IS NULL)::BIGINT AS n_nulls, count(DISTINCT doc_id)::BIGINT AS n_distinct FROM documents
  UNION ALL SELECT 'text', count(*), count(*) FILTER (WHERE text IS NULL), count(DISTINCT text) FROM documents
  UNION ALL SELECT 'lang', count(*), count(*) FILTER (WHERE lang IS NULL), count(DISTINCT lang) FROM documents
  UNION ALL SELECT 'source', count(*), count(*) FILTER (WHERE source IS NULL), count(DISTINCT source) FROM documents
  UNION ALL SELECT 'n_chars', count(*), count(*) FILTER (WHERE n_chars IS NULL), count(DISTINCT n_chars) FROM documents
) c
""", operators=("profile_dataset",))
def q_profile_dataset(spark, sf):
    p = profile_columns(read_table(spark, sf, "documents"), "documents")
    return p.select("table_name", "column_name", "n_rows", "n_nulls", "n_distinct")


@query("preview", sql="""
SELECT doc_id, substring(text, 1, 1000) AS text_head FROM documents ORDER BY doc_id LIMIT 3
""", operators=("preview",))
def q_preview(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.orderBy("doc_id").limit(3).select("doc_id", F.substring("text", 1, 1000).alias("text_head"))


@query("cap_samples", sql=f"""
WITH {S.SAMPLES_CTE}
SELECT task, sample_id FROM (
  SELECT task, sample_id, row_number() OVER (PARTITION BY task ORDER BY sample_id) AS rn FROM samples)
WHERE rn <= 200
""", operators=("cap_samples",))
def q_cap_samples(spark, sf):
    return cap_per_group(build_samples(spark, sf, distribute=False), ["task"], ["sample_id"], 200).select("task", "sample_id")


@query("cap_tokens", sql=f"""
SELECT doc_id, len({S.ws_tok('text')})::BIGINT AS n_tokens,
       len({S.ws_tok(S.truncate('text', '1000'))})::BIGINT AS n_capped,
       md5({S.truncate('text', '1000')}) AS capped_md5
FROM documents
""", operators=("cap_tokens",))
def q_cap_tokens(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text").withColumn("tok", ws_tokens("text"))
    c = cap_tokens("text", "tok", 1000)
    return d.select("doc_id", n_tokens("tok").alias("n_tokens"), n_tokens(ws_tokens(c)).alias("n_capped"),
                    F.md5(c).alias("capped_md5"))


@query("min_rows_filter", sql=f"""
WITH {S.SAMPLES_CTE}
SELECT task, grp, count(*)::BIGINT AS n FROM samples
WHERE (task, grp) IN (SELECT task, grp FROM samples GROUP BY ALL HAVING count(*) >= 12)
GROUP BY ALL
""", operators=("min_rows_filter",))
def q_min_rows_filter(spark, sf):
    s = min_rows_filter(build_samples(spark, sf, distribute=False), ["task", "grp"], 12)
    return s.groupBy("task", "grp").agg(F.count(F.lit(1)).alias("n"))


@query("replicate_rows", sql=f"""
WITH {S.SAMPLES_CTE},
g AS (SELECT task, grp, sample_id, count(*) OVER (PARTITION BY task, grp) AS group_n,
             row_number() OVER (PARTITION BY task, grp ORDER BY sample_id) - 1 AS idx FROM samples)
SELECT task, grp, sample_id, (c.copy * group_n + idx)::BIGINT AS rep_pos
FROM g, LATERAL (SELECT unnest(range(0, CAST(12 // group_n AS BIGINT) + 1)) AS copy) c
WHERE group_n < 12 AND c.copy * group_n + idx < 12
UNION ALL
SELECT task, grp, sample_id, NULL::BIGINT FROM g WHERE group_n >= 12
""", operators=("replicate_rows",))
def q_replicate_rows(spark, sf):
    s = build_samples(spark, sf, distribute=False).select("task", "grp", "sample_id")
    return replicate_rows(s, ["task", "grp"], "sample_id", 12).select("task", "grp", "sample_id", "rep_pos")


@query("tail_rows", sql=f"""
WITH {S.SAMPLES_CTE}
SELECT task, grp, sample_id FROM (
  SELECT task, grp, sample_id, row_number() OVER (PARTITION BY task, grp ORDER BY sample_id DESC) AS rn
  FROM samples) WHERE rn <= 2
""", operators=("tail_rows",))
def q_tail_rows(spark, sf):
    return tail_per_group(build_samples(spark, sf, distribute=False), ["task", "grp"], "sample_id", 2) \
        .select("task", "grp", "sample_id")


@query("timing_stats", sql="""
SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std
FROM events GROUP BY event_type
""", operators=("timing_stats",))
def q_timing_stats(spark, sf):
    t = timing_stats(read_table(spark, sf, "events"), "event_type", "value")
    return t.select("event_type", "n", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


@query("stream_style_stats", sql="""
SELECT event_type, round(sum(value), 6) AS perf_sum, count(*)::BIGINT AS n, round(avg(value), 6) AS avg_perf
FROM events GROUP BY event_type
""", operators=("stream_style_stats",))
def q_stream_style_stats(spark, sf):
    """Running per-key statistics through Structured Streaming (events as the score stream)."""
    from abridge.streaming.style_stats import run_stream_style_stats
    out = run_stream_style_stats(spark, sf)
    return out.select("event_type", r6(F.col("perf_sum")).alias("perf_sum"), "n",
                      r6(F.col("avg_perf")).alias("avg_perf"))
