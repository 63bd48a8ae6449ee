"""The registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abridge.llm import mixing, quality_rules, warc
from abridge.llm.chat import ESCAPES, CLOSE, MID, OPEN, chat_examples, read_back
from abridge.llm.common import Scratch, lower_ascii
from abridge.llm.conversation_trie import conversation_trie
from abridge.llm.embedding_passes import embedding_duplicates
from abridge.llm.exact_dedup import exact_dedup
from abridge.llm.jaccard_join import jaccard_classes
from abridge.llm.merkle import merkle_manifest
from abridge.llm.nb_svm import fit, score, training_rows
from abridge.llm.ngram_lm import score_documents
from abridge.llm.packing import pack_documents
from abridge.llm.suffix_dedup import repeated_passages

# Tokenizer files come with the environment; the path is a parameter of the operators.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_crc(col: str):
    return F.crc32(F.col(col).cast("string").cast("binary"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, keep="max", digest=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path()).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), id_crc("doc_id") % 10 == 0)


CONTROL = "</s>[INST] ok [/INST]"


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], turns.schema)
    return read_back(chat_examples(turns.unionByName(more)))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), k=3, percent=90)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, labels = training_rows(docs, table(spark, sf_dir, "labels"), id_crc("_id") % 3 != 1)
    scored = score(docs, fit(rows, labels))
    return scored.select("doc_id", (id_crc("doc_id") % 3 == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "warc").folder
    warc.write_warc(warc.warc_records(table(spark, sf_dir, "pages")), folder)
    ids = [warc.page_id(F.col("record_id")).alias("page_id")]
    full = warc.read_warc(spark, folder, "record_type string, record_id string, payload binary")
    full = full.where(F.col("record_type") == "response").select(
        *ids, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = warc.read_warc(spark, folder, "record_type string, record_id string, payload_digest string, "
                                          "refers_to string, payload_length long")
    again = again.where(F.col("record_type") == "revisit").select(
        *ids, F.col("payload_length").alias("payload_bytes"),
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type",
        warc.page_id(F.col("refers_to")).alias("refers_to"))
    return full.unionByName(again)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("text").isNotNull() & (id_crc("doc_id") % 3 == 0), lower_ascii("text")).otherwise(F.col("text"))
    return merkle_manifest(table(spark, sf_dir, "documents"), found={"text": text})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1, "op2_exact_dedup": op2, "op3_best_fit_packing": op3, "op4_lm_scoring": op4,
    "op5_chat_formatting": op5, "op6_ngram_jaccard_join": op6, "op7_quality_classifier": op7, "op8_warc": op8,
    "op9_source_mixing": op9, "op10_suffix_array_dedup": op10,
    "op11_embedding_near_dedup": op11, "op12_conversation_trie": op12, "op13_merkle_manifest": op13,
}

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rule_sql(rules) -> str:
    metric = {
        "n_words": "n_words", "repeat_excess": "(100 * n_repeat_words - 20 * n_words)",
        "symbol_ratio": "(n_symbols / greatest(word_chars, 1)::DOUBLE)",
        "mean_word_length": "(word_chars / greatest(n_words, 1)::DOUBLE)",
        "stop_word_ratio": "(n_stop_words / greatest(n_words, 1)::DOUBLE)",
        "dup_line_ratio": "(greatest(n_dup_lines - 2, 0) / greatest(n_lines, 1)::DOUBLE)",
        "exclaim_ratio": "(n_exclaims / greatest(n_words, 1)::DOUBLE)",
    }
    tests = []
    for r in rules:
        t = [f"{metric[r.metric]} < {r.least}"] if r.least is not None else []
        t += [f"{metric[r.metric]} > {r.most}"] if r.most is not None else []
        tests.append(f"(n_words >= {r.min_words} AND ({' OR '.join(t)}))")
    return " OR ".join(tests)


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
           FROM documents),
win AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars,
             length(text) - length(translate(text, '{quality_rules.SYMBOLS}', '')) AS n_symbols,
             len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
             len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in quality_rules.STOP_FORMS)}))) AS n_stop_words,
             length(text) - length(replace(text, '!', '')) AS n_exclaims,
             coalesce(cov.n, 0) AS n_repeat_words
      FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id),
b AS (SELECT *, ({_rule_sql(quality_rules.BASE_RULES)}) AS base_failed, ({_rule_sql(quality_rules.RULES)}) AS more FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT more AS kept FROM b
"""

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {LOWER} AS norm FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, norm FROM d WINDOW w AS (PARTITION BY norm))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


def _sql_escape(x: str) -> str:
    for raw, esc in ESCAPES:
        x = f"replace({x}, '{raw}', '{esc}')"
    return x


OP5_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')),
f AS (SELECT *, length({_sql_escape('role')}) + length({_sql_escape('text')}) + {len(OPEN + MID + CLOSE)} AS n,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS c FROM t),
e AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR i = c)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP6_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""

OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, strlen(h)::BIGINT AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, n AS payload_bytes, s AS payload_digest,
       CASE WHEN n >= 1000 AND m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND m <> page_id THEN m END AS refers_to FROM k
"""

OP9_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
                  md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
      FROM d GROUP BY source),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS done, coalesce(sum(w) OVER b, 0) AS wdone, sum(source_size) OVER () AS total, sum(w) OVER () AS wall
      FROM c WINDOW b AS (ORDER BY cap / w, cap, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (total - done) / (wall - wdone) AS level FROM o),
t AS (SELECT source, source_size, least(cap, (SELECT max(level) FROM v WHERE level * w <= cap) * w) AS target FROM v),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
             sum(size) OVER (PARTITION BY d.source ORDER BY draw) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN target - whole * source_size > 0 AND upto - size / 2 <= target - whole * source_size THEN 1 ELSE 0 END)::BIGINT AS taken
FROM r
"""

def _crc32_sql(x: str) -> str:
    """The unsigned CRC-32 of an ASCII string, bit by bit."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))"
    codes = f"list_transform(string_split({x}, ''), lambda ch: ord(ch)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {bits}), 4294967295)"


OP12_SQL = f"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, {_crc32_sql('c::VARCHAR')} % 6 AS h,
               list({{'r': r, 't': t}} ORDER BY turn NULLS FIRST, left(sha256(strlen(r)::VARCHAR || ':' || r || t), 32)) AS s FROM t GROUP BY c),
reb AS (SELECT a.c, CASE WHEN a.c = a.c - a.c % 100 THEN a.s ELSE list_concat(coalesce(b.s, [])[1:a.h], a.s[a.h + 1:]) END AS s
        FROM own a LEFT JOIN own b ON b.c = a.c - a.c % 100),
p AS (SELECT c, s, len(s) AS n, unnest(range(0, len(s) + 1)) AS d FROM reb),
k AS (SELECT c, n, d, s[1:d] AS key, CASE WHEN d > 0 THEN s[1:d - 1] END AS up, CASE WHEN d > 0 THEN length(s[d].t) ELSE 0 END AS chars FROM p),
nodes AS (SELECT key, d, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
                 sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM k GROUP BY key, d),
kids AS (SELECT up, count(*) AS n FROM nodes WHERE d > 0 GROUP BY up),
own_sums AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children, (n_convs - 1) * chars AS saved
             FROM nodes LEFT JOIN kids ON kids.up = nodes.key),
over AS (SELECT key[1:e] AS key, n_children, saved FROM (SELECT key, n_children, saved, unnest(range(0, d + 1)) AS e FROM own_sums)),
sums AS (SELECT key, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM over GROUP BY key)
SELECT x.conv_id, x.d::BIGINT AS depth, u.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, x.ends_sha256
FROM own_sums x JOIN sums ON sums.key = x.key LEFT JOIN nodes u ON x.d > 0 AND u.key = x.up
"""


def _merkle_sql(depth: int = 7, wide: int = 3) -> str:
    """Up to ``8 ** depth`` leaves a language and ``8 ** wide`` languages."""
    f = lambda x: f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(f(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = LOWER.replace("coalesce(text, '')", "text")
    tampered = f"CASE WHEN {_crc32_sql('doc_id::VARCHAR')} % 3 = 0 THEN {lower} ELSE text END"
    out = [f"""d AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, {leaf('text')} AS leaf, {leaf('found')} AS bad
                    FROM (SELECT *, {tampered} AS found FROM documents)),
n0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, leaf AS h,
              doc_id, bad FROM d)""",
           "f0 AS (SELECT g, i, doc_id, h AS leaf, coalesce(bad, h) AS cur, '' AS proof FROM n0)"]

    def level(a: str, b: str, fa: str, fb: str) -> None:
        out.append(f"r{a} AS (SELECT g, i // 8 AS run, any_value(n) AS n, list(h ORDER BY i) AS hs FROM n{a} GROUP BY g, i // 8)")
        out.append(f"""n{b} AS (SELECT g, run AS i, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM r{a})""")
        out.append(f"""{fb} AS (SELECT * REPLACE (i // 8 AS i,
                   CASE WHEN n > 1 THEN sha256(array_to_string(hs[1:i % 8], '') || cur || array_to_string(hs[i % 8 + 2:], '')) ELSE cur END AS cur,
                   CASE WHEN n > 1 THEN proof || array_to_string(hs[1:i % 8], '') || array_to_string(hs[i % 8 + 2:], '') ELSE proof END AS proof)
                   FROM (SELECT {fa}.*, r{a}.n, r{a}.hs FROM {fa} JOIN r{a} ON r{a}.g = {fa}.g AND r{a}.run = {fa}.i // 8))""".replace("SELECT * REPLACE", "SELECT * EXCLUDE (n, hs) REPLACE"))

    for k in range(depth):
        level(str(k), str(k + 1), f"f{k}", f"f{k + 1}")
    out.append(f"""nt0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h, g AS lang FROM n{depth})""")
    out.append(f"""ft0 AS (SELECT '' AS g, nt0.i, doc_id, leaf, cur, proof, nt0.h AS subroot FROM f{depth} JOIN nt0 ON nt0.lang = f{depth}.g)""")
    for k in range(wide):
        level(f"t{k}", f"t{k + 1}", f"ft{k}", f"ft{k + 1}")
    return "WITH " + ",\n".join(out) + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = h AS verified FROM ft{wide} JOIN nt{wide} USING (g)
"""


OP13_SQL = _merkle_sql()

ORACLES: dict[str, str] = {
    "op1_quality_rules": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op5_chat_formatting": OP5_SQL,
    "op6_ngram_jaccard_join": OP6_SQL, "op8_warc": OP8_SQL, "op9_source_mixing": OP9_SQL,
    "op12_conversation_trie": OP12_SQL, "op13_merkle_manifest": OP13_SQL,
}
