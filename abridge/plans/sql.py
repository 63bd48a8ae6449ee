"""DuckDB oracle SQL fragments shared by several registered queries.

These are the independent re-statements of each operator in plain SQL,
used only for the correctness gate.
"""

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def ws_tok(x: str) -> str:
    return f"regexp_extract_all({x}, '\\S+')"


def rouge_tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def md5_bucket(x: str) -> str:
    return f"('0x' || substr(md5(CAST({x} AS VARCHAR)), 1, 8))::BIGINT"


def final_answer(x: str) -> str:
    t = strip(x)
    return f"(CASE WHEN contains({t}, chr(10)) THEN string_split({t}, chr(10))[-1] ELSE {t} END)"


def first_sentence(x: str) -> str:
    return f"(CASE WHEN contains({x}, '.') THEN split_part({x}, '.', 1) ELSE substring({x}, 1, 50) END)"


def target(n: str, ratio: str, min_one: bool = True) -> str:
    t = f"CAST(floor({n} * CAST({ratio} AS DOUBLE)) AS BIGINT)"
    return f"greatest(1, {t})" if min_one else t


SAMPLES_CTE = f"""
samples AS (
  SELECT 'reconstruction' AS task, doc_id AS sample_id, source AS grp, text AS prompt,
         CAST(NULL AS VARCHAR) AS reference, CAST(NULL AS VARCHAR) AS question,
         CAST(NULL AS VARCHAR) AS answer
  FROM documents
  UNION ALL
  SELECT 'summarization', doc_id, source, text,
         CASE WHEN len(lines) > 0 THEN lines[({md5_bucket('doc_id')} % len(lines)) + 1] END,
         NULL, NULL
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\\S')) AS lines
        FROM documents)
  UNION ALL
  SELECT 'qa', u.conv_id * 1000000 + u.turn, p.role, p.text, NULL, u.text, a.text
  FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  JOIN conversations p ON p.conv_id = u.conv_id AND p.turn = u.turn - 1
  WHERE u.role = 'user'
  UNION ALL
  SELECT 'reasoning', u.conv_id * 1000000 + u.turn, 'user', u.text, NULL,
         {first_sentence('u.text')}, {final_answer('a.text')}
  FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'
)"""


def rouge_hits_cte(pairs: str, key: str, ref: str, cand: str, prefix: str = "") -> str:
    """CTEs ``h1``/``h2`` with clipped unigram/bigram hits for ``pairs`` (key, ref tokens, cand tokens)."""
    p = prefix
    big_r = f"list_transform(range(1, len({ref})), lambda i: {ref}[i] || ' ' || {ref}[i + 1])"
    big_c = f"list_transform(range(1, len({cand})), lambda i: {cand}[i] || ' ' || {cand}[i + 1])"
    return f"""
{p}r1 AS (SELECT {key}, g, count(*) AS n FROM (SELECT {key}, unnest({ref}) AS g FROM {pairs}) GROUP BY {key}, g),
{p}c1 AS (SELECT {key}, g, count(*) AS n FROM (SELECT {key}, unnest({cand}) AS g FROM {pairs}) GROUP BY {key}, g),
{p}h1 AS (SELECT {key}, sum(least(a.n, b.n))::BIGINT AS hit1 FROM {p}r1 a JOIN {p}c1 b USING ({key}, g) GROUP BY {key}),
{p}r2 AS (SELECT {key}, g, count(*) AS n FROM (SELECT {key}, unnest({big_r}) AS g FROM {pairs}) GROUP BY {key}, g),
{p}c2 AS (SELECT {key}, g, count(*) AS n FROM (SELECT {key}, unnest({big_c}) AS g FROM {pairs}) GROUP BY {key}, g),
{p}h2 AS (SELECT {key}, sum(least(a.n, b.n))::BIGINT AS hit2 FROM {p}r2 a JOIN {p}c2 b USING ({key}, g) GROUP BY {key})"""


def inference_sql(task: str, ratios, adapt_size: int, config: str, n_style: int, n_icl: int, more_methods=()) -> str:
    """CTEs ending in ``inf``: infer-role prompts answered in the style of the best demonstration shown."""
    from abridge.functions.text import TMPL_EXAMPLE, TMPL_FEW_SHOT
    from abridge.operators.catalog import STYLE_RULE, TASK_SETTINGS
    from abridge.operators.requests import STANDIN_PREFIX, STANDIN_SUFFIX
    shown = TASK_SETTINGS[task][0]
    ruled = ", ".join(f"'{s}'" for s in STYLE_RULE)
    request = render(TMPL_FEW_SHOT, target="k.target", instruction=instruction(f"'for_{task}'"), examples="e.examples",
                     text="k.prompt")
    return f"""{adaptation_sql(task, ratios, adapt_size, n_style, n_icl, config=config, more_methods=more_methods)},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config, task, ratio, grp ORDER BY ca DESC, iteration) AS rank FROM demos)
         WHERE rank <= {shown}),
ex AS (SELECT b.ratio, b.grp, min_by(b.text_style, b.rank) AS text_style,
              string_agg({render(TMPL_EXAMPLE, original='c.prompt', compressed='c.compressed')}, chr(10) ORDER BY b.rank) AS examples
       FROM best b JOIN sc c ON c.sample_id = b.sample_id AND c.ratio = b.ratio AND c.style = b.text_style GROUP BY b.ratio, b.grp),
keys AS (SELECT k.*, e.text_style, md5({request}) AS request_id
         FROM (SELECT sc.* FROM sc JOIN roles r ON r.sample_id = sc.sample_id WHERE style = 'loc-begin'
               AND (r.pos >= {adapt_size} OR r.group_n < {adapt_size})) k
         LEFT JOIN ex e ON e.ratio = k.ratio AND e.grp = k.grp),
said AS (SELECT k.*, CASE WHEN k.text_style IN ({ruled}) THEN {sq(STANDIN_PREFIX)} || c.compressed || {sq(STANDIN_SUFFIX)} END AS response
         FROM keys k LEFT JOIN sc c ON c.sample_id = k.sample_id AND c.ratio = k.ratio AND c.style = k.text_style),
parsed AS (SELECT *, {parse_compression('response')} AS said_text FROM said),
out AS (SELECT * EXCLUDE (compressed), CASE WHEN response IS NOT NULL THEN 'completion' ELSE 'fallback' END AS source,
               CASE WHEN response IS NOT NULL THEN {truncate('said_text', 'target')} ELSE {truncate('prompt', 'target')} END AS compressed
        FROM parsed),
inf AS (SELECT '{config}' AS config, * EXCLUDE (em, f1), len({ws_tok('compressed')})::BIGINT AS n_out,
               {exact_match('answer', 'compressed')} AS em, {token_f1('answer', 'compressed')} AS f1 FROM out)"""


def lcs(ref: str, cand: str) -> str:
    """LCS length of two token lists.

    Hunt and Szymanski's thresholds: entry k is the least reference position at which a common
    subsequence of length k can end. Each candidate token lowers entries to its next match position;
    the number of entries at the end is the length.
    """
    at = (f"list_transform({cand}, lambda y: list_filter(range(1, len({ref}) + 1), lambda i: {ref}[i] = y))")
    steps = f"list_prepend([]::BIGINT[], list_filter({at}, lambda m: len(m) > 0))"
    step = ("list_filter(list_transform(range(1, len(t) + 2), lambda k: least(t[k], list_min(list_filter(m, "
            "lambda q: q > CASE WHEN k = 1 THEN 0 ELSE t[k - 1] END)))), lambda x: x IS NOT NULL)")
    return f"len(list_reduce({steps}, lambda t, m: {step}))::BIGINT"


LCS_BITS = 120  # a bit vector that fits a HUGEINT


def lcs_cte(pairs: str, key: str, ref: str, cand: str, out: str) -> str:
    """CTEs ending in ``out`` (key, lcs): the LCS of two token lists of each row of ``pairs``.

    Equal pairs are done once, and tokens that only one side has cannot be in it. Of what is left the shorter side becomes
    one bit a token: a token of the other with the bits M turns V into ``(V + (V & M)) | (V - (V & M))``, and the zero
    bits at the end are the length. Where both sides keep more than ``LCS_BITS`` tokens, a side that is a subsequence
    by the greedy match is the LCS, and else the thresholds of :func:`lcs` run.
    """
    ones = "((1::HUGEINT << n::INTEGER) - 1)"
    step = "((v + (v & m)) | (v - (v & m))) & ones"
    kept = lambda xs, ys: f"list_filter({xs}, lambda y: list_contains({ys}, y))"
    greedy = ("list_reduce(list_prepend(0::BIGINT, short), lambda pos, c: CASE WHEN pos < 0 THEN -1 "
              "ELSE coalesce(pos + nullif(list_position(long[pos + 1:], c), 0), -1) END)")
    return f"""
{out}_d AS (SELECT *, row_number() OVER () AS k FROM (SELECT DISTINCT {ref} AS rt, {cand} AS ct FROM {pairs})),
{out}_f AS (SELECT k, CASE WHEN len(a) <= len(b) THEN a ELSE b END AS a, CASE WHEN len(a) <= len(b) THEN b ELSE a END AS b
            FROM (SELECT k, {kept('rt', 'ct')} AS a, {kept('ct', 'rt')} AS b FROM {out}_d)),
{out}_r AS (SELECT k, len(a) AS n, unnest(a) AS g, generate_subscripts(a, 1) - 1 AS bit FROM {out}_f WHERE len(a) <= {LCS_BITS}),
{out}_m AS (SELECT k, g, n, sum(1::HUGEINT << bit::INTEGER)::HUGEINT AS m FROM {out}_r GROUP BY k, g, n),
{out}_c AS (SELECT k, unnest(b) AS g, generate_subscripts(b, 1) AS i FROM {out}_f WHERE len(a) <= {LCS_BITS}),
{out}_s AS (SELECT k, n, {ones} AS ones, list(m ORDER BY i) AS ms FROM {out}_c JOIN {out}_m USING (k, g) GROUP BY k, n),
{out}_x AS (SELECT k, a, b, list_transform(b, lambda t: list_position(b, t)) AS long, list_transform(a, lambda t: list_position(b, t)) AS short
            FROM {out}_f WHERE len(a) > {LCS_BITS}),
{out}_e AS (
  SELECT k, n - bit_count(list_reduce(list_prepend(ones, ms), lambda v, m: {step})) AS lcs FROM {out}_s
  UNION ALL SELECT k, CASE WHEN {greedy} >= 0 THEN len(short) ELSE {lcs('short', 'long')} END FROM {out}_x),
{out} AS (SELECT {', '.join('p.' + c for c in key.split(', '))}, coalesce(e.lcs, 0) AS lcs FROM {pairs} p JOIN {out}_d d ON d.rt = p.{ref} AND d.ct = p.{cand}
          LEFT JOIN {out}_e e ON e.k = d.k)"""


def fmeasure(h: str, nr: str, nc: str) -> str:
    return f"(CASE WHEN {h} > 0 THEN 2.0 * {h} / CAST({nr} + {nc} AS DOUBLE) ELSE 0.0 END)"


def token_f1(g: str, p: str) -> str:
    gs = f"list_distinct(regexp_extract_all(lower({g}), '\\S+'))"
    ps = f"list_distinct(regexp_extract_all(lower({p}), '\\S+'))"
    ng, np_ = f"CAST(len({gs}) AS DOUBLE)", f"CAST(len({ps}) AS DOUBLE)"
    common = f"CAST(len(list_intersect({gs}, {ps})) AS DOUBLE)"
    prec, rec = f"({common} / {np_})", f"({common} / {ng})"
    return (f"(CASE WHEN {ng} = 0 AND {np_} = 0 THEN 1.0 "
            f"WHEN {ng} = 0 OR {np_} = 0 OR {common} = 0 THEN 0.0 "
            f"ELSE 2.0 * {prec} * {rec} / ({prec} + {rec}) END)")


def exact_match(g: str, p: str) -> str:
    return f"CAST(lower({strip(g)}) = lower({strip(p)}) AS DOUBLE)"


STOP_WORDS_SQL = None  # filled lazily from the compressor's fixed list


def _rule_sql(rule: str, seed: int) -> str:
    if rule == "prefix":
        return "array_to_string(tok[1:target], ' ')"
    if rule == "middle":
        return "array_to_string(tok[(n_tok - target) // 2 + 1:(n_tok - target) // 2 + target], ' ')"
    if rule == "suffix":
        return "array_to_string(tok[n_tok - target + 1:n_tok], ' ')"
    if rule == "stride":
        return "array_to_string(list_transform(range(0, target), lambda i: tok[(i * n_tok) // target + 1]), ' ')"
    if rule == "window":
        key = (f"'{seed}|' || task || '|' || CAST(sample_id AS VARCHAR) || '|' || "
               "CAST(CAST(round(ratio * 1000) AS BIGINT) AS VARCHAR)")
        st = f"({md5_bucket_expr(key)} % (n_tok - target + 1))"
        return f"array_to_string(tok[{st} + 1:{st} + target], ' ')"
    if rule == "lines":
        lt = "regexp_extract_all(line, '\\S+')"
        return (f"array_to_string(list_filter(list_transform(string_split(prompt, chr(10)), "
                f"lambda line: array_to_string({lt}[1:(len({lt}) * target) // n_tok], ' ')), "
                f"lambda x: x <> ''), chr(10))")
    if rule == "abbrev":
        from abridge.operators.compress import STOP_WORDS
        stop = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
        return (f"array_to_string(list_transform(list_filter(tok, lambda w: NOT list_contains({stop}, lower(w))), "
                "lambda w: CASE WHEN length(w) > 2 THEN substring(w, 1, 1) || "
                "regexp_replace(substring(w, 2, length(w) - 2), '[aeiouAEIOU]', '', 'g') || "
                "substring(w, length(w), 1) ELSE w END)[1:target], ' ')")
    raise ValueError(rule)


def md5_bucket_expr(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 8))::BIGINT"


def candidates_cte(samples: str, ratios, methods, seed: int = 42, floor0=("selective-context",)) -> str:
    """CTE ``cands``: the rule candidate grid, restated in SQL."""
    from abridge.operators.candidates import rule_of
    ratio_rows = ", ".join(f"(CAST({r} AS DOUBLE))" for r in ratios)
    meth_rows = ", ".join(f"('{m}', '{rule_of(m)}')" for m in methods)
    fl = ", ".join(f"'{m}'" for m in floor0) or "''"
    rules = sorted({rule_of(m) for m in methods})
    case = " ".join(f"WHEN rule = '{r}' THEN {_rule_sql(r, seed)}" for r in rules
                    if r not in ("sentences", "extractive"))
    sent_case = ""
    parts = [f"""
grid AS (
  SELECT s.*, tok, len(tok)::BIGINT AS n_tok, rr.ratio, mm.style, mm.rule,
         CASE WHEN mm.style IN ({fl}) THEN {target('len(tok)', 'rr.ratio', False)}
              ELSE {target('len(tok)', 'rr.ratio')} END AS target
  FROM (SELECT *, {ws_tok('prompt')} AS tok FROM {samples}) s
  CROSS JOIN (VALUES {ratio_rows}) AS rr(ratio)
  CROSS JOIN (VALUES {meth_rows}) AS mm(style, rule)
)"""]
    if "sentences" in rules:
        parts.append("""
sent_x AS (
  SELECT task, sample_id, ratio, style, target, unnest(string_split(prompt, '. ')) AS sent,
         generate_subscripts(string_split(prompt, '. '), 1) AS pos
  FROM grid WHERE rule = 'sentences'
),
sent_c AS (
  SELECT *, sum(len(regexp_extract_all(sent, '\\S+'))) OVER (
      PARTITION BY task, sample_id, ratio, style ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM sent_x
),
sent_r AS (
  SELECT task, sample_id, ratio, style,
         """ + strip("string_agg(sent || '. ', '' ORDER BY pos)") + """ AS sent_text
  FROM sent_c WHERE cum <= target GROUP BY ALL
)""")
        sent_case = "WHEN rule = 'sentences' THEN coalesce(sent_text, '')"
    ext_case = ""
    if "extractive" in rules:
        parts.append(f"""
ext_df AS (
  SELECT g, count(*) AS df FROM (
    SELECT DISTINCT task, sample_id, unnest({rouge_tok('prompt')}) AS g
    FROM (SELECT DISTINCT task, sample_id, prompt FROM grid WHERE rule = 'extractive')) GROUP BY g
),
ext_s AS (
  SELECT DISTINCT task, sample_id, unnest(string_split(prompt, '. ')) AS sent,
         generate_subscripts(string_split(prompt, '. '), 1) AS pos
  FROM (SELECT DISTINCT task, sample_id, prompt FROM grid WHERE rule = 'extractive')
),
ext_sc AS (
  SELECT task, sample_id, pos, avg(ln(df)) AS m FROM (
    SELECT task, sample_id, pos, unnest({rouge_tok('sent')}) AS g FROM ext_s) x
  JOIN ext_df USING (g) GROUP BY ALL
),
ext_rank AS (
  SELECT s.task, s.sample_id, s.pos, s.sent, len({ws_tok('s.sent')}) AS ntok,
         coalesce(round(sc.m, 9), 1e9) AS neg_score
  FROM ext_s s LEFT JOIN ext_sc sc USING (task, sample_id, pos)
),
ext_c AS (
  SELECT g.task, g.sample_id, g.ratio, g.style, g.target, r.pos, r.sent,
         sum(r.ntok) OVER (PARTITION BY g.task, g.sample_id, g.ratio, g.style
                           ORDER BY r.neg_score, r.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM grid g JOIN ext_rank r USING (task, sample_id) WHERE g.rule = 'extractive'
),
ext_r AS (
  SELECT task, sample_id, ratio, style,
         {strip("string_agg(sent, '. ' ORDER BY pos) || '. '")} AS ext_text
  FROM ext_c WHERE cum <= target GROUP BY ALL
)""")
        ext_case = "WHEN rule = 'extractive' THEN coalesce(ext_text, '')"
    joins = ""
    if "sentences" in rules:
        joins += " LEFT JOIN sent_r USING (task, sample_id, ratio, style)"
    if "extractive" in rules:
        joins += " LEFT JOIN ext_r USING (task, sample_id, ratio, style)"
    parts.append(f"""
cands AS (
  SELECT grid.*, CASE
      WHEN n_tok <= target AND rule NOT IN ('sentences', 'extractive') THEN prompt
      {sent_case} {ext_case} {case} END AS compressed
  FROM grid{joins}
)""")
    return ",".join(parts)


METRIC_TASKS = {
    "rouge1": ("reconstruction", "summarization"), "rouge2": ("reconstruction", "summarization"),
    "rougeL": ("reconstruction", "summarization"), "bertscore": ("reconstruction", "summarization"),
    "em": ("qa", "reasoning"), "f1": ("qa",),
}
KEY4 = "task, sample_id, ratio, style"


def scored_cte(tasks, methods, ratios, seed: int = 42) -> str:
    """CTEs ending in ``sc``: every rule candidate with its task metrics and primary score.

    ROUGE-L of a reconstruction candidate that is a subsequence of the prompt by its rule has the closed
    form LCS = candidate length; all others (abbreviations, summaries) run the LCS itself.
    """
    tl = ", ".join(f"'{t}'" for t in tasks)
    r1 = fmeasure("coalesce(hit1, 0)", "len(rt)", "len(ct)")
    r2 = fmeasure("coalesce(hit2, 0)", "greatest(len(rt) - 1, 0)", "greatest(len(ct) - 1, 0)")
    rl = fmeasure("lcs", "len(rt)", "len(ct)")
    rouge = "c.task IN ('reconstruction', 'summarization') AND rt IS NOT NULL"
    return f"""{SAMPLES_CTE},
base AS (SELECT * FROM samples WHERE task IN ({tl})),
{candidates_cte('base', ratios, methods, seed)},
p0 AS (SELECT {KEY4}, {rouge_tok("CASE task WHEN 'reconstruction' THEN prompt ELSE reference END")} AS rt, {rouge_tok('compressed')} AS ct
       FROM cands WHERE task = 'reconstruction' OR task = 'summarization' AND reference IS NOT NULL),
p1 AS (SELECT * FROM p0 WHERE NOT (task = 'reconstruction' AND style <> 'unreadable')),
{lcs_cte('p1', KEY4, 'rt', 'ct', 'pl')},
p AS (SELECT p0.*, CASE WHEN task = 'reconstruction' AND style <> 'unreadable' THEN len(ct) ELSE coalesce(pl.lcs, 0) END AS lcs
      FROM p0 LEFT JOIN pl USING ({KEY4})),
{rouge_hits_cte('p', KEY4, 'rt', 'ct')},
sc0 AS (
  SELECT c.task, c.sample_id, c.grp, c.ratio, c.style, c.prompt, c.reference, c.question, c.answer, c.tok, c.compressed, c.n_tok, c.target,
         len(rt)::BIGINT AS n_ref, len(ct)::BIGINT AS n_cand, lcs::BIGINT AS lcs,
         CASE WHEN {rouge} THEN {r1} END AS rouge1,
         CASE WHEN {rouge} THEN {r2} END AS rouge2,
         CASE WHEN {rouge} THEN {rl} END AS rougeL,
         CASE WHEN {rouge} THEN {rl} END AS bertscore,
         CASE WHEN c.task = 'qa' THEN {exact_match('c.answer', 'c.compressed')}
              WHEN c.task = 'reasoning' THEN {exact_match('c.answer', final_answer('c.compressed'))} END AS em,
         CASE WHEN c.task = 'qa' THEN {token_f1('c.answer', 'c.compressed')} END AS f1
  FROM cands c LEFT JOIN p USING ({KEY4}) LEFT JOIN h1 USING ({KEY4}) LEFT JOIN h2 USING ({KEY4})
),
sc AS (
  SELECT *, CASE task WHEN 'reconstruction' THEN rougeL WHEN 'summarization' THEN (rouge1 + rouge2 + rougeL) / 3.0
                      WHEN 'qa' THEN f1 WHEN 'reasoning' THEN em END AS primary_score
  FROM sc0
)"""


def long_cte(src: str = "sc", keys: str = "ratio, task, style") -> str:
    parts = []
    for m, tasks in METRIC_TASKS.items():
        tl = ", ".join(f"'{t}'" for t in tasks)
        parts.append(f"SELECT {keys}, '{m}' AS metric, {m} AS value FROM {src} WHERE task IN ({tl})")
    return "lg AS (\n  " + "\n  UNION ALL ".join(parts) + "\n),\n" + \
        f"results_long AS (SELECT {keys}, metric, sum(coalesce(value, 0)) / count(*) AS value FROM lg GROUP BY ALL)"


def sq(s: str) -> str:
    """SQL string literal (newlines as chr(10))."""
    parts = s.split("\n")
    lits = ["'" + p.replace("'", "''") + "'" for p in parts]
    return "(" + " || chr(10) || ".join(lits) + ")"


def render(template: str, **cols: str) -> str:
    parts, rest = [], template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if pre:
            parts.append(sq(pre))
        parts.append(f"CAST({cols[name]} AS VARCHAR)")
    if rest:
        parts.append(sq(rest))
    return "(" + " || ".join(parts) + ")"


def instruction(style: str = "style") -> str:
    from abridge.operators.catalog import STYLES
    whens = " ".join(f"WHEN '{s}' THEN {sq(i)}" for s, i in STYLES)
    return f"(CASE {style} {whens} ELSE '' END)"


def _re(p: str) -> str:
    return "'" + p.replace("(?isd)", "(?is)").replace("(?sd)", "(?s)").replace("(?id)", "(?i)") \
        .replace("(?U)", "").replace("'", "''") + "'"


def first_match(x: str, patterns, default: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({x}, {_re(p)}) THEN regexp_extract({x}, {_re(p)}, 1)"
                     for p in patterns)
    return f"(CASE {whens} ELSE {default} END)"


def clean_compression(x: str) -> str:
    from abridge.functions.text import CLEAN_LEAD_IN, CLEAN_NOTES
    c = f"regexp_replace({x}, {_re(CLEAN_LEAD_IN)}, '', 'g')"
    for p in CLEAN_NOTES:
        c = f"regexp_replace({c}, {_re(p)}, '', 'g')"
    return strip(f"regexp_replace({c}, '\\s+', ' ', 'g')")


def parse_compression(r: str) -> str:
    from abridge.functions.text import COMPRESSION_PATTERNS
    return clean_compression(strip(first_match(r, COMPRESSION_PATTERNS, strip(r))))


def parse_vanilla(r: str) -> str:
    from abridge.functions.text import VANILLA_LEAD_IN, VANILLA_PATTERNS
    body = strip(first_match(strip(r), VANILLA_PATTERNS, strip(r)))
    return strip(f"regexp_replace({body}, {_re(VANILLA_LEAD_IN)}, '')")


def parse_lingua(r: str) -> str:
    from abridge.functions.text import LINGUA_PATTERNS
    return strip(first_match(strip(r), LINGUA_PATTERNS, strip(r)))


def parse_reconstruction(r: str) -> str:
    from abridge.functions.text import RECONSTRUCTION_PATTERNS
    return strip(first_match(r, RECONSTRUCTION_PATTERNS, r))


def truncate(text: str, target_: str) -> str:
    tok = ws_tok(text)
    return f"(CASE WHEN len({tok}) <= {target_} THEN {text} ELSE array_to_string({tok}[1:{target_}], ' ') END)"


def adaptation_sql(task: str, ratios, adapt_size: int = 10, n_style: int = 2, n_icl: int = 3,
                   warmup: float = 0.5, seed: int = 42, config: str = "full", icl_demos: int = 3,
                   more_methods=()) -> str:
    """Unrolled SQL restatement of the adaptation rounds (CTE ``demos`` and final ``stats``)."""
    from abridge.operators.catalog import STYLE_NAMES, TASK_SETTINGS
    g = "config, task, ratio, grp"
    kind = TASK_SETTINGS[task][1]
    styles = ", ".join(f"({i}, '{s}')" for i, s in enumerate(STYLE_NAMES))
    ratio_rows = ", ".join(f"(CAST({r} AS DOUBLE))" for r in ratios)
    parts = [scored_cte((task,), STYLE_NAMES + list(more_methods), ratios, seed), f""",
sc2 AS (SELECT task, sample_id, ratio, style, round(primary_score, 12) AS score FROM sc),
roles AS (SELECT task, grp, sample_id, row_number() OVER (PARTITION BY task, grp ORDER BY sample_id) - 1 AS pos,
                 count(*) OVER (PARTITION BY task, grp) AS group_n
          FROM samples WHERE task = '{task}' AND coalesce(reference, answer, CASE task WHEN 'reconstruction' THEN prompt END) IS NOT NULL),
adapt AS (SELECT '{config}' AS config, r.task, rr.ratio, r.grp, r.sample_id, r.pos
          FROM roles r CROSS JOIN (VALUES {ratio_rows}) AS rr(ratio) WHERE r.pos < {adapt_size}),
sty AS (SELECT * FROM (VALUES {styles}) AS t(style_idx, style)),
st0 AS (SELECT DISTINCT {g}, style_idx, style, 0.0::DOUBLE AS perf_sum, 0::BIGINT AS n
        FROM adapt CROSS JOIN sty),"""]
    demos = []
    for i in range(adapt_size):
        uniform = i < warmup * adapt_size
        u = (f"(('0x' || substr(md5('{seed}|' || c.task || '|' || CAST(CAST(round(c.ratio * 1000) AS BIGINT) AS VARCHAR)"
             f" || '|' || c.grp || '|{i}|' || CAST(s.slot AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0)")
        uni = f"least(CAST(floor(u * {len(STYLE_NAMES)}) AS BIGINT), {len(STYLE_NAMES) - 1})"
        parts.append(f"""
cur{i} AS (SELECT {g}, sample_id FROM adapt WHERE pos = {i}),
dr{i} AS (SELECT c.*, s.slot, {u} AS u FROM cur{i} c CROSS JOIN (SELECT unnest(range(0, {n_style})) AS slot) s),
w{i} AS (SELECT *, CASE WHEN n > 0 THEN greatest(perf_sum / n, 0.1) ELSE 0.1 END AS w FROM st{i}),
cw{i} AS (SELECT {g}, style_idx,
            round(sum(w) OVER (PARTITION BY {g} ORDER BY style_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                  / sum(w) OVER (PARTITION BY {g}), 12) AS cum,
            sum(n) OVER (PARTITION BY {g}) AS total_n FROM w{i}),""")
        if uniform:
            parts.append(f"""
pk{i} AS (SELECT {g}, sample_id, slot, {uni} AS style_idx FROM dr{i}),""")
        else:
            parts.append(f"""
pk{i} AS (SELECT d.config, d.task, d.ratio, d.grp, d.sample_id, d.slot,
            CASE WHEN max(cw.total_n) = 0 THEN {uni.replace('u *', 'd.u *')}
                 ELSE least(sum(CASE WHEN cw.cum <= d.u THEN 1 ELSE 0 END), {len(STYLE_NAMES) - 1}) END AS style_idx
          FROM dr{i} d JOIN cw{i} cw USING ({g}) GROUP BY d.config, d.task, d.ratio, d.grp, d.sample_id, d.slot, d.u),""")
        icl = ""
        if i > 0 and n_icl > 0:
            pool = " UNION ALL ".join(f"SELECT * FROM d{j}" for j in range(i))
            parts.append(f"""
pool{i} AS (SELECT {g}, text_style, least(count(*) OVER (PARTITION BY {g}), {icl_demos}) AS n_pool,
              row_number() OVER (PARTITION BY {g} ORDER BY ca DESC, iteration) AS rank FROM ({pool})),""")
            icl = (f" UNION ALL SELECT {g}, sample_id, slot, 'icl' AS style, text_style FROM cur{i} "
                   f"CROSS JOIN (SELECT unnest(range({n_style}, {n_style + n_icl})) AS slot) "
                   f"JOIN pool{i} USING ({g}) WHERE rank = least(slot - {n_style} + 1, n_pool)")
        ca = ("CASE WHEN count(*) <= 1 THEN 0.0 ELSE max(score) - " +
              ("median(score)" if kind == "mid" else "min(score)") + " END")
        parts.append(f"""
tr{i} AS (SELECT t.*, sc2.score FROM (
            SELECT {g}, sample_id, slot, sty.style, sty.style AS text_style FROM pk{i} JOIN sty USING (style_idx){icl}) t
          JOIN sc2 ON sc2.task = t.task AND sc2.sample_id = t.sample_id AND sc2.ratio = t.ratio AND sc2.style = t.text_style),
ca{i} AS (SELECT {g}, {ca} AS ca FROM tr{i} GROUP BY {g}),
d{i} AS (SELECT b.config, b.task, b.ratio, b.grp, {i} AS iteration, b.sample_id, b.style AS style_used, b.text_style, b.score, ca{i}.ca
         FROM (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY score DESC, slot) AS rn FROM tr{i}) b
         JOIN ca{i} USING ({g}) WHERE b.rn = 1),
st{i + 1} AS (SELECT s.config, s.task, s.ratio, s.grp, s.style_idx, s.style,
               s.perf_sum + coalesce(d.score, 0.0) AS perf_sum,
               s.n + CASE WHEN d.score IS NOT NULL THEN 1 ELSE 0 END AS n
             FROM st{i} s LEFT JOIN (SELECT * FROM d{i} WHERE style_used <> 'icl') d
             ON d.config = s.config AND d.task = s.task AND d.ratio = s.ratio AND d.grp = s.grp
                AND d.style_used = s.style),""")
        demos.append(f"SELECT * FROM d{i}")
    parts.append("\ndemos AS (" + " UNION ALL ".join(demos) + f"),\nstats AS (SELECT * FROM st{adapt_size})")
    return "".join(parts)


def stem_cte(tokens: str, out: str) -> str:
    """CTEs ending in ``out`` (g, stem): Porter's steps over the distinct tokens ``g`` of ``tokens``, one projection each.

    ``f`` is the word's shape, a c or v for each character, of which each step's conditions are prefixes.
    """
    from abridge.functions import stem as P
    shape = ("list_reduce(list_prepend('', string_split(w, '')), lambda f, ch: f || CASE WHEN contains('aeiou', ch) THEN 'v' "
             "WHEN ch = 'y' AND right(f, 1) = 'c' THEN 'v' ELSE 'c' END)")
    head = lambda n: f"left(f, length(w) - {n})"
    m = lambda x: f"((length({x}) - length(replace({x}, 'vc', ''))) // 2)"
    short = lambda w, f: f"(({f} LIKE '%cvc' AND right({w}, 1) NOT IN ('w', 'x', 'y')) OR {f} = 'vc')"

    def swap(rules, least, extra=None):
        whens = []
        for old, new in sorted(rules, key=lambda r: -len(r[0])):
            n = len(old)
            cond = f"{m(head(n - 1 if old == 'logi' else n))} >= {least}"
            cond += (extra or {}).get(old, "")
            whens.append(f"WHEN ends_with(w, '{old}') THEN CASE WHEN {cond} THEN left(w, length(w) - {n}) || '{new}' ELSE w END")
        return "CASE " + " ".join(whens) + " ELSE w END"

    steps = [
        "CASE WHEN ends_with(w, 'ies') AND length(w) = 4 THEN left(w, 3) ELSE " + swap(P.STEP_1A, 0) + " END",
        f"""CASE WHEN ends_with(w, 'ied') THEN left(w, CASE WHEN length(w) = 4 THEN 3 ELSE length(w) - 2 END)
            WHEN ends_with(w, 'eed') THEN CASE WHEN {m(head(3))} > 0 THEN left(w, length(w) - 1) ELSE w END
            WHEN ends_with(w, 'ed') AND contains({head(2)}, 'v') THEN left(w, length(w) - 2) || '+'
            WHEN ends_with(w, 'ing') AND contains({head(3)}, 'v') THEN left(w, length(w) - 3) || '+' ELSE w END""",
        # what lost an ending is marked by a plus sign
        f"""CASE WHEN NOT ends_with(w, '+') THEN w WHEN regexp_matches(w, '(at|bl|iz)[+]$') THEN replace(w, '+', 'e')
            WHEN w[-2] = w[-3] AND {head(1)} LIKE '%c' THEN CASE WHEN w[-2] IN ('l', 's', 'z') THEN replace(w, '+', '') ELSE left(w, length(w) - 2) END
            WHEN {m(head(1))} = 1 AND {short("replace(w, '+', '')", head(1))} THEN replace(w, '+', 'e') ELSE replace(w, '+', '') END""",
        f"CASE WHEN ends_with(w, 'y') AND length(w) > 2 AND {head(1)} LIKE '%c' THEN left(w, length(w) - 1) || 'i' ELSE w END",
        f"CASE WHEN ends_with(w, 'alli') AND {m(head(4))} > 0 THEN left(w, length(w) - 2) ELSE w END",
        swap(P.STEP_2, 1), swap(P.STEP_3, 1),
        swap(P.STEP_4, 2, {"ion": " AND w[-4] IN ('s', 't')"}),
        f"CASE WHEN ends_with(w, 'e') AND ({m(head(1))} > 1 OR ({m(head(1))} = 1 AND NOT {short('left(w, length(w) - 1)', head(1))})) THEN left(w, length(w) - 1) ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {m(head(1))} > 1 THEN left(w, length(w) - 1) ELSE w END"]
    parts = [f"{out}_0 AS (SELECT DISTINCT g, g AS w FROM {tokens} WHERE length(g) >= {P.LEAST_CHARS})"]
    for i, x in enumerate(steps):
        parts.append(f"{out}_{i + 1} AS (SELECT g, {x} AS w FROM (SELECT *, {shape} AS f FROM {out}_{i}))")
    odd = ", ".join(f"('{a}', '{b}')" for a, b in P.IRREGULAR.items())
    parts.append(f"{out} AS (SELECT g, coalesce(o.s, w) AS stem FROM {out}_{len(steps)} LEFT JOIN (VALUES {odd}) AS o(a, s) ON o.a = g)")
    return ",\n".join(parts)
