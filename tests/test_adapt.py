"""Adaptation against a plain model: ties, missing scores, prompts and groups without any score, few-shot only."""

import hashlib
import statistics

from abridge.operators.adapt import adaptation
from abridge.operators.catalog import STYLE_NAMES, TASK_SETTINGS

N = len(STYLE_NAMES)
CONFIGS = [("full", 2, 3), ("style_only", 2, 0), ("icl_only", 0, 2)]


def _plain(prompts, scores, task, ratio, grp, n_style, n_icl, size, seed=42):
    sums, counts, demos = [0.0] * N, [0] * N, []
    for i, sample in prompts:
        w = [max(s / n, 0.1) if n else 0.1 for s, n in zip(sums, counts)]
        share = [round(sum(w[:k + 1]) / sum(w), 12) for k in range(N)]
        tries = []
        for slot in range(n_style):
            key = "|".join(map(str, (seed, task, round(ratio * 1000), grp, i, slot)))
            u = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) / 2 ** 32
            k = int(u * N) if i < 0.5 * size or not sum(counts) else sum(c <= u for c in share)
            tries.append((slot, False, min(k, N - 1)))
        pool = [d[5] for d in sorted(demos, key=lambda d: (-d[4], d[0]))][:3]
        tries += [(n_style + j, True, pool[min(j, len(pool) - 1)]) for j in range(n_icl if pool else 0)]
        tries = [(slot, icl, k, scores[sample, k]) for slot, icl, k in tries if scores.get((sample, k)) is not None]
        if tries:
            got = [t[3] for t in tries]
            low = statistics.median(got) if TASK_SETTINGS[task][1] == "mid" else min(got)
            _, icl, k, best = min(tries, key=lambda t: (-t[3], t[0]))
            demos.append((i, sample, "icl" if icl else STYLE_NAMES[k], best, max(got) - low if len(got) > 1 else 0.0, k))
            if not icl:
                sums[k] += best
                counts[k] += 1
    return demos, sums, counts


def test_rounds_equal_a_plain_model(spark):
    size, ratio = 8, 0.25
    groups = {("qa", "g"): range(8), ("reasoning", "g"): range(5), ("qa", "no scores"): range(50, 52)}
    roles = [(t, g, f"s{i}", pos, True) for (t, g), ids in groups.items() for pos, i in enumerate(ids)]
    scores, rows = {}, []
    for t in ("qa", "reasoning"):
        for i in range(8):
            for k, style in enumerate(STYLE_NAMES):
                # few values, so ties abound; a prompt without rows, styles without rows, and null scores
                x = (i * 7 + k * 5 + len(t)) % 4 / 4
                if i == 3 or (i + k) % 9 == 0:
                    continue
                value = None if (i + k) % 11 == 0 else x
                scores[t, f"s{i}", k] = value
                rows.append((t, f"s{i}", ratio, style, value))
    sc = spark.createDataFrame(rows, "task string, sample_id string, ratio double, style string, score double")
    ro = spark.createDataFrame(roles, "task string, grp string, sample_id string, pos int, is_adapt boolean")
    demos, stats = adaptation(sc, ro, [ratio], adapt_size=size, configs=CONFIGS)
    got, sums = {}, {}
    for d in demos.orderBy("iteration").collect():
        got.setdefault((d.config, d.task, d.grp), []).append((d.iteration, d.sample_id, d.style_used, d.score, round(d.ca, 9), STYLE_NAMES.index(d.text_style)))
    for x in stats.collect():
        sums[x.config, x.task, x.grp, x.style_idx] = (round(x.perf_sum, 9), x.n)
    assert len(sums) == len(CONFIGS) * len(groups) * N
    for config, n_style, n_icl in CONFIGS:
        for (t, g), ids in groups.items():
            own = {(s, k): v for (u, s, k), v in scores.items() if u == t}
            want, total, n = _plain([(p, f"s{i}") for p, i in enumerate(ids)], own, t, ratio, g, n_style, n_icl, size)
            assert got.get((config, t, g), []) == [(*d[:4], round(d[4], 9), d[5]) for d in want]
            assert [sums[config, t, g, k] for k in range(N)] == [(round(a, 9), b) for a, b in zip(total, n)]
    assert ("icl_only", "qa", "g") not in got and len(got["full", "qa", "g"]) > 4


def test_no_groups_give_empty_tables(spark):
    sc = spark.createDataFrame([], "task string, sample_id long, ratio double, style string, score double")
    ro = spark.createDataFrame([], "task string, grp string, sample_id long, pos int, is_adapt boolean")
    demos, stats = adaptation(sc, ro, [0.5])
    assert demos.count() == 0 and stats.count() == 0 and dict(demos.dtypes)["sample_id"] == "bigint"
