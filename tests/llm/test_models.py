"""Packing, language model, classifier and WARC."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="session")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_packing(docs, rows, clashing, no_docs, tokenizer):
    from tokenizers import Tokenizer

    from abridge.llm.packing import pack_documents, sequences
    t = Tokenizer.from_file(tokenizer)
    ids = {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows}
    for d in (docs, clashing):
        placed = pack_documents(d, tokenizer, with_ids=True)
        got = defaultdict(list)
        seq = defaultdict(list)
        for r in placed.collect():
            got[r["doc_id"]].append(r)
            seq[r["sequence_id"]].append((r["offset"], r["length"]))
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        for i, want in ids.items():
            p = sorted(got[i], key=lambda r: r["piece"])
            assert [x for r in p for x in r["ids"]] == want and [r["piece"] for r in p] == list(range(len(p)))
            assert [r["start"] for r in p] == [sum(x["length"] for x in p[:k]) for k in range(len(p))]
            assert all(r["length"] == 1024 for r in p[1:]) and len(p) == -(-len(want) // 1024)
        for s in seq.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= 1024
        assert len(seq) <= math.ceil(sum(map(len, ids.values())) / 1024) + 1
    whole = sequences(placed)
    assert whole.agg(F.sum("length")).first()[0] == sum(map(len, ids.values()))
    assert pack_documents(no_docs, tokenizer).count() == 0


def test_encoder_equals_the_tokenizer(tokenizer):
    from tokenizers import Tokenizer

    from abridge.llm.packing import Encoder
    t = Tokenizer.from_file(tokenizer)
    t.encode_special_tokens = True
    texts = ["a b", "a  b", " a", "a ", "a\nb", "a \n b", "a\n\nb", "a\tb c", "it's we'll 12 3,4", "x y z", "é ü\x1c a",
             "\0 a\0b", "\n", " ", "a  b　c d", "<|endoftext|> a", "", "A!! B|C\nD e's", "a\r\nb \r c"]
    texts += ["a\x85b", "\x1cx\x1d y", "\u3000 a\u2028b", "\u00a0\u00a0x", "z" * 3000, "\ud7ff\U0001f600 é\u0301", "½ ² 三 ৩"]
    enc = Encoder(tokenizer)
    assert [np.frombuffer(enc.encode(x), "<u4").tolist() for x in texts] == [e.ids for e in t.encode_batch(texts)]


def test_encoder_takes_white_space_of_any_length(tokenizer):
    from tokenizers import Tokenizer

    from abridge.llm.packing import LONG_RUN, Encoder
    t, enc = Tokenizer.from_file(tokenizer), Encoder(tokenizer)
    texts = ["a" + " " * 3_000_000 + "b", "a" + "\n" * 3_000_000, "\n" * 1_500_000 + "x"]
    for n in (LONG_RUN - 1, LONG_RUN, LONG_RUN + 1):
        for run in (" " * n, "\n" * n, " \n\t\u3000" * (n // 4 + 1), "\x1c" * n, "\x85\u2028\xa0" * n):
            texts += [run, "a" + run + "b", run + "'s", "a." + run + "\x1c" + run + "1 " + run]
    for x in texts:
        assert np.frombuffer(enc.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_added_tokens_have_their_ids(spark, tokenizer):
    from tokenizers import Tokenizer

    from abridge.llm.packing import encoder, pack_documents
    t, end = Tokenizer.from_file(tokenizer), "<|endoftext|>"
    texts = [f"a {end} b", end, end * 3, f"{end}\n {end}  x", f"x  {end}'s", "<|endoftext|", f"<|<|endoftext|>|>{end}",
             "plain  text\n", "", f"a{' ' * 70_000}{end}{' ' * 70_000}b", "<|ENDOFTEXT|>"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert want[0] == [64, 220, 50256, 275]
    assert [np.frombuffer(encoder(tokenizer).encode(x), "<u4").tolist() for x in texts] == want
    d = spark.createDataFrame(list(enumerate(texts[:9])), "doc_id long, text string")
    assert {r["doc_id"]: r["ids"] for r in pack_documents(d, tokenizer, with_ids=True).collect()} == {
        i: x + [2] for i, x in enumerate(want[:9])}


def test_best_fit_plan():
    from abridge.llm.packing import best_fit_plan
    rng = np.random.default_rng(3)
    for hist in ({}, {1: 5000}, {10: 7}, {6: 3, 5: 1, 4: 4}, {int(k): int(rng.integers(1, 50)) for k in rng.integers(1, 11, 9)}):
        room, seen = Counter(), Counter()
        for length, a, b, first, per, at in best_fit_plan(hist, 10):
            for r in range(b - a):
                s, o = first + r // per, at + (r % per) * length
                assert room[s] == o
                room[s] += length
            seen[length] += b - a
        assert seen == Counter(hist) and all(x <= 10 for x in room.values())
        if hist:
            assert len(room) <= -(-sum(k * v for k, v in hist.items()) // 10) * 11 / 9 + 1


def brute_model(rows, held, order=3, mu=None):
    from abridge.llm import ngram_lm as M
    docs = {i: WORD.findall(lower(t)) + [None] for i, t in rows}
    counts, totals = Counter(), Counter()
    for i, w in docs.items():
        if not held(i):
            for j in range(len(w)):
                for k in range(1, order + 1):
                    c = tuple(w[j - x] if j >= x else 0 for x in range(1, k))
                    counts[c, w[j]] += 1
                    totals[c] += 1
    n, v = totals[()], sum(1 for c, _ in counts if c == ())
    out = {}
    for i, w in docs.items():
        score = base = 0.0
        for j in range(len(w)):
            u = math.log10((counts[(), w[j]] + 0.1) / (n + 0.1 * (v + 1)))
            base += u
            for k in range(order, 0, -1):
                c = tuple(w[j - x] if j >= x else 0 for x in range(1, k))
                if k == 1:
                    score += u
                elif counts[c, w[j]]:
                    score += math.log10(counts[c, w[j]] / (totals[c] + M.MU[k]))
                    break
                elif totals[c]:
                    score += math.log10(M.MU[k] / (totals[c] + M.MU[k]))
        out[i] = (held(i), len(w), sum(counts[(), x] > 0 for x in w), n, base, score)
    return out


@pytest.mark.parametrize("hot_share", [4, 1000])
def test_language_model(docs, rows, clashing, no_docs, monkeypatch, hot_share):
    order = 3 if hot_share == 4 else 2
    from abridge.llm import ngram_lm as M
    monkeypatch.setattr(M, "HOT_SHARE", hot_share)
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    want = brute_model([(r[0], r[1]) for r in rows], held, order)
    expr = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    got = M.score_documents(docs if hot_share == 4 else clashing, expr, order=order)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    n = 0
    for r in got.collect():
        w = want[r["doc_id"]]
        assert tuple(r)[1:5] == w[:4]
        assert r["base_score"] == pytest.approx(w[4], abs=1e-6)
        assert r["score"] == pytest.approx(w[5], abs=3 * r["n_tokens"] / M.STEP)
        n += 1
    assert n == len(rows)
    assert M.score_documents(no_docs, expr).count() == 0


@pytest.mark.parametrize("dictionary", [None, 8])
def test_production_model_counts_trigrams(docs, rows, monkeypatch, dictionary):
    """The registered order, with all frequent words in the dictionary and with nearly none."""
    from abridge.llm import ngram_lm as M
    if dictionary:
        monkeypatch.setattr(M, "DICTIONARY", dictionary)
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    want = brute_model([(r[0], r[1]) for r in rows], held, 3)
    expr = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    for r in M.score_documents(docs, expr).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]][5], abs=3 * r["n_tokens"] / M.STEP)


def test_columns_round_trip():
    from abridge.llm.ngram_lm import expand_columns, squeeze_columns
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1 << 32), (1000, 5), (1000, 1 << 20), (1000, 1 << 32)):
        rows = sorted(map(tuple, rng.integers(0, top, (n, 3)).tolist()))
        cols = [np.array([r[i] for r in rows], np.int64) for i in range(3)]
        assert all((a == b).all() for a, b in zip(expand_columns(squeeze_columns(cols), 3), cols, strict=True))


def test_split_contexts_are_found(docs, monkeypatch):
    """Every context counts as hot: the scores above hold with all of them split."""
    from abridge.llm import ngram_lm as M
    seen = {}
    real = M._split_contexts
    monkeypatch.setattr(M, "HOT_SHARE", 1000)
    monkeypatch.setattr(M, "_split_contexts", lambda *a: seen.setdefault("x", real(*a)))
    M.score_documents(docs, F.lit(False)).count()
    assert len(seen["x"][2]) > 10 and all(v > 0 for v in seen["x"][2].values())


def test_elias_fano():
    from abridge.llm.ngram_lm import EliasFano
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (1, 1 << 62), (1000, 10), (1000, 1 << 40), (257, (1 << 63) - 1)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        data = EliasFano.encode(v)
        back = EliasFano(memoryview(data + b"rest"))
        assert (back.values() == v).all() and back.bytes == len(data)


def test_classifier_learns_and_handles_odd_texts(spark, docs, no_docs):
    from abridge.llm.nb_svm import fit, score, training_rows
    good = ["the cat sat on the mat and looked at the %s" % x for x in "abcdefghijklmnopqrst"]
    bad = ["BUY!! NOW!! $$$ %s %% ** click || here" % x for x in "abcdefghijklmnopqrst"]
    d = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i < 20), 0) for i in range(40)] + [(3, None, 0), (None, 1, 0), (5, 1, 1)],
                                "doc_id long, quality int, toxic int")
    rows, y = training_rows(d, lab, F.col("_id") % 4 != 1)
    assert len(rows) == 30 and y.sum() == 15
    model = fit(rows, y)
    got = {r[0]: r[1] for r in score(d, model).collect()}
    assert all((got[i] >= 0.5) == (i < 20) for i in got)
    odd = score(docs, model, carry=True)
    assert odd.columns == [*docs.columns, "score"] and odd.where("score >= 0 and score <= 1").count() == docs.count()
    assert score(no_docs, model).count() == 0
    empty = training_rows(no_docs, lab.limit(0), F.lit(True))
    assert score(docs, fit(*empty)).select("score").distinct().count() == 1


def test_classifier_held_out_accuracy(spark):
    from abridge.llm.queries import op7
    from tests.conftest import SF01
    got = op7(spark, SF01).where("held_out").join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id")
    right = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.97


PAGES = [(1, "u1", "x" * 1500), (2, "u\r\n2", "x" * 1500), (3, None, "é" * 600), (4, "u4", "é" * 600), (5, "u5", "é" * 600),
         (6, "u6", None), (7, "u7", ""), (8, "u8", "short"), (9, "u9", "short"), (10, "u10", "\r\n\r\n" + "y" * 999_999),
         (11, "u11", "x" * 999), (12, "u12", "x" * 999), (None, "u", "z")]


def test_warc_round_trip(spark):
    from abridge.llm.common import Scratch
    from abridge.llm.warc import page_id, read_warc, warc_records, write_warc
    pages = spark.createDataFrame([(*r, "x") for r in PAGES], "page_id long, url string, html string, payload string").repartition(3)
    folder = Scratch(spark, "warc-test").folder
    write_warc(warc_records(pages), folder)
    got = read_warc(spark, folder).withColumn("id", page_id(F.col("record_id"))).withColumn(
        "to", page_id(F.col("refers_to"))).collect()
    assert len(got) == len(PAGES)
    keep = {1: 2, 3: 5, 4: 5}
    for r in got:
        data = next(x[2] or "" for x in PAGES if x[0] == r["id"]).encode()
        assert r["payload_length"] == len(data) and r["payload_digest"] == "sha1:" + hashlib.sha1(data).hexdigest()
        assert r["to"] == keep.get(r["id"]) and r["record_type"] == ("revisit" if r["id"] in keep else "response")
        assert r["payload"] == (None if r["id"] in keep else data)
    part = read_warc(spark, folder, "record_type string, record_id string").where(F.col("record_type").isin("revisit", "none"))
    assert {r[1] for r in part.collect()} == {f"<urn:page:{i}>" for i in keep}
    assert "record_type" not in part._jdf.queryExecution().executedPlan().toString().split("Filter")[-1].split("\n")[0] \
        or part.count() == 3
    one = read_warc(spark, folder, "record_id string, payload binary").where(F.col("record_id") == "<urn:page:8>")
    assert [bytes(r["payload"]) for r in one.collect()] == [b"short"]
    empty = Scratch(spark, "warc-test").folder
    write_warc(warc_records(pages.limit(0)), empty)
    assert read_warc(spark, empty).count() == 0
