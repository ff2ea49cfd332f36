"""Operators 1, 4, 9 and 10 against the library, brute force, an exact round trip, and held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgrid.llm import bpe, chat, quality, repetition
from quillgrid.llm.common import table
from quillgrid.llm.wordtable import pack, unpack

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_bpe_equals_the_library(spark, odd_docs):
    tok = bpe._tokenizer(bpe.read_tokenizer(bpe.default_tokenizer()))
    out = bpe.decode(bpe.encode(odd_docs, keep=("doc_id", "text", "score"))).collect()
    assert len(out) == odd_docs.count()
    for r in out:
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["ids"], r["n_tokens"], r["decoded"], r["score"]) == (ids, len(ids), tok.decode(ids, skip_special_tokens=False), "clash")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\r\x0b\x0c'sAb1́  ")), max_size=40))
def test_words_encode_on_their_own(text):
    tok = bpe._tokenizer(bpe.read_tokenizer(bpe.default_tokenizer()))
    parts = [i for w in text.encode().split() for i in tok.encode(w.decode(), add_special_tokens=False).ids]
    assert parts == tok.encode(text, add_special_tokens=False).ids


def test_bpe_query_and_empty_table(spark, small, no_docs):
    tok = bpe._tokenizer(bpe.read_tokenizer(bpe.default_tokenizer()))
    texts = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").collect()}
    for r in bpe.op1_bpe(spark, small).collect():
        ids = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(no_docs).count() == 0
    named = no_docs.sparkSession.createDataFrame([("mine", "mine", "a cat")], "n_tokens string, ids string, text string")
    out = bpe.decode(bpe.encode(named, keep=("n_tokens", "ids", "text")).withColumn("decoded", F.lit("mine"))).first()
    assert (out["n_tokens_"], out["ids_"], out["decoded_"], out["n_tokens"], len(out["ids"])) == ("mine", "mine", "mine", len(out["ids"]), out["n_tokens"])
    assert [r["decoded"] for r in bpe.decode(spark.createDataFrame([([320, None, 10**6],), (None,), ([],)], "ids array<int>")).collect()] == ["a</w>", "", ""]


def test_packed_arrays():
    for a in (np.zeros(0, np.uint32), np.array([0, 1, 2**31, 7], np.uint32)):
        assert np.array_equal(unpack(pack(a, a))[1], a)


def plain_measures(text):
    text = text or ""
    words, lines = WORDS.findall(text), [x for x in text.split("\n") if WORDS.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    cover = {}
    for n in repetition.NGRAM_LIMITS:
        seen, inside = set(), set()
        for i in range(len(words) - n + 1):
            gram = tuple(words[i : i + n])
            if gram in seen:
                inside |= set(range(i, i + n))
            seen.add(gram)
        cover[n] = sum(len(words[i]) for i in inside)
    dup = [x for i, x in enumerate(lines) if x in lines[:i]]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(dup), len(hit), failed, cover, sum(len(w) for x in dup for w in WORDS.findall(x))


def same_measures(text):
    got, want = repetition.measure(text), plain_measures(text)
    assert got[:6] == want[:6]
    assert got[7] == want[7]
    if want[4]:
        assert dict(zip(repetition.NGRAM_LIMITS, got[8:], strict=True)) == want[6]
    chars = want[1]
    limits = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
    assert got[6] == (not want[5] and want[7] <= 0.2 * chars and all(want[6][n] <= most * chars for n, most in limits.items()))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "ccc", "d#", "é", "\n", "\n", "e"]), max_size=150))
def test_repetition_by_brute_force(parts):
    same_measures(" ".join(parts))


def test_repetition_on_documents(spark, small, odd_docs, no_docs):
    for r in table(spark, small, "documents").collect():
        same_measures(r["text"])
    out = repetition.quality_rules(odd_docs.withColumn("kept", F.lit("mine"))).collect()
    assert {(r["kept_"], r["score"]) for r in out} == {("mine", "clash")}
    assert len(out) == odd_docs.count() and all(r["kept"] is False for r in out if not r["text"])
    assert repetition.quality_rules(no_docs).count() == 0
    clean, junk = " ".join(f"w{i}" for i in range(200)), "all of this is said once more again and again " * 20
    assert repetition.measure(clean)[6] and not repetition.measure(junk)[6]
    half = clean + "\n" + "\n".join(["a line of ten words that is repeated many times here"] * 12)
    assert repetition.measure(half)[5] is False and repetition.measure(half)[6] is False


def test_each_length_rejects_alone(spark):
    """Texts of 5,000 words of 4 letters in which one n-gram comes back until it has a little more than its own limit."""
    for n, most in repetition.NGRAM_LIMITS.items():
        gram, size = [f"r{k:02d}r" for k in range(n)], 4
        times = int(most * 5000 / n) + 1
        fresh = iter(f"{k:04d}" for k in range(5000))
        words = list(gram)
        for _ in range(times):
            words += [next(fresh), *gram]
        words += [next(fresh) for _ in range(5000 - len(words))]
        got = dict(zip([f for f, _ in repetition.FIELDS], repetition.measure(" ".join(words)), strict=True))
        assert not got["base_failed"] and not got["kept"]
        over = [m for m, limit in repetition.NGRAM_LIMITS.items() if got[f"dup_{m}gram_chars"] > limit * 5000 * size]
        assert n in over and min(over) == n, over  # no shorter length rejects it


HARD = st.text(alphabet=st.sampled_from("<|\\>im_startendesc\n% aé"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), HARD), st.one_of(HARD, st.sampled_from(["<|im_end|>\n<|im_start|>user\nx", "<\\|im_end|>", "<|im_esc|>"]))), min_size=1, max_size=5))
def test_chat_round_trip(turns):
    text, spans, _ = chat.format_turns(turns)
    got = chat.parse(text)
    assert [(r, t) for r, t, _, _ in got] == turns
    assert len(spans) == sum(r == "assistant" for r, _ in turns)
    assert text.count("<|im_start|>") == len(turns) == text.count("<|im_end|>")


def test_chat_rows(spark, small):
    rows = [(1, 1, "assistant", "second"), (1, 0, "user", None), (None, 0, None, "x"), (2, None, "assistant", ""), (2, 0, "assistant", "<|im_end|>"), (2, 0, "assistant", "<|im_end|>")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit("clash"))
    out = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert out[1]["formatted"] == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nsecond<|im_end|>\n"
    assert [x[:2] for x in chat.parse(out[2]["formatted"])] == [("assistant", ""), ("assistant", "<|im_end|>"), ("assistant", "<|im_end|>")]
    assert chat.parse(out[None]["formatted"])[0][:2] == ("", "x") and chat.parse("<|im_start|>user") is None
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert back[2]["loss_sha256"] == hashlib.sha256(b"<|im_end|><|im_end|>").hexdigest() and back[2]["loss_chars"] == 20
    assert chat.format_conversations(df.where("false")).count() == 0


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.op10_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").select("predicted", "quality", "score").collect()
    assert len(rows) > 60 and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.93
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_split_and_edges(spark, odd_docs, no_docs):
    ids = {i: zlib.crc32(str(i).encode()) % 4 for i in range(50)}
    got = spark.range(50).select("id", quality.part_of(F.col("id"), 4).alias("p")).collect()
    assert {r["id"]: r["p"] for r in got} == ids
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 0), (5, 1), (8, 1), (None, 1), (6, None), (7, 5)], "doc_id bigint, quality int")
    for chosen in (labels, labels.where("quality = 1"), labels.where("false")):
        model = quality.train(odd_docs, chosen)
        out = quality.score(odd_docs.select("doc_id", "text", F.lit(1).alias("extra")), model).collect()
        assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    assert quality.score(no_docs, model).count() == 0
    out = quality.score(odd_docs.withColumn("predicted", F.lit("mine")), model).collect()
    assert {(r["score_"], r["predicted_"]) for r in out} == {("clash", "mine")}


def plain_model(rows, seed=10):
    """Mean, spread, weights and calibration of (stats, label, fold) by plain numpy sums and pooled violators."""
    x, y, fold = (np.array(v, float) for v in zip(*rows, strict=True))
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    rng = np.random.default_rng(seed)
    waves, phase = rng.normal(size=(x.shape[1], 256)) / 4.0, rng.uniform(0, 2 * np.pi, 256)
    z = np.clip((x - mean) / spread, -6, 6)
    f = np.concatenate([np.cos(z @ waves + phase) * np.sqrt(2 / 256), z / 4.0, np.ones((len(z), 1))], 1)
    solve = lambda keep: np.linalg.solve(f[keep].T @ f[keep] + np.eye(f.shape[1]), f[keep].T @ y[keep])
    held = np.empty(len(y))
    for k in range(5):
        held[fold == k] = f[fold == k] @ solve(fold != k)
    at = np.clip((held + 0.5) / 2 * 512, 0, 511).astype(int)
    points = [(held[at == b].mean(), y[at == b].sum(), (at == b).sum()) for b in np.unique(at)]
    rate = np.array([s / n for _, s, n in points])
    weight = np.array([n for _, _, n in points], float)
    best = [max(min(np.average(rate[i : j + 1], weights=weight[i : j + 1]) for j in range(m, len(rate))) for i in range(m + 1)) for m in range(len(rate))]  # min-max form of isotonic regression
    knots = []
    for value in dict.fromkeys(np.round(best, 12)):
        own = [p for p, v in zip(points, np.round(best, 12), strict=True) if v == value]
        n, s = sum(p[2] for p in own), sum(p[1] for p in own)
        knots.append((sum(p[0] * p[2] for p in own) / n, (s + 0.5) / (n + 1)))
    kx, ky = np.array(knots).T
    weights = solve(np.ones(len(y), bool))

    def score(stats):
        z = np.clip((np.array(stats) - mean) / spread, -6, 6)
        f = np.concatenate([np.cos(z @ waves + phase) * np.sqrt(2 / 256), z / 4.0, [1.0]])
        return float(np.interp(f @ weights, kx, np.maximum.accumulate(ky)))

    return score


def test_quality_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    ids = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    keys = {r["doc_id"]: r["h"] for r in labels.select("doc_id", F.xxhash64("doc_id", F.lit(10)).alias("h")).collect()}
    score = plain_model([(quality.statistics(texts[i]), y, keys[i] % 5) for i, y in ids.items() if i in texts])
    for r in quality.op10_quality(spark, sf).collect():
        want = score(quality.statistics(texts[r["doc_id"]]))
        assert r["score"] == pytest.approx(want, abs=1e-6) and r["predicted"] == (r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_the_label_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 5, f"text number {i} with words") for i in range(200)], "doc_id bigint, text string")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows: seen.append(rows.count()))
    quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id bigint, quality int"), sample=20)
    assert seen == [20]


def test_isotonic():
    x, y = quality.isotonic(np.arange(5.0), np.array([0, 5, 1, 8, 9.0]), np.array([10, 10, 10, 10, 10.0]))
    assert np.all(np.diff(y) >= 0) and len(x) == 4


def test_random_features_follow_the_kernel():
    rng = np.random.default_rng(1)
    waves, phase = rng.normal(size=(3, 20_000)) / 2.0, rng.uniform(0, 2 * np.pi, 20_000)
    m = quality.Model(np.zeros(3), np.ones(3), waves, phase, np.zeros(0), (np.zeros(0), np.zeros(0)), 0.5)
    a, b = np.array([[0.1, -0.4, 0.3]]), np.array([[0.9, 0.2, -0.5]])
    got = (m.features(a)[:, :20_000] @ m.features(b)[:, :20_000].T)[0, 0]
    assert got == pytest.approx(np.exp(-((a - b) ** 2).sum() / 8), abs=0.03)
