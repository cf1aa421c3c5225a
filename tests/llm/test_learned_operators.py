"""Near duplicates, language models and language identification: brute force, gradients, held-out accuracy."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import words
from versionlog.llm import language_id, lm_scoring, order_minhash
from versionlog.llm.components import components

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# Near duplicates


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def banded_lcs(a, b, band):
    """By the whole table; matches outside the band do not count."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y and abs(i - j) <= band else max(row[j + 1], row[j])
    return row[-1]


def test_alignment_is_the_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randint(0, 9) for _ in range(rng.randint(1, 40))] for _ in range(2))
        at, to = (np.array(x, dtype=np.int64) for x in zip(*[(i, j) for j, y in enumerate(b) for i in range(len(a) - 1, -1, -1) if a[i] == y] or [(0, 10**6)], strict=True))
        for band in (0, 2, 7, 100):
            assert order_minhash.common_in_order(at, to, band) == banded_lcs(a, b, band)
        assert banded_lcs(a, b, 100) == lcs(a, b)


def test_very_long_texts_are_aligned_in_bounded_memory():
    w = [f"w{i}".encode() for i in range(200_000)]
    a, moved = order_minhash.kmers(w), order_minhash.kmers(w[:20_000] + w[30_000:] + w[20_000:30_000])
    tracemalloc.start()
    near, far = order_minhash.similarity(a, moved), order_minhash.similarity(a, order_minhash.kmers(w[100_000:] + w[:100_000]))
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    assert near == pytest.approx((199_996 - 10_000) / (199_996 + 10_000), rel=1e-3) and far < 0.8


def test_similarity_needs_the_same_order():
    w = [f"w{i}".encode() for i in range(200)]
    a = order_minhash.kmers(w)
    assert order_minhash.similarity(a, a) == 1.0
    edited = order_minhash.kmers([*w[:100], b"new", *w[100:]])
    assert abs(order_minhash.similarity(a, edited) - 192 / (196 + 197 - 192)) < 1e-9
    assert order_minhash.similarity(a, order_minhash.kmers(w[100:] + w[:100])) == pytest.approx(96 / (196 * 2 - 96)) or order_minhash.similarity(a, order_minhash.kmers(w[100:] + w[:100])) < 0.8
    assert order_minhash.similarity(a, order_minhash.kmers([])) == 0.0
    swapped = [w[i ^ 1] for i in range(200)]
    assert order_minhash.similarity(a, order_minhash.kmers(swapped)) < 0.8


def test_occurrences_are_told_apart():
    x = order_minhash.kmers([b"a"] * 12)
    assert len(set(x.tolist())) == 8
    assert order_minhash.similarity(x, order_minhash.kmers([b"a"] * 11)) == pytest.approx(7 / 8)
    assert len(order_minhash.kmers([b"a", b"b"])) == 1 and len(order_minhash.sketch(order_minhash.kmers([]))) == 0


def edit(rng, w, n):
    w = list(w)
    for _ in range(n):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice([[], [f"e{rng.random()}"], [w[i], f"e{rng.random()}"]])
    return w


def test_classes_match_brute_force(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(12):
        base = words(rng, 150).split()
        texts += [" ".join(edit(rng, base, rng.randint(0, 9))) for _ in range(25)]
    passage = words(rng, 60)
    texts += [passage + " " + words(rng, 80) for _ in range(60)]
    texts += [texts[0]] * 5 + [words(rng, n) for n in (1, 3, 5, 8)] * 2 + ["One Two", "one  two\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs).collect()}
    k = [order_minhash.kmers(order_minhash.split(t)) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = set(k[i].tolist()), set(k[j].tolist())
            n = len(a & b)
            if n >= 0.8 * (len(a) + len(b) - n) and lcs(k[i].tolist(), k[j].tolist()) >= 0.8 * (len(a) + len(b) - lcs(k[i].tolist(), k[j].tolist())):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert got == {i: find(i) for i in range(len(texts))}


def test_pairs_in_a_bucket_of_many_different_texts_are_found(spark):
    rng = random.Random(3)
    passage, texts = words(rng, 140), []
    for i in range(200):  # all share the passage, at 0.79; two at a time two words more, at 0.81
        texts += [f"{passage} a{i} b{i} c{i}{x} {words(rng, 15)}" for x in "de"]
    k = [order_minhash.kmers(order_minhash.split(t)) for t in texts]
    assert all(order_minhash.similarity(k[i], k[i + 1]) >= 0.8 for i in range(0, 400, 2))
    assert all(order_minhash.similarity(k[i], k[j]) < 0.8 for i in range(0, 400, 8) for j in range(400) if i // 2 != j // 2)
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [i for i in range(400) if got[i] != i // 2 * 2] == []


def test_alike_pairs_among_many_that_share_most_are_found(spark, monkeypatch):
    whole = order_minhash.sketch
    monkeypatch.setattr(order_minhash, "sketch", lambda x: whole(x[:300], 2))  # all are in one bucket
    rng, texts = random.Random(5), []
    opening = words(rng, 350)
    for i in range(4):  # those with the same middle part are at 0.79, two at a time share eight words more
        middle = words(rng, 180)
        for j in range(25):
            own = words(rng, 8)
            texts += [f"{opening} {middle} {own} {words(rng, 64)}" for _ in range(2)]
    k = [order_minhash.kmers(order_minhash.split(t)) for t in texts]
    assert all(order_minhash.similarity(k[i], k[j]) >= 0.8 if j == i + 1 and i % 2 == 0 else order_minhash.similarity(k[i], k[j]) < 0.8 for i in range(200) for j in range(i + 1, 200))
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [i for i in range(200) if got[i] != i // 2 * 2] == []


def test_no_alike_pair_is_ruled_out(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "BLOCK", 7)
    rng, texts = random.Random(6), []
    for _ in range(8):
        base = words(rng, 90).split()
        texts += [" ".join(edit(rng, base[: rng.randint(70, 90)], rng.randint(0, 9))) for _ in range(30)]
    texts = sorted(set(texts))
    k = [order_minhash.kmers(order_minhash.split(t)) for t in texts]
    alike = {(i, j) for i in range(len(k)) for j in range(i + 1, len(k)) if order_minhash.similarity(k[i], k[j]) >= 0.8}
    rows = [(i.to_bytes(2), i, bytearray(x.tobytes())) for i, x in enumerate(k)]
    pairs = order_minhash._possible(spark.createDataFrame(rows, "node binary, root long, kmers binary"), 0.8).collect()
    got = {(int.from_bytes(r["u"]), int.from_bytes(r["v"])) for r in pairs}
    assert alike and alike <= got and len(pairs) == len(got) < len(k) * (len(k) - 1) // 2


def test_near_duplicates_of_odd_rows(spark, odd_docs):
    got = Counter((r["id"] if "id" in r else r["doc_id"], r["class_id"], r["is_first"]) for r in order_minhash.near_duplicates(odd_docs).collect())
    assert sum(got.values()) == odd_docs.count()
    assert got[(1, 1, True)] == 3 and got[(2, 2, True)] == got[(3, 3, True)] == 1 and got[(None, None, True)] == 2
    assert order_minhash.near_duplicates(odd_docs.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 150)}}


# Language identification


def numeric(f, p, k, i, e):
    old = p[k][i]
    p[k][i] = old + e
    a = f()
    p[k][i] = old - e
    b = f()
    p[k][i] = old
    return (a - b) / (2 * e)


def test_gru_gradients():
    rng = np.random.default_rng(0)
    m = language_id.ByteGru.fresh(["a", "b", "c"], units=3, window=5)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, y, mask = rng.integers(0, 256, (5, 4)).astype(np.uint8), np.array([0, 1, 2, 1]), np.ones((5, 4))
    _, d = m.gradients(x, y, mask)
    for k in m.p:
        i = np.unravel_index(np.abs(d[k]).argmax(), d[k].shape)
        assert numeric(lambda: m.gradients(x, y, mask)[0], m.p, k, i, 1e-3) == pytest.approx(d[k][i], rel=1e-2)


def test_held_out_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = language_id.fit_language_id(docs, ~held)
    got = language_id.identify(docs.filter(held), model).join(docs, "doc_id")
    assert got.filter(F.col("lang") == F.col("lang_pred")).count() > 0.97 * got.count()
    assert got.filter((F.col("score") < 0) | (F.col("score") > 1)).count() == 0


def test_languages_of_odd_rows(spark, odd_docs):
    model = language_id.fit_language_id(odd_docs, F.lit(True))
    rows = language_id.identify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert by[2] == by[3] == by[6] == by[8] == "und" and by[9] in model.classes
    none = language_id.fit_language_id(odd_docs, F.lit(False))
    assert none is None and {r["lang_pred"] for r in language_id.identify(odd_docs, none).collect()} == {"und"}
    assert language_id.identify(odd_docs.limit(0), model).count() == 0


# Language model


def small_model(complete=True):
    rng = np.random.default_rng(1)
    ids = np.concatenate([[lm_scoring.END], rng.integers(0, 300, 6000), [lm_scoring.END]])
    pair, n = np.unique(ids[:-1] * lm_scoring.SIZE + ids[1:], return_counts=True)
    a, b, counts = pair // lm_scoring.SIZE, pair % lm_scoring.SIZE, np.bincount(ids[1:], minlength=lm_scoring.SIZE).astype(float)
    v, k = lm_scoring.classes_of(a, b, n, counts, np.argsort(-counts, kind="stable")[:64], np.arange(lm_scoring.SIZE) % 2 == 0)
    cell, at = np.unique(a * lm_scoring.CLASSES + k[b], return_inverse=True)
    classes = np.column_stack([cell // lm_scoring.CLASSES, cell % lm_scoring.CLASSES, np.bincount(at, weights=n), np.bincount(at)])
    held = slice(None) if complete else slice(0, len(pair), 2)
    t = lm_scoring.Tables(k, v, counts, classes, pair[held], n[held].astype(float), complete)
    flat = lm_scoring.AttentionModel.fresh()
    flat += 0.1 * np.random.default_rng(7).standard_normal(len(flat)).astype(np.float32)
    m = lm_scoring.AttentionModel(flat, t)
    m.for_scoring()
    return m, ids[1:-1].astype(np.uint16)


def test_attention_gradients():
    m, ids = small_model()
    m.tables.vectors = m.tables.vectors.astype(np.float64)
    m = lm_scoring.AttentionModel(m.flat.astype(np.float64), m.tables)
    c, s = lm_scoring.CONTEXT, lm_scoring.STRIDE
    w, weight = np.lib.stride_tricks.sliding_window_view(ids, c + 1)[[0, 40, 500]], np.random.default_rng(4).random(3 * s)
    slabs, targets = w[:, :-1], w[:, c - s + 1 :].reshape(-1)
    _, d = m.gradients(slabs, targets, weight)
    d = lm_scoring.AttentionModel(d, m.tables).p
    for k in m.p:
        i = np.unravel_index(np.abs(d[k]).argmax(), d[k].shape)
        assert numeric(lambda: m.gradients(slabs, targets, weight)[0], m.p, k, i, 1e-4) == pytest.approx(d[k][i], rel=1e-2)


def test_next_id_probabilities_sum_to_one():
    m, ids = small_model()
    c, s, size = lm_scoring.CONTEXT, lm_scoring.STRIDE, lm_scoring.SIZE
    klass = m.tables.group.astype(int) * lm_scoring.MEMBERS + m.tables.member
    within = np.exp(m.tables.log_within(np.full(size, ids[c - 1]), np.arange(size, dtype=np.uint16))[0].astype(np.float64))
    used, first = np.unique(klass, return_index=True)
    targets = np.zeros((len(used), s), dtype=np.int64)
    targets[:, -1] = first
    p = np.exp([float(m.log_classes(ids[:c], t)[-1]) for t in targets])
    assert p.sum() == pytest.approx(1, abs=1e-3)
    assert np.bincount(klass, weights=within)[used] == pytest.approx(1, abs=5e-3)


def test_windows_score_each_id_once_after_half_a_window_of_context():
    m, every = small_model()
    c, s, end = lm_scoring.CONTEXT, lm_scoring.STRIDE, lm_scoring.END
    texts = [np.concatenate([[end], every[: n - 2], [end]]).astype(np.uint16) for n in (2, 3, 5, s, s + 1, s + 2, c, c + 1, c + 2, 200)]
    got, _, loose = m.score(np.concatenate(texts), np.array([len(x) for x in texts]))
    assert len(loose) == 0
    for ids, score in zip(texts, got, strict=True):
        padded, want = np.concatenate([np.full(c - s, end), ids, np.full(c, end)]).astype(np.uint16), 0.0
        for i in range(1, len(ids)):
            a, k = (i - 1) // s * s, (i - 1) % s
            seen = padded[a : a + c].copy()
            seen[c - s + k + 1 :] = 7  # what comes later does not matter
            targets = np.zeros(s, dtype=np.int64)
            targets[k] = ids[i]
            want += m.log_classes(seen, targets)[k] + m.tables.log_within(ids[i - 1 : i], ids[i : i + 1])[0][0]
        assert score == pytest.approx(want / math.log(10), rel=1e-4)


def test_a_pass_of_training_predicts_each_id_once(monkeypatch):
    m, every = small_model()
    c, s, end = lm_scoring.CONTEXT, lm_scoring.STRIDE, lm_scoring.END
    lengths = np.array([2, 3, s, s + 1, s + 2, c, c + 1, c + 2, 200, 1000])
    texts = [np.concatenate([[end], every[: n - 2], [end]]).astype(np.uint16) for n in lengths]
    seen, real = Counter(), m.gradients

    def gradients(w, targets, weight):
        before = w[:, c - s :].reshape(-1)[weight > 0]
        seen.update(zip(before.tolist(), targets[weight > 0].tolist(), strict=True))
        return real(w, targets, weight)

    monkeypatch.setattr(m, "gradients", gradients)
    m.learn(np.concatenate(texts), lengths, 0.01, 0.001)
    assert seen == Counter((int(a), int(b)) for x in texts for a, b in zip(x[:-1], x[1:], strict=True))


def test_training_and_scoring_see_the_same_hidden_layer():
    m, ids = small_model()
    c, s = lm_scoring.CONTEXT, lm_scoring.STRIDE
    slab = ids[: c + 4 * s]
    windows = np.lib.stride_tricks.sliding_window_view(slab, c)[::s]
    assert m.hidden(windows)[0] == pytest.approx(m.hidden_of(slab), abs=1e-5)


def test_no_place_needs_a_key_or_value_of_its_own():
    m, ids = small_model()
    c, s, dim = lm_scoring.CONTEXT, lm_scoring.STRIDE, lm_scoring.DIM
    got, made = m.hidden(ids[None, :c])
    p, x = m.p, m.tables.vectors[ids[:c]]
    for k in range(s):
        at = c - s + k
        a = np.exp(x[at] @ p["q"] @ (x[: at + 1] @ p["k"]).T / math.sqrt(dim) + p["near"][at - np.arange(at + 1)])
        own = np.concatenate([x[at], a / a.sum() @ (x[: at + 1] @ p["v"])])
        assert got[k] == pytest.approx(np.tanh(own @ p["w1"] + p["b1"]), abs=1e-5)
    assert not {"q", "k", "v"} & set(made) and not hasattr(m, "kv")


def test_words_without_odd_spaces_need_no_looking_ahead():
    enc, rng = lm_scoring.SubwordIds(RANKS), random.Random(7)
    some = ["a", "it's", "'ll", "x" * 50, "1,2", "--", "\u00e9\u6f22", "\u00bd", "\x1b[0m", "\U0001f389", "\u0301a", "\u200b", "\ufeffz", "\u0663"]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    assert [enc.plain.encode_ordinary(" " + t) for t in texts] == [enc.model.encode_ordinary(" " + t) for t in texts]
    assert "(?!" not in enc.plain._pat_str


def test_pairs_that_are_not_held_are_listed():
    m, every = small_model(complete=False)
    full, _ = small_model()
    ids = np.concatenate([[lm_scoring.END], every[:500], [lm_scoring.END]]).astype(np.uint16)
    score, owner, pair = m.score(ids, np.array([len(ids)]))
    known = set(m.tables.held.keys.tolist())
    assert sorted(pair.tolist()) == sorted(p for p in (ids[:-1].astype(np.int64) * lm_scoring.SIZE + ids[1:]).tolist() if p not in known) and set(owner) == {0}
    low = m.tables.log_low(pair // lm_scoring.SIZE, pair % lm_scoring.SIZE).sum()
    right = full.tables.log_within(pair // lm_scoring.SIZE, pair % lm_scoring.SIZE)[0].sum()
    assert score[0] + (right - low) / math.log(10) == pytest.approx(full.score(ids, np.array([len(ids)]))[0][0], rel=1e-5)


def test_ids_give_back_words():
    enc = lm_scoring.SubwordIds(RANKS)
    begins = enc.begins()
    rng = random.Random(6)
    odd = ["a", "Ab\u00a0", "\u00a0", "\u2003x", "é漢", "x" * 50, "it's", "\x1c", "1 2", "\u0085b", "🎉"]
    texts = [lm_scoring.words(" ".join(rng.choice(odd) for _ in range(rng.randint(0, 12)))) for _ in range(300)]
    ids = [enc.ids(w) for w in texts]
    text, h = lm_scoring._words_of(np.concatenate(ids), np.array([len(x) for x in ids]), begins)
    names = {}
    assert np.bincount(text, minlength=300).tolist() == [len(w) + 1 for w in texts]
    for w, x in zip([w for t in texts for w in [*t, b"\n"]], h.tolist(), strict=True):
        assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


def test_lookup_holds_what_it_was_given():
    rng = np.random.default_rng(5)
    for kind in (np.uint32, np.int64):
        keys = np.unique(rng.integers(0, 1 << 31, 5000).astype(kind))
        found, new = lm_scoring.Lookup(keys[::2], np.arange(len(keys[::2])))(keys)
        assert found[::2].tolist() == list(range(len(keys[::2]))) and sorted(new.tolist()) == list(range(1, len(keys), 2))
    assert lm_scoring.Lookup(keys[:0], keys[:0])(keys)[1].tolist() == list(range(len(keys)))


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_held_out_scores_beat_the_unigram(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = lm_scoring.score_texts(docs.withColumn("held", held), ~held, RANKS, extra=["held"])
    r = got.filter("held").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert r["s"] / r["n"] > r["b"] / r["n"] + {"0.01": 0.0, "0.1": 0.15}[sf]


def test_joined_words_and_pairs_give_the_same_scores(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learn = F.col("doc_id") % 4 != 0
    rows = lambda: {r["doc_id"]: (r["score"], r["base_score"], r["n_known"]) for r in lm_scoring.score_texts(docs, learn, RANKS).collect()}
    want = rows()
    monkeypatch.setattr(lm_scoring, "PAIRS", 500)
    monkeypatch.setattr(lm_scoring, "COMMON_WORDS", 50)
    got = rows()
    assert {k: pytest.approx(v, rel=1e-5) for k, v in want.items()} == got


def test_scores(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = {r["doc_id"]: r for r in lm_scoring.score_texts(docs, ~held, RANKS).collect()}
    rows = docs.withColumn("held", held).collect()
    counts = Counter()
    for r in rows:
        if not r["held"]:
            counts.update([*r["text"].encode().lower().split(), b"\n"])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        w = [*r["text"].encode().lower().split(), b"\n"]
        x = got[r["doc_id"]]
        assert x["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in w), rel=1e-9)
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (len(w), sum(counts[t] > 0 for t in w), n)
        assert x["score"] < 0
    odd = lm_scoring.score_texts(odd_docs, F.col("doc_id") != 1, RANKS, extra=["source"]).collect()
    assert len(odd) == odd_docs.count()
    assert {r["n_tokens"] for r in odd if r["doc_id"] in (2, 3, 6)} == {1}
    assert lm_scoring.score_texts(odd_docs.limit(0), F.lit(True), RANKS).count() == 0
    assert {r["train_tokens"] for r in lm_scoring.score_texts(odd_docs, F.lit(False), RANKS).collect()} == {0}
