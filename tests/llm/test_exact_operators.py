"""Token counts, packing, quality, line dedup, mixing, top-k and chat formatting against brute force."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import words
from versionlog.llm import bit_sliced_topk, line_dedup, mixing, packing, preference_chat, token_counts, weak_quality

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
MIXED = list(" \n\tabcé▁漢🎉Åß0x1#'") + ["the", "ing", "<s>", "<|endoftext|>", "\x00", "́", "'ll"]


def mixed(rng, n):
    return "".join(rng.choice(MIXED) for _ in range(n))


# Token counts


def test_chunks_splice_to_the_whole_encoding():
    rng, enc = random.Random(1), token_counts.PieceEncoder(PIECES, chunk=48, overlap=6)
    texts = [mixed(rng, rng.randint(0, 600)) for _ in range(300)] + ["a" * 900, " " * 900, "ab" * 700, "▁" * 300, "é" * 999, "", words(rng, 400)]
    for t in texts:
        assert list(enc.encode(t)) == enc.model.encode(t)
    assert enc.widened > 0


def test_token_counts_of_odd_rows(spark, odd_docs):
    enc = token_counts.PieceEncoder(PIECES)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(odd_docs, PIECES).collect())
    want = []
    for r in odd_docs.collect():
        t = r["text"] or ""
        n = len(enc.model.encode(t))
        want.append((str(r["doc_id"]), len(t.encode()), n, n > 4096))
    assert got == sorted(want)
    assert token_counts.token_counts(odd_docs.limit(0), PIECES).count() == 0


# Packing


def test_word_memory_gives_the_library_ids():
    rng, enc = random.Random(2), packing.WordEncoder(WORDS)
    assert enc.splits
    for _ in range(2000):
        t = mixed(rng, rng.randint(0, 30))
        assert [int(i) for r in enc.runs(t.encode()) for i in r] == enc.model.encode(t, add_special_tokens=False).ids


def test_lower_bound_and_best_fit():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes = rng.integers(1, 21, rng.integers(1, 9))
        best = _optimal([int(s) for s in sizes], 20)
        bound = packing.lower_bound(np.bincount(sizes, minlength=21), 20)
        bins, n = packing.best_fit(sizes, 20)
        assert bound <= best <= n
        assert np.bincount(bins, weights=sizes).max() <= 20
    assert packing.lower_bound(np.bincount([11, 11, 11], minlength=21), 20) == 3
    assert packing.lower_bound(np.bincount([], minlength=21), 20) == 0


def _optimal(sizes, cap):
    best = len(sizes)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best and i < len(sizes):
            return
        if i == len(sizes):
            best = min(best, len(bins))
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= cap:
                put(i + 1, [*bins[:b], bins[b] + sizes[i], *bins[b + 1 :]])
        put(i + 1, [*bins, sizes[i]])

    put(0, [])
    return best


def check_packing(rows, docs, cap, ids_of):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= cap
    want = {}
    for d, t in docs:
        ids = ids_of(t)
        want.setdefault(d, []).extend((i, s, min(cap, len(ids) - s), zlib.crc32(np.array(ids[s : s + cap], dtype="<u4").tobytes())) for i, s in enumerate(range(0, len(ids), cap)))
    assert {d: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in v) for d, v in by_doc.items()} == {d: sorted(v) for d, v in want.items()}
    return len(by_seq)


def test_packing_of_odd_rows(spark, odd_docs):
    enc = packing.WordEncoder(WORDS)
    rows = packing.pack_documents(odd_docs, WORDS).collect()
    check_packing(rows, [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()], 2048, lambda t: enc.model.encode(t, add_special_tokens=False).ids + [0])
    assert packing.pack_documents(odd_docs.limit(0), WORDS).count() == 0


def test_partitions_exchange_until_few_bins_are_left(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_PIECES", 40)
    monkeypatch.setattr(packing, "FAN_IN", 3)
    rng = np.random.default_rng(7)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 101, 1200))]
    df = spark.createDataFrame(rows, "doc_id long, piece long, start long, length long, ids_crc32 long")
    report = []
    out = packing.pack(df, 100, report=report).collect()
    assert len(out) == 1200 and len(report) > 2
    fill = {}
    for r in out:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 100
    bound = packing.lower_bound(np.bincount([r[3] for r in rows], minlength=101), 100)
    assert len(fill) <= bound * 1.03 + 1


# Quality


def brute_features(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    return (len(w), sum(map(len, w)), sum(len(re.findall(r"[#*$%&|<>]", x)) for x in w), len(lines) - len(set(lines)), len(covered))


def test_quality_features(spark, odd_docs):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b"]) for _ in range(rng.randint(0, 40))) + rng.choice(["", "\n\nx\nx\n x", " #$ |"]) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in weak_quality.features(df).collect():
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_features(texts[r["doc_id"]])
    got = weak_quality.quality(odd_docs)
    assert got.count() == odd_docs.count() and got.filter("doc_id = 2 and (kept or not base_failed)").count() == 0
    assert weak_quality.quality(odd_docs.limit(0)).count() == 0


def test_votes_recover_planted_classes():
    rng = random.Random(6)
    counts = {}
    truth = {}
    for _ in range(4000):
        good = rng.random() < 0.8
        votes = tuple(None if rng.random() < 0.4 else int(good if rng.random() < acc else not good) for acc in (0.9, 0.85, 0.8, 0.75, 0.9))
        counts[votes] = counts.get(votes, 0) + 1
        truth[votes] = truth.get(votes, 0) + (1 if good else -1)
    model = weak_quality.fit_votes(sorted(counts.items(), key=str), 5)
    assert 0.7 < model.prior < 0.9
    odds = [sum(model.odds[r][v] for r, v in enumerate(k)) + 1.4 for k in counts]
    right = sum(counts[k] * ((o > 0) == (truth[k] > 0)) for k, o in zip(counts, odds, strict=True))
    assert right / 4000 > 0.93
    assert weak_quality.fit_votes([], 5).prior == 0.5


def test_junk_is_dropped_and_clean_text_kept(spark):
    rng = random.Random(8)
    clean = [(i, "\n".join(words(rng, 12).capitalize() + "." for _ in range(5))) for i in range(200)]
    junk = [(1000 + i, " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in words(rng, 60).split())) for i in range(15)]
    junk += [(2000 + i, " ".join(w.upper() + "!!" for w in words(rng, 60).split())) for i in range(15)]
    kept = {r["doc_id"] for r in weak_quality.quality(spark.createDataFrame(clean + junk, "doc_id long, text string")).filter("kept").collect()}
    assert kept == {i for i, _ in clean}


# Line dedup


def test_lines_of_many_sites_go_but_for_the_first(spark, odd_docs):
    rng = random.Random(9)
    rows, own = [], {}
    for i in range(120):
        site = f"s{i % 12}" if i % 12 else None
        lines = [f"own line number {i} here"]
        lines += ["stands on all the sites"] + ["on nine sites only it is"] * (i % 12 < 9) + ["exactly ten sites have it"] * (i % 12 < 10) + ["short one"] + ["many times on one site"] * (i % 12 == 3)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), site))
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for i, text, _ in rows:
        lines = text.split("\n")
        gone = {"stands on all the sites", "exactly ten sites have it"}
        want = [x for x in lines if x not in gone or (i == 0)]
        assert out[i]["text"].split("\n") == want and out[i]["n_lines"] == len(lines) and out[i]["n_removed"] == len(lines) - len(want)
    got = line_dedup.dedup_lines(odd_docs)
    assert sorted(str(r["text"]) for r in got.collect()) == sorted(str(r["text"]) for r in odd_docs.collect())
    assert set(odd_docs.columns) <= set(got.columns)
    assert line_dedup.dedup_lines(odd_docs.limit(0)).count() == 0


# Mixing


def brute_best(counts, budget):
    reach = {0}
    for s, c in counts.items():
        for _ in range(c):
            reach |= {x + s for x in reach if x + s <= budget}
    return max(reach)


def test_fill_is_the_best_subset_sum():
    rng = random.Random(10)
    for _ in range(60):
        counts = {rng.randint(1, 60): rng.randint(1, 4) for _ in range(rng.randint(1, 7))}
        budget = rng.randint(0, 300)
        took = mixing.fill(counts, budget)
        assert all(0 < k <= counts[s] for s, k in took.items())
        assert sum(s * k for s, k in took.items()) == brute_best(counts, budget)
    big = {s: 50 for s in range(1, 3000, 7)}
    took = mixing.fill(big, 12_345_678)
    assert sum(s * k for s, k in took.items()) == 12_345_678
    assert mixing.fill({}, 5) == mixing.fill({3: 2}, 0) == {}


def test_fill_with_very_large_sizes():
    def filled(counts, budget):
        took = mixing.fill(counts, budget)
        assert all(0 < k <= counts[s] for s, k in took.items())
        return sum(s * k for s, k in took.items())

    assert filled({150_000: 1, 100: 1000}, 200_000) == 200_000
    assert filled({190_000: 3}, 200_000) == 190_000
    assert filled({190_000: 3, 300_000: 1, 7: 1}, 200_000) == 190_007
    assert filled({s: 1 for s in range(140_000, 200_000, 6_007)}, 700_000) == brute_best({s: 1 for s in range(140_000, 200_000, 6_007)}, 700_000)
    assert filled({150_000: 40, 131_073: 30, 3_000_000: 5, 900: 4000, 7: 300}, 12_345_678) == 12_345_678


def test_targets_are_reshared():
    assert mixing.targets([100, 100, 0], [3, 1, 2], 300) == [200.0, 100.0, 0.0]
    assert mixing.targets([10, 10], [1, 1], 1000) == [20.0, 20.0]
    assert mixing.targets([], [], 0) == []


def test_mix(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 10)
    rng = random.Random(11)
    rows = [(i, words(rng, 7 if i % 3 else rng.randint(0, 20)), f"s{min(i % 9, 4)}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_words(df).collect()
    assert len(got) == 900 and {r["taken"] // max(1, r["size"]) for r in got} <= {0, 1, 2}
    by = {}
    source = {i: s for i, _, s in rows}
    for r in got:
        x = by.setdefault(source[r["doc_id"]], [0, r["target"], r["source_size"]])
        x[0] += r["taken"]
    assert all(abs(t - a) <= 1 and t <= 2 * n for t, a, n in by.values())
    assert sorted(map(tuple, mixing.mix_words(df.repartition(5)).collect())) == sorted(map(tuple, got))
    odd = mixing.mix_words(odd_docs).collect()
    assert len(odd) == odd_docs.count() and all(r["taken"] <= 2 * r["size"] for r in odd)
    assert mixing.mix_words(odd_docs.limit(0)).count() == 0


# Top-k


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 0.3, 6), 1)]) for i in range(700)]
    rows += [(700, None), (701, [float("nan")] * 6), (702, [None] * 6), (None, [0.0] * 6), (3, rows[3][1]), (704, [1e6] * 6), (706, [float("inf")] * 6), (750, [1.0, 2.0]), (751, [3.0, 1.0]), (800, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {}
    for r in bit_sliced_topk.top_k(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in {(i): v for i, v in ok if i % 50 == 0}.items():
        want = sorted(((-int(v @ w), i) for i, w in ok if i != q and len(w) == len(v)))[:5]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert bit_sliced_topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_blocks_meet_once(spark, monkeypatch):
    monkeypatch.setattr(bit_sliced_topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(bit_sliced_topk, "BLOCK_QUERIES", 7)
    rows = [(i, [float((i * 7919) % 13 - 6), float(i % 5), 0.25]) for i in range(400)]
    got = {}
    for r in bit_sliced_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 10 == 0, k=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    q = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows}
    for i in range(0, 400, 10):
        want = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:3]
        assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(want)]


# Chat


def brute_pairs(turns):
    """Prompt, completions and masked words of each pair, turn by turn."""
    sides = {}
    for conv, turn, role, text in turns:
        if conv is not None:
            sides.setdefault(conv // 2, ([], []))[conv % 2].append((turn is None, turn or 0, role or "", text or ""))
    line = lambda x: f"<|{x[2]}|>\n{x[3]}<|end|>\n"
    out = {}
    for k, (good, bad) in sides.items():
        good, bad = sorted(good), sorted(bad)
        n = 0
        while n < min(len(good), len(bad)) and good[n][2:] == bad[n][2:]:
            n += 1
        masks = tuple([x[3] + "<|end|>" for x in side[n:] if x[2] == "assistant"] for side in (good, bad))
        out[k] = ("".join(map(line, good[:n])), "".join(map(line, good[n:])), "".join(map(line, bad[n:])), *masks)
    return out


def test_preference_pairs(spark, monkeypatch):
    turns = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "ok"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"),
        (2, 0, None, None), (2, 1, "assistant", "same"), (3, 1, "assistant", "same"), (3, 0, None, None), (4, 0, "user", "alone"), (None, 0, "user", "x"),
        (6, 0, "user", "r"), (6, 0, "user", "r"), (7, 0, "user", "r"), (8, None, "assistant", "last"), (8, 3, "user", "f"), (9, 3, "user", "f"),
        (10, 0, "user", "q"), (10, 1, "assistant", "a"), (11, 1, "user", "q"), (11, 2, "assistant", "b"), (13, -5, "assistant", "only rejected"), (13, None, None, "é🎉"),
    ]
    rng = random.Random(8)
    for conv in range(20, 60):
        turns += [(conv, rng.choice([None, *range(-3, 40)]), rng.choice(["user", "assistant"]), rng.choice("ab")) for _ in range(rng.randint(1, 30))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash")).withColumn("pos", F.lit(1))
    args = F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0
    want = brute_pairs(turns)
    got = {r["pair_id"]: r for r in preference_chat.preference_pairs(df, *args).collect()}
    assert set(got) == set(want) and {r["block"] for r in got.values()} == {0}
    masked = lambda text, spans: [text[x["start"] : x["end"]] for x in spans]
    for k, r in got.items():
        assert (r["prompt"], r["chosen"], r["rejected"], masked(r["chosen"], r["chosen_loss"]), masked(r["rejected"], r["rejected_loss"])) == want[k]
    assert got[5]["prompt"] == "<|user|>\nq<|end|>\n"  # whatever the turns are numbered
    monkeypatch.setattr(preference_chat, "BLOCK", 4)
    parts = {}
    for r in sorted(preference_chat.preference_pairs(df, *args).collect(), key=lambda r: (r["pair_id"], r["block"])):
        old = parts.get(r["pair_id"], ("", "", "", [], []))
        new = (r["prompt"], r["chosen"], r["rejected"], masked(r["chosen"], r["chosen_loss"]), masked(r["rejected"], r["rejected_loss"]))
        parts[r["pair_id"]] = tuple(a + b for a, b in zip(old, new, strict=True))
    assert parts == want
    assert preference_chat.preference_pairs(df.limit(0), F.col("conv_id"), F.lit(True)).count() == 0


@pytest.mark.parametrize("name", ["op4_bit_sliced_topk", "op8_line_dedup", "op9_preference_chat"])
def test_sql_agrees(spark, name):
    import duckdb

    from versionlog.llm import queries

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    cols = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in cols]
    rows = sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())
    assert sorted(str(tuple(r[c] for c in cols)) for r in queries.QUERIES[name](spark, d).collect()) == rows
