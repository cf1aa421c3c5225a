"""The pipeline's stages, one by one and end to end."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.conftest import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "xx", s, len(t or "")) for i, t, s in rows], SCHEMA)


def test_stages_are_named_and_in_order():
    assert [n for n, _ in cp.STAGES] == ["language id", "line dedup", "near dedup", "mix sources", "pack"]


def test_each_stage(spark):
    rng = random.Random(3)
    base = words(rng, 120).split()
    rows = [(i, words(rng, 60) + "\na shared closing line here", f"s{i % 12}") for i in range(60)]
    rows += [(100 + i, " ".join([*base[: 40 + i], "x", *base[41 + i :]]), "s1") for i in range(5)]
    rows += [(200, None, "s1"), (201, "12 34 ##", "s2"), (202, "", None), (203, "a shared closing line here", "s2")]
    docs = docs_of(spark, rows)
    kept = cp.keep_known_languages(spark, docs, "")
    assert kept.columns == cp.COLUMNS and {r["doc_id"] for r in kept.collect()} == {i for i, *_ in rows} - {200, 201, 202}
    lines = cp.drop_shared_lines(spark, kept, "")
    assert lines.columns == cp.COLUMNS
    text = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert "closing" in text[0] and not any("closing" in t for i, t in text.items() if i) and 203 not in text
    near = cp.keep_one_of_near_duplicates(spark, lines, "")
    assert {r["doc_id"] for r in near.collect()} == set(text) - {101, 102, 103, 104}
    mixed = cp.mix_to_weights(spark, near, "")
    assert mixed.columns == cp.COLUMNS and {r["doc_id"] for r in mixed.collect()} <= set(text)
    assert max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 2
    packed = cp.pack(spark, mixed, "")
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_repeated_ids_keep_one_row_each(spark):
    t = "one two three four five six seven eight"
    docs = docs_of(spark, [(1, t, "s"), (1, t, "s"), (2, t, "s"), (3, "other words stand in this one", "s"), (3, "and again some quite different ones", "s"), (None, "a text without any id at all", "s")])
    got = cp.keep_one_of_near_duplicates(spark, docs, "").collect()
    assert sorted((str(r["doc_id"]), r["text"][:3]) for r in got) == [("1", "one"), ("3", "and"), ("3", "oth"), ("None", "a t")]
    a, b = "the first text has seven words here", "but another one has other words than that"
    got = cp.keep_one_of_near_duplicates(spark, docs_of(spark, [(0, b, "s"), (1, a, "s"), (1, b, "s")]), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(0, b), (1, a)]


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_empty_tables(spark, name, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_run(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
