"""A training corpus from ``documents`` in five stages, each one operator of ``versionlog.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versionlog.llm import language_id, line_dedup, mixing, order_minhash, packing
from versionlog.llm.common import stored
from versionlog.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose best language is less probable than this is rejected.
LEAST_LANGUAGE_SCORE = 0.3


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts too) and those of no learned language.

    ``lang`` becomes the language found.
    """
    model = language_id.fit_language_id(docs, F.lit(True))
    seen = language_id.identify(docs, model, extra=[F.col("text"), F.col("source"), F.col("n_chars")])
    kept = seen.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that ten sites share out of all documents but the first, and drops documents that this empties."""
    out = line_dedup.dedup_lines(docs)
    out = out.filter((F.col("n_removed") == 0) | (F.length(F.translate("text", " \t\n\x0b\x0c\r", "")) > 0))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each near-duplicate class.

    Where ids are null or repeat, rows are told apart by id and a hash of the text, and one of equal rows
    stays.  Alike texts that share their class's least id all stay.
    """
    classes = order_minhash.near_duplicates(docs).filter("is_first").withColumnRenamed("doc_id", "__id")
    first = classes.groupBy("__id", F.coalesce("text_hash", F.lit(0)).alias("__hash")).agg(F.count(F.lit(1)).alias("n"))
    first = stored(first, "first-of-class")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.coalesce(F.xxhash64("text"), F.lit(0)) == F.col("__hash"))
    kept = docs.join(first.drop("n"), same, "left_semi").select(*COLUMNS)
    if first.filter((F.col("n") > 1) | F.col("__id").isNull()).isEmpty():
        return kept
    return kept.withColumn("__h", F.xxhash64("text")).groupBy("doc_id", "__h").agg(*(F.first(c).alias(c) for c in COLUMNS if c != "doc_id")).select(*COLUMNS)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (not at all, once, or twice)."""
    size = mixing.n_words(F.col("text"))
    numbered = stored(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "mix-input")
    taken = mixing.mix(numbered, size, id_col="row").filter("taken > 0")
    times = taken.select(F.col("row").alias("__row"), F.expr("cast(taken div size as int)").alias("__n"))
    out = numbered.join(times, F.col("row") == F.col("__row"))
    return out.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language id", keep_known_languages),
    ("line dedup", drop_shared_lines),
    ("near dedup", keep_one_of_near_duplicates),
    ("mix sources", mix_to_weights),
    ("pack", pack),
]

#: Learned, aligned and packed rows are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written and read again as the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
