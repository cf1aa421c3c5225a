"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versionlog.llm import bit_sliced_topk, language_id, line_dedup, lm_scoring, mixing, order_minhash, packing, preference_chat, token_counts, weak_quality

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """Where the installed package has a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every whole document."""
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and model scores of every whole document, learned outside the held-out seventh."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(_remainder(7) == 2, F.lit(False)))
    learn = _remainder(7) != 2
    return lm_scoring.score_texts(docs, learn, tokenizer_path("byte_bpe_multi_50k.tiktoken"), extra=["held_out"])


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document, learned from those outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit_language_id(docs, _remainder(3) != 1)
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out")
    return language_id.identify(docs, model, extra=[held_out])


def op4_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector with all others."""
    return bit_sliced_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 3, 1, 2, ... at 150 % of all words."""
    return mixing.mix_words(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece tokens of every whole document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule features and the posterior verdict of every whole document."""
    out = weak_quality.quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten sites or more share."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "n_lines", "n_removed", "text")


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, coalesce('s' || source, 'z') AS site, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT line, min((doc_id, pos)) AS first FROM l
  WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 3
  GROUP BY line HAVING count(DISTINCT site) >= 10
), k AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS text
  FROM (SELECT l.*, b.line IS NOT NULL AND (doc_id, pos) <> first AS gone FROM l LEFT JOIN b USING (line))
  GROUP BY doc_id
)
SELECT d.doc_id, d.source, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN k USING (doc_id)
"""


def op9_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in pairs of neighbouring ids, the even one chosen: prompt and two masked completions."""
    turns = table(spark, sf_dir, "conversations")
    out = preference_chat.preference_pairs(turns, F.floor(F.col("conv_id") / 2).cast("long"), F.col("conv_id") % 2 == 0)
    spans = {c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",") for c in ("chosen_loss", "rejected_loss")}
    return out.withColumns(spans)


OP9_SQL = f"""
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS good, coalesce(role, '') AS role, coalesce(text, '') AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), paired AS (
  SELECT pair_id, pos, a.pair_id IS NOT NULL AND b.pair_id IS NOT NULL AND a.role = b.role AND a.words = b.words AS same
  FROM (SELECT * FROM t WHERE good) a FULL JOIN (SELECT * FROM t WHERE NOT good) b USING (pair_id, pos)
), fork AS (
  SELECT pair_id, min(pos) AS forked FROM paired WHERE same IS NOT TRUE GROUP BY pair_id
), written AS (
  SELECT t.*, pos // {preference_chat.BLOCK} AS block, (forked IS NULL OR pos < forked) AS shared,
         concat('<|', role, '|>', chr(10), words, '<|end|>', chr(10)) AS line
  FROM t LEFT JOIN fork USING (pair_id)
), spaced AS (
  SELECT *, sum(length(line)) OVER (PARTITION BY pair_id, good, shared, block ORDER BY pos) - length(line) AS begun FROM written
), masked AS (
  SELECT *, CASE WHEN role = 'assistant' THEN concat(begun + strlen('<|assistant|>') + 1, '-', begun + length(line) - 1) END AS span FROM spaced
)
SELECT pair_id::BIGINT AS pair_id, block::BIGINT AS block,
       coalesce(string_agg(line, '' ORDER BY pos) FILTER (shared AND good), '') AS prompt,
       coalesce(string_agg(line, '' ORDER BY pos) FILTER (NOT shared AND good), '') AS chosen,
       coalesce(string_agg(line, '' ORDER BY pos) FILTER (NOT shared AND NOT good), '') AS rejected,
       coalesce(string_agg(span, ',' ORDER BY pos) FILTER (NOT shared AND good), '') AS chosen_loss,
       coalesce(string_agg(span, ',' ORDER BY pos) FILTER (NOT shared AND NOT good), '') AS rejected_loss
FROM masked GROUP BY ALL
"""


def op10_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES: dict[str, Query] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_lm_scores": op2_lm_scores,
    "op3_language_id": op3_language_id,
    "op4_bit_sliced_topk": op4_bit_sliced_topk,
    "op5_mix_sources": op5_mix_sources,
    "op6_token_counts": op6_token_counts,
    "op7_weak_quality": op7_weak_quality,
    "op8_line_dedup": op8_line_dedup,
    "op9_preference_chat": op9_preference_chat,
    "op10_pack_documents": op10_pack_documents,
}

ORACLE_SQL: dict[str, str] = {"op4_bit_sliced_topk": OP4_SQL, "op8_line_dedup": OP8_SQL, "op9_preference_chat": OP9_SQL}
