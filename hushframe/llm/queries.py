"""The registered queries ``opN_<name>``: each applies its operator to the whole of its table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import bpe, decontaminate, html, lm, quality, sharding, simhash, substring, token_counts, toxicity
from hushframe.llm.kit import checkpoint_dir, fold


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    """Vocabulary file of the queries; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup after four batches: every document under two tokenizer versions; the second version's counts of all
    documents revised; that batch once more (no effect); and the documents with a reserved-rights line deleted."""
    docs = read(spark, sf_dir, "documents")
    words, rough, exact = token_counts.count_words(F.col("text")), F.ceil(F.octet_length("text") / 4), F.ceil(F.length("text") / 4)
    rollup = token_counts.Rollup(spark, f"{checkpoint_dir(spark)}/rollup-{uuid.uuid4().hex}")
    load = token_counts.inserts(docs, "words-1", words).unionByName(token_counts.inserts(docs, "quarter-1", rough))
    revise = docs.select(F.lit("revise").alias("op"), "source", "lang", F.lit("quarter-1").alias("tokenizer"), exact.cast("long").alias("tokens"), rough.cast("long").alias("old_tokens"))
    gone = docs.where(F.col("text").rlike(r"All rights reserved\."))
    drop = token_counts.inserts(gone, "words-1", words).unionByName(token_counts.inserts(gone, "quarter-1", exact)).withColumn("op", F.lit("delete"))
    for name, changes in (("load", load), ("revise", revise), ("revise", revise), ("licence", drop)):
        rollup.commit(name, changes)
    return rollup.totals()


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents")).withColumn("grown_shard", F.lit(None).cast("int"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), tokenizer())


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the documents that keep its removed passages, words cut, and the remaining text's digest."""
    done = substring.dedup_passages(read(spark, sf_dir, "documents").select("doc_id", "text"))
    keepers = F.coalesce("_keepers", F.array().cast("array<long>"))
    return done.select("doc_id", keepers.alias("kept_in"), F.col("_words_cut").alias("words_cut"), F.length("text").cast("long").alias("chars_left"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return got.withColumn("held_out", fold(F.col("doc_id"), toxicity.FOLDS) == 0)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_bpe": op2_bpe,
    "op3_html": op3_html,
    "op4_lm": op4_lm,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_simhash": op6_simhash,
    "op7_sharding": op7_sharding,
    "op8_decontaminate": op8_decontaminate,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
}

#: The same totals from the documents as they are, without batches.
TOKEN_SQL = r"""
WITH d AS (SELECT source, lang, text FROM documents WHERE text IS NULL OR text NOT LIKE '%All rights reserved.%')
SELECT source, lang, tokenizer, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM (
  SELECT source, lang, 'words-1' AS tokenizer, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n FROM d
  UNION ALL SELECT source, lang, 'quarter-1', coalesce(CAST(ceil(length(text) / 4.0) AS BIGINT), 0) FROM d
) GROUP BY source, lang, tokenizer
"""

ORACLE_SQL: dict[str, str] = {"op1_token_counts": TOKEN_SQL, "op8_decontaminate": decontaminate.ORACLE_SQL}
