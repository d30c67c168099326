"""A corpus-cleaning pipeline over ``documents``: five stages, each one operator of ``hushframe.llm``.

``run`` writes every stage as Parquet in the shared folder and reads it again for the next, so a lost executor
costs at most one stage.  All stages but the last return the columns of their input, under any names; the last returns one row
for each row it is given.  Odd rows have the same lot in every stage: a null or empty text fails the quality rules and goes
there; rows with a null doc_id are judged by quality, and otherwise pass; rows that repeat a doc_id are reduced
to the least one (near-dedup); of equal documents the one of least doc_id stays; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import bpe, decontaminate, quality, simhash, substring
from hushframe.llm.kit import drop_table, table, unused
from hushframe.llm.queries import read, tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the rules reject go."""
    return quality.keep_rows(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group, the document of least doc_id stays (once, if its row is repeated)."""
    return simhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: repeated passages are cut from all documents but the first; a document left without words goes."""
    keepers, cut = unused(docs, "keepers", "words_cut")
    done = substring.dedup_passages(docs, keepers=keepers, words_cut=cut)
    left = done.where((F.col(cut) == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col(cut) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that contain a benchmark item go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: per document its ids' count and digest, and the digest of the text decoded from them."""
    return bpe.round_trip(docs, tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]

#: Boosted trees, fingerprints and encodings are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table is deleted once the next one stands."""
    docs, last = read(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = table(stage(spark, docs, sf_dir), f"stage{i}")
        if last is not None:
            drop_table(last)
        last = docs
    return docs
