"""Operator 8 [native]: benchmark decontamination by size-partitioned MinHash containment search.

Texts are lower-cased and cut at everything that is no letter or digit.  An item of n distinct five-word
shingles is contained in a document when at least 0.8 n of them occur in it, so a document that contains it lacks at most
m = n - ceil(0.8 n).  Items are partitioned by n (powers of two).  All sketches of a partition have one size, k = 2 m + 1 with
the partition's largest m: the k least hash values of an item (bottom-k MinHash; all, where it has fewer).  A document
that contains the item holds all but m of its sketch.  So documents are probed with all their shingles, partition by partition
for which they are long enough, hits are counted for each document and item, and pairs with too few hits are ruled out.  No sketch
of the document is needed: one of fixed size would lose short items in long documents.  Candidates are verified by
exact shingle containment.

Only DataFrame functions run here.  The sketches are broadcast only while their counted size is under ``BROADCAST_ROWS``;
beyond it both sides are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.kit import table, tables, unused

SHINGLE, CONTAINMENT, BROADCAST_ROWS = 5, 0.8, 500_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for a null text."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(text: Column, k: int = SHINGLE) -> Column:
    """Distinct 64-bit hashes of k-word shingles; fewer words: one hash of them all; no words: none."""
    # the outer transform binds the word hashes once; named twice, they would be computed again for every shingle
    hashed = F.array(F.transform(words(text), lambda w: F.xxhash64(w)))
    windows = lambda h: F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - F.lit(k - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, k)))
    return F.array_distinct(F.transform(hashed, lambda h: F.when(F.size(h) > 0, windows(h)).otherwise(F.array().cast("array<bigint>")))[0])


def size_class(n: Column) -> Column:
    """Partition of an item of n shingles: powers of two."""
    return F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int")


def sketches(items: DataFrame, k: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """``items(item_id, text)`` -> ``(item_id, n_shingles, hashes, part, sketch, least_hits)``; items without words have no row."""
    rows = items.select("item_id", F.array_sort(shingles(F.col("text"), k)).alias("hashes")).withColumn("n_shingles", F.size("hashes")).where("n_shingles > 0")
    n = F.col("n_shingles")
    rows = rows.withColumn("part", size_class(n)).withColumn("missing", (n - F.ceil(n * F.lit(containment) - F.lit(1e-9))).cast("int"))
    widths = rows.groupBy("part").agg((2 * F.max("missing") + 1).alias("k"))  # a row for each power of two
    # the hash values are uniform, so the least are a uniform sample; sorted above
    rows = rows.join(F.broadcast(widths), "part").withColumn("sketch", F.slice("hashes", F.lit(1), F.col("k")))
    return rows.select("item_id", "n_shingles", "hashes", "part", "sketch", (F.size("sketch") - F.col("missing")).alias("least_hits"))


def contaminated(docs: DataFrame, items: DataFrame, k: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_shingles)`` for every pair that reaches the containment.

    An item of fewer than ``k`` words is one shingle of them all, so only a document of just these words holds it: a
    phrase that short inside other text is no evidence.  Null and empty texts contain nothing; items without words are in no
    document; items or documents with a null id are not searched.  Rows that repeat an id are searched each, and the pair is
    reported once, with the most that one of them shares.  Empty tables give an empty table; other columns are ignored.
    """
    texts = lambda df, key: df.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text")).where(F.col(key).isNotNull())
    with tables() as keep:
        sketch = table(sketches(texts(items, "item_id").distinct(), k, containment).withColumn("row", F.monotonically_increasing_id()), "items")
        limits = sketch.agg(F.sum(F.size("sketch")).alias("rows"), F.min("n_shingles").alias("least")).first()
        need = math.ceil((limits["least"] or 1) * containment - 1e-9)
        keys = sketch.select("row", "part", "least_hits", F.explode("sketch").alias("h"))
        keys = F.broadcast(keys) if (limits["rows"] or 0) <= BROADCAST_ROWS else keys

        probe = texts(docs, "doc_id").select("doc_id", shingles(F.col("text"), k).alias("own")).where(F.size("own") >= need)
        posted = probe.select("doc_id", F.size("own").alias("n_own"), F.explode("own").alias("h"))
        # a document of n_own shingles cannot hold 0.8 of an item of the partition's least size beyond n_own
        met = posted.join(keys, "h").where(F.col("n_own") >= F.pow(F.lit(2.0), F.col("part")) * F.lit(containment) - 1)
        hits = met.groupBy("doc_id", "row", "least_hits").agg(F.count("*").alias("hits"))
        candidates = table(hits.where("hits >= least_hits").select("doc_id", "row"), "candidates")

        own = texts(docs, "doc_id").join(candidates.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", shingles(F.col("text"), k).alias("own"))
        pairs = own.join(candidates, "doc_id").join(sketch.select("row", "item_id", "n_shingles", "hashes"), "row")
        shared = pairs.select("doc_id", "item_id", F.size(F.array_intersect("own", "hashes")).cast("long").alias("n_shared"), "n_shingles")
        enough = shared.where(F.col("n_shared") >= F.col("n_shingles") * F.lit(containment) - F.lit(1e-9))
        found = enough.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_shared", "n_shingles")).alias("most")).select("doc_id", "item_id", "most.n_shared", "most.n_shingles")
        return keep(table(found, "contaminated"))


def clean(docs: DataFrame, items: DataFrame, k: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """``docs`` without the documents that contain an item.

    Rows with a null doc_id stay, and so do those with null and empty texts; of an id whose rows repeat, all rows go if one of them
    contains an item; columns may have any names and stay as they are; an empty table of either kind removes nothing.
    """
    (bad,) = unused(docs, "bad")
    found = contaminated(docs, items, k, containment).select(F.col("doc_id").alias(bad)).distinct()
    return docs.join(found, docs["doc_id"].cast("long") == F.col(bad), "left_anti")


#: DuckDB: the same pairs by comparing all shingles, without sketches.
ORACLE_SQL = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark WHERE item_id IS NOT NULL
), s AS (
  SELECT DISTINCT side, id, array_to_string(ws[i : i + 4], ' ') AS sh
  FROM (SELECT side, id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT id AS item_id, count(*) AS n_shingles FROM s WHERE side = 'i' GROUP BY id)
SELECT d.id AS doc_id, n.item_id, count(*) AS n_shared, n.n_shingles
FROM s d JOIN s i ON d.sh = i.sh AND d.side = 'd' AND i.side = 'i' JOIN n ON n.item_id = i.id
GROUP BY d.id, n.item_id, n.n_shingles
HAVING count(*) >= 0.8 * n.n_shingles - 1e-9
"""
