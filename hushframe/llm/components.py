"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) and one join; state is a Parquet table in the
shared folder, so lost executors only repeat a step.  Nothing is collected but four totals per round.  Nodes with a large share
of all edges (``SHARE``; so a bounded number) get their minimum by broadcast: their edges stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.kit import drop_table, spread_join, table

#: A node with more than 1/SHARE of the edges is a hub; there are at most 2 * SHARE.  With up to LEAST edges no node is one.
SHARE, LEAST = 1000, 4096


def _told(rows: DataFrame, least: DataFrame, hubs: int | None) -> DataFrame:
    """Each row with its node's minimum."""
    one = least.select("a", "m")
    return rows.join(one, "a") if hubs is None else spread_join(rows, one, "a", least.where(F.col("n") > hubs).select("a", "m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, hubs: int | None) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node of its neighbourhood."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "a"))
    return _told(both.where("b > a"), least, hubs).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, hubs: int | None) -> DataFrame:
    """A node's smaller neighbours, and the node, are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = _told(down, least, hubs).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` with long nodes -> ``(node, root)`` for every node that is not its component's least node.

    Self loops, repeated and reversed edges do no harm; an empty table gives an empty table.
    """
    now = table(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        each = _both(now).groupBy("a").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("b", "a") % 1_000_003).alias("y"))
        n, x, y, degree = each.agg(F.sum("n"), F.bit_xor("x"), F.sum("y"), F.max("n")).first()
        if not n or (n, x, y) == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last, limit = (n, x, y), max(n // (2 * SHARE), LEAST)
        hubs = limit if degree > limit else None
        after = table(_small_star(_large_star(now, hubs), hubs), "edges")
        drop_table(now)
        now = after
