"""Operator 7: sharding by vector bin packing of bytes, tokens and rows.

Rows with equal texts form a group.  Packing one by one would be serial in the number of groups, so the items
that are packed are bounded in number: a group above 1/4096 of the total is an item by itself, and is cut only
where it would fill more than half a shard; all other groups are dealt by hash into ``BINS`` items.  Items are packed on the
driver, largest first, each into the shard whose residual capacity has the highest dot product with the item's
size vector among those with room (else: with the most residual bytes).  A row's slot is its cell's offset in the
shard and its place in the cell; items are cut into cells of at most about 1/8192 of all rows for the numbering, so no task
numbers a whole shard, or a whole group of copies.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.kit import table

SHARDS, BINS, OVERHEAD = 40, 8192, 16
#: A group above 1/PIECES of all bytes or rows is packed by itself; so there are at most 2 * PIECES such groups.
PIECES = 4096


def pack(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item; ``sizes``: items x (bytes, tokens, rows)."""
    if not len(sizes):
        return np.empty(0, np.int64)
    total = np.maximum(sizes.sum(axis=0), 1)
    unit = sizes / total * shards  # a shard's capacity is 1 in each dimension
    free = np.ones((shards, sizes.shape[1]))
    out = np.empty(len(sizes), np.int64)
    for i in np.lexsort((np.arange(len(sizes)), -unit[:, 0])):
        room = free[:, 0] >= unit[i, 0]
        if room.any():
            dot = np.where(room, free @ unit[i], -np.inf)
            out[i] = int(dot.argmax())
        else:
            out[i] = int(free[:, 0].argmax())
        free[out[i]] -= unit[i]
    return out


def shard(docs: DataFrame, shards: int = SHARDS, bins: int = BINS, pieces: int = PIECES) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, size, text_crc32, n_tokens, law, shard, slot)``, one row for each row.

    The law is ``bytes``: shards have near-equal sums of ``size`` = UTF-8 bytes of the text + 16.  A null text has
    no bytes and no tokens and is grouped with the empty text; rows with a null doc_id and repeated rows are placed
    like any other; slots run from 0 without gaps in each shard; an empty table gives an empty table.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select(
        "doc_id", (F.octet_length("text") + OVERHEAD).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"), F.xxhash64("text").alias("group"),
    )
    rows = table(rows, "sizes")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    most_bytes, most_rows = max(total["bytes"] / pieces, 1.0), max(total["rows"] / pieces, 1.0)
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).where((F.col("bytes") > most_bytes) & (F.col("rows") > 1) | (F.col("rows") > most_rows))
    share = lambda of: F.greatest(F.col("bytes") / max(total["bytes"], 1), F.col("rows") / max(total["rows"], 1)) * of
    large = groups.select("group", F.ceil(share(2 * shards)).cast("int").alias("n"), F.ceil(share(2 * pieces) / F.ceil(share(2 * shards))).cast("int").alias("cells"))
    # at most 2 * pieces rows: each has a 1/pieces share of the bytes or of the rows
    named = rows.join(F.broadcast(large), "group", "left")
    chance = F.xxhash64("doc_id", "text_crc32", F.lit(7))
    item = F.when(F.col("n").isNull(), F.pmod(F.xxhash64("group", F.lit(11)), F.lit(bins))).otherwise(bins + F.abs(F.col("group") % F.lit(1 << 40)) * 4 * shards + F.pmod(chance, F.col("n")))
    cell = F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(chance, F.lit(13)), F.col("cells")))
    named = named.withColumn("item", item).withColumn("cell", cell).drop("n", "cells")
    sums = named.groupBy("item", "cell").agg(F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    # at most bins + 2 * (2 * pieces + 4 * shards) rows
    cells = sums.toPandas().sort_values(["item", "cell"]).reset_index(drop=True)
    items = cells.groupby("item", as_index=False)[["bytes", "tokens", "rows"]].sum()
    items["shard"] = pack(items[["bytes", "tokens", "rows"]].to_numpy(float), shards)
    cells = cells.merge(items[["item", "shard"]], on="item")
    cells["start"] = cells.groupby("shard")["rows"].cumsum() - cells["rows"]
    plan = cells[["item", "cell", "shard", "start"]]
    placed = docs.sparkSession.createDataFrame(plan.astype("int64") if len(plan) else pd.DataFrame({c: [] for c in plan.columns}), "item long, cell long, shard long, start long")
    within = F.row_number().over(Window.partitionBy("item", "cell").orderBy("doc_id", "text_crc32")) - 1
    out = named.withColumn("rank", within).join(F.broadcast(placed), ["item", "cell"])
    return out.select("doc_id", "size", "text_crc32", "n_tokens", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("rank")).cast("long").alias("slot"))


def spread(sizes: np.ndarray) -> float:
    """Largest sum over the mean, minus one."""
    return float(sizes.max() / sizes.mean() - 1) if len(sizes) and sizes.mean() else math.nan
