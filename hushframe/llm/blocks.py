"""Links inside key groups, without pairs: each group yields a spanning forest of its link graph.

Members are counted first.  A group up to ``GROUP`` members is searched in one task, breadth first, by one vectorised
comparison per visited member: at most (members - 1) links leave it.  A larger group is cut into blocks before it is dealt,
and each pair of blocks becomes a group of its own, so no task ever holds more than ``GROUP`` members at once.
No member is dropped, so the components are those of all links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.kit import partitions, runs, table

#: Members that one search takes; a larger group is cut into blocks of half this size.
GROUP = 2048


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Spanning forest of the graph whose links ``near(i, others)`` tells; ``others`` are indices not yet reached."""
    left, out = np.arange(n), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            if hit.any():
                found = left[hit].tolist()
                out += [(i, j) for j in found]
                queue += found
                left = left[~hit]
    return out


#: Groups up to this size are compared all at once, offset by offset.
SMALL = 24
#: Groups to be cut are broadcast up to this counted number; beyond it they are joined by key.
BROADCAST_GROUPS = 100_000


def _cut(rows: DataFrame, sizes: DataFrame, group: int) -> DataFrame:
    """``rows`` with every group of more than ``group`` members replaced by the pairs of its blocks."""
    many = table(sizes.where(F.col("n") > group).select("key", F.ceil(F.col("n") * 2 / F.lit(group)).cast("int").alias("blocks")), "many")
    count = many.count()
    if not count:
        return rows
    both = rows.join(F.broadcast(many) if count <= BROADCAST_GROUPS else many, "key", "left")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pair = lambda other: F.xxhash64("key", F.least(own, other), F.greatest(own, other))
    keys = F.when(F.col("blocks").isNull(), F.array("key")).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), pair))
    payload = [c for c in rows.columns if c not in ("key", "node")]
    return both.select(F.explode(keys).alias("key"), "node", *payload)


def linked(rows: DataFrame, payload: str, link: Callable[[pa.Array], list[tuple[int, int]]], pairs: Callable | None = None, group: int = GROUP, sizes: DataFrame | None = None) -> DataFrame:
    """``rows(key long, node long, <payload>)`` -> ``(a, b)``: links that give the components of all links within keys.

    ``link(payloads)`` returns the index pairs of a spanning forest of one group.  ``pairs(payloads, keys, sizes)``, where
    given, does the same at once for a whole batch of small groups, and returns links of the groups up to ``SMALL``.
    ``sizes(key, n)`` spares the counting; ``n`` may be larger than the number of members where members are large.
    """
    spark = rows.sparkSession
    rows = rows.select("key", "node", payload)
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")) if sizes is None else sizes
    least = SMALL if pairs is not None else 1

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, "key"):
            keys, nodes, data = batch.column("key").to_numpy(), batch.column("node").to_numpy(), batch.column(payload)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            counts = np.diff(np.r_[starts, len(keys)])
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            if pairs is not None:
                i, j = pairs(data, keys, np.repeat(counts, counts))
                a.append(nodes[i])
                b.append(nodes[j])
            for s, m in zip(starts[counts > least], counts[counts > least], strict=True):
                if found := link(data.slice(s, m)):
                    i, j = np.array(found).T
                    a.append(nodes[s + i])
                    b.append(nodes[s + j])
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                lo, hi = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], names=["a", "b"])

    dealt = _cut(rows, sizes, group).repartition(partitions(spark), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(search, "a long, b long")
