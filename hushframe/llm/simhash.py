"""Operator 6: SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes.  Two fingerprints at most four bits apart differ in at most four of them, so the
guaranteed minimum of shared positional bytes is four.  Each fingerprint is posted under its single positional bytes; within
a posting list the shared bytes of each pair are tallied, pairs below the minimum are ruled out, and the others are verified by
their exact distance.  Of five positions a pair with four shared bytes of eight shares one at least, so the
first five positions are posted.  A byte has 256 values: where the lists would hold more than ``LIST`` fingerprints on the
average, they are split by a second shared position, a third, and a fourth at most (of the four that any pair shares), which loses
no pair; a list that is long all the same is cut into blocks (``blocks.linked``).

Equal fingerprints are one node, so copies cost nothing.  Lists yield spanning forests, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.llm.blocks import SMALL, forest, linked
from hushframe.llm.components import components
from hushframe.llm.kit import map_batches, spread_join, table, tables, texts_of, unused

SHINGLE, BITS, SEED = 4, 4, 42
#: Average length of a posting list, beyond which the lists are split by one more position.
LIST = 2048
#: A fingerprint with more than 1/SHARE of the documents is hot; there are at most SHARE of them.
SHARE = 1000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of the word shingles of one text, repeats included; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # long texts in slices
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(at, min(n, at + 65536))], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp)``; ``fp`` is the fingerprint's bits as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(x, shingle) for x in texts_of(batch.column("text"))], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fp long")


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the eight positional bytes are equal: each byte of the difference is folded to its top bit."""
    low, top = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
    d = a ^ b
    return 8 - np.bitwise_count((((d & low) + low) | d) & top)


def depth_of(points: int, need: int, most: int = LIST) -> int:
    """Positions that a posting names, for lists of at most ``most`` of uniform fingerprints on the average."""
    depth = 1
    while depth < need and points > most * 256**depth:
        depth += 1
    return depth


def postings(points: DataFrame, need: int, depth: int) -> DataFrame:
    """``points(node, fp)`` -> ``(node, fp, key)``: a row for each ascending choice of ``depth`` positions that can begin ``need`` shared ones."""
    choices = [c for c in combinations(range(8), depth) if c[-1] < 8 - need + depth]
    masks = [sum(0xFF << (8 * p) for p in c) for c in choices]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
    return points.select("node", "fp", F.explode(keys).alias("key"))


def near_links(points: DataFrame, bits: int = BITS, most: int = LIST) -> DataFrame:
    """``points(node, fp)`` with distinct ``fp`` -> links ``(a, b)`` with the components of all pairs within ``bits`` bits."""
    need = 8 - bits
    if not 1 <= need <= 7:
        raise ValueError("bits must be 1 to 7")
    posted = postings(points, need, depth_of(points.count(), need, most))

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The tally, the count filter, then the exact distance."""
        ok = shared_bytes(x, y) >= need
        ok[ok] = np.bitwise_count(x[ok] ^ y[ok]) <= bits
        return ok

    def link(data: pa.Array) -> list[tuple[int, int]]:
        v = data.to_numpy().view(np.uint64)
        return forest(len(v), lambda i, rest: near(np.full(len(rest), v[i]), v[rest]))

    def pairs(data: pa.Array, keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = data.to_numpy().view(np.uint64)
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        at = np.flatnonzero((sizes > 1) & (sizes <= SMALL))
        for d in range(1, SMALL):
            at = at[at + d < len(v)]
            at = at[keys[at] == keys[at + d]]
            if not len(at):
                break
            hit = at[near(v[at], v[at + d])]
            left.append(hit)
            right.append(hit + d)
        return np.concatenate(left), np.concatenate(right)

    return linked(posted, "fp", link, pairs)


def near_duplicates(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, fp, component_id)``, one row for each row of ``docs``.

    Null and empty texts have fingerprint zero and are linked like any other.  Rows with a null doc_id take part: they can join
    other documents, and have the component of their fingerprint (null, if no row of it has a doc_id).  Repeated rows
    stay; an empty table gives an empty table; other columns are ignored, whatever their names.
    """
    with tables() as keep:
        rows = keep(table(fingerprints(docs, shingle), "fingerprints"))
        points = table(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "points")
        roots = components(near_links(points.select(F.col("fp").alias("node"), "fp"), bits))
        named = points.join(roots, points["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
        named = table(named, "named")
        firsts = named.groupBy("root").agg(F.min("first").alias("component_id"))
        of = keep(table(named.join(firsts, "root").select("fp", "component_id", "n"), "components"))
    total = of.agg(F.sum("n")).first()[0] or 0
    hot = of.where(F.col("n") > max(total // SHARE, 1)).select("fp", "component_id")  # at most SHARE rows
    return spread_join(rows, of.select("fp", "component_id"), "fp", hot).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component; rows with a null doc_id stay.

    Of a repeated doc_id one row stays: the least by text, then by the other columns in their order (those of a type that has an
    order).  Nulls come first.  Columns may have any names; an empty table gives an empty table.
    """
    doc, count, picked = unused(docs, "doc", "rows", "picked")
    with tables() as keep:
        found = near_duplicates(docs, bits, shingle).where("doc_id is not null")
        own = found.groupBy(F.col("doc_id").alias(doc)).agg(F.min("component_id").alias("component_id"), F.count("*").alias(count))
        own = keep(table(own.where(F.col(doc) == F.col("component_id")).select(doc, count), "kept"))
    # one plan at every size: the ids are merged with the documents, which are dealt once for both uses
    both = docs.join(own.hint("merge"), docs["doc_id"].cast("long") == F.col(doc))
    once = both.where(F.col(count) == 1).select(*docs.columns)
    whole, order = F.struct(*docs.columns), [f.name for f in docs.schema.fields if _ordered(f.dataType)]
    order = F.struct("text", *[n for n in order if n != "text"])
    more = both.where(F.col(count) > 1).groupBy(doc).agg(F.min_by(whole, order).alias(picked)).select(f"{picked}.*")
    return once.unionByName(more).unionByName(docs.where(docs["doc_id"].cast("long").isNull()))


def _ordered(t: T.DataType) -> bool:
    """Whether values of the type can be compared."""
    if isinstance(t, T.ArrayType):
        return _ordered(t.elementType)
    if isinstance(t, T.StructType):
        return all(_ordered(f.dataType) for f in t.fields)
    return isinstance(t, T.AtomicType) and not isinstance(t, T.VariantType)
