"""Operator 5: substring dedup by paragraph MinHash banding.

Paragraphs are lines of ``min_words`` words or more, and runs of shorter lines, without a blank line between, that reach this
together; all are lower-cased (A-Z).  Twenty-four minima of the hashed five-word shingles form eight bands of three: a
pair at the threshold 0.8 is missed with probability (1 - 0.8**3)**8 = 0.3 %, and equal paragraphs never.  Paragraphs that
collide in a band are searched for exact Jaccard similarity of at least the threshold, band by band (``blocks.linked``); the
verified links alone make the components, and all paragraphs of one component but its first go.

A passage may also stand inside a longer line.  For that, the minimiser of every 20 consecutive positions
opens a virtual paragraph of 32 words (any passage of 51 words or more holds one, whatever surrounds it).
Those have J = 1 only, so their single band is the hash of the whole (96 bits), and the first document keeps them.
A removed window is a seed: it is stretched word by word, left and right, as far as document and keeper agree;
out of its line only where they agree on 51 words or more.
A line of which four fifths are covered by removed spans goes entirely.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.llm.blocks import forest, linked
from hushframe.llm.components import components
from hushframe.llm.kit import drop_table, map_batches, mix, spread_join, table, tables, texts_of, unused, window_hashes

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 8, 3
MIN_WORDS, WINDOW, SPACING, COVER = 25, 32, 20, 0.8
#: Members of a search of sets; words of a paragraph that counts as two members; a band key with more than 1/HOT of all postings
#: is hot, and none with up to LEAST.
GROUP, LONG, HOT, LEAST = 512, 128, 1000, 4096

_seeds = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and where each line's words start (the last entry: the number of words)."""
    seen: dict[bytes, int] = {}
    ids, starts = [], [0]
    for line in text.lower().split(b"\n"):
        ids += [seen.setdefault(w, len(seen)) for w in line.split()]
        starts.append(len(ids))
    own = np.array([xxhash.xxh64_intdigest(w) for w in seen], np.uint64)
    return (own[np.array(ids, np.int64)] if ids else np.empty(0, np.uint64)), np.array(starts, np.int64)


def shingles(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a paragraph; fewer words than ``k``: one of the whole sequence."""
    return np.unique(window_hashes(h, min(k, len(h)))) if len(h) else np.empty(0, np.uint64)


def bands(sh: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Band keys (paragraphs x BANDS) of shingle hashes ``sh`` that start at ``of`` for each paragraph."""
    out = np.empty((len(of), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(of), b, np.uint64)
        for r in range(ROWS):
            x = (sh ^ _seeds[b * ROWS + r]) * np.uint64(0xFF51AFD7ED558CCD)
            x ^= x >> np.uint64(32)
            key = mix(key * np.uint64(31) + np.minimum.reduceat(x, of))
        out[:, b] = key
    return out


def minimisers(v: np.ndarray, spacing: int, of: np.ndarray) -> np.ndarray:
    """Positions of the leftmost minimum of every ``spacing`` consecutive values of one text (``of``, ascending); of all its values, where there are fewer."""
    if not len(v):
        return np.empty(0, np.int64)
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    sizes = np.diff(np.r_[starts, len(v)])
    few = [s + int(v[s : s + n].argmin()) for s, n in zip(starts[sizes < spacing], sizes[sizes < spacing], strict=True)]
    if len(v) < spacing:
        return np.unique(few)
    inside = np.flatnonzero(of[: len(v) - spacing + 1] == of[spacing - 1 :])
    found = np.lib.stride_tricks.sliding_window_view(v, spacing).argmin(axis=1)[inside] + inside
    return np.unique(np.r_[found, np.array(few, np.int64)])


def units(docs: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW, spacing: int = SPACING) -> DataFrame:
    """``(doc_id, start, words, whole, uid, more, bands)``: paragraphs with their bands, and virtual paragraphs without.

    ``uid`` and ``more`` are 96 bits of hash of the words: rows that have both in common are equal.
    """
    least = max(min_words, SHINGLE)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        """All texts of a batch at once: positions are those of one long sequence of words, kept inside lines and texts."""
        seen: dict[bytes, int] = {}
        ids, first, starts, sizes, of = [], [], [], [], []
        for i, text in enumerate(texts_of(batch.column("text"))):
            first.append(len(ids))
            run = len(ids)  # where the run of short lines before this place begins
            for line in [*text.lower().split(b"\n"), b""]:
                begin = len(ids)
                ids += [seen.setdefault(w, len(seen)) for w in line.split()]
                if begin < len(ids) < begin + least:
                    continue
                for start, end in ((run, begin), (begin, len(ids))):
                    if end - start >= least:
                        starts.append(start)
                        sizes.append(end - start)
                        of.append(i)
                run = len(ids)
        if not ids:
            return None
        h = np.array([xxhash.xxh64_intdigest(w) for w in seen], np.uint64)[np.array(ids, np.int64)]
        first, start, size, of = np.array([*first, len(ids)]), np.array(starts, np.int64), np.array(sizes, np.int64), np.array(of, np.int64)
        doc, at, keys, uid, more = [of], [start], np.empty((0, BANDS), np.uint64), [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        if len(start):
            n = size - SHINGLE + 1
            head = np.cumsum(n) - n
            step = np.arange(n.sum()) - np.repeat(head, n)
            sh = window_hashes(h, SHINGLE)[np.repeat(start, n) + step]
            keys = bands(sh, head)
            order = mix(sh + step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            uid.append(mix(np.add.reduceat(order, head) + size.astype(np.uint64)))
            more.append(mix(np.bitwise_xor.reduceat(mix(order * np.uint64(0xD6E8FEB86659FD93)), head)))
        room = np.maximum(np.diff(first) - window + 1, 0)
        if room.any():
            text_of = np.repeat(np.arange(len(room)), room)
            place = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room) + np.repeat(first[:-1], room)
            anchors = place[minimisers(mix(window_hashes(h, 4)[place]), spacing, text_of)]
            doc.append(np.searchsorted(first, anchors, side="right") - 1)
            at.append(anchors)
            uid.append(window_hashes_at(h, anchors, window))
            more.append(window_hashes_at(h[::-1], len(h) - window - anchors, window))
        doc, at, uid, more = np.concatenate(doc), np.concatenate(at), np.concatenate(uid), np.concatenate(more)
        lines = len(start)
        whole = np.arange(len(doc)) < lines
        words = np.where(whole, np.r_[size, np.zeros(len(doc) - lines, np.int64)], window)
        offsets = np.r_[np.arange(lines + 1) * BANDS, np.full(len(doc) - lines, lines * BANDS)].astype(np.int32)
        columns = [batch.column("doc_id").take(pa.array(doc)), pa.array((at - first[doc]).astype(np.int32)), pa.array(words.astype(np.int32)), pa.array(whole), pa.array(uid.view(np.int64)), pa.array((more >> np.uint64(32)).astype(np.uint32).view(np.int32))]
        columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).ravel())))
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "words", "whole", "uid", "more", "bands"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, start int, words int, whole boolean, uid long, more int, bands array<long>", rows=256)


def window_hashes_at(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """``window_hashes(h, k)[at]`` without the rest."""
    out = np.zeros(len(at), np.uint64)
    for i in range(k):
        out = (out ^ h[at + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out)


def jaccard_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Spanning forest of the sets linked by exact Jaccard similarity; sizes rule most others out."""
    size = np.array([len(s) for s in sets])

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        hit = np.minimum(size[rest], size[i]) >= similarity * np.maximum(size[rest], size[i])
        at = np.flatnonzero(hit)
        if len(at):
            flat = np.concatenate([sets[j] for j in rest[at]])
            inside = sets[i][np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)] == flat
            both = np.add.reduceat(inside, np.r_[0, np.cumsum(size[rest[at]])[:-1]], dtype=np.int64)
            hit[at] = both >= similarity * (size[i] + size[rest[at]] - both) - 1e-9
        return hit

    return forest(len(sets), near)


def paragraph_classes(docs: DataFrame, lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``lines(uid, first)``, distinct -> ``(uid, root)`` for paragraphs that are near another; nodes are uids."""
    posted = lines.select("uid", F.greatest(F.lit(1), F.col("first.words") / LONG).alias("weight"), F.explode("first.bands").alias("key"))
    sizes = table(posted.groupBy("key").agg(F.count("*").alias("rows"), F.sum("weight").alias("n")).where("rows > 1"), "sizes", release=True)
    total, most = sizes.agg(F.sum("rows"), F.max("rows")).first()
    limit, keyed = max((total or 0) // HOT, LEAST), posted.select("uid", "key")
    hot = sizes.where(F.col("rows") > limit).select("key")  # at most HOT rows
    met = spread_join(keyed, sizes.select("key"), "key", hot) if (most or 0) > limit else keyed.join(sizes.select("key"), "key")
    keys = met.groupBy("uid").agg(F.collect_list("key").alias("keys"))  # at most one for each band
    where = keys.join(lines.select("uid", "first"), "uid").select(F.col("first.doc_id").alias("doc_id"), F.struct("uid", "keys", "first.start", "first.words").alias("wanted"))
    wanted = where.groupBy("doc_id").agg(F.collect_list("wanted").alias("wanted"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(wanted.hint("merge"), "doc_id")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        key, node, sets = [], [], []
        for text, wanted in zip(texts_of(batch.column("text")), batch.column("wanted").to_pylist(), strict=True):
            h, _ = words_of(text)
            for w in wanted:
                own = shingles(h[w["start"] : w["start"] + w["words"]]).view(np.int64)
                key += w["keys"]
                node += [w["uid"]] * len(w["keys"])
                sets += [own] * len(w["keys"])
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(node, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["key", "node", "sets"]) if key else None

    def link(data: pa.Array) -> list[tuple[int, int]]:
        return jaccard_forest([np.sort(x.values.to_numpy().view(np.uint64)) for x in data], similarity)

    rows = map_batches(texts, run, "key long, node long, sets array<long>", rows=64)
    links = table(linked(rows, "sets", link, group=GROUP, sizes=sizes.select("key", "n")), "links", release=True)
    return components(links).select(F.col("node").alias("uid"), "root")


def removals(docs: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, window: int = WINDOW, spacing: int = SPACING) -> DataFrame:
    """``(doc_id, keeper, start, words)``: word spans of each document that an earlier place, in document ``keeper``, holds.

    A span within a single document (a paragraph repeated in it) counts for paragraphs, not for virtual ones.
    Order is by (doc_id, start).  Rows that repeat a doc_id with the same text are one document here.  A doc_id with different texts
    (null is empty) names no place, so it neither keeps nor loses anything; nor does a null doc_id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    with tables() as keep:
        repeated = table(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")  # reads no text
        if not repeated.isEmpty():
            digest, some = F.xxhash64("text"), docs.join(repeated.hint("merge"), "doc_id", "left_semi")
            unclear = table(some.groupBy("doc_id").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).where("a <> b").select("doc_id"), "unclear")
            docs = docs.join(unclear.hint("merge"), "doc_id", "left_anti")
        all_units = table(units(docs, min_words, window, spacing), "units")
        same = ["uid", "more"]
        lines = all_units.where("whole").groupBy(*same).agg(F.min(F.struct("doc_id", "start", "words", "bands")).alias("first"), F.count("*").alias("n"))
        lines = table(lines, "lines", release=True)
        windows = all_units.where("not whole").groupBy(*same).agg(F.min(F.struct("doc_id", "start", "words")).alias("keep"), F.count("*").alias("n"))
        near = paragraph_classes(docs, lines, similarity)
        # members of classes, and paragraphs that occur more than once
        member = near.unionByName(near.select(F.col("root").alias("uid"), "root").distinct())
        named = lines.join(member, "uid", "left").where("root is not null or n > 1")
        named = table(named.select(*same, F.coalesce("root", "uid").alias("root"), F.struct("first.doc_id", "first.start", "first.words").alias("first")), "named", release=True)
        kept = named.groupBy("root").agg(F.min("first").alias("keep"), F.count("*").alias("members"))
        total, most = kept.agg(F.sum("members"), F.max("members")).first()
        limit = max((total or 0) // HOT, LEAST)
        hot = kept.where(F.col("members") > limit).select("root", "keep")  # at most HOT rows
        kept = spread_join(named, kept.select("root", "keep"), "root", hot) if (most or 0) > limit else named.join(kept, "root")
        kept = kept.select(F.lit(True).alias("whole"), *same, "keep").unionByName(windows.where("n > 1").select(F.lit(False).alias("whole"), *same, "keep"))
        spans = all_units.drop("bands").join(kept, ["whole", *same])
        other = F.when(F.col("whole"), (F.col("doc_id") != F.col("keep.doc_id")) | (F.col("start") != F.col("keep.start"))).otherwise(F.col("doc_id") != F.col("keep.doc_id"))
        hits = table(spans.where(other).select("whole", "doc_id", F.col("keep.doc_id").alias("keeper"), F.col("keep.start").alias("source"), "start", "words"), "hits", release=True)
        for done in (all_units, lines, named):  # the largest tables; stretching reads the texts
            drop_table(done)
        beside = stretched(docs, hits.where("not whole").select("doc_id", "keeper", "source", "start"), window, spacing)
        return keep(table(hits.select("doc_id", "keeper", "start", "words").unionByName(beside), "removals", release=True))


def stretched(docs: DataFrame, seeds: DataFrame, window: int = WINDOW, spacing: int = SPACING) -> DataFrame:
    """``seeds(doc_id, keeper, source, start)``: equal windows -> ``(doc_id, keeper, start, words)``: the equal words beside them.

    Less than ``spacing`` words on each side are compared: a longer stretch holds an anchor that both documents have,
    so another seed.  Where such a seed of the same keeper adjoins, its own stretch goes on from there.  A passage of less
    than ``window + spacing - 1`` words is not stretched beyond the line: short lines beside a repeated one stay.  Words are told
    apart by 32 bits of hash here: one word in four billion is taken for the keeper's.
    """
    row = Window.partitionBy("doc_id", "keeper", F.col("start") - F.col("source")).orderBy("start")
    edges = seeds.select("*", F.coalesce(F.lag("start").over(row) + window < F.col("start"), F.lit(True)).alias("left"), F.coalesce(F.lead("start").over(row) > F.col("start") + window, F.lit(True)).alias("right"))
    edges = table(edges.where("left or right"), "edges", release=True)
    places = edges.select("doc_id", "start").unionByName(edges.select(F.col("keeper").alias("doc_id"), F.col("source").alias("start"))).distinct()
    wanted = places.groupBy("doc_id").agg(F.collect_list("start").alias("wanted"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(wanted.hint("merge"), "doc_id")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        doc, at, before, after, room = [], [], [], [], []
        for i, text, wanted in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), batch.column("wanted").to_pylist(), strict=True):
            h, lines = words_of(text)
            h = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
            for s in wanted:
                doc.append(i)
                at.append(s)
                before.append(h[max(s - spacing + 1, 0) : s][::-1])
                after.append(h[s + window : s + window + spacing - 1])
                first, last = np.minimum(np.searchsorted(lines, [s, s + window - 1], side="right"), len(lines) - 1)
                room.append((s - int(lines[first - 1]), int(lines[last]) - s - window))
        words = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(before, words), pa.array(after, words), pa.array([x for x, _ in room], pa.int32()), pa.array([x for _, x in room], pa.int32())], names=["doc_id", "start", "before", "after", "line_before", "line_after"]) if doc else None

    around = table(map_batches(texts, run, "doc_id long, start int, before array<int>, after array<int>, line_before int, line_after int", rows=64).dropDuplicates(["doc_id", "start"]), "around", release=True)
    kept = around.select(F.col("doc_id").alias("keeper"), F.col("start").alias("source"), F.col("before").alias("kept_before"), F.col("after").alias("kept_after"))
    both = edges.join(around, ["doc_id", "start"]).join(kept, ["keeper", "source"])

    def agreed(a: str, b: str):
        same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
        first = F.array_position(same, False)
        return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")

    agree = both.select("doc_id", "keeper", "source", "start", "line_before", "line_after", F.when(F.col("left"), agreed("before", "kept_before")).alias("l"), F.when(F.col("right"), agreed("after", "kept_after")).alias("r"))
    begin = F.last(F.col("start") - F.col("l"), ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, 0))
    end = F.first(F.col("start") + window + F.col("r"), ignorenulls=True).over(row.rowsBetween(0, Window.unboundedFollowing))
    long = F.col("end") - F.col("begin") >= window + spacing - 1
    sized = agree.withColumn("begin", begin).withColumn("end", end)
    sized = sized.select("doc_id", "keeper", "start", *(F.when(F.col(n).isNotNull() & ~long, F.least(n, line)).otherwise(F.col(n)).alias(n) for n, line in (("l", "line_before"), ("r", "line_after"))))
    sides = F.array(F.struct((F.col("start") - F.col("l")).alias("start"), F.col("l").alias("words")), F.struct((F.col("start") + window).alias("start"), F.col("r").alias("words")))
    return sized.select("doc_id", "keeper", F.inline(sides)).where("words > 0")


_word = re.compile(rb"[^\x20\x09-\x0D]+")


def cut(text: str, spans: list[tuple[int, int]], cover: float = COVER) -> tuple[str, int]:
    """The text without the word spans (start, words), and how many words went.

    Lines that are covered go with their line end.  What stays keeps its white space; a removed stretch takes the white space
    after it along (at the end of a line: before it).
    """
    merged: list[list[int]] = []
    for start, words in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], start + words)
        else:
            merged.append([start, start + words])
    out, at, went, k = [], 0, 0, 0
    for line in text.encode().split(b"\n"):
        begin, size = at, len(line.split())
        at += size
        while k < len(merged) and merged[k][1] <= begin:
            k += 1
        own = [(max(a, begin) - begin, min(b, at) - begin) for a, b in _within(merged, k, at)]
        n = sum(b - a for a, b in own)
        if not n:
            out.append(line)
        elif n >= cover * size:
            went += size
        else:
            went += n
            out.append(_without(line, own))
    return b"\n".join(out).decode(), went


def _within(merged: list[list[int]], k: int, end: int) -> Iterator[list[int]]:
    while k < len(merged) and merged[k][0] < end:
        yield merged[k]
        k += 1


def _without(line: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A line without some of its words."""
    places = [m.span() for m in _word.finditer(line)]
    left, from_ = [], 0
    for a, b in spans:
        left.append(line[from_ : places[a][0]])
        from_ = places[b][0] if b < len(places) else len(line)
    left.append(line[from_:])
    kept = b"".join(left)
    return kept.rstrip(b" \t\r\x0b\x0c") if spans[-1][1] == len(places) else kept


def dedup_passages(docs: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, window: int = WINDOW, spacing: int = SPACING, keepers: str = "_keepers", words_cut: str = "_words_cut") -> DataFrame:
    """``docs`` with ``text`` cut, plus ``keepers`` (array of doc_ids, null: none) and ``words_cut``; one row for each row.

    Null and empty texts, and rows with a null doc_id, pass through uncut.  Rows that repeat a doc_id are cut alike, if their
    texts are equal, and not at all otherwise.  Other columns are kept as they are, whatever their names; one that is called like a
    result column is replaced by it.  An empty table gives an empty table.
    """
    docs = docs.drop(keepers, words_cut)
    doc, places = unused(docs, "doc", "spans")
    with tables() as keep:
        found = removals(docs, similarity, min_words, window, spacing)
        per = found.groupBy(F.col("doc_id").alias(doc)).agg(F.sort_array(F.collect_set("keeper")).alias(keepers), F.collect_set(F.struct("start", "words")).alias(places))
        per = keep(table(per, "spans", release=True))
    both = docs.join(per.hint("merge"), docs["doc_id"].cast("long") == F.col(doc), "left").drop(doc)
    names = both.columns
    at = names.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = batch.column(names.index(places))
        rows = np.flatnonzero(pc.and_(spans.is_valid(), batch.column(at).is_valid()).to_numpy(zero_copy_only=False))
        counts = np.zeros(batch.num_rows, np.int64)
        cols = [batch.column(i) for i, n in enumerate(names) if n != places]
        if len(rows):  # texts without spans are handed on as they are
            some = pa.array(rows)
            done = [cut(t, [(x["start"], x["words"]) for x in s]) for t, s in zip(batch.column(at).take(some).to_pylist(), spans.take(some).to_pylist(), strict=True)]
            counts[rows] = [n for _, n in done]
            mask = np.zeros(batch.num_rows, bool)
            mask[rows] = True
            cols[at] = pc.replace_with_mask(cols[at], pa.array(mask), pa.array([t for t, _ in done], cols[at].type))
        return pa.RecordBatch.from_arrays([*cols, pa.array(counts)], names=[*(n for n in names if n != places), words_cut])

    schema = T.StructType([f for f in both.schema if f.name != places]).add(words_cut, "long")
    return map_batches(both, run, schema, rows=256)
