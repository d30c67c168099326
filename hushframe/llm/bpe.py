"""Operator 2: byte-level BPE encoding and decoding with a contiguous rank array.

The vocabulary file is read once by the driver and broadcast (its size is fixed: the vocabulary).  A text is cut
at the added tokens, then into words by the usual pattern; each short word is held as its part boundaries and
the rank of each adjacent pair in two contiguous lists, which are scanned for the minimum again and again:
the boundary there goes and the ranks beside it are refreshed.  The scan is quadratic in the word's length, so words
over ``LONG`` bytes use a heap over the same linked parts, with the same result.  Encoded words are kept in a
bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.kit import map_batches

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG, CACHE, PIECE, SLOTS = 256, 400_000, 1 << 15, 1 << 18
_NONE = 1 << 60


def _slot(pair: np.ndarray) -> np.ndarray:
    return ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file (rule: printable Latin-1 stands for itself)."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class Vocabulary:
    """What encoding and decoding need from a vocabulary file: plain data, so that it can be broadcast."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: bytes([b]) for b, c in enumerate(letters)}
        as_bytes = lambda t: b"".join(back.get(c, c.encode()) for c in t) if all(c in back for c in t) else t.encode()
        self.byte_ids = [vocab[c] for c in letters]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        # a pair of ids in one integer -> (rank << 32 | id of the merged token)
        self.merges = {vocab[a] << 32 | vocab[b]: rank << 32 | vocab[a + b] for rank, (a, b) in reversed([*enumerate(merges)])}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.tokens = [b""] * size
        for t, i in vocab.items():
            self.tokens[i] = as_bytes(t)
        for t, i in self.added.items():
            self.tokens[i] = as_bytes(t)


class Codec:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.cut = regex.compile(PATTERN)
        self.added = regex.compile("|".join(regex.escape(t) for t in sorted(vocabulary.added, key=len, reverse=True))) if vocabulary.added else None
        self.crowded = re.compile(r"\s | \s| $")
        self.spaced = re.compile(r"^[^ ]+| [^ ]+").findall
        self.cache: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.byte_ids = np.array(vocabulary.byte_ids, np.int64)
        self.keys, self.values = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.int64)
        pairs = np.array([*vocabulary.merges.keys()], np.int64)
        for pair, slot, value in zip(pairs.tolist(), _slot(pairs).tolist(), vocabulary.merges.values(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & (SLOTS - 1)
            self.keys[slot], self.values[slot] = pair, value

    def learn(self, words: set[str]) -> None:
        """Put the ids of these words, as little-endian unsigned 32-bit integers, into the cache."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode()
            by_size.setdefault(len(raw), []).append((w, raw))
        for size, group in by_size.items():
            if size > LONG:
                for w, raw in group:
                    self.cache[w] = np.array(self._heap([self.v.byte_ids[b] for b in raw]), "<u4").tobytes()
                continue
            for at in range(0, len(group), PIECE):
                part = group[at : at + PIECE]
                self._scan([w for w, _ in part], self.byte_ids[np.frombuffer(b"".join(r for _, r in part), np.uint8)].reshape(len(part), size))

    def _scan(self, words: list[str], parts: np.ndarray) -> None:
        """``parts``: a row of ids for each word."""
        who = np.arange(len(words))
        ranks = self._rank(parts[:, :-1], parts[:, 1:])
        while True:
            n, width = ranks.shape
            if width:
                best = ranks.argmin(axis=1)
                found = ranks[np.arange(n), best]
                done = found == _NONE
            else:
                done = np.ones(n, bool)
            if done.any():
                blob, step = parts[done].astype("<u4").tobytes(), 4 * parts.shape[1]
                for k, i in enumerate(who[done].tolist()):
                    self.cache[words[i]] = blob[k * step : (k + 1) * step]
                going = ~done
                if not going.any():
                    return
                who, parts, ranks, best, found = who[going], parts[going], ranks[going], best[going], found[going]
                n = len(who)
            row = np.arange(n)
            parts[row, best] = found & 0xFFFFFFFF
            keep = np.ones(parts.shape, bool)
            keep[row, best + 1] = False
            parts = parts[keep].reshape(n, -1)
            keep = np.ones(ranks.shape, bool)
            keep[row, best] = False
            ranks = ranks[keep].reshape(n, -1)
            left = np.flatnonzero(best > 0)
            ranks[left, best[left] - 1] = self._rank(parts[left, best[left] - 1], parts[left, best[left]])
            right = np.flatnonzero(best < ranks.shape[1])
            ranks[right, best[right]] = self._rank(parts[right, best[right]], parts[right, best[right] + 1])

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 32 | merged id of each pair, by open addressing; ``_NONE`` where there is no merge."""
        pair = a.astype(np.int64) << 32 | b
        slot = _slot(pair)
        out = np.full(pair.shape, _NONE, np.int64)
        hit = self.keys[slot] == pair
        out[hit] = self.values[slot[hit]]
        open_ = np.nonzero(~hit & (self.keys[slot] >= 0))
        while len(open_[0]):
            slot[open_] = (slot[open_] + 1) & (SLOTS - 1)
            k = self.keys[slot[open_]]
            hit = k == pair[open_]
            got = tuple(x[hit] for x in open_)
            out[got] = self.values[slot[got]]
            open_ = tuple(x[~hit & (k >= 0)] for x in open_)
        return out

    def _heap(self, parts: list[int]) -> list[int]:
        get, n = self.v.merges.get, len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := get(a << 32 | b)) is not None]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            if (r := get(parts[i] << 32 | parts[j])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue  # a part has changed since
            parts[i], parts[j] = r & 0xFFFFFFFF, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return [p for p in parts if p is not None]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Texts whose spaces stand alone are cut at them first: a space always opens a word, so what follows it up to
        the next is encoded, and cached, as one chunk."""
        pieces: list[list] = []  # of each text: lists of chunks, and ids of added tokens
        for text in texts:
            parts, at = [], 0
            for m in self.added.finditer(text) if self.added else ():
                parts += [self._chunks(text[at : m.start()]), self.v.added[m[0]].to_bytes(4, "little")]
                at = m.end()
            pieces.append([*parts, self._chunks(text[at:] if at else text)])
        if len(self.chunks) > CACHE:
            self.chunks.clear()
        new = {c for parts in pieces for p in parts if type(p) is list for c in p}.difference(self.chunks)
        words = {c: self.cut.findall(c) for c in new}
        if len(self.cache) > CACHE:
            self.cache.clear()
        self.learn({w for ws in words.values() for w in ws}.difference(self.cache))
        cache, chunks = self.cache, self.chunks
        for c, ws in words.items():
            chunks[c] = cache[ws[0]] if len(ws) == 1 else b"".join([cache[w] for w in ws])
        return [b"".join([p if type(p) is bytes else b"".join([chunks[c] for c in p]) for p in parts]) for parts in pieces]

    def _chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if self.crowded.search(text):
            return self.cut.findall(text)
        return self.spaced(text)

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> str:
        """Token bytes joined; what is not UTF-8 becomes replacement characters."""
        tokens = self.v.tokens
        return b"".join([tokens[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


def _encoded(docs: DataFrame, path: str, one, schema: str, names: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(shared)
        texts = [x or "" for x in batch.column("text").to_pylist()]
        rows = [one(codec, x, ids) for x, ids in zip(texts, codec.encode_batch(texts), strict=True)]
        cols = [pa.array(c, pa.list_(pa.int32()) if name == "ids" else None) for name, c in zip(names, zip(*rows, strict=True), strict=True)] if rows else []
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", *names]) if rows else None

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema, rows=256)


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """One codec for each broadcast vocabulary in a worker."""
    if id(shared.value) not in _codecs:
        _codecs.clear()
        _codecs[id(shared.value)] = Codec(shared.value)
    return _codecs[id(shared.value)]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, ids array<int>)``; a null text is empty and has no ids; each row gives a row."""

    def one(codec: Codec, text: str, ids: bytes) -> tuple:
        return (np.frombuffer(ids, "<i4"),)

    return _encoded(docs, path, one, "doc_id long, ids array<int>", ["ids"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids array<int>)`` -> ``(doc_id, text)``; null ids decode to the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(shared)
        texts = [codec.decode(b"".join(i.to_bytes(4, "little") for i in ids or [])) for ids in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_batches(encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")), run, "doc_id long, text string", rows=256)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip)`` for each row: encoded, and decoded again from the ids.

    Null and empty texts have no tokens; long texts and repeated rows are like any other; other columns are ignored.
    """

    def one(codec: Codec, text: str, ids: bytes) -> tuple:
        back = codec.decode(ids)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text

    return _encoded(docs, path, one, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean", ["n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])
