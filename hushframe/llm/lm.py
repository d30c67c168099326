"""Operator 4: language-model scores by deleted interpolation of n-gram maximum-likelihood estimates.

P(w | u) = a(b) c(u,w)/c(u) + d(b) c(w)/N + e(b) [w unknown], where b is the bucket (power of two) of the context's
frequency c(u), and the three weights of each bucket sum to one.  Every token, the end included, is the context of the
next, and the end is that of a text's first, so contexts and tokens have the same counts.  Words that training
lacks are one class, as in the base score.  The weights are learned by expectation-maximisation on held-out counts:
one fold of the training rows is deleted from the counts and predicted from the rest.  For two estimates the
E-step depends on their ratio alone, so a histogram of log ratios by bucket (bounded) is all that EM needs.

Rows are encoded once into batches of about ``BATCH`` tokens: a sorted vocabulary of word hashes and the texts as
positions in it.  A batch sends each of its distinct words and word pairs once, with its counts, packed by key range,
to the range's task, and gets the corpus totals back in the same order.  So a frequent word weighs no more
than its number of batches, nothing is broadcast, and what is moved grows with the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.kit import mix, partitions, runs, table, tables

FOLDS, DELETED, BATCH, RANGE = 10, 1, 400_000, 500_000
#: Tasks of the counting shuffle for each shuffle partition of the session, at most.
TASKS = 16
_END = b" "  # no word holds a space
_BITS = 46  # of a word pair's hash
_BIN, _LOW, _BINS = 0.02, -8.0, 1000


def _squeeze(raw: bytes) -> bytes:
    """Blobs travel compressed: small rows keep the executors' heaps small."""
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _open(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _six(keys: np.ndarray) -> bytes:
    """Sorted keys as differences in two planes: the low six bytes (random) and the high two (mostly zero)."""
    step = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    return len(keys).to_bytes(4, "little") + step[:, :6].tobytes() + _squeeze(step[:, 6:].tobytes())


def _unsix(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    step = np.empty((n, 8), np.uint8)
    step[:, :6] = np.frombuffer(raw, np.uint8, 6 * n, 4).reshape(-1, 6)
    step[:, 6:] = np.frombuffer(_open(raw[4 + 6 * n :]), np.uint8).reshape(-1, 2)
    return np.cumsum(step.view(np.uint64).ravel(), dtype=np.uint64)


def encode(docs: DataFrame) -> DataFrame:
    """Batches ``(batch, kind, ids, folds, sizes, vocab, seq)``; kind 1: rows of the deleted fold, 0: all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {0: [], 1: []}

        def flush(kind: int) -> pa.RecordBatch:
            nonlocal made
            rows, names = held[kind], {_END: 0}
            seq, sizes = [], []
            for _, _, words in rows:
                seq += [names.setdefault(w, len(names)) for w in words]
                seq.append(0)
                sizes.append(len(words) + 1)
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in names], np.uint64)
            vocab, where = np.unique(hashes, return_inverse=True)
            seq = where[np.array(seq, np.int64)].astype("<u4")
            made += 1
            out = pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | made]), pa.array([kind], pa.int32()), pa.array([[i for i, _, _ in rows]], pa.list_(pa.int64())), pa.array([[f for _, f, _ in rows]], pa.list_(pa.int32())), pa.array([sizes], pa.list_(pa.int32())), pa.array([_six(vocab)], pa.binary()), pa.array([_squeeze(seq.tobytes())], pa.binary())],
                names=["batch", "kind", "ids", "folds", "sizes", "vocab", "seq"],
            )
            held[kind] = []
            return out

        total = {0: 0, 1: 0}
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                fold = zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS
                raw = text.as_buffer() if text.is_valid else None
                words = raw.to_pybytes().lower().split() if raw else []
                kind = int(fold == DELETED)
                held[kind].append((i, fold, words))
                total[kind] += len(words) + 1
                if total[kind] >= BATCH:
                    yield flush(kind)
                    total[kind] = 0
        for kind in (0, 1):
            if held[kind]:
                yield flush(kind)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "batch long, kind int, ids array<long>, folds array<int>, sizes array<int>, vocab binary, seq binary")


class _Coded:
    """One batch, decoded."""

    def __init__(self, row: dict) -> None:
        self.kind = row["kind"]
        self.vocab, self.seq = _unsix(row["vocab"]), np.frombuffer(_open(row["seq"]), "<u4").astype(np.int64)
        self.sizes = np.array(row["sizes"], np.int64)
        self.folds = np.array(row["folds"], np.int64)
        end = int(np.searchsorted(self.vocab, np.uint64(xxhash.xxh64_intdigest(_END))))
        self.context = np.r_[end, self.seq[:-1]]  # the token before a text's first is an end
        self.train = np.repeat(self.folds != 0, self.sizes)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The batch's distinct word pairs, sorted, and each token's place among them."""
        with np.errstate(over="ignore"):
            h = mix(self.vocab[self.context] * np.uint64(0x9E3779B97F4A7C15) + (self.vocab[self.seq] ^ np.uint64(0xD6E8FEB86659FD93)))
        return np.unique(h >> np.uint64(64 - _BITS), return_inverse=True)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, in four bytes each where they fit, else in six and a little."""
    step = np.diff(keys, prepend=np.uint64(0))
    first, rest = int(step[0]), step[1:]
    if len(rest) and int(rest.max()) >= 1 << 32 and len(rest) > 64:
        return bytes([2]) + _six(keys)
    small = not len(rest) or int(rest.max()) < 1 << 32
    return bytes([small]) + first.to_bytes(8, "little") + rest.astype("<u4" if small else "<u8").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    if raw[0] == 2:
        return _unsix(raw[1:])
    rest = np.frombuffer(raw, "<u4" if raw[0] else "<u8", offset=9).astype(np.uint64)
    return np.cumsum(np.r_[np.uint64(int.from_bytes(raw[1:9], "little")), rest], dtype=np.uint64)


def _small(v: np.ndarray) -> bytes:
    """Counts in one, two, four or eight bytes each; the first byte tells."""
    top = int(v.max(initial=0))
    size = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([size]) + _squeeze(v.astype(f"<u{size}").tobytes())


def _large(raw: bytes) -> np.ndarray:
    return np.frombuffer(_open(raw[1:]), f"<u{raw[0]}").astype(np.int64)


def totals(coded: DataFrame, order: int, entries: int) -> DataFrame:
    """Corpus counts of every batch's keys: ``(batch, range, kind, train, deleted, own_new, own_sum, own_deleted)``.

    ``train`` and ``deleted`` are packed counts in the order of the batch's keys (``deleted`` for batches of the deleted
    fold only); in each range's first row, ``own_new`` is the number of keys seen in training, ``own_sum`` the training
    tokens and ``own_deleted`` those of the deleted fold.
    """
    bits = max(0, int(np.ceil(np.log2(max(entries / RANGE, 1)))))
    width = 64 if order == 1 else _BITS

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = _Coded(row := batch.slice(i, 1).to_pylist()[0])
                keys, place = (c.vocab, c.seq) if order == 1 else c.pairs()
                count = np.bincount(place[c.train], minlength=len(keys))
                of = (keys >> np.uint64(width - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                cuts = np.r_[starts, len(keys)]
                rows = [(int(of[a]), _pack(keys[a:b]), _small(count[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r for r, _, _ in rows]), pa.array([row["batch"]] * len(rows)), pa.array([c.kind] * len(rows), pa.int32()), pa.array([k for _, k, _ in rows], pa.binary()), pa.array([n for _, _, n in rows], pa.binary())],
                    names=["range", "batch", "kind", "keys", "counts"],
                )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, "range"):
            of = batch.column("range").to_numpy()
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(of)], strict=True):
                part = batch.slice(int(a), int(b - a))
                keys = [_unpack(k) for k in part.column("keys").to_pylist()]
                counts = [_large(n) for n in part.column("counts").to_pylist()]
                kinds = part.column("kind").to_pylist()
                every, place = np.unique(np.concatenate(keys), return_inverse=True)
                flat = np.concatenate(counts)
                train = np.bincount(place, flat, len(every)).astype(np.int64)
                dev = np.bincount(place, flat * np.repeat(kinds, [len(k) for k in keys]), len(every)).astype(np.int64)
                ends = np.cumsum([len(k) for k in keys])
                back = [place[e - len(k) : e] for e, k in zip(ends, keys, strict=True)]
                n = len(back)
                yield pa.RecordBatch.from_arrays(
                    [part.column("batch"), part.column("range"), part.column("kind"), pa.array([_small(train[p]) for p in back], pa.binary()), pa.array([_small(dev[p]) if k else None for p, k in zip(back, kinds, strict=True)], pa.binary()), pa.array([int((train > 0).sum())] + [0] * (n - 1)), pa.array([int(train.sum())] + [0] * (n - 1)), pa.array([int(dev.sum())] + [0] * (n - 1))],
                    names=["batch", "range", "kind", "train", "deleted", "own_new", "own_sum", "own_deleted"],
                )

    sent = coded.mapInArrow(send, "range long, batch long, kind int, keys binary, counts binary")
    # a task streams several ranges, one after the other
    dealt = sent.repartition(min(1 << bits, TASKS * partitions(coded.sparkSession)), "range").sortWithinPartitions("range", "batch")
    return table(dealt.mapInArrow(add, "batch long, range long, kind int, train binary, deleted binary, own_new long, own_sum long, own_deleted long"), f"totals{order}")


def _joined(coded: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    gather = lambda df, name: df.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("range", *(c for c in ("train", "deleted") if c in df.columns)))).alias(name))
    return coded.join(gather(one, "one"), "batch").join(gather(two, "two"), "batch")


def _counts(row: dict, name: str, of: str = "train") -> np.ndarray:
    return np.concatenate([_large(x[of]) for x in row[name]])


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.log2(np.maximum(c, 1)).astype(np.int64) + 1, 0)


def weights(joined: DataFrame, n_kept: int, rounds: int = 60) -> np.ndarray:
    """Weights (bucket x [pair, word, unknown]) by EM on the deleted fold, predicted from the other training rows."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = _Coded(row := batch.slice(i, 1).to_pylist()[0])
                k1, k2 = (_counts(row, n) - _counts(row, n, "deleted") for n in ("one", "two"))
                k2 = k2[c.pairs()[1]]
                u, w = k1[c.context], k1[c.seq]
                with np.errstate(divide="ignore"):
                    ratio = np.log10(k2 / np.maximum(u, 1)) - np.log10(np.maximum(w, 1) / max(n_kept, 1))
                # bin 0: unknown; 1: the pair is new; from 2: log ratios
                at = np.where(w == 0, 0, np.where(k2 == 0, 1, 2 + np.clip(np.nan_to_num(ratio - _LOW, neginf=0) / _BIN, 0, _BINS - 1).astype(np.int64)))
                flat, n = np.unique(_bucket(u) * (_BINS + 2) + at, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(n)], names=["cell", "n"])

    got = joined.where("kind = 1").mapInArrow(measure, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cells = np.zeros((65, _BINS + 2))
    cells.ravel()[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(float)
    ratio = 10 ** (_LOW + _BIN * (np.arange(_BINS) + 0.5))
    pooled = cells.sum(axis=0)
    start = np.array([0.3, 0.6, 0.1])

    def em(row: np.ndarray, prior: np.ndarray, weight: float) -> np.ndarray:
        lam = prior.copy()
        for _ in range(rounds):
            own = row[2:] * (lam[0] * ratio / (lam[0] * ratio + lam[1]))
            new = np.array([own.sum(), row[1] + row[2:].sum() - own.sum(), row[0]]) + weight * prior
            lam = new / new.sum()
        return lam

    whole = em(pooled, start, 1.0)
    out = np.stack([em(row, whole, 2.0) for row in cells])
    out[0] = [0.0, *(out[0][1:] / out[0][1:].sum())]  # an unseen context has no pairs
    return out


def score(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row for each row of ``docs``.

    Null and empty texts hold the end alone; rows with a null doc_id fall into the fold of the empty text; copies and
    repeated rows count and are scored each; other columns are ignored; an empty table gives an empty table.
    """
    with tables() as keep:
        return keep(table(_scored(docs), "scores"))


def _scored(docs: DataFrame) -> DataFrame:
    coded = table(encode(docs), "coded")
    tokens, words = coded.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.sum(F.octet_length("vocab") / 6)).first()
    one = totals(coded, 1, int(words or 0))
    two = totals(coded, 2, int(tokens or 0))
    v, n, deleted = (int(x or 0) for x in one.agg(F.sum("own_new"), F.sum("own_sum"), F.sum("own_deleted")).first())
    joined = _joined(coded, one.drop("deleted"), two.drop("deleted"))
    lam = weights(_joined(*(t.where("kind = 1") for t in (coded, one, two))), n - deleted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = _Coded(row := batch.slice(i, 1).to_pylist()[0])
                t1, t2 = _counts(row, "one"), _counts(row, "two")
                base = np.log10((t1 + 0.1) / (n + 0.1 * (v + 1)))[c.seq]
                u, w, k2 = t1[c.context], t1[c.seq], t2[c.pairs()[1]]
                a = lam[_bucket(u)]
                p = a[:, 0] * k2 / np.maximum(u, 1) + a[:, 1] * w / max(n, 1) + a[:, 2] * (w == 0)
                starts = np.cumsum(np.r_[0, c.sizes[:-1]])
                add = lambda x: np.add.reduceat(x, starts)
                m = len(c.sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(c.folds == 0), pa.array(c.sizes), pa.array(add((w > 0).astype(np.int64))), pa.array(np.full(m, n, np.int64)), pa.array(add(base)), pa.array(add(np.log10(p)))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return joined.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
