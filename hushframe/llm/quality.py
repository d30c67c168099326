"""Operator 10: quality rules - gradient-boosted trees over document statistics.

The trees learn ``labels.quality`` on a bounded sample of labelled rows (``SAMPLE`` rows of least hashed
doc_id, an exact, order-free choice), are flattened into node arrays and score batches at once.  More symbols, repeated
lines, repeated words or upper case never raise the score (monotonic constraints).  Base rules come first.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.kit import fold, map_batches
from hushframe.llm.trees import Nodes, boost

SAMPLE, FOLDS, WINDOW, KEEP = 12_000, 5, 5, 0.35
#: Statistics, in the order of the feature vector.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word", "symbol_rate", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "letter_share", "top_word_share", "line_words", "pipe_rate", "bang_rate", "long_word_share", "digit_share")
#: +1: more is better; -1: more is worse.
MONOTONE = {"symbol_rate": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "top_word_share": -1, "pipe_rate": -1, "bang_rate": -1, "distinct_share": 1}


def statistics(text: bytes) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """The base counts and the feature vector of one whole text."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = n_chars(joined)
    symbols = len(joined) - len(joined.translate(None, b"#*$%&|<>"))
    lines, seen, dup = text.split(b"\n"), set(), 0
    full = 0
    for line in lines:
        if line and not line.isspace() and line.split():
            full += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = n_repeat(words)
    ids: dict[bytes, int] = {}
    for w in words:
        ids[w] = ids.get(w, 0) + 1
    letters = n_letters(joined)
    upper = len(joined) - len(joined.translate(None, _ASCII_UPPER))
    d, c = max(n, 1), max(chars, 1)
    x = [
        float(np.log1p(n)), chars / d, symbols / c, dup / max(full, 1), repeat / d, len(ids) / d, upper / max(letters, 1), letters / c,
        max(ids.values(), default=0) / d, n / max(full, 1), joined.count(b"|") / d, joined.count(b"!") / d, sum(v for w, v in ids.items() if len(w) > 20) / d,
        (len(joined) - len(joined.translate(None, b"0123456789"))) / c,
    ]
    return (n, chars, symbols, dup, repeat), x


_ASCII_UPPER = bytes(range(65, 91))
_ASCII_LETTERS = _ASCII_UPPER + bytes(range(97, 123))
_ASCII = bytes(range(0x80))
_CONT = bytes(range(0x80, 0xC0))
_no_letters = re.compile(r"[\W\d_]+")


def n_letters(raw: bytes) -> int:
    """Letters of any script in UTF-8 bytes; only what is not ASCII is decoded."""
    wide = raw.translate(None, _ASCII)
    return len(raw) - len(raw.translate(None, _ASCII_LETTERS)) + (len(_no_letters.sub("", wide.decode())) if wide else 0)


def n_chars(raw: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(raw.translate(None, _CONT))


def n_repeat(words: list[bytes], k: int = WINDOW) -> int:
    """Words inside a k-word window that occurs twice or more in the text, the first included.

    Windows are told apart by exact integer names: each word has a number, and each run of two parts a number.
    """
    if len(words) <= k:
        return 0
    ids: dict[bytes, int] = {}
    name = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    if len(ids) == len(words):
        return 0
    # pairs, then fours, then fives, each renumbered densely: no hashing
    two = _dense(name[:-1], name[1:])
    four = _dense(two[:-2], two[2:])
    five = _dense(four[:-1], name[4:])
    hit = np.bincount(five)[five] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]


def base_failed(n: np.ndarray, repeat: np.ndarray) -> np.ndarray:
    return (n < 10) | (100 * repeat > 20 * n)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> Nodes | None:
    """Trees from at most ``sample`` labelled rows outside fold 0 (null labels and ids are left out); None without labels."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    ids = ids.where(fold(F.col("doc_id"), folds) != 0).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [statistics(t or b"")[1] for t in batch.column("text").cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    got = map_batches(rows, run, "doc_id long, quality int, x array<double>").toPandas().sort_values("doc_id")
    if not len(got):
        return None
    x = np.stack(got["x"].to_numpy())
    return boost(x, got["quality"].to_numpy(float), {FEATURES.index(k): v for k, v in MONOTONE.items()})


def assess(docs: DataFrame, labels: DataFrame, keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept)`` for each row.

    A null text is empty, which fails the base rules; without labels, the base rules alone decide; rows with a
    null doc_id are scored too; repeated rows give equal rows; other columns are ignored.
    """
    model = learn(docs, labels, sample)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not batch.num_rows:
            return None
        got = [statistics(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
        base, x = np.array([b for b, _ in got], np.int64), np.array([f for _, f in got])
        failed = base_failed(base[:, 0], base[:, 4])
        score = 1 / (1 + np.exp(-model.score(x))) if model else np.ones(len(x))
        cols = [pa.array(np.ascontiguousarray(c)) for c in base.T]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols, pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep))], names=["doc_id", *STATS, "base_failed", "score", "kept"])

    schema = "doc_id long, " + ", ".join(f"{s} long" for s in STATS) + ", base_failed boolean, score double, kept boolean"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


def keep_rows(docs: DataFrame, labels: DataFrame, keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged; decided row by row, so nothing is joined.

    Null and empty texts fail the base rules and go; rows with a null doc_id are judged like any other; repeated rows share one
    fate; columns may have any names; an empty table gives an empty table; without labels the base rules alone decide.
    """
    model = learn(docs, labels, sample)
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not batch.num_rows:
            return None
        got = [statistics(t or b"") for t in batch.column(at).cast(pa.string()).cast(pa.binary()).to_pylist()]
        base, x = np.array([b for b, _ in got], np.int64), np.array([f for _, f in got])
        ok = ~base_failed(base[:, 0], base[:, 4])
        if model:
            ok &= 1 / (1 + np.exp(-model.score(x))) >= keep
        return batch.filter(pa.array(ok))

    return map_batches(docs, run, docs.schema)
