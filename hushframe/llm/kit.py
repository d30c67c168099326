"""Plumbing shared by the operators: checkpoint tables, Arrow batches, byte words, fold numbers, key runs.

Words are maximal runs of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``), which is exactly
what ``bytes.split()`` yields.  A null text is an empty text.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own_dirs: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; a temp folder only in local mode without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="tables-")
    return _own_dirs[app]


#: Tables written in the running ``tables()`` block.
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def table(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here and survives lost executors.

    Spark deletes the shuffle files of finished jobs when the driver's garbage is collected, which a long chain of jobs with little
    on the driver may not see for long; ``release`` asks for it, once the table stands and needs them no more.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.table_path = path
    if (made := _made.get()) is not None:
        made.append(back)
    if release:
        spark._jvm.System.gc()
    return back


def drop_table(df: DataFrame) -> None:
    """Delete a table of ``table()`` that no later plan reads."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df.table_path)
    path.getFileSystem(conf).delete(path, True)


@contextmanager
def tables() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Intermediate tables of the block are deleted at its end, but for those handed to the function it gives.

    What is kept belongs to the block around it, if there is one.
    """
    made: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    token = _made.set(made)
    try:
        yield keep
    finally:
        _made.reset(token)
        paths = {df.table_path for df in kept}
        for df in made:
            if df.table_path not in paths:
                drop_table(df)
        if (outer := _made.get()) is not None:
            outer += kept


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` is called so (letters' case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def spread_join(rows: DataFrame, one: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``rows`` joined with ``one`` (a row for each key), without all rows of a frequent key in one task.

    ``hot`` is the part of ``one`` whose keys have many rows; the caller bounds its size, so it is broadcast.
    """
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(one, key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType, rows: int = 512) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows, so that a worker holds few texts at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                if (out := fn(batch.slice(at, rows))) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def fold(doc_id, folds: int):
    """crc32 of the doc_id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash for each window of ``k`` consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return mix(out)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Cut a stream that is sorted by ``key`` into batches that never split a run of equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        if held and held[-1].column(key)[held[-1].num_rows - 1] != keys[0]:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        k = keys.to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1]))
        if cut:
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
