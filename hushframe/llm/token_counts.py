"""Operator 1: token counts as delta-maintained rollups by source, language and tokenizer version.

Changes arrive in batches: an insert adds a row's count, a delete takes it away, a revision takes the old count and adds
the new one.  A batch is reduced to signed sums for each key (combined before the shuffle), written aside, and becomes part
of the rollup by one log entry.  Entries are numbered, and a number can be taken once only (a rename that never overwrites),
so of several writers one goes first and the others read the log again.  A batch whose name is in the log is never added
again.  ``compact`` folds exactly the entries it has read into one table and says so in an entry of its own: a batch committed
meanwhile has a later number and still counts by itself.  ``vacuum`` removes what has been folded and leaves an empty
file under each batch's name, so names are looked up, never listed or collected.

Totals are exact at every point and cost a batch's rows, not the corpus.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
CHANGES = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"


def count_words(text: Column) -> Column:
    """Maximal runs other than ASCII white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of a change feed ``(op, source, lang, tokenizer, tokens, old_tokens)``.

    ``op`` is insert (+tokens), delete (-tokens) or revise (tokens - old_tokens); null counts are 0, null keys are a
    key of their own, other columns are ignored, and any other ``op`` raises in the job.
    """
    new, old = F.coalesce("tokens", F.lit(0)).cast("long"), F.coalesce("old_tokens", F.lit(0)).cast("long")
    wrong = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null"))))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(wrong.cast("int"))
    tokens = F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -new).otherwise(new - old)
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("docs"), F.sum(tokens).cast("long").alias("tokens"))


@dataclass
class _State:
    """The log as read at one point."""

    last: int = -1
    upto: int = -1
    sums: str | None = None
    base: int = -1
    batches: dict[int, dict] = field(default_factory=dict)
    folds: dict[int, dict] = field(default_factory=dict)

    def live(self) -> dict[int, dict]:
        """Batches that no compaction holds."""
        return {v: e for v, e in self.batches.items() if v > self.upto}


class Rollup:
    """The rollup kept in folder ``path`` of any file system that Spark reaches; any number of writers and readers."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at, self._io = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at(self.path).getFileSystem(conf)
        where = self._fs.makeQualified(self._at(self.path))
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf)
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        self._never_overwrite = spark.sparkContext._gateway.new_array(rename, 1)
        self._never_overwrite[0] = rename.NONE

    def _path(self, name: str):
        return self._fs.makeQualified(self._at(f"{self.path}/{name}"))

    def _delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def _write(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _text(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _claim(self, version: int, entry: dict) -> bool:
        """Write log entry ``version``; False if another writer has it."""
        staged, place = f"staged/{uuid.uuid4().hex}", self._path(f"log/{version:012d}")
        self._write(staged, json.dumps(entry))
        self._fs.mkdirs(place.getParent())
        try:
            self._context.rename(self._path(staged), place, self._never_overwrite)
        except Py4JJavaError:
            self._delete(staged)
            if not self._fs.exists(place):
                raise
            return False
        return True

    def _read(self) -> _State:
        """The log; read again if a vacuum takes an entry away meanwhile."""
        if not self._fs.exists(self._path("log")):
            return _State()
        while True:
            state = _State()
            try:
                for f in self._fs.listStatus(self._path("log")):
                    if not re.fullmatch(r"\d{12}", f.getPath().getName()):
                        continue
                    version, entry = int(f.getPath().getName()), json.loads(self._text(f.getPath()))
                    state.last = max(state.last, version)
                    (state.folds if "sums" in entry else state.batches)[version] = entry
            except Py4JJavaError as e:
                if "FileNotFoundException" not in str(e.java_exception.getClass()):
                    raise
                continue
            if state.folds:
                state.base = max(state.folds, key=lambda v: (state.folds[v]["upto"], v))
                state.upto, state.sums = state.folds[state.base]["upto"], state.folds[state.base]["sums"]
            return state

    def _has(self, state: _State, batch: str) -> bool:
        """Looked up after the log was read: a vacuum writes the name before it takes the entry away."""
        known = {e["batch"] for e in state.live().values()} | {b for f in state.folds.values() for _, b, _ in f["folded"]}
        return batch in known or self._fs.exists(self._path(f"names/{batch}"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False if a batch of this name has been added before."""
        if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9_.-]{0,99}", batch):
            raise ValueError("a batch name has 1 to 100 letters, digits, '_', '.' or '-' and does not begin with a dot")
        data = None
        while True:
            state = self._read()
            if self._has(state, batch):
                if data:
                    self._delete(data)
                return False
            if data is None:
                data = f"data/{uuid.uuid4().hex}"
                deltas(changes).write.parquet(f"{self.path}/{data}")
                continue  # others may have written meanwhile
            version = state.last + 1
            if self._claim(version, {"batch": batch, "data": data}):
                if version > self._read().upto:
                    return True
                self._delete(f"log/{version:012d}")  # the number was a folded entry's, vacuumed since the log was read

    def _sums(self, state: _State) -> DataFrame:
        parts = [e["data"] for e in state.live().values()] + ([state.sums] if state.sums else [])
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], SCHEMA)
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, docs, tokens)`` as of now; keys that have come back to nothing are left out."""
        return self._sums(self._read())

    def compact(self) -> None:
        """Fold all batches committed so far into one table.  Readers and writers go on meanwhile."""
        state = self._read()
        if not state.live():
            return
        sums = f"data/{uuid.uuid4().hex}"
        self._sums(state).write.parquet(f"{self.path}/{sums}")
        folded = [[v, e["batch"], e["data"]] for v, e in state.live().items()]
        version = state.last + 1
        while not self._claim(version, {"sums": sums, "upto": state.last, "folded": folded}):
            version = max(version, self._read().last) + 1

    def vacuum(self) -> None:
        """Remove entries and tables that the newest compaction replaces.  Totals that were read before, but not used yet, may need them."""
        state = self._read()
        old = {v: f for v, f in state.folds.items() if v == state.base or f["upto"] <= state.upto}
        for f in old.values():
            for version, batch, data in f["folded"]:
                if version <= state.upto:
                    self._write(f"names/{batch}", "")
                    self._delete(f"log/{version:012d}")
                    self._delete(data)
        for version, f in old.items():
            if version != state.base:
                self._delete(f"log/{version:012d}")
                self._delete(f["sums"])


def inserts(docs: DataFrame, tokenizer: str, tokens: Column) -> DataFrame:
    """The change feed that adds every row of ``docs(source, lang, ...)`` with the given count.

    Null sources and languages are keys of their own; a null count adds a row without tokens; repeated rows count each.
    """
    return docs.select(F.lit("insert").alias("op"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), tokens.cast("long").alias("tokens"), F.lit(None).cast("long").alias("old_tokens"))
