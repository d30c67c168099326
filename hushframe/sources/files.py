"""Reading by extension and writing results.  Paths may be of any file system that Spark reaches."""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",") -> DataFrame:
    """A header line is expected; give a schema to spare the pass that infers one."""
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", False)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return read_csv(spark, path, schema, "\t")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One record per line, or one array of records; a single object of columns (lists, or index -> value) is turned on the driver.

    The first line tells which: lines that are values by themselves are split between tasks, a value over several lines is not.
    """
    first = next((r[0] for r in spark.read.text(path).where("trim(value) <> ''").limit(1).collect()), "")
    try:
        json.loads(first)
        by_line = True
    except ValueError:
        by_line = False
    reader = spark.read.option("multiLine", not by_line)
    if schema:
        return reader.schema(schema).json(path)
    df = reader.json(path)
    if "_corrupt_record" in df.columns:
        raise ValueError(f"{path} is not valid JSON")
    if df.columns and all(isinstance(f.dataType, (T.ArrayType, T.StructType)) for f in df.schema.fields) and len(rows := df.limit(2).collect()) == 1:
        record = rows[0].asDict(recursive=True)
        cols = {k: list(v.values()) if isinstance(v, dict) else v for k, v in record.items()}
        if len({len(v) for v in cols.values() if v is not None}) == 1:
            import pandas as pd

            return spark.createDataFrame(pd.DataFrame(cols))
    return df


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """Read on the driver; needs an Excel library."""
    import pandas as pd

    try:
        return spark.createDataFrame(pd.read_excel(path))
    except ImportError as e:
        raise ValueError(f"reading Excel needs openpyxl or xlrd: {e}") from e


READERS = {".csv": read_csv, ".tsv": read_tsv, ".parquet": read_parquet, ".json": read_json, ".xlsx": read_excel, ".xls": read_excel}


def load(spark: SparkSession, path: str) -> DataFrame:
    """By extension.  A missing file is FileNotFoundError; an unknown extension or unreadable content is ValueError."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in READERS:
        raise ValueError(f"unknown file type {ext or path!r}; known: {', '.join(READERS)}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(path)
    try:
        return READERS[ext](spark, path)
    except (ValueError, FileNotFoundError):
        raise
    except Exception as e:
        raise ValueError(f"cannot read {path}: {str(e).splitlines()[0]}") from e


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """A folder of CSV parts, or one file (through one task, for bounded results)."""
    if not single_file:
        df.write.mode("overwrite").option("header", True).csv(path)
        return
    spark = df.sparkSession
    part = f"{path}.{uuid.uuid4().hex}"
    df.coalesce(1).write.option("header", True).csv(part)
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm(part).getFileSystem(spark._jsc.hadoopConfiguration())
    (found,) = [s.getPath() for s in fs.listStatus(jvm(part)) if s.getPath().getName().startswith("part-")] or [None]
    fs.delete(jvm(path), True)
    if found is not None:
        fs.rename(found, jvm(path))
    fs.delete(jvm(part), True)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_text(text: str, path: str) -> None:
    """One small text file, on any file system that Spark reaches; the driver's own disk without a session."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        return
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_json(value: Any, path: str) -> None:
    write_text(json.dumps(value, default=str, indent=2), path)
