"""Where queries are registered: a name, a function of (spark, sf_dir), and DuckDB SQL with the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def own(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register the function under ``name``."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under names that the name rules know."""
    names = {"c_custkey": "customer_id", "c_name": "customer_name", "c_nationkey": "region_code", "c_acctbal": "balance", "c_mktsegment": "segment"}
    return read(spark, sf_dir, "customer").select(*[F.col(a).alias(b) for a, b in names.items()])


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; in a temp folder only in local mode without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="files-")
    return f"{folder}/{uuid.uuid4().hex}-{name}"
