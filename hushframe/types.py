"""Schema predicates and the frame gate."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.errors import DataError


def quoted(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(t: T.DataType) -> bool:
    """Numbers that can be described: booleans are not."""
    return isinstance(t, T.NumericType)


def is_boolean(t: T.DataType) -> bool:
    return isinstance(t, T.BooleanType)


def can_sum(t: T.DataType) -> bool:
    """Numbers and booleans can be summed and averaged."""
    return is_numeric(t) or is_boolean(t)


def is_integer(t: T.DataType) -> bool:
    return isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_text(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.VarcharType, T.CharType))


def is_time(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_float(t: T.DataType) -> bool:
    return isinstance(t, (T.DoubleType, T.FloatType))


def is_plain(t: T.DataType) -> bool:
    """Types that can be grouped, filtered and profiled."""
    return can_sum(t) or is_text(t) or is_time(t)


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN as null: the two are one kind of missing."""
    c = quoted(name)
    return F.nanvl(c, F.lit(None)) if is_float(df.schema[name].dataType) else c


def require_frame(data: Any, spark: SparkSession | None = None) -> DataFrame:
    """A batch DataFrame with at least one column and distinct names; pandas and polars frames are converted."""
    if not isinstance(data, DataFrame):
        if hasattr(data, "to_pandas"):
            data = data.to_pandas()
        if not hasattr(data, "iloc"):
            raise TypeError(f"expected a DataFrame, got {type(data).__name__}")
        names = [str(c) for c in data.columns]
        _check(names)
        data = (spark or SparkSession.builder.getOrCreate()).createDataFrame(data)
    _check(data.columns)
    if data.isStreaming:
        raise DataError("streaming frames cannot be profiled; pass a batch DataFrame")
    return data


def _check(names: list[str]) -> None:
    if not names:
        raise DataError("the frame has no columns")
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise DataError(f"duplicate column names: {twice}; rename or drop them first")
