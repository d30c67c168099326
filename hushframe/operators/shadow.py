"""Synthetic rows of a frame's shape: ranges, categories by label, missing shares; never a real text value."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions import names as N
from hushframe.operators.profile import Profile, kind, profile
from hushframe.types import is_integer

CATEGORIES = 20


def profile_frame(df: DataFrame) -> list[dict]:
    """Type, missing share, distinct values, kind and range of each column; ranges of personal data are left out."""
    out = []
    for n, c in profile(df).columns.items():
        k = kind(c)
        shown = k in ("numeric", "datetime")
        out.append({"column": n, "dtype": c.dtype.simpleString(), "missing_rate": round(c.missing, 4), "nunique": c.distinct, "is_pii": k == "pii", "kind": k, "min": c.least if shown else None, "max": c.most if shown else None})
    return out


def _fake(name: str, kinds: list[str], i: Column) -> Column:
    """A made-up value by the kind of personal data."""
    k = (kinds or [N.pii_kind(name) or ""])[0]
    shapes = {"email": "user%06d@example.com", "phone": "+00 000 %07d", "name": "Person %06d", "card": "0000-0000-%08d", "ssn": "000-00-%04d", "national_id": "ID%08d", "ip": "0.0.0.%d", "postcode": "ZZ%05d", "address": "%d Example Street", "date_of_birth": "1900-01-%02d"}
    return F.format_string(shapes.get(k, "PRIVATE_%06d"), i)


def _column(c, p: Profile, seed: int, i: int) -> Column:
    """One synthetic column; draws differ by column and row and repeat for a seed."""
    unit = F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(i)), F.lit(1 << 30)) / float(1 << 30)
    k = kind(c)
    if not c.present:
        value: Any = F.lit(None)
    elif k == "pii" and not isinstance(c.dtype, T.StringType):
        value = (F.col("id") + 1).cast("int") if not isinstance(c.dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.lit("1900-01-01")
    elif k == "pii":
        value = _fake(c.name, c.pii, (F.col("id") + 1).cast("int"))
    elif k == "numeric":
        lo, hi = float(c.least), float(c.most)
        value = F.lit(lo) + unit * (hi - lo)
        value = F.least(F.greatest(F.round(value), F.lit(lo)), F.lit(hi)) if is_integer(c.dtype) else value
    elif k == "datetime":
        lo, hi = (F.unix_seconds(F.lit(x).cast("timestamp")) for x in (c.least, c.most))
        value = F.timestamp_seconds(lo + F.floor(unit * (hi - lo + 1)))
    elif isinstance(c.dtype, T.BooleanType):
        value = unit < 0.5
    else:
        value = F.concat(F.lit(f"{c.name}_CATEGORY_"), (F.floor(unit * max(1, min(c.distinct, CATEGORIES))) + 1).cast("string"))
    if c.missing:
        gone = F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(-1 - i)), F.lit(1 << 30)) / float(1 << 30) < c.missing
        value = F.when(~gone, value)
    target = c.dtype if not isinstance(c.dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)) else T.StringType()
    return value.cast(target).alias(c.name)


def create_shadow(df: DataFrame, rows: int = 1000, seed: int = 0) -> DataFrame:
    """``rows`` synthetic rows, made where they are used; the same for the same profile and seed."""
    p = profile(df)
    return df.sparkSession.range(rows).select(*[_column(c, p, seed, i) for i, c in enumerate(p.columns.values())])


def shadow_rows(df: DataFrame, rows: int = 20, seed: int = 0) -> pd.DataFrame:
    """A few synthetic rows on the driver, for prompts."""
    return create_shadow(df, rows, seed).toPandas()
