"""One profile of a frame: every statistic that quality, privacy, summary and synthetic data need.

Job A computes all non-distinct aggregates of all columns in one pass.  Job B counts distinct values of all columns in one
shuffle of 128-bit digests, so whole texts are never moved.  Within one call of the library (``shared``) later checks reuse
the profile; it never outlives the call, so data that has changed since is read again.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import dataclass, field
from functools import wraps
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions import names as N
from hushframe.functions import patterns as P
from hushframe.types import can_sum, is_boolean, is_float, is_integer, is_numeric, is_plain, is_text, is_time, present

SAMPLES = 3


@dataclass
class ColumnProfile:
    name: str
    dtype: T.DataType
    rows: int = 0
    present: int = 0
    distinct: int = 0
    distinct_normal: int = 0
    least: Any = None
    most: Any = None
    mean: float | None = None
    numeric_like: float = 0.0
    date_like: float = 0.0
    serial_like: float = 0.0
    pii: list[str] = field(default_factory=list)
    samples: list = field(default_factory=list)

    @property
    def missing(self) -> float:
        return 1 - self.present / self.rows if self.rows else 0.0


@dataclass
class Profile:
    rows: int
    columns: dict[str, ColumnProfile]


def _scalars(df: DataFrame, n: str, i: int) -> dict:
    t, c = df.schema[n].dataType, present(df, n)
    out = {f"n{i}": F.count(c)}
    if not is_plain(t):
        return out
    if is_text(t):
        out |= {f"num{i}": F.avg(P.looks_numeric(c).cast("int")), f"dat{i}": F.avg(P.looks_date(c).cast("int"))}
        out |= {f"pii{i}_{k}": F.bool_or(P.has_pii(c, k)) for k in P.PII}
    else:
        v = c.cast("int") if is_boolean(t) else c
        out |= {f"min{i}": F.min(c), f"max{i}": F.max(c)}
        if can_sum(t):
            out[f"avg{i}"] = F.avg(v)
        if is_numeric(t) and not isinstance(t, T.DecimalType):
            out[f"ser{i}"] = F.avg(P.excel_serial(c).cast("int"))
        if is_integer(t):
            out[f"luhn{i}"] = F.bool_and(F.when(c.isNotNull(), P.luhn_ok(c)))
    return out


#: Profiles of the running call: (frame, scan_rows, profile).
_call: ContextVar[list[tuple] | None] = ContextVar("profiles", default=None)


def shared(f: Callable) -> Callable:
    """One call of ``f`` profiles a frame once; calls inside it join in."""

    @wraps(f)
    def run(*args, **more):
        if _call.get() is not None:
            return f(*args, **more)
        token = _call.set([])
        try:
            return f(*args, **more)
        finally:
            _call.reset(token)

    return run


def bounded(df: DataFrame, scan_rows: int | str | None) -> DataFrame | None:
    """The rows a bounded PII scan reads: best effort, since rows have no order; None for a full scan."""
    return None if scan_rows in (None, "all") else df.limit(int(scan_rows))


def profile(df: DataFrame, scan_rows: int | str | None = "all", samples: bool = False) -> Profile:
    """The profile of ``df``; ``samples`` adds the least few values of each text column."""
    kept, depth = _call.get(), str(scan_rows)
    found = next((p for d, s, p in kept or () if s == depth and d.columns == df.columns and d.sameSemantics(df)), None)
    if found is None:
        found = _profile(df, scan_rows)
        if kept is not None:
            kept.append((df, depth, found))
    if samples:
        _add_samples(df, found)
    return found


def _profile(df: DataFrame, scan_rows: int | str | None) -> Profile:
    aggs: dict = {}
    for i, n in enumerate(df.columns):
        aggs |= _scalars(df, n, i)
    one = df.agg(F.count("*").alias("n"), *[c.alias(k) for k, c in aggs.items()]).first().asDict()
    if (few := bounded(df, scan_rows)) is not None:  # patterns of the first rows only
        again = {k: c for i, n in enumerate(df.columns) for k, c in _scalars(df, n, i).items() if k.startswith(("pii", "luhn"))}
        if again:
            one |= few.agg(*[c.alias(k) for k, c in again.items()]).first().asDict()
    out = {}
    for i, n in enumerate(df.columns):
        get = one.get
        p = ColumnProfile(n, df.schema[n].dataType, one["n"], one[f"n{i}"], least=get(f"min{i}"), most=get(f"max{i}"), mean=get(f"avg{i}"))
        p.numeric_like, p.date_like, p.serial_like = (float(get(f"{k}{i}") or 0) for k in ("num", "dat", "ser"))
        p.pii = sorted(k.lower() for k in P.PII if get(f"pii{i}_{k}"))
        if get(f"luhn{i}"):
            p.pii = ["card"]
        out[n] = p
    for (n, attr), count in _distinct(df).items():
        setattr(out[n], attr, count)
    return Profile(one["n"], out)


def _distinct(df: DataFrame) -> dict[tuple[str, str], int]:
    """Distinct values of every plain column, and of every text column's normal forms: rows of (column, digest), combined before one shuffle."""
    wanted: list[tuple[str, str, Column]] = []
    for n in df.columns:
        t, c = df.schema[n].dataType, present(df, n)
        if is_plain(t):
            wanted.append((n, "distinct", c + 0.0 if is_float(t) else c))  # minus zero is zero
            if is_text(t):
                wanted.append((n, "distinct_normal", P.normalize_category(c)))
    if not wanted:
        return {}
    # two hashes with different seeds: 128 bits
    def digest(i: int, c: Column) -> Column:
        return P.bound(c, lambda x: F.when(x.isNotNull(), F.struct(F.lit(i).alias("i"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(0x5EED), x).alias("b"))))

    rows = df.select(F.inline(F.filter(F.array(*[digest(i, c) for i, (_, _, c) in enumerate(wanted)]), lambda x: x.isNotNull())))
    counts = {r["i"]: r["n"] for r in rows.distinct().groupBy("i").agg(F.count("*").alias("n")).collect()}
    return {(n, attr): counts.get(i, 0) for i, (n, attr, _) in enumerate(wanted)}


def _add_samples(df: DataFrame, p: Profile) -> None:
    """The least ``SAMPLES`` values of each text column, the same at every run: one pass for each rank, not for each column."""
    open_ = {i: [] for i, n in enumerate(df.columns) if is_text(df.schema[n].dataType) and p.columns[n].present and not p.columns[n].samples}
    done: dict[int, list] = {}
    for _ in range(SAMPLES if open_ else 0):
        after = {i: F.min(F.when(present(df, df.columns[i]) > got[-1], present(df, df.columns[i])) if got else present(df, df.columns[i])) for i, got in open_.items()}
        row = df.agg(*[c.alias(f"s{i}") for i, c in after.items()]).first()
        for i in list(open_):
            if row[f"s{i}"] is None:
                done[i] = open_.pop(i)
            else:
                open_[i].append(row[f"s{i}"])
        if not open_:
            break
    for i, got in (done | open_).items():
        p.columns[df.columns[i]].samples = got


@shared
def column_facts(df: DataFrame) -> list[dict]:
    """Type, nullability, sign, uniqueness and personal data of each column."""
    p = profile(df)
    facts = []
    for n, c in p.columns.items():
        facts.append(
            {
                "column": n, "dtype": c.dtype.simpleString(), "nullable": c.present < c.rows,
                "non_negative": bool(is_numeric(c.dtype) and c.least is not None and c.least >= 0 and N.hints_nonnegative(n)),
                "unique_id": N.ends_like_id(n) and c.rows > 0 and c.distinct == c.present == c.rows, "is_pii": bool(c.pii or N.pii_kind(n)),
            }
        )
    return facts


def kind(c: ColumnProfile) -> str:
    """pii, numeric, datetime or categorical."""
    if c.pii or N.pii_kind(c.name):
        return "pii"
    return "numeric" if is_numeric(c.dtype) else "datetime" if is_time(c.dtype) else "categorical"
