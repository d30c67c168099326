"""Plans as lazy DataFrames.  Nothing here runs a job; Catalyst prunes, pushes filters down and combines before shuffles."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.errors import SafetyError
from hushframe.plans.plan import Metric, Plan
from hushframe.plans.quantiles import bracketed, large
from hushframe.types import is_boolean, is_numeric, is_text, is_time, present, quoted

#: Of approximate quantiles: the rank is off by 1/ACCURACY of the rows at most.
ACCURACY = 10_000
#: Name of the row count that execution checks and drops.
ROWS = "__rows"


def predicate(df: DataFrame, spec: dict) -> Column:
    """One filter.  A value of another type than the column's equals nothing, and is never cast to it."""
    name, op, value = spec["column"], spec["op"], spec["value"]
    t, c = df.schema[name].dataType, present(df, name)
    if op == "in":
        items = [x for v in value if v is not None and (x := _literal(t, v)) is not None]
        hit = _wide(c, t).isin(*items) if items else F.lit(False)
        hit = F.coalesce(hit, F.lit(False))
        return hit | c.isNull() if is_text(t) and None in value else hit
    if value is None:
        if op in ("==", "!="):
            return F.lit(op == "!=")
        if is_time(t):
            raise SafetyError(f"cannot order column {name!r} against nothing")
        return F.lit(False)
    lit = _literal(t, value)
    if op == "==":
        return F.lit(False) if lit is None else _wide(c, t) == lit
    if op == "!=":
        return F.lit(True) if lit is None else ~_wide(c, t).eqNullSafe(lit)
    if lit is None:
        raise SafetyError(f"{value!r} is no value of column {name!r}")
    c = _wide(c, t)
    return {">": c > lit, ">=": c >= lit, "<": c < lit, "<=": c <= lit}[op]


def _wide(c: Column, t: T.DataType) -> Column:
    return c.cast("int") if is_boolean(t) else c


def _literal(t: T.DataType, v: Any) -> Column | None:
    """The value as a literal to compare with a column of type ``t``; None if it can equal none."""
    if is_numeric(t) or is_boolean(t):
        return F.lit(int(v) if isinstance(v, bool) else v) if isinstance(v, (bool, int, float)) else None
    if is_text(t):
        return F.lit(v) if isinstance(v, str) else None
    if is_time(t) and isinstance(v, str):
        return _instant(v, t)
    return None


def _instant(text: str, t: T.DataType) -> Column | None:
    """The time that a text means, parsed once on the driver in any common notation, as a constant that is never null.

    A time with a zone has no place in a column without one.
    """
    import pandas as pd

    try:
        at = pd.Timestamp(text)
    except (ValueError, TypeError):
        return None
    if pd.isna(at) or (at.tzinfo is not None and not isinstance(t, T.TimestampType)):
        return None
    at = at.floor("us")
    if isinstance(t, T.DateType) and at != at.normalize():
        return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(at.isoformat(sep=" ") if not isinstance(t, T.DateType) else at.date().isoformat()).cast(t)


def filtered(df: DataFrame, plan: Plan) -> DataFrame:
    for spec in plan.filters:
        df = df.where(predicate(df, spec))
    return df


def metric(df: DataFrame, m: Metric, exact: bool = True) -> Column:
    """One aggregate; missing values (null or NaN) are skipped."""
    c, t = present(df, m.column), df.schema[m.column].dataType
    n = c.cast("int") if is_boolean(t) else c
    made = {
        "sum": lambda: F.coalesce(F.sum(n), F.lit(0)),
        "mean": lambda: F.avg(n),
        "median": lambda: F.median(n) if exact else F.percentile_approx(n.cast("double"), 0.5, ACCURACY),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "count": lambda: F.count(c),
        "nunique": lambda: F.count_distinct(c) if exact else F.approx_count_distinct(c),
        "std": lambda: F.stddev_samp(n),
    }[m.agg]()
    return made.alias(m.name)


def keyed(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Group keys with NaN as null; a plain column is left alone, so that its filters still reach the scan."""
    for k in keys:
        if isinstance(df.schema[k].dataType, (T.DoubleType, T.FloatType)):
            df = df.withColumn(k, present(df, k))
    return df


def lower(df: DataFrame, plan: Plan, k: int | None = None, cap: int = 50, exact: bool = True) -> DataFrame:
    """The plan's result as a lazy frame.

    Groups under ``k`` are dropped before sorting and limiting.  ``aggregate``, ``describe`` and ``count_rows`` carry
    the number of filtered rows in ``__rows``, for the caller to check and drop.  Ties are ordered by the group keys.
    ``exact=False`` sketches medians, quantiles and distinct counts: for groups whose distinct values outgrow a task.
    """
    rows = filtered(df, plan)
    limit = min(plan.limit or cap, cap)
    if plan.operation == "count_rows":
        return rows.agg(F.count("*").alias("count")).withColumn(ROWS, F.col("count"))
    if plan.operation == "aggregate":
        return aggregate(rows, plan.metrics, exact)
    if plan.operation == "describe":
        return describe(rows, limit, exact)
    if plan.operation == "value_counts":
        (key,) = plan.group_by
        counts = keyed(rows, plan.group_by).groupBy(quoted(key)).agg(F.count("*").alias("count"))
        counts = counts.where(F.col("count") >= k) if k else counts
        return counts.orderBy(F.desc("count"), quoted(key).asc_nulls_last()).limit(limit)
    groups = keyed(rows, plan.group_by)
    groups = groups.groupBy(*map(quoted, plan.group_by)).agg(*[metric(groups, m, exact) for m in plan.metrics], F.count("*").alias("count"))
    groups = groups.where(F.col("count") >= k) if k else groups
    by = [quoted(g).asc_nulls_last() for g in plan.group_by]
    if plan.sort_by and not (plan.sort_by == "count" and not plan.include_count):
        s = quoted(plan.sort_by)
        by = [s.asc_nulls_last() if plan.ascending else s.desc_nulls_last(), *by]
    out = groups.orderBy(*by).limit(limit)
    return out if plan.include_count else out.drop("count")


def aggregate(rows: DataFrame, metrics: tuple[Metric, ...], exact: bool = True) -> DataFrame:
    """Metrics of the whole frame and its number of rows; exact medians of a large frame are bracketed."""
    medians = [m for m in metrics if m.agg == "median"] if exact else []
    if not medians or not large(rows):
        return rows.agg(*[metric(rows, m, exact) for m in metrics], F.count("*").alias(ROWS))
    of = [present(rows, m.column) for m in medians]
    middle = bracketed(rows, [c.cast("int") if is_boolean(rows.schema[m.column].dataType) else c for c, m in zip(of, medians, strict=True)], (0.5,))
    one = rows.agg(*[metric(rows, m) for m in metrics if m.agg != "median"], F.count("*").alias(ROWS))
    found = {m: F.try_element_at(middle, F.lit(i)).alias(m.name) for i, m in enumerate(medians)}
    return one.select(*[found.get(m, quoted(m.name)) for m in metrics], ROWS)


STATS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def describe(df: DataFrame, columns: int, exact: bool = True) -> DataFrame:
    """Eight statistics of the first numeric columns, one row for each statistic.

    Exact quantiles of a large frame are bracketed; ``exact=False`` keeps a sketch of bounded size.
    """
    names = [f.name for f in df.schema.fields if is_numeric(f.dataType)][:columns]
    if not names:
        raise SafetyError("describe needs a numeric column")
    quarters, values = (0.25, 0.5, 0.75), [present(df, n).cast("double") for n in names]
    apart = bracketed(df, values, quarters) if exact and large(df) else None
    aggs = []
    for i, c in enumerate(values):
        if apart is not None:
            q = F.lit(None).cast("array<double>")
        else:
            q = F.percentile(c, F.array(*map(F.lit, quarters))) if exact else F.percentile_approx(c, list(quarters), ACCURACY)
        aggs += [F.array(F.count(c).cast("double"), F.avg(c), F.stddev_samp(c), F.min(c), F.max(c)).alias(f"s{i}"), q.alias(f"q{i}")]
    one = df.agg(*aggs, F.count("*").alias(ROWS))
    if apart is not None:
        one = one.withColumn("apart", apart)
    quarter = lambda i, j: F.col(f"q{i}")[j] if apart is None else F.try_element_at(F.col("apart"), F.lit(i * len(quarters) + j))
    whole = lambda i: [F.col(f"s{i}")[j] for j in range(4)] + [quarter(i, j) for j in range(3)] + [F.col(f"s{i}")[4]]
    one = one.select(*[F.array(*whole(i)).alias(f"c{i}") for i in range(len(names))], ROWS)
    rows = F.array(*[F.struct(F.lit(s).alias("index"), *[F.col(f"c{i}")[j].alias(n) for i, n in enumerate(names)]) for j, s in enumerate(STATS)])
    return one.select(F.explode(rows).alias("r"), ROWS).select(*[F.col("r").getField(n).alias(n) for n in ("index", *names)], ROWS)
