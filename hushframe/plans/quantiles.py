"""Exact quantiles of whole columns, without one task that holds all their distinct values.

A sketch first brackets each quantile between two values; then the values inside the brackets alone, a share of about
``2 * MARGIN`` of all, are counted by value and ranked, and a count of the values below each bracket gives the ranks their
offset.  All is one lazy plan of three scans; ranking streams over sorted rows, so memory is bounded at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative rank error of the sketch is 1/ACCURACY; a bracket is four times that to each side.  Below FEW values a bracket is
#: everything, since a few ranks to each side would be less than one value.
ACCURACY, FEW = 10_000, 100_000
MARGIN = 4 / ACCURACY
#: From so many bytes on (Spark's estimate) ``describe`` and the medians of whole columns are bracketed; the answers are the same.
LARGE = 8 << 30


def large(df: DataFrame) -> bool:
    """Whether Spark estimates the frame at ``LARGE`` bytes or more; chooses a plan, never an answer."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= LARGE


def bracketed(df: DataFrame, values: list[Column], shares: tuple[float, ...]) -> Column:
    """A constant ``map<int, double>``: the quantile ``shares[j]`` of ``values[i]`` under ``i * len(shares) + j``.

    Quantiles interpolate between neighbours, as ``percentile`` does.  Nulls are skipped; a column without values, or a
    frame without rows, has no entry.  The frame is scanned three times: one that changes between scans, so that a quantile
    is outside its bracket, fails the query.
    """
    m = len(shares)
    flat = df.select(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(values)])
    ends = [min(1.0, max(0.0, p + side * MARGIN)) for p in shares for side in (-1, 1)]
    sketch = flat.agg(*[F.struct(F.count(f"v{i}").alias("n"), F.percentile_approx(f"v{i}", ends, ACCURACY).alias("at")).alias(f"s{i}") for i in range(len(values))])
    bounds = sketch.select(F.array(*[F.col(f"s{i}") for i in range(len(values))])).scalar()
    seen = flat.withColumn("bounds", bounds)

    def end(i: int, j: int, upper: int) -> Column:
        of = F.col("bounds")[i]
        return F.when(of["n"] >= FEW, of["at"][2 * j + upper]).otherwise(F.lit(float("inf" if upper else "-inf")))

    places = [(i * m + j, F.col(f"v{i}"), end(i, j, 0), end(i, j, 1)) for i in range(len(values)) for j in range(m)]
    below = seen.agg(F.array(*[F.count(F.when(v < low, 1)) for _, v, low, _ in places]).alias("below")).select("below").scalar()
    inside = F.array_compact(F.array(*[F.when((v >= low) & (v <= high), F.struct(F.lit(k).alias("k"), v.alias("v"))) for k, v, low, high in places]))
    counts = seen.select(F.inline(inside)).groupBy("k", "v").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    share = F.array(*map(F.lit, shares))[F.col("k") % m]
    at = share * (F.get(bounds, F.floor(F.col("k") / m).cast("int"))["n"] - 1)
    ranked = counts.withColumn("below", F.get(below, F.col("k"))).select("k", "v", (F.sum("n").over(upto) + F.col("below")).alias("upto"), "below", at.alias("at"))
    pair = ranked.groupBy("k", "at", "below").agg(F.min(F.when(F.col("upto") > F.floor("at"), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil("at"), F.col("v"))).alias("b"))
    missed = F.raise_error(F.lit("a quantile is outside its bracket"))
    outside = (F.floor("at") < F.col("below")) | F.col("b").isNull()
    value = F.when(outside, missed.cast("double")).when((F.floor("at") == F.ceil("at")) | (F.col("a") == F.col("b")), F.col("a")).otherwise((F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b"))
    found = pair.agg(F.map_from_entries(F.collect_list(F.struct("k", value.alias("value")))).alias("q"))
    due = m * sketch.select(sum((F.col(f"s{i}.n") > 0).cast("int") for i in range(len(values)))).scalar()
    return found.select(F.when(F.size("q") == due, F.col("q")).otherwise(missed.cast("map<int,double>"))).scalar()
