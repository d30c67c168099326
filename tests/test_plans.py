import json
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hushframe.errors import SafetyError
from hushframe.operators.receipt import format_receipt
from hushframe.plans.execute import execute, prepare, run_plan, safe_query
from hushframe.plans import quantiles
from hushframe.plans.lower import lower, predicate
from hushframe.plans.plan import extract_json, parse, validate
from hushframe.policy import Policy


@pytest.fixture(scope="module")
def trips(spark):
    """Three ferry lines of 9, 7 and 2 trips; fares in steps of 1.25."""
    rows = [(line, 1.25 * i, f"Guest {line}{i}") for line, n in (("harbour", 9), ("island", 7), ("night", 2)) for i in range(n)]
    return spark.createDataFrame(rows, "line string, fare double, passenger_name string")


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, NaN and every kind of column."""
    df = spark.createDataFrame([("a", 1.0, 1, True, "2024-01-01"), ("a", None, 2, False, "2024-01-02"), ("b", 3.0, 3, True, None), (None, 4.0, 4, True, "2024-01-04"), ("c", float("nan"), 5, False, "2024-01-05")], "k string, v double, i long, b boolean, d string")
    return df.withColumn("t", F.to_timestamp("d").cast("timestamp_ntz")).withColumn("y", F.to_date("d")).drop("d")


def kept(df, column, op, value):
    return sorted(r["i"] for r in df.where(predicate(df, {"column": column, "op": op, "value": value})).collect())


@pytest.mark.parametrize(
    ("column", "op", "value", "want"),
    [
        ("k", "==", "a", [1, 2]), ("k", "!=", "a", [3, 4, 5]), ("k", "==", None, []), ("k", "!=", None, [1, 2, 3, 4, 5]), ("k", "in", [None, "a"], [1, 2, 4]), ("v", "in", [None], []),
        ("i", "in", ["3", 3], [3]), ("b", "in", [1], [1, 3, 4]), ("i", "in", [True], [1]), ("k", "in", [], []), ("i", "==", "3", []), ("i", "==", "abc", []), ("i", "!=", "abc", [1, 2, 3, 4, 5]),
        ("k", "==", 1, []), ("b", "==", 1, [1, 3, 4]), ("b", ">", 0, [1, 3, 4]), ("i", "==", True, [1]), ("v", ">", 1, [3, 4]), ("v", "!=", 3.0, [1, 2, 4, 5]), ("v", ">", None, []),
        ("t", ">", "2024-01-01", [2, 4, 5]), ("t", "==", "junk", []), ("t", "!=", "junk", [1, 2, 3, 4, 5]), ("t", "<=", "2024-01-02", [1, 2]),
        ("t", ">", "2024/01/01", [2, 4, 5]), ("t", ">", "January 1, 2024", [2, 4, 5]), ("t", ">=", "20240104", [4, 5]), ("t", "==", "2 Jan 2024", [2]), ("t", "!=", "2024/01/02", [1, 3, 4, 5]),
        ("t", "in", ["2024/01/05", "junk"], [5]), ("t", "==", "2024-01-01T00:00:00+02:00", []), ("y", ">", "2024/01/01", [2, 4, 5]), ("y", "<", "2024-01-02 12:00", [1, 2]), ("y", "!=", "20240101", [2, 3, 4, 5]),
    ],
)
def test_filters_follow_the_truth_table(edge, column, op, value, want):
    assert kept(edge, column, op, value) == want


def test_ordering_a_time_against_junk_or_nothing_is_refused(edge):
    for v in ("junk", None):
        with pytest.raises(SafetyError):
            predicate(edge, {"column": "t", "op": ">", "value": v})


def test_aggregates_treat_nan_as_missing(edge):
    raw = {"operation": "aggregate", "metrics": [{"column": "v", "agg": a} for a in ("sum", "mean", "median", "min", "max", "count", "nunique", "std")] + [{"column": "b", "agg": "sum"}]}
    got = run_plan(edge, validate(parse(raw), edge.schema, 50), Policy())
    assert (got["sum_v"], got["min_v"], got["max_v"], got["count_v"], got["nunique_v"], got["sum_b"]) == (8.0, 1.0, 4.0, 3, 3, 3)
    assert got["median_v"] == 3.0 and math.isclose(got["std_v"], pd.Series([1, 3, 4]).std())


def test_sum_of_nothing_is_zero_and_std_of_one_is_missing(edge):
    raw = {"operation": "groupby_aggregate", "group_by": ["k"], "metrics": [{"column": "v", "agg": "sum"}, {"column": "v", "agg": "std"}]}
    got = run_plan(edge, parse(raw), Policy()).set_index("k")
    assert got.loc["c", "sum_v"] == 0 and pd.isna(got.loc["b", "std_v"])
    assert list(got.index) == ["a", "b", "c", None] or pd.isna(got.index[-1])


def fares(agg="sum", **more):
    return {"operation": "aggregate", "metrics": [{"column": "fare", "agg": agg} | more]}


def by_line(**more):
    return fares() | {"operation": "groupby_aggregate", "group_by": ["line"]} | more


def test_small_groups_go_before_the_limit(trips):
    least = by_line(sort_by="sum_fare", ascending=True, limit=1, include_count=False)
    assert lower(trips, parse(least), k=5).toPandas().to_dict("records") == [{"line": "island", "sum_fare": 26.25}]
    assert lower(trips, parse(least)).toPandas()["line"].tolist() == ["night"]


def test_small_frames_and_filtered_counts_are_blocked(trips):
    night = {"filters": [{"column": "line", "op": "==", "value": "night"}]}
    for raw in (fares() | night, {"operation": "count_rows"} | night, {"operation": "describe"} | night):
        with pytest.raises(SafetyError):
            run_plan(trips, parse(raw), Policy(min_group_size=5))
    assert run_plan(trips.limit(2), parse({"operation": "count_rows"}), Policy(min_group_size=5)) == {"count": 2}


def test_describe_matches_pandas(trips):
    got = run_plan(trips, parse({"operation": "describe"}), Policy()).set_index("index")["fare"]
    want = trips.toPandas()["fare"].describe()
    assert all(math.isclose(got[k], want[k]) for k in want.index)


def test_sketched_quantiles_are_near(spark):
    df = spark.range(10_001).selectExpr("cast(id as double) as v")
    got = lower(df, parse({"operation": "describe"}), exact=False).toPandas().set_index("index")["v"]
    assert all(abs(got[q] - at) <= 5 for q, at in (("25%", 2500), ("50%", 5000), ("75%", 7500)))
    assert abs(lower(df, parse({"operation": "aggregate", "metrics": [{"column": "v", "agg": "median", "as_name": "m"}]}), exact=False).first()["m"] - 5000) <= 5


def broken():
    """Each rule of the language broken once in an otherwise good plan."""
    good_filter = {"column": "fare", "op": ">=", "value": 2}
    for change in ({"operation": "sample"}, {"operation": "pivot"}, {"operation": None}, {"limit": -1}, {"limit": 99}, {"limit": False}, {"limit": "5"}, {"group_by": ["line", "line"]}, {"group_by": ["deck"]}, {"group_by": [7]}, {"group_by": []}, {"metrics": []}, {"metrics": "fare"}, {"filters": {}}, {"include_count": "yes"}, {"ascending": None}, {"sort_by": "fare"}, {"sort_by": 1}):
        yield by_line() | change
    for change in ({"column": "line"}, {"column": "deck"}, {"agg": "mode"}, {"agg": None}, {"as_name": "2nd"}, {"as_name": "count"}, {"as_name": 5}):
        yield by_line() | {"metrics": [{"column": "fare", "agg": "mean"} | change]}
    for change in ({"column": "deck"}, {"op": "~"}, {"op": "in"}, {"value": "2"}, {"value": True}, {"value": [2]}, {"value": {}}, {"either": 1}):
        yield by_line() | {"filters": [good_filter | change]}
    yield by_line() | {"filters": [{k: v for k, v in good_filter.items() if k != "value"}]}
    yield by_line() | {"filters": [{"column": "line", "op": "<", "value": 2}]}
    yield by_line() | {"metrics": [{"column": "fare", "agg": "sum"}, {"column": "fare", "agg": "sum"}]}
    yield {"operation": "value_counts"}
    yield ["aggregate"]


@pytest.mark.parametrize("raw", list(broken()), ids=lambda r: json.dumps(r)[:60])
def test_bad_plans_are_refused(trips, raw):
    validate(parse(by_line()), trips.schema, 50)
    with pytest.raises(SafetyError):
        validate(parse(raw), trips.schema, 50)


def test_json_is_found_in_prose():
    assert extract_json('Sure:\n```json\n{"operation": "count_rows"}\n```') == {"operation": "count_rows"}
    for bad in ("no json", "{oops", "[1]"):
        with pytest.raises(SafetyError):
            extract_json(bad)


def test_filters_and_columns_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    raw = {"operation": "groupby_aggregate", "group_by": ["o_orderstatus"], "metrics": [{"column": "o_totalprice", "agg": "sum"}], "filters": [{"column": "o_orderpriority", "op": "!=", "value": "1-URGENT"}]}
    plan = lower(df, parse(raw))._jdf.queryExecution().toString()
    assert "PushedFilters: [Not(EqualNullSafe(o_orderpriority,1-URGENT))]" in plan
    assert "partial_sum" in plan and "o_custkey" not in plan.split("ReadSchema")[1]


def test_query_end_to_end_with_retries_and_receipt(trips):
    replies = iter(["nothing", json.dumps(by_line())])
    prompts = []
    got = safe_query(trips, "total fare by line", lambda p: prompts.append(p) or next(replies), Policy(min_group_size=5))
    assert not got.blocked and got.attempts == 2 and sorted(got.answer["line"]) == ["harbour", "island"]
    assert "passenger_name" not in prompts[0] and "Guest" not in prompts[0]
    assert got.receipt["exposure"]["personal_columns_withheld"] == ["passenger_name"] and got.receipt["outcome"]["plan"]["operation"] == "groupby_aggregate"
    assert got.receipt["outcome"]["answer"] == "DataFrame 2 x 3 (line, sum_fare, count)" and "exposure: " in format_receipt(got.receipt)


def test_failures_are_closed(trips):
    assert execute(prepare(trips, "x", lambda p: "{}", Policy())).blocked
    ready = prepare(trips, "count", lambda p: '{"operation": "count_rows"}', Policy())
    ready.view = trips.select(F.raise_error(F.lit("boom")).alias("fare"))
    ready.plan = parse(fares("count"))
    got = execute(ready)
    assert got.blocked and got.answer is None and got.receipt["outcome"]["refused"]


def stirred(spark, n):
    """Values with ties, gaps and a skew; nulls, NaN, and a column without values."""
    x = (F.col("id") * 7919) % 10007
    return spark.range(n).select((x * 0.37).alias("fare"), F.when(x % 3 > 0, x % 5).alias("crew"), F.when(x % 4 == 0, F.lit(float("nan"))).otherwise(x * x).alias("load"), F.lit(None).cast("double").alias("none"), (x % 2 == 0).alias("full"))


@pytest.mark.parametrize("n", [0, 2, 30_000])
def test_bracketed_quantiles_are_those_of_whole_columns(spark, monkeypatch, n):
    df, few = stirred(spark, n), {"agg": "median"}
    metrics = [few | {"column": "fare"}, {"column": "crew", "agg": "sum"}, few | {"column": "none"}, few | {"column": "load", "as_name": "mid"}, few | {"column": "full"}]
    plans = [parse({"operation": "describe"}), parse({"operation": "aggregate", "metrics": metrics})]
    want = [[r.asDict() for r in lower(df, p).collect()] for p in plans]
    monkeypatch.setattr(quantiles, "LARGE", 0)
    monkeypatch.setattr(quantiles, "FEW", 20_000)
    wide = [lower(df, p) for p in plans]
    assert [[r.asDict() for r in w.collect()] for w in wide] == want
    assert all("percentile(" not in w._jdf.queryExecution().optimizedPlan().toString() for w in wide)


def test_a_bracket_that_misses_fails(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "LARGE", 0)
    monkeypatch.setattr(quantiles, "FEW", 1)
    monkeypatch.setattr(quantiles, "MARGIN", -0.2)
    with pytest.raises(Exception, match="outside its bracket|bracket"):
        lower(stirred(spark, 30_000).select("fare"), parse({"operation": "describe"})).collect()
