"""Every registered query of the engine against its DuckDB form, and random plans against DuckDB."""

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hushframe import queries as core
from hushframe.plans.lower import ROWS, lower
from hushframe.plans.plan import parse, validate

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df):
    return sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, sf, duck, name):
    got = core.QUERIES[name](spark, sf).toPandas()
    if name in core.ORACLE_SQL:
        want = duck.execute(core.ORACLE_SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_redact_result_has_every_customer(spark, sf):
    got = core.QUERIES["redact_result"](spark, sf).toPandas()
    ids = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").toPandas()["c_custkey"]
    assert sorted(got["customer_id"].astype(str)) == sorted(ids.astype(str)) and set(got["customer_name"]) == {"[REDACTED]"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(core.QUERIES) <= set(e.queries())


FILTERS = st.lists(
    st.sampled_from([("o_orderstatus", "==", "F"), ("o_orderstatus", "!=", "O"), ("o_totalprice", ">", 100000), ("o_totalprice", "<=", 200000.5), ("o_custkey", "in", [1, 2, 3, 50, 51]), ("o_orderpriority", "in", ["1-URGENT", "5-LOW"])]), max_size=3
)
SQL = {"==": "{c} = {v}", "!=": "{c} IS DISTINCT FROM {v}", ">": "{c} > {v}", "<=": "{c} <= {v}", "in": "{c} IN {v}"}
AGG = {"sum": "coalesce(sum({c}), 0)", "mean": "avg({c})", "median": "median({c})", "min": "min({c})", "max": "max({c})", "count": "count({c})", "nunique": "count(DISTINCT {c})", "std": "stddev_samp({c})"}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(FILTERS, st.sampled_from(sorted(AGG)), st.sampled_from(["o_totalprice", "o_custkey"]), st.sampled_from(["o_orderstatus", "o_orderpriority"]), st.sampled_from([None, 5, 400]))
def test_random_plans(spark, sf, duck, filters, agg, column, key, k):
    raw = {"operation": "groupby_aggregate", "group_by": [key], "metrics": [{"column": column, "agg": agg, "as_name": "m"}], "filters": [dict(zip(("column", "op", "value"), f, strict=True)) for f in filters]}
    df = spark.read.parquet(f"{sf}/orders.parquet")
    got = lower(df, validate(parse(raw), df.schema, 50), k).drop(ROWS).collect()
    lit = lambda v: "(" + ",".join(map(repr, v)) + ")" if isinstance(v, list) else repr(v)
    where = " AND ".join(SQL[o].format(c=c, v=lit(v)) for c, o, v in filters) or "TRUE"
    want = duck.execute(f"SELECT {key}, {AGG[agg].format(c=column)}, count(*) FROM orders WHERE {where} GROUP BY 1 HAVING count(*) >= {k or 0} ORDER BY 1").fetchall()
    assert [(r[0], r["count"]) for r in got] == [(w[0], w[2]) for w in want]
    assert all(g["m"] == pytest.approx(w[1], rel=1e-9) for g, w in zip(got, want, strict=True) if w[1] is not None)
