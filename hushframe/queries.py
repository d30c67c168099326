"""Registered queries of the engine itself, each over whole tables, with the same result in DuckDB SQL where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions import names as N
from hushframe.functions import patterns as P
from hushframe.operators.privacy import create_privacy_plan, k_anonymize, make_safe_view, mask_blocked, protect_columns, redact_frame
from hushframe.operators.profile import profile
from hushframe.operators.quality import findings, validate
from hushframe.operators.shadow import create_shadow
from hushframe.plans.lower import ROWS, lower
from hushframe.plans.plan import parse, validate as check
from hushframe.policy import Policy
from hushframe.registry import ORACLE_SQL, QUERIES, own, people, read
from hushframe.types import is_numeric, quoted


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(quoted(n), 4).alias(n) if t == "double" else quoted(n) for n, t in df.dtypes])


def planned(name: str, table: str, raw: dict, sql: str, k: int | None = None, cap: int = 50) -> None:
    """A plan as a query: validated against the table, lowered, rounded."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, table)
        out = lower(df, check(parse(raw), df.schema, cap), k, cap)
        out = out.where(F.col(ROWS) >= (k or 0)) if ROWS in out.columns else out
        return rounded(out.drop(ROWS))

    QUERIES[name], ORACLE_SQL[name] = run, sql


def metric(column: str, agg: str, as_name: str | None = None) -> dict:
    return {"column": column, "agg": agg, "as_name": as_name}


FLAGSHIP = {"operation": "groupby_aggregate", "group_by": ["o_orderpriority"], "metrics": [metric("o_totalprice", "mean", "avg_price")], "sort_by": "avg_price", "limit": 50}
planned("op_groupby", "orders", FLAGSHIP, "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS avg_price, count(*) AS count FROM orders GROUP BY 1 HAVING count(*) >= 10", k=10)
planned("op_count_rows", "lineitem", {"operation": "count_rows"}, "SELECT count(*) AS count FROM lineitem")
planned(
    "op_aggregate", "lineitem",
    {"operation": "aggregate", "metrics": [metric("l_quantity", "sum"), metric("l_extendedprice", "mean"), metric("l_shipdate", "max", "last_ship"), metric("l_partkey", "nunique")], "filters": [{"column": "l_returnflag", "op": "!=", "value": "N"}]},
    "SELECT sum(l_quantity) AS sum_l_quantity, round(avg(l_extendedprice), 4) AS mean_l_extendedprice, max(l_shipdate) AS last_ship, count(DISTINCT l_partkey) AS nunique_l_partkey FROM lineitem WHERE l_returnflag IS DISTINCT FROM 'N'",
)
planned("op_value_counts", "customer", {"operation": "value_counts", "group_by": ["c_mktsegment"]}, "SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY 1")
_stats = ("count", "count(x)"), ("mean", "avg(x)"), ("std", "stddev_samp(x)"), ("min", "min(x)"), ("25%", "quantile_cont(x, 0.25)"), ("50%", "quantile_cont(x, 0.5)"), ("75%", "quantile_cont(x, 0.75)"), ("max", "max(x)")
planned(
    "op_describe", "orders", {"operation": "describe"},
    " UNION ALL ".join(f"SELECT '{s}' AS index, " + ", ".join(f"round(CAST({e.replace('x', c, 1) if e != 'max(x)' else f'max({c})'} AS DOUBLE), 4) AS {c}" for c in ("o_orderkey", "o_custkey", "o_totalprice")) + " FROM orders" for s, e in _stats),
)
for agg, sql in {"sum": "sum(l_quantity)", "mean": "avg(l_quantity)", "median": "median(l_quantity)", "min": "min(l_quantity)", "max": "max(l_quantity)", "count": "count(l_quantity)", "nunique": "count(DISTINCT l_quantity)", "std": "stddev_samp(l_quantity)"}.items():
    cast = sql if agg in ("count", "nunique") else f"round({sql}, 4)"
    planned(f"agg_{agg}", "lineitem", {"operation": "groupby_aggregate", "group_by": ["l_returnflag", "l_linestatus"], "metrics": [metric("l_quantity", agg, "m")]}, f"SELECT l_returnflag, l_linestatus, {cast} AS m, count(*) AS count FROM lineitem GROUP BY 1, 2")
_filters = {
    "eq": ("o_orderstatus", "==", "F", "o_orderstatus = 'F'"), "ne": ("o_orderstatus", "!=", "F", "o_orderstatus IS DISTINCT FROM 'F'"),
    "gt": ("o_totalprice", ">", 150000, "o_totalprice > 150000"), "ge": ("o_custkey", ">=", 100, "o_custkey >= 100"), "lt": ("o_totalprice", "<", 150000.5, "o_totalprice < 150000.5"),
    "le": ("o_orderdate", "<=", "1995-06-17", "o_orderdate <= TIMESTAMP '1995-06-17'"), "in": ("o_orderpriority", "in", ["1-URGENT", "2-HIGH", None, 3], "o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderpriority IS NULL"),
    "mismatch": ("o_custkey", "==", "3", "FALSE"), "null_ne": ("o_orderstatus", "!=", None, "TRUE"),
}
for n, (c, op, v, sql) in _filters.items():
    planned(f"filter_{n}", "orders", {"operation": "groupby_aggregate", "group_by": ["o_orderstatus"], "metrics": [metric("o_totalprice", "sum", "total")], "filters": [{"column": c, "op": op, "value": v}]}, f"SELECT o_orderstatus, round(sum(o_totalprice), 4) AS total, count(*) AS count FROM orders WHERE {sql} GROUP BY 1")
planned("kanon_groups", "supplier", {"operation": "value_counts", "group_by": ["s_nationkey"]}, "SELECT s_nationkey, count(*) AS count FROM supplier GROUP BY 1 HAVING count(*) >= 3", k=3)
planned("topk", "lineitem", {"operation": "groupby_aggregate", "group_by": ["l_partkey"], "metrics": [metric("l_quantity", "sum", "q")], "sort_by": "q", "limit": 10}, "SELECT l_partkey, round(sum(l_quantity), 4) AS q, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY q DESC, l_partkey LIMIT 10")
planned("sort_metric", "events", {"operation": "groupby_aggregate", "group_by": ["user_id"], "metrics": [metric("value", "mean", "v")], "sort_by": "v", "ascending": True, "limit": 20}, "SELECT user_id, round(avg(value), 4) AS v, count(*) AS count FROM events GROUP BY 1 ORDER BY avg(value), user_id LIMIT 20")
planned("sort_default", "part", {"operation": "groupby_aggregate", "group_by": ["p_brand", "p_size"], "metrics": [metric("p_retailprice", "max", "top")]}, "SELECT p_brand, p_size, round(max(p_retailprice), 4) AS top, count(*) AS count FROM part GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 50")
planned("limit_cap", "customer", {"operation": "value_counts", "group_by": ["c_nationkey"]}, "SELECT c_nationkey, count(*) AS count FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7", cap=7)
planned("drop_count", "orders", {"operation": "groupby_aggregate", "group_by": ["o_orderstatus"], "metrics": [metric("o_totalprice", "min")], "include_count": False}, "SELECT o_orderstatus, round(min(o_totalprice), 4) AS min_o_totalprice FROM orders GROUP BY 1")


@own("safe_view", "SELECT c_custkey AS customer_id, c_nationkey AS region_code, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def _(spark, sf_dir):
    df = people(spark, sf_dir)
    return make_safe_view(df, create_privacy_plan(df, "average balance by segment"))


@own("minimal", "SELECT c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def _(spark, sf_dir):
    df = people(spark, sf_dir)
    return make_safe_view(df, create_privacy_plan(df, "average balance by segment", "minimal"))


@own("protect", "SELECT c_nationkey AS region_code, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def _(spark, sf_dir):
    df = people(spark, sf_dir)
    return df.select(*map(quoted, protect_columns(df, "average balance by segment", Policy.from_profile("banking"))[1]))


@own("mask_blocked", "SELECT c_custkey AS customer_id, c_mktsegment AS segment, TRUE AS masked FROM customer")
def _(spark, sf_dir):
    masked = mask_blocked(people(spark, sf_dir), ["customer_name"])
    return masked.select("customer_id", "segment", F.col("customer_name").rlike(r"^\[RESTRICTED_\d{3,}\]$").alias("masked"))


@own("dedupe_columns", 'SELECT r_regionkey AS x, r_name AS "x.1" FROM region')
def _(spark, sf_dir):
    return read(spark, sf_dir, "region").toDF(*N.dedupe(["x", "x"])[0])


@own("numeric_only", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    return df.select(*[quoted(f.name) for f in df.schema.fields if is_numeric(f.dataType)])


@own("kanon_utility", "SELECT c_nationkey, count(*) AS count FROM customer GROUP BY 1 HAVING count(*) >= 60")
def _(spark, sf_dir):
    return k_anonymize(read(spark, sf_dir, "customer").groupBy("c_nationkey").count(), 60)


@own(
    "looks_numeric",
    r"SELECT event_type, count(*) AS n, count(*) FILTER (regexp_matches(CAST(CAST(value AS DECIMAL(18, 4)) AS VARCHAR),"
    r" '^\s*[-+]?[$£€]?\s*[\d,]+(\.\d+)?\s*%?\s*$')) AS numeric FROM events GROUP BY 1",
)
def _(spark, sf_dir):
    # fixed decimals: the two engines print small and large doubles differently
    text = F.col("value").cast("decimal(18,4)").cast("string")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(P.looks_numeric(text)).alias("numeric"))


@own("looks_date", r"SELECT event_type, count(*) FILTER (regexp_matches(strftime(ts, '%Y-%m-%d %H:%M'), '^\s*\d{4}[-/]\d{1,2}[-/]\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2})?)?\s*$')) AS n FROM events GROUP BY 1")
def _(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(P.looks_date(F.date_format("ts", "yyyy-MM-dd HH:mm"))).alias("n"))


@own("normalize_cat", r"SELECT p_partkey, regexp_replace(lower(trim(p_name)), '[\s._\-]+', '', 'g') AS k FROM part")
def _(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", P.normalize_category(F.col("p_name")).alias("k"))


for _label in ("EMAIL", "IP"):
    QUERIES[f"pii_{_label.lower()}"] = lambda spark, sf_dir, k=_label: read(spark, sf_dir, "documents").where(P.has_pii(F.col("text"), k)).select("doc_id")
    ORACLE_SQL[f"pii_{_label.lower()}"] = f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{P.PII[_label]}')"
QUERIES["pii_card"] = lambda spark, sf_dir: read(spark, sf_dir, "documents").where(P.has_pii(F.col("text"), "CARD")).select("doc_id")
ORACLE_SQL["pii_card"] = f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{P.PII['CARD']}')"
QUERIES["pii_phone"] = lambda spark, sf_dir: read(spark, sf_dir, "documents").where(P.has_pii(F.col("text"), "PHONE")).select("doc_id")
ORACLE_SQL["pii_phone"] = f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{P.PII['PHONE']}') AND length(regexp_replace(text, '\\D', '', 'g')) >= 10 AND NOT regexp_matches(text, '{P.DATE_IN_TEXT}') AND NOT regexp_matches(text, '{P.TIME_IN_TEXT}')"


@own("luhn_ok", "SELECT n, (CAST(substr(s, 16, 1) AS INT) + list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN (2 * CAST(substr(s, i, 1) AS INT)) // 10 + (2 * CAST(substr(s, i, 1) AS INT)) % 10 ELSE CAST(substr(s, i, 1) AS INT) END))) % 10 = 0 AS ok FROM (SELECT 4111111111111111 + o_orderkey AS n, CAST(4111111111111111 + o_orderkey AS VARCHAR) AS s FROM orders)")
def _(spark, sf_dir):
    return read(spark, sf_dir, "orders").select((F.lit(4111111111111111) + F.col("o_orderkey")).alias("n")).select("n", P.luhn_ok(F.col("n")).alias("ok"))


# word boundaries differ outside ASCII between the two engines, so both read the texts with other letters as x
_nested = "regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g')"
for _k in ("EMAIL", "CARD", "SSN", "IP"):
    _nested = f"regexp_replace({_nested}, '{P.PII[_k]}', '[{_k}]', 'g')"


@own("redact_before_phone", f"SELECT doc_id, {_nested} AS redacted FROM documents")
def _(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", P.redact_before_phone(F.regexp_replace("text", r"[^\x00-\x7F]", "x")).alias("redacted"))


@own("redact_text")
def _(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", P.redact(F.col("text")).alias("redacted"))


@own(
    "redact_result",
    "SELECT c_custkey AS customer_id, '[REDACTED]' AS customer_name, c_nationkey AS region_code, c_acctbal AS balance, c_mktsegment AS segment FROM customer",
)
def _(spark, sf_dir):
    return redact_frame(people(spark, sf_dir))


@own("estimate_tokens", "SELECT doc_id, greatest(1, CAST(round_even(length(text) / 4.0, 0) AS INTEGER)) AS tokens FROM documents")
def _(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", P.estimate_tokens(F.col("text")).alias("tokens"))


@own("excel_serial", "SELECT l_returnflag, count(*) FILTER (l_extendedprice BETWEEN 36526 AND 51500) AS n FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(P.excel_serial(F.col("l_extendedprice"))).alias("n"))


@own("repair_casts", "SELECT o_orderkey, round(CAST(o_totalprice AS DOUBLE), 2) AS amount, CAST(DATE '1899-12-30' + CAST(40000 + o_custkey % 1000 AS INTEGER) AS VARCHAR) AS day FROM orders")
def _(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("amount"), (40000 + F.col("o_custkey") % 1000).alias("day"))
    return o.select("o_orderkey", F.round(P.REPAIRS["TEXT_NUMERIC"](F.col("amount")), 2).alias("amount"), P.REPAIRS["EXCEL_SERIAL_DATE"](F.col("day")).cast("string").alias("day"))


@own("profile", " UNION ALL ".join(f"SELECT '{c}' AS column, count(*) AS rows, count({c}) AS present, count(DISTINCT {c}) AS distinct_values FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
def _(spark, sf_dir):
    p = profile(read(spark, sf_dir, "customer"))
    return spark.createDataFrame([(c.name, c.rows, c.present, c.distinct) for c in p.columns.values()], "column string, rows long, present long, distinct_values long")


def _rule(rule: str, table: str, select: list[str], sql: str) -> None:
    """The columns of a projection that a rule finds."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, table).selectExpr(*select)
        return spark.createDataFrame([(i.column, i.severity) for i in validate(df) if i.rule_id == rule], "column string, severity string")

    QUERIES[f"q_{rule.lower()}"], ORACLE_SQL[f"q_{rule.lower()}"] = run, sql


_rule("TEXT_NUMERIC", "orders", ["concat('$', cast(o_orderkey as string)) as amount", "o_orderstatus"], "SELECT 'amount' AS column, 'high' AS severity FROM orders HAVING avg(CAST(regexp_matches('$' || o_orderkey, '^\\s*[-+]?[$]?\\s*[\\d,]+(\\.\\d+)?\\s*%?\\s*$') AS INT)) >= 0.7")
_rule("DATE_AS_TEXT", "orders", ["date_format(o_orderdate, 'yyyy-MM-dd') as placed", "o_orderstatus"], "SELECT 'placed' AS column, 'medium' AS severity FROM orders HAVING avg(CAST(regexp_matches(strftime(o_orderdate, '%Y-%m-%d'), '^\\d{4}-\\d{1,2}-\\d{1,2}$') AS INT)) >= 0.9")
_rule("MESSY_CATEGORY", "customer", ["if(c_custkey % 2 = 0, upper(c_mktsegment), lower(c_mktsegment)) as segment"], "SELECT 'segment' AS column, 'medium' AS severity FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END AS s FROM customer) HAVING count(DISTINCT s) > count(DISTINCT lower(s))")
_rule("HIGH_CARDINALITY", "documents", ["text", "lang", "source"], "SELECT 'text' AS column, 'low' AS severity FROM documents HAVING count(DISTINCT text) >= 0.9 * count(*) AND count(*) > 5")
_rule("CONSTANT_COLUMN", "orders", ["1 as one", "o_custkey"], "SELECT 'one' AS column, 'low' AS severity FROM orders HAVING count(*) > 1")
_rule("NON_UNIQUE_ID", "events", ["event_id", "user_id"], "SELECT 'user_id' AS column, 'medium' AS severity FROM events HAVING count(user_id) > count(DISTINCT user_id) UNION ALL SELECT 'event_id', 'medium' FROM events HAVING count(event_id) > count(DISTINCT event_id)")
_rule("EMPTY_COLUMN", "orders", ["o_orderkey", "cast(null as double) as gap"], "SELECT 'gap' AS column, 'medium' AS severity FROM orders HAVING count(*) > 0")
_rule("HIGH_MISSING", "lineitem", ["if(l_returnflag = 'A', l_quantity, null) as q"], "SELECT 'q' AS column, 'medium' AS severity FROM lineitem HAVING count(*) FILTER (l_returnflag IS DISTINCT FROM 'A') >= 0.6 * count(*)")
_rule("EXCEL_SERIAL_DATE", "orders", ["40000 + o_custkey % 1000 as due_date", "o_totalprice"], "SELECT 'due_date' AS column, 'medium' AS severity FROM orders HAVING avg(CAST(40000 + o_custkey % 1000 BETWEEN 36526 AND 51500 AS INT)) >= 0.9")
_rule("UNEXPECTED_NEGATIVE", "customer", ["c_acctbal as amount", "c_nationkey"], "SELECT 'amount' AS column, 'medium' AS severity FROM customer HAVING min(c_acctbal) < -greatest(0.001 * greatest(abs(min(c_acctbal)), abs(max(c_acctbal))), 0.000001)")
_rule("PII", "documents", ["text", "lang", "source"], f"SELECT 'text' AS column, 'high' AS severity FROM documents HAVING bool_or(regexp_matches(text, '{P.PII['EMAIL']}') OR regexp_matches(text, '{P.PII['CARD']}') OR regexp_matches(text, '{P.PII['IP']}'))")


@own("validate")
def _(spark, sf_dir):
    return findings(read(spark, sf_dir, "documents"))


_phone = (
    f"regexp_matches(text, '{P.PII['PHONE']}') AND length(regexp_replace(text, '\\D', '', 'g')) >= 10"
    f" AND NOT regexp_matches(text, '{P.DATE_IN_TEXT}') AND NOT regexp_matches(text, '{P.TIME_IN_TEXT}')"
)


@own(
    "pii_values",
    " UNION ALL ".join(
        f"SELECT 'text' AS column, '{k.lower()}' AS kind FROM documents HAVING bool_or({_phone if k == 'PHONE' else f"regexp_matches(text, '{P.PII[k]}')"})" for k in P.PII
    ),
)
def _(spark, sf_dir):
    p = profile(read(spark, sf_dir, "documents"))
    return spark.createDataFrame([(n, k) for n, c in p.columns.items() for k in c.pii], "column string, kind string")


@own("shadowframe")
def _(spark, sf_dir):
    return create_shadow(people(spark, sf_dir), 200, seed=7)


from hushframe import queries_wide  # noqa: E402, F401  registers more queries
