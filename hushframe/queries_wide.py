"""More registered queries: files, small-group rules, name rules, reports and sessions."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.api import scan
from hushframe.errors import DataError, SafetyError
from hushframe.functions import names as N
from hushframe.functions import patterns as P
from hushframe.operators.guarded import guarded_sql
from hushframe.operators.leak import collect_sensitive_values
from hushframe.operators.privacy import classify_columns, privacy_report, risk_score
from hushframe.operators.profile import column_facts
from hushframe.operators.quality import ai_readiness, infer_columns, quality_score, validate
from hushframe.operators.session import SafeSession
from hushframe.plans.execute import run_plan
from hushframe.plans.lower import lower
from hushframe.plans.plan import parse
from hushframe.policy import Policy
from hushframe.registry import ORACLE_SQL, QUERIES, own, people, read, scratch
from hushframe.sources.files import load, write_csv
from hushframe.types import require_frame


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def values_sql(names: str, table: list[tuple]) -> str:
    """SQL of a constant table."""
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in table)}) AS t({', '.join(f'"{n.strip()}"' for n in names.split(','))})"


# ---- files: a table written in each format and loaded by its extension


def _file(name: str, table: str, write: Callable[[DataFrame, str], None], ext: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, table)
        path = scratch(spark, f"{table}{ext}")
        write(df, path)
        return load(spark, path).select(*[F.col(f.name).cast(f.dataType) for f in df.schema.fields])

    QUERIES[name], ORACLE_SQL[name] = run, f"SELECT * FROM {table}"


_file("src_csv", "nation", lambda df, path: write_csv(df, path), ".csv")
_file("sink_csv", "customer", lambda df, path: write_csv(df, path, single_file=True), ".csv")
_file("src_tsv", "region", lambda df, path: df.write.option("header", True).option("sep", "\t").csv(path), ".tsv")
_file("src_json", "nation", lambda df, path: df.write.json(path), ".json")
_file("src_parquet", "part", lambda df, path: df.write.parquet(path), ".parquet")


@own("src_memory", "SELECT * FROM region")
def _(spark, sf_dir):
    return require_frame(read(spark, sf_dir, "region").toPandas(), spark)


@own("src_dispatch", values_sql("path, error", [("missing.csv", "FileNotFoundError"), ("table.foo", "ValueError"), ("noextension", "ValueError")]))
def _(spark, sf_dir):
    out = []
    for path in ("missing.csv", "table.foo", "noextension"):
        try:
            load(spark, path)
        except (FileNotFoundError, ValueError) as e:
            out.append((path, type(e).__name__))
    return rows(spark, out, "path string, error string")


# ---- the small-group rule in every engine, with answers on both sides


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _by_segment(spark: SparkSession, sf_dir: str, raw: dict, k: int) -> list[tuple[str, str]]:
    df, out = read(spark, sf_dir, "customer"), []
    for s in SEGMENTS:
        one = parse(raw | {"filters": [{"column": "c_mktsegment", "op": "==", "value": s}]})
        try:
            (value,) = run_plan(df, one, Policy(min_group_size=k)).values()
        except SafetyError:
            value = "refused"
        out.append((s, str(value)))
    return out


_segments_sql = " UNION ALL ".join(f"SELECT '{s}' AS segment, CASE WHEN count(*) >= 300 THEN CAST({{}} AS VARCHAR) ELSE 'refused' END AS answer FROM customer WHERE c_mktsegment = '{s}'" for s in SEGMENTS)


@own("kanon_frame", _segments_sql.format(*["max(c_custkey)"] * 5))
def _(spark, sf_dir):
    """A total for each segment; those of fewer than 300 customers are refused."""
    raw = {"operation": "aggregate", "metrics": [{"column": "c_custkey", "agg": "max"}]}
    return rows(spark, _by_segment(spark, sf_dir, raw, 300), "segment string, answer string")


@own("kanon_count", _segments_sql.format(*["count(*)"] * 5))
def _(spark, sf_dir):
    return rows(spark, _by_segment(spark, sf_dir, {"operation": "count_rows"}, 300), "segment string, answer string")


@own("kanon_guarded", "SELECT c_nationkey AS region_code, round(max(c_acctbal), 4) AS most, 1000 AS claimed FROM customer WHERE c_acctbal > 0 GROUP BY 1 HAVING count(*) >= 55")
def _(spark, sf_dir):
    """Guarded SQL that claims a count of its own: groups are counted by the engine all the same."""
    sql = "SELECT region_code, round(max(balance), 4) AS most, 1000 AS claimed FROM data WHERE balance > 0 GROUP BY region_code"
    return guarded_sql(people(spark, sf_dir).select("region_code", "balance"), sql.replace("round(max(balance), 4)", "max(balance)"), 55).withColumn("most", F.round("most", 4))


@own("kanon_guarded_total", "SELECT count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer WHERE c_nationkey < 12 HAVING count(*) >= 60")
def _(spark, sf_dir):
    out = guarded_sql(people(spark, sf_dir), "SELECT count(*) AS n, avg(balance) AS mean FROM data WHERE region_code < 12", 60)
    return out.withColumn("mean", F.round("mean", 4))


# ---- times in any notation


def _times(name: str, op: str, value: str, where: str) -> None:
    """Orders by status under a filter on a date column that also holds nulls."""
    raw = {"operation": "groupby_aggregate", "group_by": ["o_orderstatus"], "metrics": [{"column": "o_orderkey", "agg": "max", "as_name": "last"}]}
    raw["filters"] = [{"column": "day", "op": op, "value": value}]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, "orders").withColumn("day", F.expr("if(o_orderkey % 7 = 0, null, o_orderdate)"))
        return lower(df, parse(raw))

    QUERIES[name] = run
    ORACLE_SQL[name] = (
        "SELECT o_orderstatus, max(o_orderkey) AS last, count(*) AS count FROM"
        f" (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS day FROM orders) WHERE {where} GROUP BY 1"
    )


_times("filter_time_slash", ">", "1995/06/17", "day > TIMESTAMP '1995-06-17'")
_times("filter_time_text", "<=", "June 17, 1995", "day <= TIMESTAMP '1995-06-17'")
_times("filter_time_plain", ">=", "19950617", "day >= TIMESTAMP '1995-06-17'")
_times("filter_time_ne_null", "!=", "1995/06/17", "day IS DISTINCT FROM TIMESTAMP '1995-06-17'")


# ---- patterns and names


@own("pii_ssn", "SELECT o_orderkey FROM (SELECT o_orderkey, 'ref 123-45-' || CASE WHEN o_orderkey % 2 = 0 THEN printf('%04d', o_orderkey % 10000) ELSE printf('%03d', o_orderkey % 1000) END AS t FROM orders) WHERE regexp_matches(t, '" + P.PII["SSN"] + "')")
def _(spark, sf_dir):
    tail = F.when(F.col("o_orderkey") % 2 == 0, F.format_string("%04d", F.col("o_orderkey") % 10000)).otherwise(F.format_string("%03d", F.col("o_orderkey") % 1000))
    text = F.concat(F.lit("ref 123-45-"), tail)
    return read(spark, sf_dir, "orders").where(P.has_pii(text, "SSN")).select("o_orderkey")


NAMES = ("CustomerName", "product_name", "emailAddress", "mobile", "dateOfBirth", "zip", "accountNo", "order_total", "homeAddress", "surname")


@own(
    "pii_name_hints",
    values_sql("name, kind", [("CustomerName", "name"), ("product_name", None), ("emailAddress", "email"), ("mobile", "phone"), ("dateOfBirth", "date_of_birth"), ("zip", "postcode"), ("accountNo", None), ("order_total", None), ("homeAddress", "address"), ("surname", "name")]).replace("('accountNo', NULL)", "('accountNo', 'card')"),
)
def _(spark, sf_dir):
    return rows(spark, [(n, N.pii_kind(n)) for n in NAMES], "name string, kind string")


@own("name_tokens", values_sql("name, token", [("HTTPServerName", "http"), ("HTTPServerName", "server"), ("HTTPServerName", "name"), ("unit_price2", "unit"), ("unit_price2", "price2"), ("NetTotal EUR", "net"), ("NetTotal EUR", "total"), ("NetTotal EUR", "eur")]))
def _(spark, sf_dir):
    return rows(spark, [(n, t) for n in ("HTTPServerName", "unit_price2", "NetTotal EUR") for t in N.tokens(n)], "name string, token string")


QUESTION = "total sales and claims for each customer by regions"


@own("mention_strict", values_sql("name, named", [("region", True), ("customer", True), ("customer_id", False), ("revenue", False), ("claim_count", False)]))
def _(spark, sf_dir):
    return rows(spark, [(n, N.mentioned(QUESTION, n)) for n in ("region", "customer", "customer_id", "revenue", "claim_count")], "name string, named boolean")


@own("mention_loose", values_sql("name, needed", [("region", True), ("customer_id", True), ("revenue", True), ("claim_count", True), ("postcode", False), ("order_total", False)]))
def _(spark, sf_dir):
    return rows(spark, [(n, N.needed(QUESTION, n)) for n in ("region", "customer_id", "revenue", "claim_count", "postcode", "order_total")], "name string, needed boolean")


@own("detect_operation", values_sql("question, operation", [("export the raw data", "raw_lookup"), ("highest sales first", "ranking"), ("monthly sales", "trend"), ("average price", "aggregate"), ("hello", "general_analysis")]))
def _(spark, sf_dir):
    return rows(spark, [(q, N.detect_operation(q)) for q in ("export the raw data", "highest sales first", "monthly sales", "average price", "hello")], "question string, operation string")


@own("classify_columns", values_sql("category, column", [("business_identifier", "customer_id"), ("financial", "balance"), ("location", "region_code")]))
def _(spark, sf_dir):
    df = people(spark, sf_dir)
    found = classify_columns(df, privacy_report(df)["pii_columns"])
    return rows(spark, [(k, c) for k, cs in found.items() for c in cs], "category string, column string")


# ---- reports from one profile


@own("privacy_report", values_sql("column, evidence, level", [("customer_name", "name", "medium_risk")]))
def _(spark, sf_dir):
    r = privacy_report(people(spark, sf_dir))
    found = [(x["column"], x["by"], level) for level in ("high_risk", "medium_risk") for x in r[level]]
    return rows(spark, found, "column string, evidence string, level string")


@own("privacy_report_values", "SELECT 'text' AS column, 'value' AS evidence, 'high_risk' AS level FROM documents HAVING bool_or(regexp_matches(text, '" + P.PII["EMAIL"] + "') OR regexp_matches(text, '" + P.PII["IP"] + "'))")
def _(spark, sf_dir):
    r = privacy_report(read(spark, sf_dir, "documents"))
    found = [(x["column"], x["by"], level) for level in ("high_risk", "medium_risk") for x in r[level]]
    return rows(spark, found, "column string, evidence string, level string")


def _fact(alias: str, column: str, unique: str, non_negative: str, pii: bool) -> str:
    return f"SELECT '{alias}' AS column, count(*) > count({column}) AS nullable, {non_negative} AS non_negative, {unique} AS unique_id, {str(pii).upper()} AS is_pii FROM customer"


@own(
    "column_facts",
    " UNION ALL ".join(
        [
            _fact("customer_id", "c_custkey", "count(DISTINCT c_custkey) = count(*)", "FALSE", False), _fact("customer_name", "c_name", "FALSE", "FALSE", True),
            _fact("total", "c_nationkey", "FALSE", "min(c_nationkey) >= 0", False), _fact("amount", "c_acctbal", "FALSE", "min(c_acctbal) >= 0", False),
        ]
    ),
)
def _(spark, sf_dir):
    df = people(spark, sf_dir).withColumnsRenamed({"region_code": "total", "balance": "amount"}).drop("segment")
    facts = [(f["column"], f["nullable"], f["non_negative"], f["unique_id"], f["is_pii"]) for f in column_facts(df)]
    return rows(spark, facts, "column string, nullable boolean, non_negative boolean, unique_id boolean, is_pii boolean")


_words = lambda c: f"CASE WHEN count(DISTINCT {c}) >= 0.9 * count(*) THEN 'text' ELSE 'category' END"


@own(
    "infer_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column, {m} AS meaning FROM orders"
        for c, m in (("o_orderkey", "max('numeric')"), ("o_custkey", "max('numeric')"), ("o_orderstatus", _words("o_orderstatus")), ("o_totalprice", "max('money')"), ("o_orderdate", "max('date')"), ("o_orderpriority", _words("o_orderpriority")))
    ),
)
def _(spark, sf_dir):
    return rows(spark, list(infer_columns(read(spark, sf_dir, "orders")).items()), "column string, meaning string")


def _messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a trap in each of four columns."""
    return read(spark, sf_dir, "orders").selectExpr(
        "concat('$', cast(o_orderkey as string)) as amount", "date_format(o_orderdate, 'yyyy-MM-dd') as placed", "1 as one",
        "if(o_orderstatus = 'F', o_totalprice, null) as paid", "o_custkey",
    )


_numeric = r"avg(CAST(regexp_matches('$' || o_orderkey, '^\s*[-+]?[$]?\s*[\d,]+(\.\d+)?\s*%?\s*$') AS INT)) >= 0.7"
_dated = r"avg(CAST(regexp_matches(strftime(o_orderdate, '%Y-%m-%d'), '^\d{4}-\d{1,2}-\d{1,2}$') AS INT)) >= 0.9"
_half = "count(*) FILTER (o_orderstatus IS DISTINCT FROM 'F')"


@own(
    "validate_rules",
    " UNION ALL ".join(
        [
            f"SELECT 'TEXT_NUMERIC' AS rule_id, 'amount' AS column, 'high' AS severity FROM orders HAVING {_numeric}",
            "SELECT 'HIGH_CARDINALITY', 'amount', 'low' FROM orders HAVING count(DISTINCT o_orderkey) >= 0.9 * count(*) AND count(*) > 5",
            f"SELECT 'DATE_AS_TEXT', 'placed', 'medium' FROM orders HAVING {_dated}",
            "SELECT 'HIGH_CARDINALITY', 'placed', 'low' FROM orders HAVING count(DISTINCT CAST(o_orderdate AS DATE)) >= 0.9 * count(*) AND count(*) > 5",
            "SELECT 'CONSTANT_COLUMN', 'one', 'low' FROM orders HAVING count(*) > 1",
            f"SELECT 'HIGH_MISSING', 'paid', 'medium' FROM orders HAVING {_half} >= 0.6 * count(*)",
            "SELECT 'NON_UNIQUE_ID', 'paid', 'medium' FROM orders WHERE o_orderstatus = 'F' HAVING count(o_totalprice) > count(DISTINCT o_totalprice)",
        ]
    ),
)
def _(spark, sf_dir):
    return rows(spark, [(i.rule_id, i.column, i.severity) for i in validate(_messy(spark, sf_dir))], "rule_id string, column string, severity string")


@own(
    "quality_score",
    "SELECT 'completeness' AS dimension, CAST(round_even(100 * (1 - CAST({h} AS DOUBLE) / count(*) / 5), 0) AS BIGINT) AS score FROM orders"
    " UNION ALL SELECT 'type_consistency', CASE WHEN {n} AND {d} THEN 60 WHEN {n} OR {d} THEN 80 ELSE 100 END FROM orders"
    " UNION ALL SELECT 'duplicate_risk', CASE WHEN count(o_totalprice) > count(DISTINCT o_totalprice) THEN 80 ELSE 100 END FROM orders WHERE o_orderstatus = 'F'"
    " UNION ALL SELECT 'pii_risk', 100 UNION ALL SELECT 'outlier_risk', 100".format(h=_half, n=_numeric, d=_dated),
)
def _(spark, sf_dir):
    return rows(spark, [(k, v) for k, v in quality_score(_messy(spark, sf_dir))["breakdown"].items()], "dimension string, score long")


@own("ai_readiness", values_sql("check, ok", [("fits_in_prompt", True), ("no_duplicate_columns", True), ("types_consistent", False), ("no_pii", True), ("low_cardinality_ok", False)]))
def _(spark, sf_dir):
    return rows(spark, [(c["check"], c["ok"]) for c in ai_readiness(_messy(spark, sf_dir))["checks"]], "check string, ok boolean")


@own("q_duplicate_columns", "SELECT 'x' AS column, 'high' AS severity")
def _(spark, sf_dir):
    df = read(spark, sf_dir, "orders").selectExpr("o_orderkey as x", "o_custkey as x", "o_totalprice as y")
    return rows(spark, [(i.column, i.severity) for i in validate(df) if i.rule_id == "DUPLICATE_COLUMNS"], "column string, severity string")


@own("risk_score", values_sql("question, score, level", [("average balance by segment", 40, "medium"), ("list every customer name", 25, "low")]))
def _(spark, sf_dir):
    out = [(q, r["score"], r["risk_level"]) for q in ("average balance by segment", "list every customer name") for r in [risk_score(people(spark, sf_dir), q)]]
    return rows(spark, out, "question string, score long, level string")


@own("scan", "SELECT count(*) AS n_rows, 'high' AS risk_level, 'customer_name' AS pii, 'balance,customer_id' AS sensitive FROM customer")
def _(spark, sf_dir):
    r = scan(people(spark, sf_dir), "banking")
    return rows(spark, [(r.rows, r.risk_level, ",".join(r.pii_columns), ",".join(r.sensitive_columns))], "n_rows long, risk_level string, pii string, sensitive string")


@own("leak_collect", "SELECT DISTINCT trim(n_name) AS v FROM nation WHERE length(trim(n_name)) >= 4")
def _(spark, sf_dir):
    df = read(spark, sf_dir, "nation").select(F.col("n_name").alias("customer_name"), "n_regionkey")
    return rows(spark, [(v,) for v in collect_sensitive_values(df)], "v string")


@own("fmt_missing", values_sql("share, label", [(0, "0%"), (0.254, "25%"), (0.996, ">99%"), (1, "100%")]).replace("VALUES (0,", "VALUES (0.0,").replace("(1,", "(1.0,"))
def _(spark, sf_dir):
    return rows(spark, [(v, P.missing_label(v)) for v in (0.0, 0.254, 0.996, 1.0)], "share double, label string")


# ---- sessions


def _total(*filters: tuple[str, str, Any]) -> str:
    plan = {"operation": "aggregate", "metrics": [{"column": "balance", "agg": "sum"}]}
    return json.dumps(plan | {"filters": [dict(zip(("column", "op", "value"), f, strict=True)) for f in filters]})


SCRIPT = (
    ("balance in building", (("segment", "==", "BUILDING"),)), ("balance in machinery", (("segment", "==", "MACHINERY"),)),
    ("balance in building without one", (("segment", "==", "BUILDING"), ("region_code", "!=", 3))), ("balance in building", (("segment", "==", "BUILDING"),)),
)


@own("session_ask", values_sql("step, blocked, used", [(0, False, 1), (1, False, 2), (2, True, 2), (3, False, 3)]))
def _(spark, sf_dir):
    """Four questions; the third narrows the first and is refused without a charge."""
    replies = iter(_total(*filters) for _, filters in SCRIPT)
    session = SafeSession(people(spark, sf_dir), lambda prompt: next(replies), Policy(min_group_size=5))
    out = []
    for i, (question, _) in enumerate(SCRIPT):
        got = session.ask(question)
        out.append((i, got["blocked"], got["used_budget"]))
    return rows(spark, out, "step long, blocked boolean, used long")


@own("frame_gate", values_sql("case, error", [("repeated names", "DataError"), ("no frame", "TypeError"), ("stream", "DataError")]))
def _(spark, sf_dir):
    out = []
    bad = {"repeated names": lambda: people(spark, sf_dir).toDF("x", "x", "a", "b", "c"), "no frame": lambda: [1, 2], "stream": lambda: spark.readStream.format("rate").load()}
    for case, make in bad.items():
        try:
            require_frame(make(), spark)
        except (DataError, TypeError) as e:
            out.append((case, type(e).__name__))
    return rows(spark, out, "case string, error string")
