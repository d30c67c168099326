import pandas as pd
import pytest
from pyspark.sql import functions as F

from hushframe import Guard, Policy, ask, protect, scan
from hushframe.errors import DataError, ModelError, PolicyError, SafetyError
from hushframe.functions import names as N
from hushframe.functions import patterns as P
from hushframe.operators import guarded
from hushframe.operators.agent import Agent
from hushframe.operators.leak import attacks_on, collect_sensitive_values, detect_leak, leak_test
from hushframe.operators.privacy import create_contract, create_privacy_plan, k_anonymize, mask_blocked, privacy_report, redact_frame, redact_value
from hushframe.operators.profile import column_facts, profile
from hushframe.operators.quality import ai_readiness, infer_columns, quality_score, repair, spellings, validate
from hushframe.operators.report import expectation_suite, html_report
from hushframe.operators.session import SafeSession, question_cost
from hushframe.operators.shadow import create_shadow, profile_frame
from hushframe.operators.summary import summarize, token_savings


@pytest.fixture(scope="module")
def people(spark):
    rows = [(f"Ann Doe{i}", f"ann{i}@mail.org", f"ACC{i:05d}", ["N", "S"][i % 2], 100 + i, f"call +44 20 7946 09{i:02d}") for i in range(60)]
    return spark.createDataFrame(rows, "full_name string, email string, account_number string, region string, balance long, notes string")


@pytest.mark.parametrize(("name", "kind"), [("Customer Name", "name"), ("Product Name", None), ("Team Name", None), ("Surname", "name"), ("first_name", "name"), ("cover_noofnameddrivers", None), ("EmailAddress", "email"), ("dob", "date_of_birth"), ("c_name", None), ("accountNo", "card"), ("name", "name")])
def test_names_that_suggest_personal_data(name, kind):
    assert N.pii_kind(name) == kind


def test_id_lookalikes_are_no_ids():
    for n in ("build_date", "fluid_level", "grid_ref", "annual_mileage", "covid_cases"):
        assert not N.looks_like_id(n)
    assert N.looks_like_id("user_id") and N.looks_like_id("userid")


def test_dedupe_names():
    assert N.dedupe(["a", "a", "a.1", "b"]) == (["a", "a.2", "a.1", "b"], ["a"])


def test_value_patterns_agree_with_python(spark):
    cells = ["a@b.co", "é.ü@exämple.com", "4111 1111 1111 1111", "123-45-6789", "10.0.0.1", "+44 20 7946 0958", "2024-10-07 16:38:46", "call 020 7946 0958 x", "none", "", "tel 1.2", "+44 20 7946 0958", "a 020 7946 0958 1, b +44 20 7946 0958", "1 2 3 2024-01-01 020 7946 0958 77"]
    df = spark.createDataFrame([(c,) for c in cells] + [(None,)], "c string")
    for label in P.PII:
        got = {r["c"] for r in df.where(P.has_pii(F.col("c"), label)).collect()}
        assert got == {c for c in cells if label.lower() in P.text_kinds(c)}, label
    red = {r["c"]: r["r"] for r in df.select("c", P.redact(F.col("c")).alias("r")).collect()}
    assert red[None] is None and all(red[c] == P.redact_text(c) for c in cells)


def test_luhn(spark):
    df = spark.createDataFrame([("4111111111111111",), ("12345678901234",), ("4111-1111-1111-1111",), ("12",), (None,)], "c string")
    assert [r[0] for r in df.select(P.luhn_ok(F.col("c"))).collect()] == [True, False, True, False, False]


def test_cards_in_numbers_and_rare_values(spark):
    df = spark.createDataFrame([(4111111111111111, 12345678901234, "ok"), (4012888888881881, 99999999999999, "ok")] + [(None, None, "ok")] * 98 + [(None, None, "x@y.org")], "card_like long, big_id long, notes string")
    p = profile(df)
    assert p.columns["card_like"].pii == ["card"] and p.columns["big_id"].pii == [] and p.columns["notes"].pii == ["email"]


def test_report_and_plan(people):
    r = privacy_report(people)
    assert r["pii_columns"] == ["account_number", "email", "full_name", "notes"]
    plan = create_privacy_plan(people, "average balance by region")
    assert plan.allowed_columns == ["region", "balance"] and plan.operation == "aggregate" and plan.safe_view_risk_level == "low"
    assert create_privacy_plan(people, "list emails by region").retained_pii_columns == ["email"]
    assert create_privacy_plan(people, "balance", "minimal").allowed_columns == ["balance"]
    with pytest.raises(ValueError):
        create_privacy_plan(people, "x", "other")


def test_protect_and_scan(people):
    view, report = protect(people, "total balance by region", "banking", return_report=True)
    assert view.columns == ["region", "balance"] and set(report.dropped_columns) == {"full_name", "email", "account_number", "notes"}
    s = scan(people, "banking")
    assert s.risk_level == "high" and s.rows == 60 and "account_number" in s.business_identifier_columns


def test_profiles_do_not_outlive_a_call(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("plain words",)], "note string").write.parquet(path)
    assert privacy_report(spark.read.parquet(path))["pii_columns"] == []
    spark.createDataFrame([("mail a@b.org",)], "note string").write.mode("append").parquet(path)
    assert privacy_report(spark.read.parquet(path))["pii_columns"] == ["note"] and scan(spark.read.parquet(path)).rows == 2


def test_repeated_names_are_a_finding(spark):
    df = spark.createDataFrame([(1, 2), (3, 4)], "x long, y long").select(F.col("x"), F.col("y").alias("x"))
    assert [(i.rule_id, i.column) for i in validate(df)] == [("DUPLICATE_COLUMNS", "x")]


def test_distinct_counts_and_samples(spark):
    df = spark.createDataFrame([("b", 0.0, True), ("B ", -0.0, None), ("a", float("nan"), True), ("b", 1.5, False), (None, None, None), ("d", 2.0, True)], "s string, v double, f boolean")
    p = profile(df, samples=True).columns
    assert (p["s"].distinct, p["s"].distinct_normal, p["v"].distinct, p["f"].distinct) == (4, 3, 3, 2) and p["s"].samples == ["B ", "a", "b"]


def test_frame_gate(spark, people):
    with pytest.raises(DataError):
        scan(people.select(F.lit(1).alias("x"), F.lit(2).alias("x")))
    with pytest.raises(TypeError):
        scan([1, 2])
    assert scan(pd.DataFrame({"region": ["a"], "n": [1]})).rows == 1
    with pytest.raises(DataError):
        scan(spark.readStream.format("rate").load())


def test_quality_rules(spark):
    df = spark.createDataFrame(
        [("$2,000", "2024-01-01", "North", 45292, -3.0, None, 1), ("3", "2024-01-02", "north ", 45293, 4.0, None, 1), ("4.5", "2024-01-03", "NORTH", 45294, 100.0, None, 1)],
        "amount string, signup string, region string, `Renewal Date` long, `Order Quantity` double, gap string, user_id long",
    )
    issues = validate(df, evidence=True)
    rules = {(i.rule_id, i.column) for i in issues}
    assert {("TEXT_NUMERIC", "amount"), ("DATE_AS_TEXT", "signup"), ("MESSY_CATEGORY", "region"), ("EXCEL_SERIAL_DATE", "Renewal Date"), ("UNEXPECTED_NEGATIVE", "Order Quantity"), ("EMPTY_COLUMN", "gap"), ("NON_UNIQUE_ID", "user_id"), ("CONSTANT_COLUMN", "user_id")} <= rules
    assert spellings(df, "region") == ["NORTH", "North", "north "]
    fixed = repair(df, next(i for i in issues if i.rule_id == "TEXT_NUMERIC"))
    assert [r["amount"] for r in fixed.collect()] == [2000.0, 3.0, 4.5]
    assert 0 <= quality_score(df)["score"] <= 100 and ai_readiness(df)["ready_for_summary"]
    assert infer_columns(df)["Renewal Date"] == "date" and infer_columns(df)["user_id"] == "identifier"


def test_empty_frames_have_no_findings_that_need_rows(spark):
    df = spark.createDataFrame([], "a string, n long, t timestamp")
    assert validate(df) == [] and quality_score(df)["score"] == 100 and create_shadow(df, 3).count() == 3


def test_summary_shadow_exports_hold_no_real_values(people):
    text = summarize(people)
    frame = create_shadow(people, 50, seed=3).toPandas()
    assert "ann1@mail.org" not in text and "Ann Doe" not in text
    real = {v for c in ("full_name", "email", "account_number", "notes") for v in people.toPandas()[c]}
    assert not real & set(frame.astype(str).to_numpy().ravel()) and frame["balance"].between(100, 159).all()
    assert create_shadow(people, 50, seed=3).toPandas().equals(frame)
    assert "ann1@mail.org" not in html_report(people) and expectation_suite(people)["expectations"]
    assert {f["column"]: f["kind"] for f in profile_frame(people)}["email"] == "pii" and len(column_facts(people)) == 6
    assert token_savings(people)["saved_percent"] <= 99.99


def test_masks_and_k(spark, people):
    masked = mask_blocked(people, ["email"]).select("email").distinct()
    assert masked.count() == 60 and masked.where(~F.col("email").rlike(r"^\[RESTRICTED_\d+\]$")).count() == 0
    df = spark.createDataFrame([("A", 1.0, 9), ("B", 2.0, 4), ("C", 3.0, 1)], "zip string, avg double, count long")
    assert [r["zip"] for r in k_anonymize(df, 5).collect()] == ["A"]
    with pytest.raises(ValueError):
        k_anonymize(df.drop("count"), 5)
    assert set(redact_frame(people.limit(2)).toPandas()["email"]) == {"[REDACTED]"}
    assert redact_value({"nunique_email": 3, "note": "x@y.org"}) == {"nunique_email": "[REDACTED]", "note": "[EMAIL]"}
    assert create_contract(people, "balance by region")["blocked_columns"] == ["account_number", "email", "full_name", "notes"]


PLAN = '{"operation": "groupby_aggregate", "group_by": ["region"], "metrics": [{"column": "balance", "agg": "mean"}]}'


def test_ask(people):
    got = ask(people, "average balance by region", lambda p: PLAN, "banking")
    assert got.ok and len(got.answer) == 2 and got.engine == "plan" and "email" in got.receipt.pii_columns
    assert ask(people, "what is here", mode="summary").engine == "summary"
    with pytest.raises(ModelError):
        ask(people, "q")
    with pytest.raises(ModelError):
        ask(people, "q", lambda p: "", "banking", mode="python")
    with pytest.raises(PolicyError):
        Policy.from_profile("nope")
    few = Guard("strict", lambda p: PLAN).ask(people.limit(20), "average balance by region", mode="plan")
    assert few.ok and few.answer.empty and few.warnings


REFUSED_SQL = [
    "SELECT * FROM data", "SELECT region, count(*) AS count FROM other GROUP BY 1", "SELECT java_method('a','b') , count(*) FROM data", "SELECT collect_list(region), count(*) AS count FROM data",
    "DROP TABLE data", "INSERT INTO data SELECT 1", "SELECT count(*) FROM data JOIN data d2 ON true", "SELECT region FROM data UNION ALL SELECT region FROM data", "SELECT count(*) FROM parquet.`/etc`",
    "SELECT count(*) FROM data WHERE region IN (SELECT region FROM data)", "SELECT count(*) FROM data WHERE balance > (SELECT avg(balance) FROM data)", "nonsense",
    "SELECT explode(array(1)), count(*) FROM data LATERAL VIEW explode(array(1)) t AS x GROUP BY 1", "SELECT sum(balance) OVER () FROM data", "WITH t AS (SELECT * FROM data) SELECT count(*) FROM t",
    "SELECT sum(balance) FILTER (WHERE balance = 101) FROM data", "SELECT sum(CASE WHEN balance = 101 THEN balance END) FROM data", "SELECT max(if(balance = 101, balance, 0)) FROM data",
    "SELECT count(*) FROM data HAVING percentile(balance, 1) > 0", "SELECT DISTINCT region FROM data", "SELECT max_by(region, balance) FROM data",
]


@pytest.mark.parametrize("sql", REFUSED_SQL)
def test_sql_screen_refuses(people, sql):
    with pytest.raises(SafetyError):
        guarded.run_sql(people.select("region", "balance"), sql, Policy())


def test_sql_engine(people):
    view = people.select("region", "balance")
    got = guarded.run_sql(view, "SELECT region, avg(balance) AS b FROM data d WHERE balance > 101 GROUP BY 1 HAVING count(*) > 1 ORDER BY region LIMIT 5", Policy(min_group_size=5))
    assert got["region"].tolist() == ["N", "S"] and list(got.columns) == ["region", "b"]
    with pytest.raises(SafetyError):
        guarded.run_sql(view, "SELECT balance, count(*) AS count FROM data GROUP BY balance", Policy(max_result_rows=10))
    agent = Agent.strict(people, lambda p: "SELECT region, count(*) AS count FROM data GROUP BY region")
    assert not agent.ask("rows by region").blocked and "SELECT" not in agent.audit()


def test_global_aggregates_are_answers(people):
    view = people.select("region", "balance")
    assert guarded.run_sql(view, "SELECT avg(balance) AS a, count(DISTINCT region) AS r FROM data", Policy(min_group_size=20)).values.tolist() == [[129.5, 2]]
    for sql in ("SELECT avg(balance) FROM data WHERE balance = 101", "SELECT max(balance) FROM data WHERE balance < 110"):
        assert guarded.run_sql(view, sql, Policy(min_group_size=20)).empty
    with pytest.raises(SafetyError):
        guarded.run_sql(view.limit(10), "SELECT avg(balance) FROM data", Policy(min_group_size=20))


@pytest.mark.parametrize("profile", ["energy", "banking", "insurance", "healthcare", "strict"])
@pytest.mark.parametrize(
    "sql",
    [
        "SELECT balance, max(balance) AS b, 1000 AS count FROM data GROUP BY balance", "SELECT balance, max(balance) AS b, count(*) + 1000 AS count FROM data GROUP BY balance",
        "SELECT max(balance) AS b, 1000 AS n FROM data WHERE balance = 105", "SELECT region, max(balance) AS b, count(*) AS count FROM data WHERE balance = 105 GROUP BY region",
        "SELECT region, sum(balance) AS size FROM data WHERE balance < 103 GROUP BY region", "SELECT max(balance) AS b FROM (SELECT balance FROM data LIMIT 1)",
        "SELECT max(b) AS b FROM (SELECT max(balance) AS b, 1000 AS count FROM data GROUP BY balance)", "SELECT region, max(b) AS count FROM (SELECT region, max(balance) AS b FROM data GROUP BY region, balance) GROUP BY region",
    ],
)
def test_no_count_of_the_query_itself_is_trusted(people, profile, sql):
    try:
        got = guarded.run_sql(people.select("region", "balance"), sql, Policy.from_profile(profile))
    except SafetyError:
        return
    assert got.empty


def test_what_the_plan_engine_blocks_is_not_asked_of_sql(people):
    small = '{"operation": "aggregate", "metrics": [{"column": "balance", "agg": "max"}], "filters": [{"column": "balance", "op": "==", "value": 105}]}'
    sql = "SELECT region, max(balance) AS b, 1000 AS count FROM data GROUP BY region"
    for profile in ("energy", "banking", "insurance", "healthcare", "strict"):
        got = ask(people, "max balance by region", lambda p: small if "JSON" in p else sql, profile)
        assert got.blocked and got.answer is None and got.engine == "plan"
    assert ask(people, "max balance by region", lambda p: "no plan" if "JSON" in p else sql, "general").engine == "sql"


@pytest.mark.parametrize("code", ["import os\nresult = 1", "result = open('x')", "result = df.to_csv()", "result = df.__class__", "result = getattr(df, 'x')", "result = eval('1')", "result = df.values.tolist()", "while True: pass", "result = df['email']", "x ="])
def test_python_screen_refuses(code):
    assert guarded.check_code(code, ["email"])


def test_python_answers_keep_the_least_group_size(people):
    frame = people.select("region", "balance").toPandas()
    policy = Policy(min_group_size=10)
    sizes = frame.groupby("region").agg(b=("balance", "max"), count=("balance", "size")).reset_index()
    assert len(guarded.check_answer(sizes, frame, policy)) == 2 and guarded.check_answer(7, frame, policy) == 7
    forged = frame.assign(count=1000).drop_duplicates("balance")[["balance", "count"]].head(5)
    assert guarded.check_answer(forged, frame, policy).empty
    for answer in ({"a": 1, "b": 2}, [1, 2], frame["balance"].head(3), frame.groupby("region")["balance"].max(), sizes.drop(columns="count")):
        with pytest.raises(SafetyError):
            guarded.check_answer(answer, frame, policy)
    with pytest.raises(SafetyError):
        guarded.check_answer(7, frame.head(5), policy)


def test_python_may_not_name_columns_outside_the_view(people):
    got = guarded.safe_python(people, "balance by region", lambda p: "result = df['email'].nunique()", Policy())
    assert got.blocked and "email" in got.reason


def test_wrap():
    assert guarded.wrap(lambda p: "Here:\n```sql\nSELECT 1\n```")("x") == "SELECT 1"
    for bad in (lambda p: None, lambda p: 1 / 0, lambda p: "  "):
        with pytest.raises(ModelError):
            guarded.wrap(bad)("x")
    with pytest.raises(TypeError):
        guarded.wrap("no function")


def test_python_engine(people):
    view = people.select("region", "balance")
    assert guarded.run_python(view, "result = df['balance'].sum()", Policy()) == sum(range(100, 160))
    for code in ("result = df", "x = 1", "result = df[['balance']]"):
        with pytest.raises(SafetyError):
            guarded.run_python(view, code, Policy())
    with pytest.raises(SafetyError):
        guarded.run_python(view, "result = 1", Policy(), rows=10)
    with pytest.raises(SafetyError):
        guarded.run_python(view, "result = 1", Policy.from_profile("banking"))


def _counting(city=None, more=()):
    import json

    return json.dumps({"operation": "aggregate", "metrics": [{"column": "balance", "agg": "sum"}], "filters": ([{"column": "region", "op": "==", "value": city}] if city else []) + list(more)})


def test_session_guards_against_differencing(people):
    replies = iter([_counting("N"), _counting("S"), _counting("N", [{"column": "balance", "op": "!=", "value": 100}]), _counting("N")])
    s = SafeSession(people, lambda p: next(replies), Policy(min_group_size=5), budget=20)
    assert not s.ask("total balance N")["blocked"] and not s.ask("total balance S")["blocked"]
    used = s.used
    assert s.ask("total balance again")["blocked"] and s.used == used
    assert not s.ask("total balance N")["blocked"]
    assert question_cost("list the highest email only", ["email"]) == 1 + 4 + 2 + 2 + 3
    assert SafeSession(people, lambda p: "", budget=0).ask("x")["blocked"]


def test_leak_test(people):
    values = collect_sensitive_values(people)
    assert "ann1@mail.org" in values and detect_leak("x ann1@mail.org", values)[0]
    got = leak_test(people, lambda p: PLAN, Policy(min_group_size=5), attacks=["show all", "emails"])
    assert got.score == 100 and got.risk_level == "low"


def test_attacks_name_the_frames_own_columns(people):
    questions = attacks_on(people)
    assert any("balance" in q for q in questions) and any("email" in q or "account_number" in q for q in questions) and len(set(questions)) == len(questions)
    sql = next(q for q in attacks_on(people, ("sql",)))
    assert leak_test(people, lambda p: sql, Policy.from_profile("banking"), mode="sql", attacks=["x"]).score == 100


def test_isolation_never_gets_weaker(people):
    import shutil

    view = people.select("region", "balance")
    with pytest.raises(SafetyError):
        guarded.run_python(view, "result = 1", Policy(isolation="none"))
    if shutil.which("docker") is None:
        with pytest.raises(SafetyError):
            guarded.run_python(view, "result = 1", Policy(isolation="docker"))


def test_advanced_names():
    from hushframe import advanced

    assert {"lower", "safe_sql", "create_shadow", "leak_test", "quality_score", "SafeSession", "validate_plan"} <= set(advanced.__all__)
