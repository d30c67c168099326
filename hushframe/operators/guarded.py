"""Guarded engines for model-written code.

SQL is the engine of choice.  The text is parsed by Catalyst; every node, expression and function of the tree must be on an
allow-list; the only relation is the safe view, put into the tree as a plan, never by name.  The answer must be one aggregation.
Its groups are counted by a column that the engine adds to the analysed aggregate, over the rows that reach it, and small
groups are dropped right above it: what the query itself calls a count is never trusted.  Aggregates take plain columns, since
a condition inside one could single out a row that the group's size hides.

Python is opt-in and last: the code is screened as a syntax tree and run in a process of its own over a bounded copy, with a
time limit.  Screening is a barrier, not a sandbox.
"""

from __future__ import annotations

import ast
import os
import pickle
import re
import shutil
import subprocess
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from py4j.java_gateway import JavaObject
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.errors import ModelError, SafetyError
from hushframe.operators.privacy import PrivacyPlan, check_result_rows, create_privacy_plan, make_safe_view, redact_value
from hushframe.operators.receipt import create_receipt
from hushframe.operators.summary import build_safe_prompt
from hushframe.policy import Policy

VIEW = "data"
#: What a query may be made of: plan nodes, expressions, aggregate functions and scalar functions.
NODES = frozenset("Project Filter Aggregate Sort GlobalLimit LocalLimit SubqueryAlias UnresolvedRelation UnresolvedHaving".split())
EXPRESSIONS = frozenset(
    "UnresolvedAttribute UnresolvedAlias UnresolvedFunction UnresolvedOrdinal UnresolvedStar Alias Literal SortOrder Cast CaseWhen And Or Not EqualTo EqualNullSafe GreaterThan "
    "GreaterThanOrEqual LessThan LessThanOrEqual In IsNull IsNotNull Like RLike Between Add Subtract Multiply Divide UnaryMinus Remainder IntegralDivide".split()
)
AGGREGATES = frozenset("count sum avg mean min max median std stddev stddev_samp variance var_samp".split())
FUNCTIONS = frozenset(
    "abs round floor ceil ceiling greatest least coalesce nullif if year quarter month day dayofmonth weekofyear hour date_trunc trunc to_date date lower upper trim length "
    "substring substr left right concat between like rlike".split()
)
PLAIN = frozenset("UnresolvedAttribute UnresolvedStar Literal".split())
RETRIES, PYTHON_ROWS, TIMEOUT = 3, 200_000, 10


@dataclass
class GuardedResult:
    answer: Any
    code: str | None
    blocked: bool
    reason: str | None
    receipt: dict
    attempts: int = 0


def extract_code(reply: str) -> str:
    """The code of a reply, without fences."""
    text = str(reply or "")
    m = re.search(r"```[a-zA-Z]*\n(.*?)```", text, re.S)
    code = (m[1] if m else text).strip()
    if not code:
        raise ModelError("the model returned no code")
    return code


def wrap(call: Callable[[str], Any], clean: Callable[[str], str] = extract_code) -> Callable[[str], str]:
    """Any function of text to text as a model: its failures become ModelError, its replies are cleaned."""
    if not callable(call):
        raise TypeError("wrap needs a function of a prompt")

    def model(prompt: str) -> str:
        try:
            reply = call(prompt)
        except Exception as e:
            raise ModelError(f"the model could not be called ({type(e).__name__}: {e})") from e
        if reply is None:
            raise ModelError("the model returned nothing")
        return clean(str(reply))

    return model


def check_sql(spark: SparkSession, sql: str) -> str:
    """The statement, if its parsed tree holds nothing but what is allowed; SafetyError otherwise."""
    text = sql.strip().rstrip(";")
    _parsed(spark, text)
    return text


def _parsed(spark: SparkSession, text: str) -> JavaObject:
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise SafetyError(f"the query cannot be parsed: {str(e).splitlines()[0]}") from None
    for node in _tree(tree, lambda n: _list(n.children())):
        name = node.nodeName().strip("'")
        if name not in NODES:
            raise SafetyError(f"the query uses {name}, which is not allowed")
        if name == "UnresolvedRelation" and (source := ".".join(_list(node.multipartIdentifier()))).lower() != VIEW:
            raise SafetyError(f"the query reads {source}; only '{VIEW}' may be read")
        for top in _list(node.expressions()):
            _check_expression(top)
    return tree


def _check_expression(top: JavaObject) -> None:
    for e in _tree(top, lambda x: _list(x.children())):
        kind = e.getClass().getSimpleName().rstrip("$")
        if kind not in EXPRESSIONS:
            raise SafetyError(f"expression {kind} is not allowed")
        if kind != "UnresolvedFunction":
            continue
        name = ".".join(_list(e.nameParts())).lower()
        if name not in AGGREGATES | FUNCTIONS:
            raise SafetyError(f"function {name} is not allowed")
        if name in AGGREGATES:
            inner = {x.getClass().getSimpleName() for x in _list(e.arguments())}
            if not e.filter().isEmpty() or inner - PLAIN:
                raise SafetyError(f"{name} takes a plain column; put conditions into WHERE")


def _tree(top: JavaObject, below: Callable[[JavaObject], list]) -> Iterator[JavaObject]:
    stack = [top]
    while stack:
        node = stack.pop()
        yield node
        stack += below(node)


def _list(s: JavaObject) -> list:
    return [s.apply(i) for i in range(s.size())]


class _Planner:
    """Catalyst plans of one view: the checked query over it, with small groups dropped inside the plan."""

    def __init__(self, view: DataFrame) -> None:
        self.spark, self.view, jvm = view.sparkSession, view, view.sparkSession._jvm
        one = lambda package, name: getattr(getattr(package, name + "$"), "MODULE$")
        self._dataset = one(jvm.org.apache.spark.sql.classic, "Dataset")
        self._named = one(jvm.org.apache.spark.sql.catalyst.plans.logical, "SubqueryAlias").apply
        self._seq, self._mark = jvm.PythonUtils.toSeq, f"view_{uuid.uuid4().hex}"

    def _frame(self, plan: JavaObject) -> DataFrame:
        return DataFrame(self._dataset.ofRows(self.spark._jsparkSession, plan), self.spark)

    def _placed(self, node: JavaObject) -> JavaObject:
        """The tree with the view's own plan in place of its name."""
        if node.nodeName().strip("'") == "UnresolvedRelation":
            return self._named(VIEW, self._named(self._mark, self.view._jdf.queryExecution().analyzed()))
        kids = [self._placed(k) for k in _list(node.children())]
        return node.withNewChildren(self._seq(kids)) if kids else node

    def run(self, text: str, k: int | None) -> DataFrame:
        """The answer as a lazy frame.  Exactly one aggregation may stand between the answer and the view."""
        try:
            plan = self._frame(self._placed(_parsed(self.spark, text)))._jdf.queryExecution().analyzed()
        except AnalysisException as e:
            raise SafetyError(f"the query does not fit the data: {str(e).splitlines()[0]}") from None
        above, node = [], plan
        while not (node.nodeName() == "SubqueryAlias" and node.identifier().name() == self._mark):
            (child,) = _list(node.children())
            above.append(node)
            node = child
        at = [i for i, n in enumerate(above) if n.nodeName() == "Aggregate"]
        if len(at) != 1:
            raise SafetyError("the query returns rows; it must aggregate" if not at else "aggregates of aggregates are not allowed")
        if not k:
            return self._frame(plan)
        hidden = f"rows_{uuid.uuid4().hex}"
        group = above[at[0]]
        rows = self.view.agg(F.count(F.lit(1)).alias(hidden))._jdf.queryExecution().analyzed().aggregateExpressions().apply(0)
        counted = group.copy(group.groupingExpressions(), self._seq([*_list(group.aggregateExpressions()), rows]), group.child(), group.hint())
        whole = self._frame(counted).where(F.col(hidden) >= k)._jdf.queryExecution().analyzed()
        for parent in reversed(above[: at[0]]):
            whole = parent.withNewChildren(self._seq([whole]))
        return self._frame(whole).drop(hidden)


def guarded_sql(view: DataFrame, sql: str, k: int | None = None) -> DataFrame:
    """The checked query over the view as a lazy frame; groups of fewer than ``k`` rows are not in it."""
    return _Planner(view).run(check_sql(view.sparkSession, sql), k)


def run_sql(view: DataFrame, sql: str, policy: Policy) -> pd.DataFrame:
    """The answer of a guarded query.  A single total over too few rows is refused; small groups are left out."""
    k = policy.min_group_size
    got = guarded_sql(view, sql, k).limit(policy.max_result_rows + 1).toPandas()
    check_result_rows(len(got), policy)
    if k and got.empty and view.limit(k).count() < k:
        raise SafetyError(f"fewer than {k} rows; the answer could point at individuals")
    return redact_value(got) if policy.redact_result_pii else got


def _loop(df: DataFrame, question: str, model: Callable[[str], str], policy: Policy, language: str, run: Callable[[DataFrame, str], Any]) -> GuardedResult:
    privacy: PrivacyPlan = create_privacy_plan(df, question, policy.safe_mode, policy.pii_scan_rows, policy.max_result_rows, policy.use_presidio)
    view, reason, code, answer, tries = make_safe_view(df, privacy), None, None, None, 0
    for tries in range(1, RETRIES + 1):
        prompt = build_safe_prompt(view, question) + f"\nAnswer with {language} only." + (f"\nThe last reply was refused: {reason}" if reason else "")
        try:
            code = extract_code(model(prompt))
            answer, reason = run(view, code), None
            break
        except (SafetyError, ModelError) as e:
            reason = str(e)
        except Exception as e:  # noqa: BLE001  fail closed
            reason = f"the code could not be run ({type(e).__name__})"
    receipt = create_receipt(question, language.split()[0].lower(), privacy, policy, answer, refused=reason)
    return GuardedResult(answer, code, reason is not None, reason, receipt, tries)


def safe_sql(df: DataFrame, question: str, model: Callable[[str], str], policy: Policy | None = None) -> GuardedResult:
    policy = policy or Policy.regulated()
    return _loop(df, question, model, policy, f"SQL (one SELECT that aggregates plain columns of the table {VIEW})", lambda view, sql: run_sql(view, sql, policy))


#: What screened Python may not use.
MODULES = frozenset({"pandas", "numpy", "math", "statistics", "datetime", "re"})
CALLS = frozenset("open exec eval compile __import__ input globals locals vars getattr setattr delattr dir breakpoint exit quit help memoryview print".split())
ATTRIBUTES = frozenset(
    "to_csv to_json to_pickle to_parquet to_excel to_sql to_html to_clipboard to_feather to_hdf to_dict to_records to_numpy tolist values itertuples iterrows items "
    "read_csv read_json read_pickle read_parquet read_excel read_sql read_html read_table eval query pipe save savetxt tofile load fromfile system popen environ "
    "write writeTo writeStream sparkSession rdd toLocalIterator collect foreach foreachPartition".split()
)


def check_code(code: str, blocked_columns: list[str] = ()) -> list[str]:
    """Reasons to refuse Python code, from its syntax tree alone; nothing is run."""
    try:
        tree = ast.parse(code)
    except SyntaxError as e:
        return [f"syntax error: {e.msg}"]
    found = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            roots = {a.name.split(".")[0] for a in node.names} if isinstance(node, ast.Import) else {(node.module or "").split(".")[0]}
            found += [f"import of {r}" for r in sorted(roots - MODULES)]
        elif isinstance(node, ast.Name) and (node.id in CALLS or node.id.startswith("__")):
            found.append(f"use of {node.id}")
        elif isinstance(node, ast.Attribute):
            if node.attr.startswith("_") or node.attr in ATTRIBUTES:
                found.append(f"attribute {node.attr}")
            if node.attr in blocked_columns:
                found.append(f"column {node.attr}")
        elif isinstance(node, ast.Constant) and isinstance(node.value, str):
            if "__" in node.value:
                found.append("a string with double underscores")
            found += [f"column {c}" for c in blocked_columns if c == node.value]
        elif isinstance(node, (ast.While, ast.AsyncFunctionDef, ast.ClassDef, ast.Global, ast.Nonlocal)):
            found.append(type(node).__name__)
    return found


_RUNNER = """
import pickle, sys, builtins
frame, code, out = pickle.load(open(sys.argv[1], "rb")), open(sys.argv[2]).read(), sys.argv[3]
import pandas, numpy, math, statistics, datetime, re
allowed = "abs all any bool dict divmod enumerate filter float int isinstance len list map max min pow range repr reversed round set sorted str sum tuple zip True False None Exception ValueError KeyError __import__".split()
space = {"__builtins__": {k: getattr(builtins, k) for k in allowed if hasattr(builtins, k)}, "df": frame, "pd": pandas, "np": numpy}
try:
    exec(compile(code, "<answer>", "exec"), space)
    if "result" not in space:
        raise ValueError("the code sets no 'result'")
    answer = ("ok", space["result"])
except Exception as e:
    answer = ("error", f"{type(e).__name__}: {e}")
pickle.dump(answer, open(out, "wb"))
"""


def run_python(view: DataFrame, code: str, policy: Policy, blocked_columns: list[str] = (), rows: int = PYTHON_ROWS, timeout: int = TIMEOUT) -> Any:
    """Screened code over a pandas copy of the view, in a process of its own.  Views over ``rows`` rows are refused, not sampled."""
    if not policy.allow_python_fallback:
        raise SafetyError("the policy does not allow Python")
    if found := check_code(code, list(blocked_columns)):
        raise SafetyError("refused: " + "; ".join(dict.fromkeys(found)))
    frame = view.limit(rows + 1).toPandas()
    if len(frame) > rows:
        raise SafetyError(f"the view has over {rows} rows; use the SQL engine")
    with tempfile.TemporaryDirectory() as d:
        paths = [os.path.join(d, n) for n in ("frame", "code", "out", "run.py")]
        frame.to_pickle(paths[0], compression=None)
        for p, text in ((paths[1], code), (paths[3], _RUNNER)):
            with open(p, "w", encoding="utf-8") as f:
                f.write(text)
        command = [sys.executable, "-I", paths[3], *paths[:3]]
        if policy.isolation == "docker":
            command = docker_command(d)
        elif policy.isolation != "process":
            raise SafetyError(f"unknown isolation {policy.isolation!r}")
        try:
            subprocess.run(command, timeout=timeout, check=False, capture_output=True, cwd=d, env={"PATH": os.environ.get("PATH", "")})
        except subprocess.TimeoutExpired:
            raise SafetyError(f"the code ran over {timeout} s") from None
        if not os.path.exists(paths[2]):
            raise SafetyError("the code ended without an answer")
        with open(paths[2], "rb") as f:
            status, answer = pickle.load(f)
    if status != "ok":
        raise SafetyError(answer)
    return check_answer(answer, frame, policy)


def docker_command(folder: str, image: str = "python-data:latest") -> list[str]:
    """A container without network, with a read-only root; there is no fallback to a weaker isolation."""
    if shutil.which("docker") is None:
        raise SafetyError("the policy asks for docker, which is not installed")
    limits = ["--network", "none", "--read-only", "--memory", "512m", "--cpus", "1", "--tmpfs", "/tmp"]
    return ["docker", "run", "--rm", *limits, "-v", f"{folder}:/work", image, "python", "-I", "/work/run.py", "/work/frame", "/work/code", "/work/out"]


def check_answer(answer: Any, frame: pd.DataFrame, policy: Policy) -> Any:
    """Size, shape and small-group rules for what Python code returns."""
    k = policy.min_group_size
    if isinstance(answer, (pd.DataFrame, pd.Series)):
        check_result_rows(len(answer), policy)
        if len(frame) and len(answer) >= len(frame) and len(frame) > 1:
            raise SafetyError("the answer has as many rows as the data")
        if policy.enforce_minimal_result and len(frame) > 20 and len(answer) > len(frame) / 2:
            raise SafetyError("the answer is not much smaller than the data")
        if policy.block_1d_row_results and isinstance(answer, pd.Series) and len(answer) > 1 and answer.index.equals(frame.index[: len(answer)]):
            raise SafetyError("the answer is a column of rows")
    elif isinstance(answer, (list, tuple, set, dict)):
        check_result_rows(len(answer), policy)
    if k:
        answer = _large_groups(answer, frame, k)
    if len(repr(answer)) > policy.max_result_bytes:
        raise SafetyError("the answer is too large")
    return redact_value(answer) if policy.redact_result_pii else answer


def _large_groups(answer: Any, frame: pd.DataFrame, k: int) -> Any:
    """The small-group rule for every shape of answer.

    Several values must be a frame of group keys with a count: a row stays if its own count and the size of its group in
    the data both reach ``k``.  One value needs ``k`` rows of data.  What the code filtered before it counted cannot be
    seen here, which is why every profile with a least group size forbids Python.
    """
    several = len(answer) > 1 if isinstance(answer, (pd.DataFrame, pd.Series, list, tuple, set, dict)) else False
    if not several:
        if len(frame) < k:
            raise SafetyError(f"fewer than {k} rows; the answer could point at individuals")
        return answer
    if not isinstance(answer, pd.DataFrame):
        raise SafetyError("several values must come as a frame of group keys with a count column")
    answer = answer.reset_index() if any(answer.index.names) else answer
    count = next((c for c in answer.columns if str(c).lower() in ("count", "n", "size")), None)
    keys = [c for c in answer.columns if c in frame.columns and c != count]
    if count is None or not keys:
        raise SafetyError("a grouped answer needs its group keys and a count column")
    sizes = frame.groupby(keys, dropna=False).size().rename("__size").reset_index()
    joined = answer.merge(sizes, on=keys, how="left")
    return answer[((joined["__size"] >= k) & (joined[count] >= k)).to_numpy()]


def safe_python(df: DataFrame, question: str, model: Callable[[str], str], policy: Policy | None = None) -> GuardedResult:
    policy = policy or Policy.basic()
    return _loop(df, question, model, policy, "Python code over the pandas frame df that sets result", lambda view, code: run_python(view, code, policy, [c for c in df.columns if c not in view.columns]))
