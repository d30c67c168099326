"""Prepare a plan from a model's reply, run it under the policy, and fail closed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from hushframe.errors import ModelError, SafetyError
from hushframe.operators.privacy import PrivacyPlan, create_privacy_plan, make_safe_view, redact_value
from hushframe.operators.profile import shared
from hushframe.operators.receipt import create_receipt
from hushframe.operators.shadow import shadow_rows
from hushframe.plans.lower import ROWS, lower
from hushframe.plans.plan import AGGREGATES, COMPARISONS, OPERATIONS, Plan, extract_json, parse, validate
from hushframe.policy import Policy

RETRIES = 3


@dataclass
class PlanResult:
    answer: Any
    plan: Plan | None
    blocked: bool
    reason: str | None
    receipt: dict
    attempts: int = 0


@dataclass
class Prepared:
    """A validated plan over a safe view, not yet run."""

    question: str
    view: DataFrame
    privacy: PrivacyPlan
    policy: Policy
    plan: Plan | None
    reason: str | None
    attempts: int

    def frame(self) -> DataFrame:
        """The plan's lazy result, before the checks that need an action."""
        if self.plan is None:
            raise SafetyError(self.reason or "there is no plan")
        return lower(self.view, self.plan, self.policy.min_group_size, self.policy.max_result_rows)


def run_plan(view: DataFrame, plan: Plan, policy: Policy) -> Any:
    """The answer: a dict for ``aggregate`` and ``count_rows``, else a pandas frame of at most ``max_result_rows`` rows.

    One Spark job; the row count that small-group checks need comes with the result.
    """
    k = policy.min_group_size
    out = lower(view, plan, k, policy.max_result_rows)
    if plan.operation in ("count_rows", "aggregate"):
        got = out.first().asDict()
        rows = got.pop(ROWS)
        if k and rows < k and (plan.operation == "aggregate" or plan.filters):
            raise SafetyError(f"fewer than {k} rows; the answer could point at individuals")
        answer: Any = got
    else:
        answer = out.toPandas()
        if ROWS in answer:
            rows = int(answer[ROWS].iloc[0]) if len(answer) else 0
            answer = answer.drop(columns=ROWS)
            if k and rows < k:
                raise SafetyError(f"fewer than {k} rows; the answer could point at individuals")
    return redact_value(answer) if policy.redact_result_pii else answer


def plan_prompt(view: DataFrame, question: str, policy: Policy, error: str | None = None) -> str:
    """What the model sees: schema, synthetic rows of the same shape, the language, the question.  No real values."""
    schema = "\n".join(f"- {f.name}: {f.dataType.simpleString()}" for f in view.schema.fields)
    sample = shadow_rows(view, rows=8).to_csv(index=False)
    parts = [
        "Answer with one JSON object and nothing else.", f"Columns:\n{schema}", f"Synthetic rows of the same shape:\n{sample}",
        f"Keys: operation ({', '.join(OPERATIONS)}), group_by (list), metrics (list of column, agg, as_name; agg one of {', '.join(AGGREGATES)}), "
        f"filters (list of column, op, value; op one of {' '.join(COMPARISONS)}), sort_by, ascending, limit (1 to {policy.max_result_rows}), include_count.",
        "For 'top N' use sort_by with ascending false and limit N.", f"Question: {question}",
    ]
    return "\n\n".join([*parts, f"The last reply was refused: {error}"] if error else parts)


@shared
def prepare(df: DataFrame, question: str, model: Callable[[str], str], policy: Policy | None = None, retries: int = RETRIES) -> Prepared:
    """Minimise columns, ask the model for a plan, validate it; refusals are told to the model for another try."""
    policy = policy or Policy.regulated()
    privacy = create_privacy_plan(df, question, policy.safe_mode, policy.pii_scan_rows, policy.max_result_rows, policy.use_presidio)
    view = make_safe_view(df, privacy)
    reason, attempts = None, 0
    if not privacy.allowed_columns:
        return Prepared(question, view, privacy, policy, None, "no column may be used for this question", 0)
    for attempts in range(1, retries + 1):
        try:
            reply = model(plan_prompt(view, question, policy, reason))
            plan = validate(parse(extract_json(reply)), view.schema, policy.max_result_rows)
            return Prepared(question, view, privacy, policy, plan, None, attempts)
        except (SafetyError, ModelError) as e:
            reason = str(e)
    return Prepared(question, view, privacy, policy, None, reason, attempts)


def execute(prepared: Prepared) -> PlanResult:
    """Run a prepared plan.  Whatever goes wrong is a blocked result, never a partial answer."""
    answer, reason = None, prepared.reason
    if prepared.plan is not None:
        try:
            validate(prepared.plan, prepared.view.schema, prepared.policy.max_result_rows)
            answer = run_plan(prepared.view, prepared.plan, prepared.policy)
        except SafetyError as e:
            reason = str(e)
        except Exception as e:  # noqa: BLE001  fail closed
            reason = f"the plan could not be run ({type(e).__name__})"
    receipt = create_receipt(prepared.question, "plan", prepared.privacy, prepared.policy, answer, prepared.plan, reason)
    return PlanResult(answer, prepared.plan, reason is not None, reason, receipt, prepared.attempts)


@shared
def safe_query(df: DataFrame, question: str, model: Callable[[str], str], policy: Policy | None = None) -> PlanResult:
    return execute(prepare(df, question, model, policy))
