"""Sessions: a privacy budget, and a guard against differencing of near-equal questions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from hushframe.operators.privacy import privacy_report, protect_columns
from hushframe.operators.profile import shared
from hushframe.plans.execute import execute, prepare
from hushframe.plans.plan import Plan
from hushframe.policy import Policy
from hushframe.types import quoted

#: What a question costs, and the words that make it dearer.
COSTS = {"base": 1, "raw": 4, "narrow": 2, "high_risk": 2, "pii_column": 3}
WORDS = {
    "raw": ("show", "list", "all rows", "raw", "export", "email", "name"),
    "narrow": ("where", "excluding", "except", "only", "specific", "customer", "without", "remove", "not including"),
    "high_risk": ("highest", "lowest", "top", "bottom", "exact"),
}
BUDGET = 10


def question_cost(question: str, pii_columns: list[str], costs: dict | None = None) -> int:
    costs, low = costs or COSTS, question.lower()
    extra = sum(costs[k] for k, words in WORDS.items() if any(w in low for w in words))
    return costs["base"] + extra + costs["pii_column"] * sum(c.lower() in low for c in pii_columns)


def _shape(plan: Plan) -> tuple:
    return plan.operation, frozenset(plan.group_by), frozenset((m.column, m.agg) for m in plan.metrics)


def _facts(plan: Plan) -> frozenset:
    return frozenset((f["column"], f["op"], repr(f["value"])) for f in plan.filters)


def differencing(new: Plan, old: Plan) -> bool:
    """Two plans of one shape whose populations nest, or share their equalities and differ in a range or an exclusion."""
    a, b = _facts(new), _facts(old)
    if _shape(new) != _shape(old) or a == b:
        return False
    equal = lambda s: {x for x in s if x[1] == "=="}
    moved = lambda s: {x for x in s if x[1] in (">", ">=", "<", "<=", "!=")}
    return a < b or b < a or (equal(a) == equal(b) and moved(a) != moved(b))


@dataclass
class Event:
    question: str
    cost: int
    plan: Plan | None
    blocked: bool
    reason: str | None


@dataclass
class SafeSession:
    """Questions over one frame.  Column minimisation is that of ``protect``, as in single questions."""

    df: DataFrame
    model: Callable[[str], str]
    policy: Policy = field(default_factory=Policy.regulated)
    budget: int = BUDGET
    costs: dict = field(default_factory=lambda: dict(COSTS))
    used: int = 0
    events: list[Event] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.pii_columns = privacy_report(self.df, self.policy.pii_scan_rows, self.policy.use_presidio)["pii_columns"]

    def _out(self, answer: Any, receipt: dict | None, reason: str | None) -> dict:
        return {"answer": answer, "receipt": receipt, "blocked": reason is not None, "reason": reason, "used_budget": self.used, "remaining_budget": max(self.budget - self.used, 0)}

    @shared
    def ask(self, question: str) -> dict:
        cost = question_cost(question, self.pii_columns, self.costs)
        if self.used + cost > self.budget:
            self.events.append(Event(question, cost, None, True, "the session's privacy budget is spent"))
            return self._out(None, None, self.events[-1].reason)
        _, keep = protect_columns(self.df, question, self.policy)
        prepared = prepare(self.df.select(*map(quoted, keep)), question, self.model, self.policy) if keep else None
        plan = prepared.plan if prepared else None
        if plan is not None and any(e.plan is not None and not e.blocked and differencing(plan, e.plan) for e in self.events):
            self.events.append(Event(question, cost, plan, True, "narrowing the same aggregate again could reveal individuals"))
            return self._out(None, None, self.events[-1].reason)
        self.used += cost
        if prepared is None:
            self.events.append(Event(question, cost, None, True, "no column may be used for this question"))
            return self._out(None, None, self.events[-1].reason)
        got = execute(prepared)
        self.events.append(Event(question, cost, got.plan, got.blocked, got.reason))
        return self._out(got.answer, got.receipt, got.reason)
