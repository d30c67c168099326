"""An agent: a model and a policy that answer questions in a guarded language and keep an audit trail."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from hushframe.operators.guarded import GuardedResult, safe_python, safe_sql
from hushframe.operators.privacy import all_pii
from hushframe.operators.profile import shared
from hushframe.operators.quality import validate
from hushframe.operators.report import html_audit
from hushframe.policy import Policy


@dataclass
class Agent:
    df: DataFrame
    model: Callable[[str], str]
    policy: Policy = field(default_factory=Policy.regulated)
    language: str = "sql"
    history: list[dict] = field(default_factory=list)

    @classmethod
    def safe(cls, df: DataFrame, model: Callable[[str], str]) -> Agent:
        return cls(df, model, Policy.basic())

    @classmethod
    def strict(cls, df: DataFrame, model: Callable[[str], str]) -> Agent:
        return cls(df, model, Policy.strict())

    def ask(self, question: str) -> GuardedResult:
        got = {"sql": safe_sql, "python": safe_python}[self.language](self.df, question, self.model, self.policy)
        self.history.append(got.receipt)
        return got

    @shared
    def facts(self) -> dict:
        """What the audit says about the data: findings and personal data, no values."""
        return {"issues": [i.to_dict() for i in validate(self.df)], "pii": all_pii(self.df)}

    def audit(self, path: str | None = None) -> str:
        return html_audit(self.history, path)
