"""The plan: a small JSON object, parsed with strict types and validated against a schema."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from hushframe.errors import SafetyError
from hushframe.types import can_sum, is_boolean, is_numeric, is_plain

OPERATIONS = ("aggregate", "count_rows", "describe", "groupby_aggregate", "value_counts")
REFUSED = ("raw_rows", "select_rows", "show_rows", "to_csv", "to_dict", "export", "sample", "head")
AGGREGATES = ("sum", "mean", "median", "min", "max", "count", "nunique", "std")
NUMERIC_ONLY = ("sum", "mean", "median", "std")
COMPARISONS = ("==", "!=", ">", ">=", "<", "<=", "in")
ORDERED = (">", ">=", "<", "<=")
_alias = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,63}")


@dataclass(frozen=True)
class Metric:
    column: str
    agg: str
    as_name: str | None = None

    @property
    def name(self) -> str:
        return self.as_name or f"{self.agg}_{self.column}"


@dataclass(frozen=True)
class Plan:
    operation: str
    group_by: tuple[str, ...] = ()
    metrics: tuple[Metric, ...] = ()
    filters: tuple[dict, ...] = field(default=())
    sort_by: str | None = None
    ascending: bool = False
    limit: int | None = None
    include_count: bool = True

    def to_dict(self) -> dict:
        return {
            "operation": self.operation, "group_by": list(self.group_by), "metrics": [{"column": m.column, "agg": m.agg, "as_name": m.as_name} for m in self.metrics],
            "filters": [dict(f) for f in self.filters], "sort_by": self.sort_by, "ascending": self.ascending, "limit": self.limit, "include_count": self.include_count,
        }


def extract_json(reply: str) -> dict:
    """The JSON object of a model's reply, code fences and prose around it aside."""
    text = re.sub(r"```[a-zA-Z]*", "", str(reply))
    start, end = text.find("{"), text.rfind("}")
    if start < 0 or end <= start:
        raise SafetyError("the reply holds no JSON object")
    try:
        found = json.loads(text[start : end + 1])
    except ValueError as e:
        raise SafetyError(f"the reply is not valid JSON: {e}") from None
    if not isinstance(found, dict):
        raise SafetyError("the plan must be a JSON object")
    return found


def parse(raw: Any) -> Plan:
    """A plan of a dict; types are checked, never converted."""
    if isinstance(raw, Plan):
        return raw
    if not isinstance(raw, dict):
        raise SafetyError("the plan must be a JSON object")

    def listed(key: str) -> list:
        v = raw.get(key)
        if v is None:
            return []
        if not isinstance(v, list):
            raise SafetyError(f"{key} must be a list")
        return v

    def flag(key: str, default: bool) -> bool:
        v = raw.get(key, default)
        if not isinstance(v, bool):
            raise SafetyError(f"{key} must be true or false")
        return v

    operation = raw.get("operation")
    if not isinstance(operation, str):
        raise SafetyError("operation must be a string")
    metrics = []
    for m in listed("metrics"):
        if not isinstance(m, dict) or not isinstance(m.get("column"), str) or not isinstance(m.get("agg"), str):
            raise SafetyError("a metric needs a column and an agg")
        if m.get("as_name") is not None and not isinstance(m["as_name"], str):
            raise SafetyError("as_name must be a string")
        metrics.append(Metric(m["column"], m["agg"], m.get("as_name")))
    for key in ("sort_by",):
        if raw.get(key) is not None and not isinstance(raw[key], str):
            raise SafetyError(f"{key} must be a string")
    limit = raw.get("limit")
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int)):
        raise SafetyError("limit must be a whole number")
    return Plan(operation, tuple(listed("group_by")), tuple(metrics), tuple(listed("filters")), raw.get("sort_by"), flag("ascending", False), limit, flag("include_count", True))


def _scalar(v: Any) -> bool:
    return v is None or isinstance(v, (str, int, float, bool))


def validate(plan: Plan, schema: T.StructType, max_result_rows: int) -> Plan:
    """Refuse a plan that does not fit the schema or the language; returns it otherwise."""
    types = {f.name: f.dataType for f in schema.fields}

    def known(name: Any, role: str) -> T.DataType:
        if not isinstance(name, str):
            raise SafetyError(f"{role} must be a column name")
        if name not in types:
            raise SafetyError(f"{role}: column {name!r} is not available")
        if not is_plain(types[name]):
            raise SafetyError(f"{role}: column {name!r} is nested or binary")
        return types[name]

    op = plan.operation
    if op in REFUSED:
        raise SafetyError(f"operation {op!r} returns rows and is refused")
    if op not in OPERATIONS:
        raise SafetyError(f"unknown operation {op!r}")
    if plan.limit is not None and not 1 <= plan.limit <= max_result_rows:
        raise SafetyError(f"limit must be between 1 and {max_result_rows}")
    for g in plan.group_by:
        known(g, "group_by")
    if len(set(plan.group_by)) != len(plan.group_by) or "count" in plan.group_by:
        raise SafetyError("group keys must differ, and none may be called 'count'")
    for m in plan.metrics:
        t = known(m.column, "metric")
        if m.agg not in AGGREGATES:
            raise SafetyError(f"unknown aggregate {m.agg!r}")
        if m.agg in NUMERIC_ONLY and not can_sum(t):
            raise SafetyError(f"{m.agg} needs a numeric column, {m.column!r} is not")
        if m.as_name is not None and (not _alias.fullmatch(m.as_name) or m.as_name == "count"):
            raise SafetyError(f"bad metric name {m.as_name!r}")
    names = [*plan.group_by, *(m.name for m in plan.metrics)]
    if len(set(names)) != len(names) or "count" in names:
        raise SafetyError("two outputs share a name")
    for f in plan.filters:
        if not isinstance(f, dict) or set(f) - {"column", "op", "value"} or "value" not in f:
            raise SafetyError("a filter has a column, an op and a value, nothing else")
        t = known(f.get("column"), "filter")
        if f.get("op") not in COMPARISONS:
            raise SafetyError(f"unknown filter operator {f.get('op')!r}")
        v = f["value"]
        if f["op"] == "in":
            if not isinstance(v, list) or not all(map(_scalar, v)):
                raise SafetyError("'in' needs a list of plain values")
        elif not _scalar(v):
            raise SafetyError("a filter value must be a plain value")
        if f["op"] in ORDERED and v is not None:
            number = isinstance(v, (int, float)) and not isinstance(v, bool)
            if (is_numeric(t) or is_boolean(t)) != number:
                raise SafetyError(f"cannot order column {f['column']!r} against {v!r}")
    if op == "aggregate" and not plan.metrics:
        raise SafetyError("aggregate needs a metric")
    if op == "groupby_aggregate" and not (plan.group_by and plan.metrics):
        raise SafetyError("groupby_aggregate needs group_by and metrics")
    if op == "value_counts" and len(plan.group_by) != 1:
        raise SafetyError("value_counts needs exactly one column in group_by")
    if plan.sort_by is not None and plan.sort_by not in {*names, "count"}:
        raise SafetyError(f"sort_by {plan.sort_by!r} is not an output")
    return plan
