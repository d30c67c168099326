"""Personal data, the minimum set of columns for a question, and the risk of sharing a frame."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.errors import SafetyError
from hushframe.functions import names as N
from hushframe.functions import patterns as P
from hushframe.operators.profile import profile, shared
from hushframe.policy import SAFE_MODES, Policy
from hushframe.types import is_numeric, is_text, quoted

_presidio_default = {"on": False}


def enable_presidio(on: bool = True) -> bool:
    """Use the optional entity recogniser by default; False if it is not installed."""
    _presidio_default["on"] = on
    return on and presidio_available()


def presidio_available() -> bool:
    try:
        import presidio_analyzer  # noqa: F401
    except ImportError:
        return False
    return True


#: Recogniser entities and the kinds they count as.
ENTITIES = {
    "EMAIL_ADDRESS": "email", "PHONE_NUMBER": "phone", "CREDIT_CARD": "card", "IBAN_CODE": "iban", "US_SSN": "national_id", "UK_NHS": "national_id",
    "US_PASSPORT": "national_id", "US_DRIVER_LICENSE": "national_id", "PERSON": "name", "LOCATION": "location", "IP_ADDRESS": "ip", "DATE_TIME": "date",
}


def presidio_kinds(df: DataFrame, least: float = 0.5) -> dict[str, list[str]]:
    """Kinds by text column from the optional recogniser: one engine for each Python worker; {} if it is absent."""
    if not presidio_available():
        return {}
    names = [f.name for f in df.schema.fields if is_text(f.dataType)]

    def run(batches):
        from presidio_analyzer import AnalyzerEngine

        engine = AnalyzerEngine()
        import pandas as pd

        for pdf in batches:
            found = {(c, ENTITIES[r.entity_type]) for c in names for v in pdf[c].dropna().unique() for r in engine.analyze(text=v, language="en") if r.score >= least and r.entity_type in ENTITIES}
            yield pd.DataFrame(sorted(found), columns=["column", "kind"])

    out: dict[str, list[str]] = {}
    for r in df.select(*map(quoted, names)).mapInPandas(run, "column string, kind string").distinct().collect():
        out.setdefault(r["column"], []).append(r["kind"])
    return {k: sorted(v) for k, v in out.items()}


@shared
def all_pii(df: DataFrame, scan_rows: int | str | None = "all", use_presidio: bool | None = None) -> dict[str, dict]:
    """``{column: {"kinds", "by"}}``; values are better evidence than names."""
    p = profile(df, scan_rows)
    out = {}
    for n, c in p.columns.items():
        if c.pii:
            out[n] = {"kinds": list(c.pii), "by": "value"}
        elif k := N.pii_kind(n):
            out[n] = {"kinds": [k], "by": "name"}
    if _presidio_default["on"] if use_presidio is None else use_presidio:
        for n, kinds in presidio_kinds(df).items():
            own = out[n]["kinds"] if out.get(n, {}).get("by") == "value" else []
            out[n] = {"kinds": sorted({*own, *kinds}), "by": "value"}
    return out


@shared
def privacy_report(df: DataFrame, scan_rows: int | str | None = "all", use_presidio: bool | None = None) -> dict:
    high, medium, actions = [], [], []
    for n, info in all_pii(df, scan_rows, use_presidio).items():
        by_value = info["by"] == "value"
        (high if by_value or N.HIGH_RISK_KINDS & {*info["kinds"]} else medium).append({"column": n, **info})
        actions.append(f"{'mask or drop' if by_value else 'review'} '{n}' ({'contains' if by_value else 'name suggests'} {', '.join(info['kinds'])})")
    return {"pii_columns": sorted(x["column"] for x in high + medium), "high_risk": high, "medium_risk": medium, "recommended_action": actions, "note": "best effort: patterns and names, no guarantee of compliance"}


@shared
def risk_score(df: DataFrame, question: str | None = None, scan_rows: int | str | None = "all", use_presidio: bool | None = None, columns: list[str] | None = None) -> dict:
    """0 to 100.  ``columns`` scores a projection from the whole frame's profile, without another pass."""
    from hushframe.operators.quality import validate

    inside = set(df.columns if columns is None else columns)
    report = privacy_report(df, scan_rows, use_presidio)
    high, medium = ([x["column"] for x in report[k] if x["column"] in inside] for k in ("high_risk", "medium_risk"))
    pii = sorted({*high, *medium})
    score, reasons = 0, []
    if high:
        score, reasons = 50, [f"sensitive personal data: {', '.join(high)}"]
    elif medium:
        score, reasons = 25, [f"possible personal data: {', '.join(medium)}"]
    if question and (spare := [c for c in pii if not N.mentioned(question, c)]):
        score += 15
        reasons.append(f"the question does not need {', '.join(spare)}")
    traps = {i.rule_id for i in validate(df, scan_rows=scan_rows) if i.column in inside} & {"TEXT_NUMERIC", "DATE_AS_TEXT", "EXCEL_SERIAL_DATE", "MESSY_CATEGORY", "DUPLICATE_COLUMNS"}
    if traps:
        score += min(20, 5 * len(traps))
        reasons.append(f"data traps: {', '.join(sorted(traps))}")
    score = min(100, score)
    level = "high" if score >= 60 else "medium" if score >= 30 else "low"
    return {"risk_level": level, "score": score, "reasons": reasons or ["no personal data or major traps found"], "pii_columns": pii, "recommended_mode": "strict" if level == "high" else "safe"}


@dataclass
class PrivacyPlan:
    question: str
    safe_mode: str
    operation: str
    allowed_columns: list[str]
    dropped_columns: list[str]
    pii_columns: list[str]
    dropped_pii_columns: list[str]
    retained_pii_columns: list[str]
    original_risk_level: str
    safe_view_risk_level: str
    risk_level: str
    result_policy: dict
    audit: dict
    reason: str
    warnings: list[str] = field(default_factory=list)

    def to_dict(self) -> dict:
        return asdict(self)


@shared
def create_privacy_plan(df: DataFrame, question: str = "", safe_mode: str = "drop_unneeded_pii", scan_rows: int | str | None = "all", max_result_rows: int = 50, use_presidio: bool | None = None) -> PrivacyPlan:
    """The least columns that answer the question: personal data it does not name goes; ``minimal`` keeps only what it names."""
    if safe_mode not in SAFE_MODES:
        raise ValueError(f"safe_mode must be one of {SAFE_MODES}, not {safe_mode!r}")
    cols, pii = df.columns, privacy_report(df, scan_rows, use_presidio)["pii_columns"]
    named = {c for c in cols if N.mentioned(question, c)}
    spare, warnings = set(pii) - named, []
    if safe_mode == "minimal":
        keep = set(named)
        if not keep - set(pii):
            keep |= set(cols) - set(pii)
            warnings.append("minimal: the question names no analytical column; all without personal data are kept")
        warnings.append("minimal: columns are matched by name; if one is missing the answer may be wrong")
        reason = "kept the columns that the question names"
    else:
        keep, reason = set(cols) - spare, "dropped personal data that the question does not name"
    allowed = [c for c in cols if c in keep]
    operation = N.detect_operation(question)
    original = risk_score(df, question, scan_rows, use_presidio)["risk_level"]
    safe = risk_score(df, question, scan_rows, use_presidio, allowed)["risk_level"]
    dropped = [c for c in cols if c not in keep]
    audit = {"question": question, "operation": operation, "allowed": allowed, "dropped_pii": sorted(spare), "retained_pii": sorted(set(pii) & named), "dropped_other": [c for c in dropped if c not in pii]}
    rules = {"max_result_rows": max_result_rows, "max_result_bytes": 1_000_000, "redact_result_pii": True, "enforce_minimal_result": operation in ("aggregate", "ranking", "trend")}
    return PrivacyPlan(question, safe_mode, operation, allowed, dropped, pii, sorted(spare), sorted(set(pii) & named), original, safe, original, rules, audit, reason, warnings)


def make_safe_view(df: DataFrame, plan: PrivacyPlan) -> DataFrame:
    """The allowed columns in the frame's order: a projection, pruned at the scan."""
    return df.select(*map(quoted, plan.allowed_columns))


def classify_columns(df: DataFrame, pii: list[str], match: str = "substring") -> dict[str, list[str]]:
    out: dict[str, list[str]] = {k: [] for k in ("business_identifier", "financial", "health", "location", "free_text", "quasi_identifier")}
    for f in df.schema.fields:
        for k in N.categories(f.name, is_text(f.dataType), f.name in pii, match):
            out[k].append(f.name)
    return out


def scan_risk_level(base: str, pii: list[str], cats: dict[str, list[str]]) -> str:
    if cats["health"] or (cats["financial"] and (cats["business_identifier"] or pii)):
        return "high"
    return "medium" if base == "low" and (pii or cats["business_identifier"] or cats["free_text"]) else base


@shared
def protect_columns(df: DataFrame, question: str | None, policy: Policy) -> tuple[PrivacyPlan, list[str]]:
    """The privacy plan and the columns that ``protect`` keeps."""
    plan = create_privacy_plan(df, question or "", policy.safe_mode, policy.pii_scan_rows, policy.max_result_rows, policy.use_presidio)
    cats = classify_columns(df, plan.pii_columns)
    risky = {*cats["business_identifier"], *cats["free_text"], *cats["health"], *cats["quasi_identifier"]}
    keep = plan.allowed_columns if policy.allow_raw_rows else [c for c in plan.allowed_columns if c not in risky or N.needed(question, c)]
    return plan, keep


#: What a contract says may be done with the frame, and what may not.
ALLOWED_OPERATIONS = ["filter", "groupby", "aggregate", "sort", "derive_column", "join_in_memory", "describe"]
BLOCKED_OPERATIONS = ["file_read", "file_write", "network", "shell", "code_eval", "raw_row_return"]


@shared
def create_contract(df: DataFrame, question: str | None = None, scan_rows: int | str | None = "all") -> dict:
    """A declarative policy for one frame and question."""
    from hushframe.operators.quality import TRAPS, infer_columns, validate

    report = privacy_report(df, scan_rows)
    blocked = [c for c in report["pii_columns"] if not N.mentioned(question, c)]
    level = "strict" if report["high_risk"] else "review" if report["medium_risk"] else "low"
    return {
        "question": question, "allowed_columns": [c for c in df.columns if c not in blocked], "blocked_columns": blocked,
        "allowed_operations": list(ALLOWED_OPERATIONS), "blocked_operations": list(BLOCKED_OPERATIONS),
        "data_traps": [{"column": i.column, "rule_id": i.rule_id, "issue": i.message} for i in validate(df) if i.rule_id in TRAPS],
        "privacy_level": level, "max_result_rows": 50, "column_types": infer_columns(df),
        "reason": "personal data that the question does not name is blocked" if question else "all personal data is blocked", "note": report["note"],
    }


def mask_blocked(df: DataFrame, blocked: list[str]) -> DataFrame:
    """Blocked columns become ``[RESTRICTED_nnn]`` with a number for each row.

    Rows have no position here, so the number is unique and increasing within a partition, not gapless; numbering rows without gaps would take one task.
    """
    tag = F.format_string("[RESTRICTED_%03d]", F.monotonically_increasing_id())
    return df.select(*[tag.alias(c) if c in blocked else quoted(c) for c in df.columns])


def count_column(df: DataFrame) -> str | None:
    """The first numeric column named like a count."""
    return next((f.name for f in df.schema.fields if is_numeric(f.dataType) and N.tokens(f.name) & N.COUNT_TOKENS), None)


def k_anonymize(df: DataFrame, k: int, count_col: str | None = None) -> DataFrame:
    """Rows whose count reaches ``k``."""
    name = count_col or count_column(df)
    if name is None or name not in df.columns:
        raise ValueError("no count column; name one")
    return df.where(quoted(name) >= k)


def key_suggests_pii(key: Any) -> bool:
    """Whether a dict key or output name points at personal data; an aggregate's prefix does not hide it."""
    return N.pii_kind(str(key)) is not None


@shared
def redact_frame(df: DataFrame) -> DataFrame:
    """Columns named like personal data, or holding it, become ``[REDACTED]``; other text is redacted by pattern.  For bounded results."""
    info = all_pii(df)
    return df.select(*[F.when(quoted(f.name).isNotNull(), F.lit("[REDACTED]")).alias(f.name) if f.name in info else P.redact(quoted(f.name)).alias(f.name) if is_text(f.dataType) else quoted(f.name) for f in df.schema.fields])


def redact_value(v: Any) -> Any:
    """Redaction of a driver-side answer: texts, lists, dicts (by key), frames."""
    import pandas as pd

    if isinstance(v, str):
        return P.redact_text(v)
    if isinstance(v, dict):
        return {k: "[REDACTED]" if key_suggests_pii(k) and not isinstance(x, (dict, list)) else redact_value(x) for k, x in v.items()}
    if isinstance(v, (list, tuple, set)):
        return type(v)(redact_value(x) for x in v)
    if isinstance(v, pd.Series):
        if v.name is not None and key_suggests_pii(v.name):
            return v.map(lambda _: "[REDACTED]")
        return v.map(P.redact_text)
    if isinstance(v, pd.DataFrame):
        out = v.copy()
        for c in out.columns:
            texts = [x for x in out[c] if isinstance(x, str)]
            if key_suggests_pii(c) or any(P.text_kinds(x) for x in texts):
                out[c] = "[REDACTED]"
        return out
    return v


def check_result_rows(rows: int, policy: Policy) -> None:
    if rows > policy.max_result_rows:
        raise SafetyError(f"the result has {rows} rows; at most {policy.max_result_rows} may be returned")
