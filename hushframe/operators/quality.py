"""Data-quality findings, scores and readiness, all read from one profile."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.functions import names as N
from hushframe.functions import patterns as P
from hushframe.operators.profile import ColumnProfile, profile, shared
from hushframe.types import is_boolean, is_numeric, is_plain, is_text, is_time, present

NUMERIC_SHARE, DATE_SHARE, SERIAL_SHARE, CARDINALITY, MISSING = 0.7, 0.9, 0.9, 0.9, 0.6
#: Rules that can make an analysis wrong.
TRAPS = frozenset(
    "TEXT_NUMERIC DATE_AS_TEXT EXCEL_SERIAL_DATE MESSY_CATEGORY CONSTANT_COLUMN NON_UNIQUE_ID EMPTY_COLUMN HIGH_MISSING UNEXPECTED_NEGATIVE DUPLICATE_COLUMNS HIGH_CARDINALITY".split()
)
ABOUT = {
    "DUPLICATE_COLUMNS": "Two columns share a name, so access by name is ambiguous.",
    "TEXT_NUMERIC": "Numbers are stored as text: sums fail or join strings.",
    "DATE_AS_TEXT": "Dates are stored as text: order and arithmetic are wrong.",
    "MESSY_CATEGORY": "One category is spelt several ways: groups split.",
    "HIGH_CARDINALITY": "Nearly every value differs: grouping tells little.",
    "CONSTANT_COLUMN": "Every value is the same: the column tells nothing.",
    "NON_UNIQUE_ID": "An id column repeats values: joins and counts multiply.",
    "EMPTY_COLUMN": "The column has no values.",
    "HIGH_MISSING": "Most values are missing: averages rest on few rows.",
    "EXCEL_SERIAL_DATE": "Dates are stored as spreadsheet day numbers.",
    "UNEXPECTED_NEGATIVE": "A quantity that should not be negative is.",
    "PII": "The column holds or names personal data.",
}


@dataclass
class Issue:
    rule_id: str
    severity: str
    confidence: float
    column: str | None
    message: str
    evidence: Any = None
    suggestion: str = ""
    suggested_code: str = ""

    def __getitem__(self, key: str) -> Any:
        return getattr(self, key)

    def get(self, key: str, default: Any = None) -> Any:
        return getattr(self, key, default)

    def to_dict(self) -> dict:
        return asdict(self)


def _ref(n: str) -> str:
    return f"F.col({'`' + n + '`'!r})"


def _of_column(c: ColumnProfile, rows: int) -> list[Issue]:
    out: list[Issue] = []
    add = lambda *a, **k: out.append(Issue(*a, **k))
    n, ref = c.name, _ref(c.name)
    if is_text(c.dtype) and c.present:
        if c.numeric_like >= NUMERIC_SHARE:
            add("TEXT_NUMERIC", "high", round(c.numeric_like, 4), n, f"'{n}' holds numbers as text", suggestion="cast to a number first", suggested_code=f"df.withColumn({n!r}, F.regexp_replace({ref}, r'[^0-9.\\-]', '').try_cast('double'))")
        elif c.date_like >= DATE_SHARE:
            add("DATE_AS_TEXT", "medium", round(c.date_like, 4), n, f"'{n}' holds dates as text", suggestion="parse to a timestamp first", suggested_code=f"df.withColumn({n!r}, F.try_to_timestamp({ref}))")
        if c.distinct > c.distinct_normal:
            add("MESSY_CATEGORY", "medium", 0.8, n, f"'{n}' spells one category several ways", suggestion="normalise before grouping", suggested_code=f"df.withColumn({n!r}, F.lower(F.trim({ref})))")
        if rows > 5 and c.distinct / rows >= CARDINALITY:
            add("HIGH_CARDINALITY", "low", 0.6, n, f"'{n}' has {c.distinct} distinct values in {rows} rows", suggestion="do not group by it")
    if is_plain(c.dtype) and c.present > 1 and c.distinct == 1:
        add("CONSTANT_COLUMN", "low", 1.0, n, f"'{n}' has one value only", suggestion="leave it out", suggested_code=f"df.drop({n!r})")
    if is_plain(c.dtype) and N.ends_like_id(n) and c.present > c.distinct:
        add("NON_UNIQUE_ID", "medium", round(min(1.0, 0.5 + (c.present - c.distinct) / max(c.present, 1)), 4), n, f"'{n}' looks like an id but repeats values", suggestion="count distinct values")
    if rows and not c.present:
        add("EMPTY_COLUMN", "medium", 1.0, n, f"'{n}' is 100% missing", suggestion="drop it", suggested_code=f"df.drop({n!r})")
    elif c.missing >= MISSING:
        add("HIGH_MISSING", "medium", round(c.missing, 4), n, f"'{n}' is {P.missing_label(c.missing)} missing", suggestion="say how many rows a figure rests on")
    if is_numeric(c.dtype) and N.hints_date(n) and c.present and c.serial_like >= SERIAL_SHARE:
        add("EXCEL_SERIAL_DATE", "medium", 0.85, n, f"'{n}' holds spreadsheet day numbers", suggestion="convert to dates", suggested_code=f"df.withColumn({n!r}, F.date_add(F.lit('1899-12-30').cast('date'), {ref}.cast('int')))")
    if is_numeric(c.dtype) and N.hints_nonnegative(n) and c.present >= 2:
        scale = max(abs(float(c.least)), abs(float(c.most)))
        if float(c.least) < -max(1e-3 * scale, 1e-6):
            add("UNEXPECTED_NEGATIVE", "medium", 0.7, n, f"'{n}' has negative values (least {c.least})", suggestion="check them before summing")
    return out


#: Order in which findings are listed.
_ORDER = [*ABOUT]


@shared
def validate(df: DataFrame, evidence: bool = False, scan_rows: int | str | None = "all") -> list[Issue]:
    """All findings.  ``evidence=True`` adds the spellings of each messy category, one small query each.

    Repeated column names are a finding; the columns are told apart as ``a``, ``a.1`` for the other rules.
    """
    names, twice = N.dedupe(df.columns)
    df = df.toDF(*names) if twice else df
    p = profile(df, scan_rows)
    columns = [i for c in p.columns.values() for i in _of_column(c, p.rows)]
    text = [i for i in columns if i.rule_id in ("TEXT_NUMERIC", "DATE_AS_TEXT", "MESSY_CATEGORY", "HIGH_CARDINALITY")]
    rest = sorted((i for i in columns if i not in text), key=lambda i: _ORDER.index(i.rule_id))
    pii = []
    for n, c in p.columns.items():
        if c.pii:
            pii.append(Issue("PII", "high", 0.9, n, f"'{n}' holds personal data ({', '.join(c.pii)})", c.pii, "mask or drop it"))
        elif k := N.pii_kind(n):
            pii.append(Issue("PII", "medium", 0.55, n, f"'{n}' is named like personal data ({k})", [k], "review it"))
    if evidence:
        for i in text:
            if i.rule_id == "MESSY_CATEGORY":
                i.evidence = spellings(df, i.column)
    return duplicate_names(twice) + text + rest + pii


def duplicate_names(twice: list[str]) -> list[Issue]:
    """A finding for each repeated name; ``names.dedupe`` finds them in any list of names."""
    return [Issue("DUPLICATE_COLUMNS", "high", 1.0, n, f"several columns are called '{n}'", twice, "rename them", f"df.toDF(*names.dedupe(df.columns)[0])  # {n!r}") for n in twice]


def spellings(df: DataFrame, column: str, most: int = 4) -> list[str]:
    """Up to four spellings of the first category that has several."""
    c = present(df, column)
    pairs = df.select(c.alias("v"), P.normalize_category(c).alias("k")).where("v is not null").distinct()
    first = pairs.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").orderBy("k").limit(1)
    return [r["v"] for r in pairs.join(F.broadcast(first), "k").select("v").orderBy("v").limit(most).collect()]


@shared
def findings(df: DataFrame) -> DataFrame:
    """The findings as a frame."""
    rows = [(i.rule_id, i.severity, float(i.confidence), i.column, i.message, i.suggestion, i.suggested_code) for i in validate(df)]
    return df.sparkSession.createDataFrame(rows, "rule_id string, severity string, confidence double, column string, message string, suggestion string, suggested_code string")


@shared
def suggest_fixes(df: DataFrame) -> list[dict]:
    return [{"rule_id": i.rule_id, "column": i.column, "suggested_code": i.suggested_code} for i in validate(df) if i.suggested_code]


def repair(df: DataFrame, issue: Issue) -> DataFrame:
    """``df`` with a finding's suggestion applied; findings without a repair leave it as it is."""
    if issue.rule_id in ("EMPTY_COLUMN", "CONSTANT_COLUMN"):
        return df.drop(issue.column)
    make = P.REPAIRS.get(issue.rule_id)
    return df.withColumn(issue.column, make(present(df, issue.column))) if make else df


def explain_issue(issue: Issue | str) -> str:
    rule = issue if isinstance(issue, str) else issue.rule_id
    return ABOUT.get(rule, "Unknown finding.")


@shared
def detect_traps(df: DataFrame) -> list[dict]:
    """Findings that make an answer wrong, worded for a model."""
    skip = {"CONSTANT_COLUMN", "HIGH_CARDINALITY"}
    return [{"column": i.column, "trap": i.rule_id, "warning": i.message, "tell_the_model": i.suggestion} for i in validate(df) if i.rule_id in TRAPS - skip]


@shared
def infer_columns(df: DataFrame) -> dict[str, str]:
    """A meaning for each column: pii_*, identifier, date, money, quantity, numeric, text or category."""
    out, p = {}, profile(df)
    for n, c in p.columns.items():
        low = n.lower()
        if c.pii or N.pii_kind(n):
            out[n] = f"pii_{(c.pii or [N.pii_kind(n)])[0]}"
        elif N.ends_like_id(n):
            out[n] = "identifier"
        elif is_time(c.dtype) or N.hints_date(n):
            out[n] = "date"
        elif any(w in low for w in N.MONEY_HINTS):
            out[n] = "money"
        elif N.hints_nonnegative(n):
            out[n] = "quantity"
        elif is_numeric(c.dtype) or is_boolean(c.dtype):
            out[n] = "numeric"
        else:
            out[n] = "text" if p.rows and c.distinct / p.rows >= CARDINALITY else "category"
    return out


def label(score: float) -> str:
    return "Good" if score >= 85 else "Fair" if score >= 60 else "Poor"


#: Weight of each dimension of the score.
WEIGHTS = {"completeness": 0.3, "type_consistency": 0.3, "duplicate_risk": 0.15, "pii_risk": 0.15, "outlier_risk": 0.1}
_DIMENSIONS = {
    "type_consistency": {"TEXT_NUMERIC", "DATE_AS_TEXT", "EXCEL_SERIAL_DATE"},
    "duplicate_risk": {"DUPLICATE_COLUMNS", "NON_UNIQUE_ID"},
    "pii_risk": {"PII"},
    "outlier_risk": {"UNEXPECTED_NEGATIVE"},
}


@shared
def quality_score(df: DataFrame) -> dict:
    """A score of 0 to 100 by dimension; privacy is judged apart, since one column of emails is enough to matter."""
    from hushframe.operators.privacy import privacy_report

    p, issues = profile(df), validate(df)
    parts = {"completeness": round(100 * (1 - sum(c.missing for c in p.columns.values()) / len(p.columns))) if p.rows else 100}
    for d, rules in _DIMENSIONS.items():
        bad = {i.column for i in issues if i.rule_id in rules}
        parts[d] = round(100 * (1 - len(bad) / len(p.columns)))
    total = round(sum(parts[k] * w for k, w in WEIGHTS.items()))
    report = privacy_report(df)
    risk = "High" if report["high_risk"] else "Medium" if report["medium_risk"] else "Low"
    ready = {"High": "Needs Review", "Medium": "Review" if total >= 60 else "Poor", "Low": label(total)}[risk]
    return {"score": total, "label": label(total), "breakdown": parts, "privacy_risk": risk, "safe_to_send_raw": risk == "Low", "ai_readiness": ready, "issue_count": len(issues)}


@shared
def ai_readiness(df: DataFrame, max_tokens: int = 6000) -> dict:
    from hushframe.operators.privacy import privacy_report
    from hushframe.operators.summary import token_stats

    rules = {i.rule_id for i in validate(df)}
    pii, tokens = privacy_report(df)["pii_columns"], token_stats(df)
    checks = [
        {"check": "fits_in_prompt", "ok": tokens["summary_tokens"] <= max_tokens, "detail": f"summary ~{tokens['summary_tokens']} tokens"},
        {"check": "no_duplicate_columns", "ok": "DUPLICATE_COLUMNS" not in rules, "detail": "column names are distinct"},
        {"check": "types_consistent", "ok": not rules & _DIMENSIONS["type_consistency"], "detail": "numbers and dates have proper types"},
        {"check": "no_pii", "ok": not pii, "detail": f"personal data: {pii}" if pii else "none found"},
        {"check": "low_cardinality_ok", "ok": "HIGH_CARDINALITY" not in rules, "detail": "columns that nearly always differ add little"},
    ]
    ready = "DUPLICATE_COLUMNS" not in rules
    text = f"Safe to summarise, not to send raw: personal data in {', '.join(pii)}." if pii else "Ready for a summary; no personal data was found."
    return {"ready_for_summary": ready, "safe_to_send_raw": not pii, "needs_review": bool(pii) or not ready, "ready": ready, "safe_to_summarize": ready, "checks": checks, "summary": text}
