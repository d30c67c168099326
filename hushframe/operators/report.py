"""HTML reports and portable exports of what profiling found."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

from hushframe.operators.profile import column_facts, kind, profile, shared
from hushframe.operators.quality import quality_score, validate
from hushframe.sources.files import write_text


def _page(title: str, body: str) -> str:
    style = "body{font-family:sans-serif;margin:2em}td,th{padding:4px 10px;border-bottom:1px solid #ddd;text-align:left}.red{color:#b00}.amber{color:#a60}.green{color:#080}"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title><style>{style}</style></head><body><h1>{escape(title)}</h1>{body}</body></html>"


@shared
def html_report(df: DataFrame, path: str | None = None, title: str = "Data quality") -> str:
    """Each column red, amber or green by its gravest finding; no values are shown."""
    p, issues, score = profile(df), validate(df), quality_score(df)
    rows = []
    for n, c in p.columns.items():
        own = [i for i in issues if i.column == n]
        colour = "red" if any(i.severity == "high" for i in own) else "amber" if own else "green"
        text = "; ".join(i.rule_id for i in own) or "no finding"
        rows.append(f"<tr class='{colour}'><td>{escape(n)}</td><td>{escape(c.dtype.simpleString())}</td><td>{kind(c)}</td><td>{c.missing:.1%}</td><td>{c.distinct}</td><td>{escape(text)}</td></tr>")
    body = f"<p>{p.rows} rows, score {score['score']} ({score['label']}), privacy risk {score['privacy_risk']}</p><table><tr><th>Column<th>Type<th>Kind<th>Missing<th>Distinct<th>Findings</tr>{''.join(rows)}</table>"
    return _write(_page(title, body), path)


#: Columns of the audit table: where each stands in a receipt.
AUDIT = (("request", "id"), ("request", "at"), ("request", "question"), ("request", "engine"), ("exposure", "personal_columns_withheld"), ("limits", "least_group"), ("outcome", "answer"), ("outcome", "refused"))


def html_audit(entries: list[dict], path: str | None = None, title: str = "Audit") -> str:
    """Receipts as a table."""
    rows = "".join("<tr>" + "".join(f"<td>{escape(str(e.get(part, {}).get(key)))}</td>" for part, key in AUDIT) + "</tr>" for e in entries)
    return _write(_page(title, "<table><tr>" + "".join(f"<th>{key.replace('_', ' ')}" for _, key in AUDIT) + f"</tr>{rows}</table>"), path)


def _write(text: str, path: str | None) -> str:
    if path:
        write_text(text, path)
    return text


@shared
def expectation_suite(df: DataFrame, name: str = "suite") -> dict:
    """A portable suite of expectations from the frame's facts."""
    out = []
    for f in column_facts(df):
        c = {"column": f["column"]}
        out.append({"expectation_type": "expect_column_to_exist", "kwargs": c})
        for flag, kind_, more in ((not f["nullable"], "expect_column_values_to_not_be_null", {}), (f["unique_id"], "expect_column_values_to_be_unique", {}), (f["non_negative"], "expect_column_values_to_be_between", {"min_value": 0})):
            if flag:
                out.append({"expectation_type": kind_, "kwargs": c | more})
    return {"expectation_suite_name": name, "expectations": out}


def pandera_schema(df: DataFrame):
    """A pandera schema, if pandera is installed."""
    try:
        import pandera as pa
    except ImportError as e:
        raise ImportError("pandera is not installed") from e
    return pa.DataFrameSchema({f["column"]: pa.Column(nullable=f["nullable"], unique=f["unique_id"], checks=[pa.Check.ge(0)] if f["non_negative"] else None) for f in column_facts(df)})
