"""Text summaries for prompts, and what they save in tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hushframe.functions import names as N
from hushframe.functions import patterns as P
from hushframe.operators.profile import kind, profile, shared
from hushframe.operators.quality import TRAPS, validate
from hushframe.types import is_numeric, is_text, is_time, quoted

RAW_SAMPLE = 200


@shared
def summarize(df: DataFrame, mask: bool = True) -> str:
    """Rows, columns with type, missing share and range or (redacted) samples, and the data's traps."""
    p = profile(df, samples=True)
    lines = [f"{p.rows} rows, {len(p.columns)} columns"]
    for n, c in p.columns.items():
        bits = [f"- {n} ({c.dtype.simpleString()})"]
        if c.missing:
            bits.append(f"{P.missing_label(c.missing)} missing")
        private = kind(c) == "pii"
        if private:
            bits.append(f"personal data ({', '.join(c.pii) or N.pii_kind(n)})")
        if is_numeric(c.dtype) and c.present and not (private and mask):
            bits.append(f"min {c.least}, max {c.most}, mean {c.mean:.6g}")
        elif is_time(c.dtype) and c.present and not (private and mask):
            bits.append(f"from {c.least} to {c.most}")
        elif is_text(c.dtype) and c.samples:
            shown = ["[MASKED]"] if private and mask else [P.redact_text(s) if mask else s for s in c.samples]
            bits.append("e.g. " + ", ".join(repr(s[:60]) for s in shown))
        lines.append(", ".join(bits))
    traps = [f"! {i.message}; {i.suggestion}" for i in validate(df) if i.rule_id in TRAPS]
    return "\n".join([*lines, *traps])


def build_safe_prompt(df: DataFrame, question: str, privacy: str = "masked") -> str:
    if privacy not in ("masked", "raw"):
        raise ValueError("privacy must be 'masked' or 'raw'")
    return f"Data summary:\n{summarize(df, privacy == 'masked')}\n\nQuestion: {question}\n"


@shared
def token_stats(df: DataFrame) -> dict:
    """Estimated tokens of the raw table (from its first rows) and of the summary."""
    rows = profile(df).rows
    sample = df.limit(RAW_SAMPLE).toPandas()
    text = sample.to_csv(index=False)
    raw = round(P.estimate_tokens_text(text) * max(rows, 1) / max(len(sample), 1))
    return {"raw_tokens": raw, "summary_tokens": P.estimate_tokens_text(summarize(df)), "rows": rows}


@shared
def token_savings(df: DataFrame) -> dict:
    """Share of tokens that a summary saves; shown as 99.99 % at most."""
    s = token_stats(df)
    saved = max(0.0, 100 * (1 - s["summary_tokens"] / max(s["raw_tokens"], 1)))
    return s | {"saved_percent": round(min(saved, 99.99), 2)}


def estimated_column_tokens(df: DataFrame, column: str) -> DataFrame:
    """Estimated tokens of each text of a column."""
    return df.select(P.estimate_tokens(quoted(column)).alias("tokens"))
