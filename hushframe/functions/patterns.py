"""Value patterns as Catalyst expressions, and the same patterns for text on the driver."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of personal data, the specific before the general.
PII = {
    "EMAIL": r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    "CARD": r"\b(?:\d[ -]?){13,16}\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "IP": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "PHONE": r"\+?\(?(?:\d{1,3}[\s.)-]?)?(?:\(?\d{2,4}\)?[\s.-]?){2,4}\d{2,4}\b",
}
DATE_IN_TEXT = r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b"
TIME_IN_TEXT = r"\b\d{1,2}:\d{2}(?::\d{2})?\b"
#: Shapes of numbers and dates kept as text.
NUMERIC = r"^\s*[-+]?[$£€]?\s*[\d,]+(\.\d+)?\s*%?\s*$"
DATE = r"^\s*\d{4}[-/]\d{1,2}[-/]\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2})?)?\s*$|^\s*\d{1,2}[-/]\d{1,2}[-/]\d{4}\s*$"

_UNICODE = "(?U)"


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(_UNICODE + pattern)


def looks_numeric(c: Column) -> Column:
    return matches(c, NUMERIC)


def looks_date(c: Column) -> Column:
    return matches(c, DATE)


def normalize_category(c: Column) -> Column:
    """Lower-case, without spaces, dots, dashes and underscores (so there is nothing left to trim)."""
    return F.regexp_replace(F.lower(c), _UNICODE + r"[\s._\-]+", "")


#: A character without which a pattern cannot match; cells that lack it are spared the pattern.
_NEEDS = {"EMAIL": "@", "SSN": "-", "IP": "."}


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` computed once, however often ``f`` uses it."""
    return F.transform(F.array(c), f)[0]


def has_pii(c: Column, label: str) -> Column:
    """Whether a cell holds the pattern; a phone needs ten digits and no date or time in the cell."""
    hit = matches(c, PII[label])
    if label in _NEEDS:
        hit = c.contains(_NEEDS[label]) & hit
    if label != "PHONE":
        return hit
    digits = F.length(F.regexp_replace(c, _UNICODE + r"\D", ""))
    return hit & (digits >= 10) & ~matches(c, DATE_IN_TEXT) & ~matches(c, TIME_IN_TEXT)


def luhn_ok(c: Column) -> Column:
    """13 to 19 digits (others are ignored) with a right check digit; false for null."""
    digits = F.regexp_replace(c.cast("string"), r"[^0-9]", "")
    return F.coalesce(F.length(digits).between(13, 19) & F.call_function("luhn_check", digits), F.lit(False))


def _replaced(label: str) -> Callable[[Column], Column]:
    def step(x: Column) -> Column:
        possible = x.contains(_NEEDS[label]) if label in _NEEDS else x.rlike(r"\d[ -]?\d[ -]?\d")
        return F.when(possible, F.regexp_replace(x, _UNICODE + PII[label], f"[{label}]")).otherwise(x)

    return step


def redact_before_phone(c: Column) -> Column:
    """Cells with emails, cards, social security numbers and addresses of computers replaced, in this order."""
    for label in ("EMAIL", "CARD", "SSN", "IP"):
        c = bound(c, _replaced(label))
    return c


def _redact_phones(c: Column) -> Column:
    """Each match is judged by itself: the cell is cut at the matches and put together again, the phones as labels."""
    pattern = _UNICODE + PII["PHONE"]
    digits = lambda m: F.length(F.regexp_replace(m, _UNICODE + r"\D", ""))
    judged = lambda m: F.when((digits(m) >= 10) & ~matches(m, DATE_IN_TEXT) & ~matches(m, TIME_IN_TEXT), F.lit("[PHONE]")).otherwise(m)
    between, found = F.split(c, pattern), F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), judged)
    return F.concat_ws("", F.flatten(F.zip_with(between, found, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))))


def redact(c: Column) -> Column:
    """All five patterns replaced by their labels, without Python."""
    return bound(redact_before_phone(c), lambda x: F.when(matches(x, PII["PHONE"]), _redact_phones(x)).otherwise(x))


_compiled = {k: re.compile(v) for k, v in PII.items()}
_dateish = re.compile(f"{DATE_IN_TEXT}|{TIME_IN_TEXT}")


def is_phone(s: str) -> bool:
    return sum(ch.isdigit() for ch in s) >= 10 and not _dateish.search(s)


def phones(s: str) -> str:
    return _compiled["PHONE"].sub(lambda m: "[PHONE]" if is_phone(m[0]) else m[0], s)


def redact_text(s: Any) -> Any:
    """``redact`` for one value on the driver; what is not text is returned as it is."""
    if not isinstance(s, str):
        return s
    for label in ("EMAIL", "CARD", "SSN", "IP"):
        s = _compiled[label].sub(f"[{label}]", s)
    return phones(s)


def redact_samples(values: list) -> list:
    return [redact_text(v) for v in values]


def text_kinds(s: str) -> list[str]:
    """Kinds of personal data in a text on the driver."""
    return sorted(k.lower() for k, p in _compiled.items() if p.search(s) and (k != "PHONE" or is_phone(s)))


def excel_serial(c: Column) -> Column:
    """Day numbers of the years 2000 to 2040."""
    return c.between(36526, 51500)


def estimate_tokens(c: Column) -> Column:
    """A quarter of the characters, rounded half to even, 1 at least."""
    return F.greatest(F.lit(1), F.bround(F.length(c) / 4).cast("int"))


def estimate_tokens_text(s: str) -> int:
    return max(1, round(len(s) / 4))


def missing_label(share: float) -> str:
    """``100%`` only for all; otherwise rounded, with ``>99%`` short of it."""
    if share >= 1:
        return "100%"
    return ">99%" if round(share * 100) >= 100 else f"{round(share * 100)}%"


def _casts() -> dict[str, Callable[[Column], Column]]:
    return {
        "TEXT_NUMERIC": lambda c: F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double"),
        "DATE_AS_TEXT": lambda c: F.try_to_timestamp(c),
        "EXCEL_SERIAL_DATE": lambda c: F.date_add(F.lit("1899-12-30").cast("date"), c.cast("int")),
        "MESSY_CATEGORY": lambda c: F.lower(F.trim(c)),
    }


#: The repair of each quality finding as an expression.
REPAIRS = _casts()
