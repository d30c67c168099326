"""What a column's name suggests: tokens, hints and category lexicons."""

from __future__ import annotations

import re

#: Name hints; the two sets may be extended in place.
DATE_HINTS = {"date", "dt", "datetime", "timestamp", "day"}
NONNEGATIVE_HINTS = {"count", "qty", "quantity", "amount", "total", "volume", "price", "age", "num"}
MONEY_HINTS = ("price", "amount", "revenue", "cost", "salary", "value", "$", "usd", "gbp")
COUNT_TOKENS = {"count", "n", "size", "freq", "frequency", "cnt", "num"}

#: Tokens that make the bare word "name" personal.
PERSON_CONTEXT = frozenset(
    "first last sur surname full fore middle maiden given family contact person people customer client employee user holder patient member applicant "
    "policyholder driver claimant beneficiary insured payee payer borrower guarantor tenant passenger dependant dependent subscriber".split()
)
#: The ladder of name tokens for each kind of personal data, first match wins.
PII_TOKENS = (
    ("email", {"email"}),
    ("phone", {"phone", "mobile", "telephone", "msisdn"}),
    ("national_id", {"ssn", "nino", "sin"}),
    ("date_of_birth", {"dob", "birth"}),
    ("postcode", {"postcode", "zipcode", "zip"}),
    ("card", {"card", "creditcard", "ccnum", "ccnumber", "pan", "iban", "cvv", "account", "acct"}),
    ("address", {"address"}),
    ("name", {"surname"}),
)
HIGH_RISK_KINDS = {"email", "phone", "national_id", "date_of_birth", "address", "card"}

#: Category lexicons, matched as substrings of the normalised name.
BUSINESS_ID = (
    "customer_id account_id account_number policy_number policy_id claim_id claim_number sort_code iban mpan mprn meter_id meter_number contract_id case_id "
    "invoice_id txn_id order_id subscriber_id member_id reference ref_no offer_id patient_id patient_number medical_record_number mrn hospital_number nhs_number"
).split()
FINANCIAL = "balance salary income credit_score debt arrears amount revenue arr sort_code iban loan payment price cgm premium fee charge".split()
HEALTH = "diagnosis condition medication treatment nhs_number icd symptom disease prescription ward los_days".split()
LOCATION = "postcode post_code zip zipcode city address region country lat lon longitude latitude county district".split()
FREE_TEXT = "notes note comment comments complaint description feedback message remarks case_description summary".split()
QUASI = "age gender sex dob date_of_birth birth postcode post_code zip job_title occupation nationality ethnicity marital".split()
ID_STEMS = "user record person driver quote unique customer account member subscriber".split()

#: Question words that stand for parts of column names, and name parts that mean nothing by themselves.
SYNONYMS = {
    "cost": ("cost", "spend", "charge"),
    "spend": ("spend", "cost", "amount"),
    "revenue": ("revenue", "amount", "cgm", "sales", "turnover"),
    "sales": ("sales", "revenue", "amount"),
    "usage": ("usage", "kwh", "consumption", "volume"),
    "consumption": ("consumption", "kwh", "usage", "volume"),
    "balance": ("balance", "amount"),
    "premium": ("premium", "price"),
    "price": ("price", "premium", "amount", "cost"),
    "claims": ("claim", "claims"),
    "renewal": ("renewal", "renew"),
}
GENERIC = frozenset("id ids no num number code ref the of a an per by total value amount".split())

_plain = re.compile(r"[a-z0-9]+")


def tokens(name: object) -> set[str]:
    """Lower-case words of a name; camelCase and acronyms are cut like snake_case."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", str(name))
    spaced = re.sub(r"([A-Z])([A-Z][a-z])", r"\1 \2", spaced)
    return set(_plain.findall(spaced.lower()))


def hints_date(name: str) -> bool:
    return bool(tokens(name) & DATE_HINTS) or "date" in name.lower() or "time" in name.lower()


def hints_nonnegative(name: str) -> bool:
    return bool(tokens(name) & NONNEGATIVE_HINTS)


def ends_like_id(name: str) -> bool:
    return name.lower().endswith("id")


def pii_kind(name: str) -> str | None:
    """The kind of personal data that a name suggests."""
    own = tokens(name)
    for kind, words in PII_TOKENS:
        if own & words:
            return kind
    return "name" if own in ({"name"}, {"names"}) or ("name" in own and own & PERSON_CONTEXT) else None


def looks_like_id(normal: str) -> bool:
    parts = set(normal.split("_"))
    return bool(parts & {"uid", "id", "ids"}) or normal in {"guid", "uuid"} or normal in {f"{s}id" for s in ID_STEMS}


def normalised(name: str) -> str:
    return name.lower().replace(" ", "_").replace("-", "_")


def categories(name: str, is_text: bool, is_pii: bool, match: str = "substring") -> list[str]:
    """Sensitivity categories of a column.  ``match="token"`` compares whole name parts instead of substrings."""
    low = normalised(name)
    parts = set(low.split("_"))
    hit = (lambda words: any(w in low for w in words)) if match == "substring" else (lambda words: any(w == low or w in parts or ("_" in w and w in low) for w in words))
    found = [
        ("business_identifier", hit(BUSINESS_ID) or looks_like_id(low)),
        ("financial", hit(FINANCIAL)),
        ("health", hit(HEALTH)),
        ("location", hit(LOCATION)),
        ("free_text", is_text and not is_pii and hit(FREE_TEXT)),
        ("quasi_identifier", not is_pii and hit(QUASI)),
    ]
    return [k for k, ok in found if ok]


def mentioned(question: str | None, name: str) -> bool:
    """All tokens of the name occur in the question, a plural s aside."""
    asked, own = tokens(question or ""), tokens(name)
    return bool(own) and all(asked & {t, t + "s", t[:-1] if t.endswith("s") else t} for t in own)


def needed(question: str | None, name: str) -> bool:
    """A looser test: named, or named by a meaningful part, or by a synonym."""
    if mentioned(question, name):
        return True
    asked = set(_plain.findall((question or "").lower()))
    parts = {p for p in re.split(r"[ _\-]+", name.lower()) if len(p) >= 3} - GENERIC
    return bool(parts & asked) or any(s in name.lower() for w in asked for s in SYNONYMS.get(w, ()))


#: Words that tell what a question wants, in order of precedence.
OPERATIONS = (
    ("raw_lookup", ("show all", "list all", "give me all", "every row", "all records", "all customers", "export", "download", "raw data", "full data")),
    ("ranking", ("top", "bottom", "highest", "lowest", "largest", "smallest", "rank")),
    ("trend", ("trend", "over time", "monthly", "weekly", "daily", "yearly", "quarterly", "year over year")),
    ("aggregate", ("total", "sum", "average", "avg", "mean", "count", "median", "min", "max", "minimum", "maximum", "by", "per")),
)


def detect_operation(question: str | None) -> str:
    low = str(question).lower()
    return next((name for name, words in OPERATIONS if any(w in low for w in words)), "general_analysis")


def dedupe(names: list[str]) -> tuple[list[str], list[str]]:
    """``a, a`` -> ``a, a.1`` (a free number each), and the repeated names."""
    used, out, twice = set(names), [], []
    seen: set[str] = set()
    for n in names:
        if n in seen:
            if n not in twice:
                twice.append(n)
            k = 1
            while f"{n}.{k}" in used:
                k += 1
            n = f"{n}.{k}"
            used.add(n)
        seen.add(n)
        out.append(n)
    return out, twice
