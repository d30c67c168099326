"""Policies: how much an answer may reveal, by industry profile."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from hushframe.errors import PolicyError

SAFE_MODES = ("drop_unneeded_pii", "minimal")


@dataclass
class Policy:
    """``scan_rows`` bounds the distinct values a PII scan reads per column; "all" (the default here) is one full pass."""

    profile: str = "general"
    safe_mode: str = "drop_unneeded_pii"
    isolation: str = "process"
    max_result_rows: int = 50
    max_result_bytes: int = 1_000_000
    redact_result_pii: bool = True
    enforce_minimal_result: bool = False
    block_1d_row_results: bool = False
    min_group_size: int | None = None
    pii_scan_rows: int | str | None = "all"
    use_presidio: bool = False
    allow_python_fallback: bool = True
    allow_raw_rows: bool = False

    def with_(self, **changes) -> Policy:
        return replace(self, **changes)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_profile(cls, name: str) -> Policy:
        if name not in PROFILES:
            raise PolicyError(f"unknown profile {name!r}; known: {', '.join(sorted(PROFILES))}")
        return cls(profile=name, **PROFILES[name])

    @classmethod
    def basic(cls) -> Policy:
        return cls(profile="basic", max_result_rows=100)

    @classmethod
    def regulated(cls) -> Policy:
        return cls(profile="regulated", min_group_size=5, enforce_minimal_result=True, block_1d_row_results=True, allow_python_fallback=False)

    @classmethod
    def audit_only(cls) -> Policy:
        return cls(profile="audit_only")

    @classmethod
    def strict(cls) -> Policy:
        return cls.from_profile("strict")


def _closed(k: int, rows: int, **more) -> dict:
    return {"min_group_size": k, "max_result_rows": rows, "enforce_minimal_result": True, "block_1d_row_results": True, "allow_python_fallback": False} | more


#: Least group size and most result rows of each profile.
PROFILES = {
    "general": {"max_result_rows": 100},
    "energy": _closed(5, 50),
    "banking": _closed(10, 50),
    "insurance": _closed(10, 50),
    "healthcare": _closed(15, 30),
    "strict": _closed(20, 25, isolation="docker", use_presidio=True),
}


def resolve(profile: str = "general", policy: Policy | None = None) -> Policy:
    return policy if policy is not None else Policy.from_profile(profile)
