"""The parts behind the front door, under one roof."""

from hushframe.errors import DataError, HushframeError, ModelError, PolicyError, SafetyError
from hushframe.functions.names import detect_operation, mentioned, needed
from hushframe.functions.patterns import luhn_ok, redact, redact_samples, redact_text
from hushframe.operators.agent import Agent
from hushframe.operators.guarded import GuardedResult, check_code, check_sql, extract_code, guarded_sql, run_python, run_sql, safe_python, safe_sql, wrap
from hushframe.operators.leak import SURFACES, LeakResult, attacks_on, collect_sensitive_values, detect_leak, leak_test
from hushframe.operators.privacy import (
    PrivacyPlan, all_pii, classify_columns, create_contract, create_privacy_plan, enable_presidio, k_anonymize, make_safe_view, mask_blocked, privacy_report, redact_frame, redact_value, risk_score,
)
from hushframe.operators.profile import Profile, column_facts, profile
from hushframe.operators.quality import Issue, ai_readiness, detect_traps, duplicate_names, explain_issue, findings, infer_columns, quality_score, repair, suggest_fixes, validate
from hushframe.operators.receipt import create_receipt, format_receipt
from hushframe.operators.report import expectation_suite, html_audit, html_report, pandera_schema
from hushframe.operators.session import SafeSession, question_cost
from hushframe.operators.shadow import create_shadow, profile_frame, shadow_rows
from hushframe.operators.summary import build_safe_prompt, summarize, token_savings, token_stats
from hushframe.plans.execute import PlanResult, Prepared, execute, plan_prompt, prepare, run_plan, safe_query
from hushframe.plans.lower import describe, lower
from hushframe.plans.plan import Metric, Plan, extract_json, parse
from hushframe.plans.plan import validate as validate_plan
from hushframe.sources.files import load, write_csv, write_json, write_parquet, write_text

__all__ = [n for n in dir() if not n.startswith("_")]
