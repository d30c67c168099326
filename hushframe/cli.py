"""Command line: scan, protect, ask, advanced {inspect-policy, shadow, leak-test}.

Exit codes: 0 done, 1 wrong input, 2 blocked, refused or over the ``--fail-on`` level, 130 interrupted.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from hushframe.api import ask, protect, scan
from hushframe.errors import HushframeError
from hushframe.operators.leak import leak_test
from hushframe.operators.shadow import create_shadow
from hushframe.policy import PROFILES, Policy
from hushframe.sources.files import load, write_csv, write_json

LEVELS = ("low", "medium", "high")


def openai_model(name: str):
    """A model behind a hosted interface; needs the optional client and OPENAI_API_KEY."""
    try:
        from openai import OpenAI
    except ImportError as e:
        raise HushframeError("the openai client is not installed") from e
    if not os.environ.get("OPENAI_API_KEY"):
        raise HushframeError("OPENAI_API_KEY is not set")
    client = OpenAI()
    return lambda prompt: client.chat.completions.create(model=name, messages=[{"role": "user", "content": prompt}]).choices[0].message.content


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="hushframe", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(group, name: str, data: bool = True) -> argparse.ArgumentParser:
        p = group.add_parser(name)
        if data:
            p.add_argument("file")
        p.add_argument("--profile", default="general", choices=sorted(PROFILES))
        p.add_argument("--json", action="store_true")
        return p

    command(sub, "scan").add_argument("--fail-on", choices=LEVELS)
    p = command(sub, "protect")
    p.add_argument("--question")
    p.add_argument("--out")
    p = command(sub, "ask")
    p.add_argument("question")
    p.add_argument("--model", default="gpt-4o-mini")
    p.add_argument("--mode", default="auto")
    p.add_argument("--receipt-out")
    more = sub.add_parser("advanced").add_subparsers(dest="tool", required=True)
    command(more, "inspect-policy", False)
    p = command(more, "shadow")
    p.add_argument("--rows", type=int, default=100)
    p.add_argument("--out")
    p = command(more, "leak-test")
    p.add_argument("--model", default="gpt-4o-mini")
    return top


def _say(value, as_json: bool) -> None:
    print(json.dumps(value, default=str, indent=2) if as_json or isinstance(value, (dict, list)) else value)


def run(args: argparse.Namespace, model=None) -> int:
    if args.command == "advanced" and args.tool == "inspect-policy":
        _say(Policy.from_profile(args.profile).to_dict(), True)
        return 0
    spark = SparkSession.builder.getOrCreate()
    df = load(spark, args.file)
    if args.command == "scan":
        report = scan(df, args.profile)
        _say(report.to_dict(), args.json)
        return 2 if args.fail_on and LEVELS.index(report.risk_level) >= LEVELS.index(args.fail_on) else 0
    if args.command == "protect":
        view, report = protect(df, args.question, args.profile, return_report=True)
        if args.out:
            write_csv(view, args.out, single_file=True)
        _say({"kept": report.kept_columns, "dropped": report.dropped_columns}, args.json)
        return 0
    if args.command == "ask":
        got = ask(df, args.question, model or openai_model(args.model), args.profile, mode=args.mode)
        if args.receipt_out:
            write_json(got.receipt.to_dict(), args.receipt_out)
        _say({"answer": got.answer if not hasattr(got.answer, "to_dict") else got.answer.to_dict("records"), "blocked": got.blocked, "reason": got.reason, "receipt": got.receipt.summary()}, args.json)
        return 2 if got.blocked else 0
    if args.tool == "shadow":
        rows = create_shadow(df, args.rows)
        if args.out:
            write_csv(rows, args.out, single_file=True)
        else:
            rows.show(min(args.rows, 20), truncate=False)
        return 0
    got = leak_test(df, model or openai_model(args.model), Policy.from_profile(args.profile))
    _say({"score": got.score, "risk_level": got.risk_level, "leaks": sum(a.leaked for a in got.attempts), "recommendations": got.recommendations}, args.json)
    return 0 if got.risk_level == "low" else 2


def main(argv: list[str] | None = None, model=None) -> int:
    try:
        return run(parser().parse_args(argv), model)
    except (FileNotFoundError, ValueError) as e:
        if isinstance(e, HushframeError):
            print(f"refused: {e}", file=sys.stderr)
            return 2
        print(f"error: {e}", file=sys.stderr)
        return 1
    except HushframeError as e:
        print(f"refused: {e}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
