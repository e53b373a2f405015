"""python -m rowsmith.cli validate|import: a saved layout, a workbook and a target, without a screen.

Exit codes: 0 done, 1 the data has errors, 2 wrong usage, 3 the layout or the connection does not fit.
"""

from __future__ import annotations

import argparse
import getpass
import os
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from rowsmith.functions.text import byte_size
from rowsmith.plans import config as layouts
from rowsmith.plans.headers import fingerprint
from rowsmith.session import Session
from rowsmith.sources.catalog import Connection

DONE, DATA, USAGE, SETUP = 0, 1, 2, 3
SHOWN = 50


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rowsmith", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("validate", "import"):
        s = sub.add_parser(name)
        s.add_argument("--config", required=True)
        s.add_argument("--file", required=True, help="the workbook")
        s.add_argument("--host", default="localhost")
        s.add_argument("--port", type=int, default=5432)
        s.add_argument("--database", required=True)
        s.add_argument("--user", required=True, help="the password comes from PGPASSWORD or a prompt")
        s.add_argument("--sslmode", default="prefer")
        s.add_argument("--json", action="store_true")
        s.add_argument("--fail-on-warnings", action="store_true")
        if name == "import":
            s.add_argument("--out", required=True)
            s.add_argument("--mode", choices=["insert", "copy"])
    return p


def print_report(report, as_json: bool, out=None) -> None:
    """The summary, blocked columns, the first issues, and what could not be verified; to standard output if not said otherwise."""
    out = out or sys.stdout
    if as_json:
        import json

        json.dump({"summary": report.summary(), "errors": report.errors, "warnings": report.warnings, "byCode": report.by_code, "byColumn": report.by_column, "issues": [r.asDict() for r in report.issues.limit(SHOWN).collect()]}, out)
        return
    print(report.summary(), file=out)
    for v in report.verdicts:
        if v.blocked:
            print(f"  column {v.sheet_column}: {v.reason}", file=out)
    for r in report.issues.limit(SHOWN).collect():
        print(f"  {r['severity']} {r['code']} {r['excel_ref'] or r['db_column']}: {r['message']}", file=out)
    for name, kind, why in report.unverifiable:
        print(f"  not verified: {kind} {name}: {why}", file=out)


def run(args: argparse.Namespace, session: Session) -> int:
    if args.command == "import" and os.path.exists(args.out):
        print(f"{args.out} exists", file=sys.stderr)
        return USAGE
    try:
        c = layouts.load(args.config)
        if session.table is None:
            session.connect(session.connection)
            session.describe(c.schema, c.table)
        session.open(args.file, sheet=c.sheet, header_row=c.header_row)
        for w in session.load(args.config):
            print(f"warning: {w}", file=sys.stderr)
        if getattr(args, "mode", None):
            session.output = replace(session.output, mode=args.mode)
        if session.server:
            session.output = replace(session.output, conforming=session.server.conforming)
    except Exception as e:  # whatever does not fit is said without the password
        print(session.connection.redact(str(e)) if session.connection else e, file=sys.stderr)
        return SETUP
    if c.fingerprint and fingerprint(session.sheet.headers) != c.fingerprint:
        print("the sheet's headers are not those of the layout", file=sys.stderr)
        return SETUP
    report = session.validate()
    print_report(report, args.json)
    if report.errors or args.fail_on_warnings and report.warnings:
        return DATA
    if args.command == "import":
        session.generate(args.out)
        print(f"{args.out}: {byte_size(session.written)}")
    return DONE


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return USAGE if e.code else DONE
    password = os.environ.get("PGPASSWORD") or getpass.getpass()
    spark = SparkSession.builder.appName("rowsmith").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    return run(args, Session(spark, Connection(args.host, args.database, args.user, password, args.port, args.sslmode)))


if __name__ == "__main__":
    sys.exit(main())
