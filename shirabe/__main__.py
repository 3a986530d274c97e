"""Command line: ``python -m shirabe scan PATH...``, ``scan --stdin``, ``scan --staged``, ``scan --diff RANGE``,
``baseline PATH...`` and ``rules``.

Exit status: 0 nothing found, 1 findings (at ``--fail-on`` or above), 2 errors.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .detect import rules as R
from .operators import baseline as B
from .operators import scan as S
from .operators.correlate import exit_status
from .sources import config as C
from .sources import diff, files

_LEVEL = {v: k for k, v in R.LEVELS.items()}


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shirabe", description="Finds Japanese personal data in texts.")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "baseline"):
        a = sub.add_parser(name)
        a.add_argument("paths", nargs="*")
        a.add_argument("--stdin", action="store_true")
        a.add_argument("--staged", action="store_true")
        a.add_argument("--diff", metavar="RANGE")
        a.add_argument("--format", choices=("text", "json", "jsonl", "sarif", "github"), default="text")
        a.add_argument("--min-confidence", choices=_LEVEL)
        a.add_argument("--fail-on", choices=_LEVEL)
        a.add_argument("--high-recall", action="store_true")
        a.add_argument("--unmask", action="store_true")
        a.add_argument("--explain", action="store_true")
        a.add_argument("--baseline", metavar="FOLDER")
    sub.add_parser("rules").add_argument("--high-recall", action="store_true")
    return p


def findings(spark: SparkSession, args, config) -> DataFrame:
    if args.stdin:
        return files.scan_text(spark, sys.stdin.read(), config)
    if args.staged or args.diff:
        hunks = diff.hunks(diff.git_patch(spark, ".", args.diff))
        named = [r.file for r in hunks.select("file").distinct().collect()]
        if named:
            hunks = hunks.join(diff.post_images(spark, ".", named, args.diff), "file", "left")
        return S.scan_hunks(hunks, config)
    return files.scan_files(spark, *(args.paths or ["."]), config=config)


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("shirabe").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    config = C.load()
    config = replace(config, high_recall=config.high_recall or args.high_recall)
    if args.command == "rules":
        for r in S.rules_listing(spark, config).orderBy("rule_id").collect():
            print(r.rule_id, "on" if r.enabled else "off", *(["high-recall"] if r.high_recall else []), r.description, sep="\t")
        return 0
    if args.min_confidence:
        config = replace(config, min_confidence=_LEVEL[args.min_confidence])
    if args.fail_on:
        config = replace(config, scan_min_confidence=_LEVEL[args.fail_on])
    found = findings(spark, args, config)
    if args.command == "baseline":
        salt = B.new_salt()
        B.write(found.select(B.fingerprint(salt, F.col("rule_id"), F.col("file"), F.col("match")).alias("fingerprint")).distinct(), salt, args.baseline or ".shirabe-baseline")
        return 0
    if args.baseline:
        salt, known = B.read(spark, args.baseline)
        found = B.split(found.withColumn("fingerprint", B.fingerprint(salt, F.col("rule_id"), F.col("file"), F.col("match"))), known)[0]
    found = found.persist()
    shown = found.where(~F.col("fail_only"))
    form = {"text": lambda: sinks.text_report(shown, args.unmask, args.explain), "json": lambda: sinks.json_report(shown, unmask=args.unmask), "jsonl": lambda: sinks.json_lines(shown, args.unmask), "sarif": lambda: sinks.sarif(shown, args.unmask), "github": lambda: sinks.annotations(shown, args.unmask)}
    for r in form[args.format]().toLocalIterator():
        print(r.value)
    total = sinks.summary(shown).first()
    print(f"{total.findings} findings: {total.high} high, {total.medium} medium, {total.low} low", file=sys.stderr)
    return exit_status(found, _LEVEL[args.fail_on] if args.fail_on else None).first().status


if __name__ == "__main__":
    try:
        sys.exit(main())
    except Exception as e:  # the caller tells errors from findings by the status
        print(f"shirabe: {e}", file=sys.stderr)
        sys.exit(2)
