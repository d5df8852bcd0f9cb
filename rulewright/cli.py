"""Command line: ``validate-rules`` and ``list-rules`` over a catalogue."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators.catalogue import list_lines
from .plans.validator import report
from .sources.catalogue import RuleSchema, load, load_schema, shipped


def main(argv: list[str] | None = None) -> int:
    """Exit code 0 without errors, 1 with some; bad usage ends with 2."""
    parser = argparse.ArgumentParser(prog="rulewright")
    parser.add_argument("--root", help="folder of a catalogue (default: the shipped one)")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("validate-rules", help="check a catalogue against its schema")
    commands.add_parser("list-rules", help="list the rules of a catalogue")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    rules: DataFrame = load(spark, args.root) if args.root else shipped(spark)
    if args.command == "list-rules":
        for row in list_lines(rules).orderBy("file_ord", "rule_ord").collect():
            print(row["line"])
        return 0
    code, lines = report(rules, load_schema(spark, args.root) if args.root else RuleSchema())
    print("\n".join(lines))
    return code


if __name__ == "__main__":
    sys.exit(main())
