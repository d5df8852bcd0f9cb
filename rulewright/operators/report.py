"""Reports of findings: audit rows as JSON, and short Markdown summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("PASS", "ERROR", "WARNING", "INFO", "MANUAL_REVIEW", "NOT_CHECKED")


def summary(verdicts: DataFrame) -> DataFrame:
    """(rule_id, status, n, fixable): pre-aggregated; as many rows as rules and statuses."""
    return verdicts.groupBy("rule_id", "status").agg(F.count("*").alias("n"), F.sum(F.col("fixable").cast("int")).cast("long").alias("fixable"))


def write_audit_json(verdicts: DataFrame, path: str) -> None:
    verdicts.write.mode("error").json(path)


def manual_review(verdicts: DataFrame) -> DataFrame:
    """What a person has to look at, by document."""
    return verdicts.where("status in ('MANUAL_REVIEW', 'NOT_CHECKED')").groupBy("doc_id", "rule_id", "status").agg(F.count("*").alias("n"))


def markdown(verdicts: DataFrame, title: str = "Audit") -> str:
    """A table over rules and statuses (bounded by the catalogue, so it may be collected)."""
    rows = summary(verdicts).orderBy("rule_id", "status").collect()
    lines = [f"# {title}", "", "| rule | status | n | fixable |", "| --- | --- | --- | --- |"]
    return "\n".join(lines + [f"| {r['rule_id']} | {r['status']} | {r['n']} | {r['fixable']} |" for r in rows]) + "\n"


def write_manual_review(verdicts: DataFrame, path: str) -> None:
    """What a person has to look at, one Markdown line each, as a set of text files ordered by document."""
    line = F.format_string("- document %s: %s, %s (%d)", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "rule_id", "status", "n")
    manual_review(verdicts).orderBy("doc_id", "rule_id").select(line.alias("value")).write.mode("error").text(path)
