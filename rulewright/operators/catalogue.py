"""Operators on catalogues: listing, profiles, requirements, governance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.catalogue import CONFLICTS_DDL, SOURCES_DDL, UNKNOWNS_DDL
from ..sources.shipped import CONFLICTS, SOURCES, UNKNOWNS

LISTED = ("id", "target", "normativity", "autofix")


def list_rules(rules: DataFrame) -> DataFrame:
    """(file_ord, rule_ord, id, target, normativity, autofix) without prior validation; an absent field is an error."""
    cells = [F.when(F.array_contains("present_fields", c), F.coalesce(F.col(c), F.lit("None"))).otherwise(F.raise_error(F.concat(F.lit(f"KeyError: {c} in rule "), F.col("rule_ord").cast("string")))).alias(c) for c in LISTED]
    return rules.select("file_ord", "rule_ord", *cells)


def list_lines(rules: DataFrame) -> DataFrame:
    """The listing as tab-separated lines, to be ordered by (file_ord, rule_ord)."""
    return list_rules(rules).select("file_ord", "rule_ord", F.concat_ws("\t", *LISTED).alias("line"))


def write_listing(rules: DataFrame, path: str) -> None:
    """The listing as a tab-separated file set without a header."""
    list_rules(rules).orderBy("file_ord", "rule_ord").select(*LISTED).write.option("sep", "\t").csv(path)


def profile(rules: DataFrame) -> DataFrame:
    """(facet, value, n) over domain, normativity, severity, autofix and source type, in one aggregate."""
    facets = ("domain", "normativity", "severity", "autofix", "source_type")
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in facets])).alias("p")
    return rules.select(pairs).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def requirement_entries(rules: DataFrame) -> DataFrame:
    """(id, name, value): top-level entries of each open requirement, values as JSON."""
    return rules.select("id", F.explode(F.from_json(F.to_json("requirement"), "map<string,variant>")).alias("name", "value")).select("id", "name", F.to_json("value").alias("value"))


def id_follows_convention(rule_id: Column) -> Column:
    """ER-{MS|CIT|REF}-{TOPIC}-{NNN}, where a topic may have several parts."""
    return F.coalesce(rule_id.rlike(r"^ER-(MS|CIT|REF)(-[A-Z0-9]+)+-[0-9]{3}$"), F.lit(False))


def severity_is_usual(normativity: Column, severity: Column, autofix: Column) -> Column:
    """Mandatory goes with error, recommended with warning, examples with info or review and no fix.

    ``manual_review`` is accepted for any rule: it says how a breach is found, not how grave it is.
    """
    usual = F.when(normativity == "mandatory", severity == "error").when(normativity == "recommended", severity == "warning").when(normativity == "example_only", severity.isin("info", "manual_review") & (autofix == "never"))
    return F.coalesce((severity == "manual_review") & (normativity != "example_only") | usual, F.lit(False))


def governance_findings(rules: DataFrame) -> DataFrame:
    """(id, finding): rules against the id convention or the usual pairing of normativity, severity and fix."""
    checks = F.array_compact(F.array(F.when(~id_follows_convention(F.col("id")), F.lit("id")), F.when(~severity_is_usual(F.col("normativity"), F.col("severity"), F.col("autofix")), F.lit("severity"))))
    return rules.select("id", F.explode(checks).alias("finding"))


def conflicts(spark: SparkSession) -> DataFrame:
    """The shipped conflicts; those of a catalogue folder come from ``load_registers``."""
    return spark.createDataFrame(CONFLICTS, CONFLICTS_DDL)


def unknowns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(UNKNOWNS, UNKNOWNS_DDL)


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, c) for a, b, c in SOURCES], SOURCES_DDL)


def _sides(found: DataFrame) -> DataFrame:
    return found.select("*", F.explode(F.array("a_rule_id", "b_rule_id")).alias("rule_id")).where("rule_id is not null")


def effective_policy(rules: DataFrame, found: DataFrame) -> DataFrame:
    """(id, severity, autofix, conflict_id): rules under the open conflicts.

    A conflict's lint and autofix replace those of its rules, unless it names the
    rule as the one that stays effective: then its lint grades the conflict
    notice only.  A rule in several conflicts takes the most careful values.
    """
    careful = F.array(F.lit("never"), F.lit("conditional"), F.lit("safe"))
    over = _sides(found).where(~F.col("rule_id").eqNullSafe(F.col("effective_rule"))).groupBy("rule_id").agg(
        F.min("conflict_id").alias("conflict_id"),
        F.when(F.max((F.col("lint") == "manual_review").cast("int")) == 1, F.lit("manual_review")).otherwise(F.min("lint")).alias("_lint"),
        F.element_at(careful, F.min(F.array_position(careful, F.col("autofix"))).cast("int")).alias("_fix"),
    )
    joined = rules.join(over, rules["id"] == over["rule_id"], "left")
    return joined.select("id", F.coalesce("_lint", "severity").alias("severity"), F.coalesce("_fix", rules["autofix"]).alias("autofix"), "conflict_id")


def dangling_references(rules: DataFrame, found: DataFrame, known_sources: DataFrame) -> DataFrame:
    """(kind, id, missing): sources that rules or conflicts name and the index lacks, rules that conflicts name and the catalogue lacks."""
    src = rules.select(F.lit("rule source").alias("kind"), "id", F.col("source_id").alias("missing")).unionByName(found.select(F.lit("conflict source").alias("kind"), F.col("conflict_id").alias("id"), F.col("b_source_id").alias("missing")))
    src = src.where("missing is not null").join(known_sources.select(F.col("source_id").alias("missing")), "missing", "left_anti")
    named = _sides(found).select(F.lit("conflict rule").alias("kind"), F.col("conflict_id").alias("id"), F.col("rule_id").alias("missing"))
    named = named.join(rules.select(F.col("id").alias("missing")), "missing", "left_anti")
    return src.select("kind", "id", "missing").unionByName(named.select("kind", "id", "missing"))


def rules_without_basis(rules: DataFrame, unknown: DataFrame, topic_targets: DataFrame) -> DataFrame:
    """Rules on a topic that is registered as unknown, by a map (topic, target) that the caller maintains."""
    return rules.join(topic_targets.join(unknown, "topic").select("target", "unknown_id"), "target").select("id", "unknown_id")


def strongest_evidence(evidence: DataFrame) -> DataFrame:
    """Of (topic, source_id, source_type, ...) the strongest row for each topic within one source; never across sources."""
    rank = F.when(F.col("source_type").isin("red_annotation", "explicit_instruction"), 1).when(F.col("source_type") == "operational_summary", 2).when(F.col("source_type") == "example", 3).otherwise(4)
    order = W.partitionBy("topic", "source_id").orderBy(rank, "source_type")
    return evidence.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def source_relation(statements: DataFrame) -> DataFrame:
    """How two sources relate on a topic: (topic, relation) from (topic, source_id, source_type, value)."""
    grouped = statements.groupBy("topic").agg(F.countDistinct("source_id").alias("s"), F.countDistinct("value").alias("v"), F.max((F.col("source_type") == "example").cast("int")).alias("e"), F.max((F.col("source_type") != "example").cast("int")).alias("x"))
    relation = F.when(F.col("s") < 2, "complementary").when(F.col("v") == 1, "overlap").when((F.col("e") == 1) & (F.col("x") == 1), "example_vs_explicit").otherwise("contradiction")
    return grouped.select("topic", relation.alias("relation"))


def checkable_questions(rules: DataFrame) -> DataFrame:
    """(id, n): entries of the requirement; a rule should ask one checkable question."""
    return rules.select("id", F.coalesce(F.size(F.json_object_keys(F.to_json("requirement"))), F.lit(0)).cast("long").alias("n"))
