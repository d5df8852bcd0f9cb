"""Validation of rule catalogues and, with the same parts, of ordinary tables.

All checks of a row are expressions of one projection; only the search for
repeated identities needs a shuffle.  Membership is two-valued: a null or absent
value is not a member.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.catalogue import RuleSchema

_FIELD_OF = {"domain": "domain", "normativity": "normativity", "autofix": "autofix", "source_type": "source_type", "lint_severity": "severity"}
_MESSAGE = {"domain": "domain", "normativity": "normativity", "autofix": "autofix", "source_type": "source_type", "lint_severity": "lint severity"}


def is_member(value: Column, allowed: tuple[str, ...]) -> Column:
    """Membership that is false for null."""
    return F.coalesce(value.isin(*allowed), F.lit(False)) if allowed else F.lit(False)


def with_duplicate_flag(rules: DataFrame) -> DataFrame:
    """``duplicate``: an earlier rule, in any file, has this identity; absent ids share one."""
    order = W.partitionBy("_identity").orderBy("file_ord", "rule_ord")
    keyed = rules.withColumn("_identity", F.element_at("shown", "identity"))
    return keyed.withColumn("duplicate", F.row_number().over(order) > 1).drop("_identity")


def rule_errors(rules: DataFrame, schema: RuleSchema | None = None) -> DataFrame:
    """(file_ord, rule_ord, err_ord, rule_id, message), every error of every rule, in fixed order.

    For one rule: repeated id, missing fields in schema order, then domain,
    normativity, autofix, source type, severity.  Rules on which a plain loop
    would stop are left to ``broken_rules``.
    """
    schema = schema or RuleSchema()
    label = F.element_at("shown", "label")
    checked = with_duplicate_flag(rules.where(F.size("broken") == 0))
    found = [F.when(F.col("duplicate"), F.lit("duplicate id"))]
    found += [F.when(~F.array_contains("present_fields", f), F.lit(f"missing required field {f}")) for f in schema.required]
    for enum, allowed in schema.enums.items():
        field = _FIELD_OF[enum]
        # a name in Python's notation without quotes is no string and equals no allowed value
        as_text = F.coalesce(F.element_at("shown", field).rlike("^['\"]"), F.lit(False))
        found.append(F.when(~(as_text & is_member(F.col(field), allowed)), F.concat(F.lit(f"invalid {_MESSAGE[enum]} "), F.element_at("shown", field))))
    listed = checked.select("file_ord", "rule_ord", label.alias("rule_id"), F.posexplode(F.array_compact(F.array(*found))).alias("err_ord", "error"))
    return listed.select("file_ord", "rule_ord", "err_ord", "rule_id", F.concat("rule_id", F.lit(": "), "error").alias("message"))


def broken_rules(rules: DataFrame) -> DataFrame:
    """(file_ord, rule_ord, rule_id, fault): faults on which validation by a plain loop would stop."""
    return rules.select("file_ord", "rule_ord", F.element_at("shown", "label").alias("rule_id"), F.explode("broken").alias("fault"))


def report(rules: DataFrame, schema: RuleSchema | None = None) -> tuple[int, list[str]]:
    """(exit code, lines): what the command line prints.

    Collects messages only; their number is bounded by the catalogue, which is configuration.
    """
    rules = rules.cache()
    try:
        faults = broken_rules(rules).orderBy("file_ord", "rule_ord").collect()
        if faults:
            raise ValueError("; ".join(f"{r['rule_id']}: {r['fault']}" for r in faults))
        errors = [r["message"] for r in rule_errors(rules, schema).orderBy("file_ord", "rule_ord", "err_ord").collect()]
        return (1, [f"ERROR {e}" for e in errors]) if errors else (0, [f"OK: {rules.count()} rules validated"])
    finally:
        rules.unpersist()


# ---- the same checks over ordinary tables; which columns and values are checked is ours to say ----


def table_errors(table: DataFrame, key: str, required: tuple[str, ...] = (), enums: dict[str, tuple[str, ...]] | None = None, unique: tuple[str, ...] = (), order: tuple[str, ...] = (), nested: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(key, err_ord, error) for each breach.

    ``required`` columns hold no null; ``enums`` columns one of the values;
    ``nested`` maps a name to (JSON column, path) that must give a value; rows
    that are not the first (by ``order``) of their identity in ``unique`` are
    repeats, and where several tie for the first place all of them are.
    Checks without ``unique`` need no shuffle.  For it, first places are found
    by aggregates of narrow rows, so an identity that many rows share (null, say)
    is no sort of all of them in one task.
    """
    found = []
    if unique:
        by = list(order) or [key]
        places = table.groupBy(*[F.col(c).alias(f"_u{k}") for k, c in enumerate(unique)], F.struct(*by).alias("_place")).agg(F.count("*").alias("_n"))
        ids = [f"_u{k}" for k in range(len(unique))]
        first = places.groupBy(*ids).agg(F.min(F.struct("_place", "_n")).alias("_first"), F.sum("_n").alias("_all")).where("_all > 1")
        same = reduce(lambda a, kc: a & F.col(kc[1]).eqNullSafe(F.col(f"_u{kc[0]}")), enumerate(unique), F.lit(True))
        table = table.join(first, same, "left")
        repeat = (F.struct(*by) != F.col("_first._place")) | (F.col("_first._n") > 1)
        found.append(F.when(F.col("_first").isNotNull() & repeat, F.lit(f"duplicate {','.join(unique)}")))
    found += [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required]
    found += [F.when(~is_member(F.col(c), v), F.concat(F.lit(f"invalid {c} "), F.coalesce(F.col(c).cast("string"), F.lit("None")))) for c, v in (enums or {}).items()]
    found += [F.when(F.get_json_object(c, path).isNull(), F.lit(f"missing {name}")) for name, (c, path) in (nested or {}).items()]
    return table.select(F.col(key).alias("key"), F.posexplode(F.array_compact(F.array(*found))).alias("err_ord", "error"))


def error_summary(errors: DataFrame) -> DataFrame:
    """(error, n): how often each breach occurs."""
    return errors.groupBy("error").agg(F.count("*").alias("n"))
