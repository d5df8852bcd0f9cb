"""Fixes of texts and layout, and the check of what they did.

A fix is one projection over elements, only for rules that policy lets change an
element, and only where the role was recognised with confidence.  It sets what a
rule names: a wording, fonts, a size, an alignment, an indent, numbering.
Applying it again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import size_points, with_em_dash
from .lint import ELEMENT_CHECKS
from .policy import CONFIDENCE, FIXABLE, allowed

#: rule -> new text, from the rule's requirement.
TEXT_FIXES = {
    "ER-MS-AUTHORINFO-002": lambda text, need: F.replace(text, F.lit(need["disallowed_term"]), F.lit(need["preferred_term"])),
    "ER-MS-REF-PAGERANGE-001": lambda text, need: with_em_dash(text),
}
#: Rules that a change of layout satisfies whole.
LAYOUT_FIXES = tuple(r for r in FIXABLE if r not in TEXT_FIXES)


def _run(run: Column, need: dict) -> Column:
    out = run
    for field in ("east_asia_font", "ascii_font", "hansi_font", "italic"):
        if field in need:
            out = out.withField(field, F.lit(need[field]))
    sizes = [size_points(s) for s in need.get("font_size_allowed_cn") or ([need["font_size_cn"]] if "font_size_cn" in need else [])]
    return out.withField("size_pt", F.when(run["size_pt"].isin(sizes), run["size_pt"]).otherwise(F.lit(sizes[0]))) if sizes else out


def _runs(runs: Column, need: dict) -> Column:
    return F.transform(runs, lambda r: _run(r, need))


def _para(para: Column, need: dict) -> Column:
    for entry, field in (("alignment", "alignment"), ("leading_spaces_cn", "lead_spaces"), ("numbered", "numbered"), ("restart", "num_restart")):
        if entry in need:
            para = para.withField(field, F.lit(need[entry]))
    return para


def fix(elements: DataFrame, rules: dict[str, dict], least: float = CONFIDENCE) -> DataFrame:
    """Elements with ``text``, ``runs`` and ``para`` fixed, and ``fixed_rules``: what was applied where it was due.

    An element has one role, so rules of different targets are branches of one
    expression; those of one target are applied one after the other.
    """
    same_target: dict[str, list[str]] = {}
    for rule_id in FIXABLE:
        if rule_id in rules:
            same_target.setdefault(rules[rule_id]["target"], []).append(rule_id)
    branches, applied = {c: [] for c in ("text", "runs", "para")}, []
    for target, ids in same_target.items():
        now = {c: F.col(c) for c in branches}
        for rule_id in ids:
            rule = rules[rule_id]
            due = F.coalesce((F.col("role") == target) & ~ELEMENT_CHECKS[rule_id](rule["need"]) & allowed(F.lit(rule["autofix"]), F.col("confidence"), least), F.lit(False))
            if rule_id in TEXT_FIXES:
                change = {"text": TEXT_FIXES[rule_id](now["text"], rule["need"])}
            else:
                change = {"runs": _runs(now["runs"], rule["need"]), "para": _para(now["para"], rule["need"])}
            now |= {c: F.when(due, new).otherwise(now[c]) for c, new in change.items()}
            applied.append(F.when(due, F.lit(rule_id)))
        for c, new in now.items():
            branches[c].append((target, new))
    fixed = F.array_compact(F.array(*applied)) if applied else F.expr("cast(array() as array<string>)")

    def of_role(column: str) -> Column:
        cases = branches[column]
        if not cases:
            return F.col(column)
        out = F.when(F.col("role") == cases[0][0], cases[0][1])
        for target, new in cases[1:]:
            out = out.when(F.col("role") == target, new)
        return out.otherwise(F.col(column))

    return elements.withColumns({c: of_role(c) for c in branches} | {"fixed_rules": fixed})


def relint_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, seq, rule_id, was, now) where a second lint differs from the first."""
    keys = ["doc_id", "seq", "rule_id"]
    a = before.where("seq is not null").groupBy(*keys).agg(F.max("status").alias("was"))
    b = after.where("seq is not null").groupBy(*keys).agg(F.max("status").alias("now"))
    return a.join(b, keys, "full").where(~F.col("was").eqNullSafe(F.col("now")))


def write_fixed(elements: DataFrame, path: str) -> None:
    """To a new place only: an existing one is an error, so no original is overwritten."""
    elements.write.mode("error").parquet(path)
