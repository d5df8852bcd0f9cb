"""Verdicts of whole corpora as rule bitmaps.

Every rule has a number, its place among the sorted ids.  A document is one row:
one bitmap each of the rules that something in it breaks, that something in it
keeps, and that nothing in it meets (NOT_CHECKED), as words of 64 bits.  What an element
says of all rules is two words of one projection, so elements are never multiplied by rules;
words are combined by ``bit_or`` before and after one exchange of rows that hold nothing
but the document and its words.  A bitmap of Spark's own (``bitmap_construct_agg``) takes 4 KB whatever it
holds; 49 rules take 8 bytes here.

Special cases: a document of which no element has a role meets no rule; elements
with a null doc_id are one document, as are rows that repeat an id; an element may
be broken by a rule that another element of its document keeps, so both bits can be set.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lint import ELEMENT_CHECKS
from .rulebits import RuleBits

#: Rules that are decided by the words of one element; others need fonts, notes or lists that a plain text has not.
WORDING = ("ER-MS-AUTHORINFO-002", "ER-MS-REF-AUTHOR-001", "ER-MS-REF-PAGERANGE-001", "ER-MS-REF-TITLECASE-001", "ER-REF-FOREIGN-LINE-001")

_RANGE = r"([0-9]+\s*[-–−~～—]\s*[0-9]+)\s*页?\s*[。.]?$"
_NAMES = r"^([^0-9]+?), ?[(（]?[0-9]{4}"
_QUOTED = "[\"“]([^\"“”]+)[\"”]"


def _word(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), parts) if parts else F.lit(0).cast("long")


def element_words(elements: DataFrame, rules: dict[str, dict], bits: RuleBits, only=None) -> DataFrame:
    """doc_id and, for each word, ``_broken`` and ``_kept``: what one element says of all rules."""
    due = [(r, check) for r, check in ELEMENT_CHECKS.items() if r in rules and (only is None or r in only)]
    out = []
    for w in range(bits.words):
        own = [(F.coalesce(F.col("role") == rules[r]["target"], F.lit(False)), check(rules[r]["need"]), F.lit(bits.value([r], w)).cast("long")) for r, check in due if bits.at[r] >> 6 == w]
        none = F.lit(0).cast("long")
        out.append(_word([F.when(concerned & ~ok, bit).otherwise(none) for concerned, ok, bit in own]).alias(f"_broken{w}"))
        out.append(_word([F.when(concerned & ok, bit).otherwise(none) for concerned, ok, bit in own]).alias(f"_kept{w}"))
    return elements.select("doc_id", *out)


def _combined(words: DataFrame, bits: RuleBits, n_elements: Column) -> DataFrame:
    """One row a document from rows of words: bits are set that any of them sets."""
    names = [f"_{kind}{w}" for kind in ("broken", "kept") for w in range(bits.words)]
    per_doc = words.groupBy("doc_id").agg(n_elements.alias("n_elements"), *[F.bit_or(c).alias(c) for c in names])
    each = [F.array(*[F.col(f"_{kind}{w}") for w in range(bits.words)]).alias(kind) for kind in ("broken", "kept")]
    unmet = [F.bitwise_not(F.col(f"_broken{w}").bitwiseOR(F.col(f"_kept{w}"))).bitwiseAND(F.lit(bits.all(w))) for w in range(bits.words)]
    return per_doc.select("doc_id", "n_elements", *each, F.array(*unmet).alias("unmet"))


def document_bitmaps(elements: DataFrame, rules: dict[str, dict], only=None) -> tuple[DataFrame, RuleBits]:
    """(doc_id, n_elements, broken, kept, unmet) of every document, and the numbering of the rules."""
    bits = RuleBits(rules)
    return _combined(element_words(elements, rules, bits, only), bits, F.count("*")), bits


def merge_bitmaps(parts: DataFrame, bits: RuleBits) -> DataFrame:
    """One row a document from bitmaps of several passes over the same rules (parts of a corpus, or kinds of elements)."""
    flat = parts.select("doc_id", "n_elements", *[F.get(kind, F.lit(w)).alias(f"_{kind}{w}") for kind in ("broken", "kept") for w in range(bits.words)])
    return _combined(flat, bits, F.sum("n_elements"))


def rule_coverage(bitmaps: DataFrame, bits: RuleBits) -> DataFrame:
    """(rule_id, broken, kept, unmet): in how many documents each rule is so; one aggregate over one row a document."""
    kinds = ("broken", "kept", "unmet")
    sums = [F.coalesce(F.count_if(bits.holds(F.col(kind), r)), F.lit(0)).alias(f"{kind}{k}") for k, r in enumerate(bits.ids) for kind in kinds]
    rows = F.array(*[F.struct(F.lit(r).alias("rule_id"), *[F.col(f"{kind}{k}").alias(kind) for kind in kinds]) for k, r in enumerate(bits.ids)])
    return bitmaps.agg(*sums).select(F.inline(rows))


def verdict_of(bitmaps: DataFrame, bits: RuleBits) -> DataFrame:
    """(doc_id, rule_id, state): every rule on every document out of its bitmaps; broken before kept, NOT_CHECKED where unmet."""
    state = lambda r: F.when(bits.holds(F.col("broken"), r), "BROKEN").when(bits.holds(F.col("kept"), r), "PASS").otherwise("NOT_CHECKED")
    return bitmaps.select("doc_id", F.inline(F.array(*[F.struct(F.lit(r).alias("rule_id"), state(r).alias("state")) for r in bits.ids])))


def wording_parts(lines: DataFrame) -> DataFrame:
    """Decoded lines and, as rows of their own, the parts of references that rules of their own concern."""
    text, reference = F.col("text"), F.col("role") == "reference_entry"

    def part(name: str, words: Column, holds: Column) -> Column:
        return F.when(F.coalesce(reference & holds, F.lit(False)), F.struct(F.lit(name).alias("role"), words.alias("text")))

    foreign = ~text.rlike(r"^\p{IsHan}")
    parts = F.array_compact(F.array(
        F.struct(F.col("role"), text),
        part("reference_page_range", F.regexp_extract(text, _RANGE, 1), text.rlike(_RANGE)),
        part("foreign_reference_entry_layout", text, foreign),
        part("english_reference_authors", F.regexp_extract(text, _NAMES, 1), foreign & text.rlike(_NAMES)),
        part("english_reference_title", F.regexp_extract(text, _QUOTED, 1), foreign & text.rlike(_QUOTED)),
    ))
    kept = [c for c in lines.columns if c not in ("role", "text")]
    return lines.select(*kept, F.inline_outer(parts))
