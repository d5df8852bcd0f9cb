"""What policy lets a rule change, in one place for verdicts and fixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A fix that depends on recognised structure needs at least this confidence (ours: the catalogue gives no number).
CONFIDENCE = 0.9
#: Rules whose breach has one clear remedy, which ``fix`` knows; other conditional rules are left to a person.
FIXABLE = (
    "ER-MS-AUTHORINFO-002", "ER-MS-REF-PAGERANGE-001", "ER-MS-TITLE-001", "ER-MS-AUTHOR-001", "ER-MS-AUTHORINFO-001", "ER-MS-ABSTRACT-001", "ER-MS-HEADING1-001", "ER-MS-EQUATION-002",
    "ER-MS-TABLE-NOTE-002", "ER-MS-FOOTNOTE-001", "ER-MS-FOOTNOTE-002", "ER-MS-FIGURE-001", "ER-MS-REF-LAYOUT-001", "ER-MS-LATIN-FONT-001", "ER-MS-REF-JOURNAL-001",
)


def allowed(autofix: Column, confidence: Column, least: float = CONFIDENCE) -> Column:
    """Whether a rule may change an element recognised with this confidence (unknown counts as sure for safe rules only)."""
    return F.when(autofix == "safe", F.coalesce(confidence > 0, F.lit(True))).when(autofix == "conditional", F.coalesce(confidence >= least, F.lit(False))).otherwise(F.lit(False))
