"""Numbers of rules and bitmaps of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class RuleBits:
    """Which bit of which word stands for a rule."""

    def __init__(self, rule_ids):
        self.ids = tuple(sorted(rule_ids))
        self.at = {r: k for k, r in enumerate(self.ids)}
        self.words = max(1, -(-len(self.ids) // 64))

    def value(self, rule_ids, word: int = 0) -> int:
        """The word of these rules, as a signed long."""
        bits = sum(1 << (self.at[r] & 63) for r in set(rule_ids) if self.at[r] >> 6 == word)
        return bits - (1 << 64) if bits >> 63 else bits

    def all(self, word: int = 0) -> int:
        return self.value(self.ids, word)

    def holds(self, bitmap: Column, rule_id: str) -> Column:
        k = self.at[rule_id]
        return F.get(bitmap, F.lit(k >> 6)).bitwiseAND(F.lit(self.value([rule_id], k >> 6))) != 0

    def names(self, bitmap: Column) -> Column:
        """The ids whose bits are set, in their order."""
        return F.array_compact(F.array(*[F.when(self.holds(bitmap, r), F.lit(r)) for r in self.ids]))

    def word_of(self, rule_id: Column, word: int = 0) -> Column:
        """The word in which only this rule's bit is set; 0 for other words and for null."""
        own = [(r, self.value([r], word)) for r in self.ids if self.at[r] >> 6 == word]
        values = F.create_map(*[F.lit(x) for pair in own for x in pair])
        return F.coalesce(F.try_element_at(values, rule_id), F.lit(0)).cast("long")
