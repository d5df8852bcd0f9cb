"""Parsing reference lines into fields, and writing fields as lines.

Both are deterministic templates of our own: authors, year, title, container,
volume, pages.  Chinese lines use full-width commas, foreign ones put article
titles in double quotes and journals in italics (``<i>``).  What a line lacks is
null; a line that does not start with authors and a year has only ``raw``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_han

_ZH = r"^([^，]+)，([0-9]{4})([a-z]?)，([^，]+)(?:，([^，]+))?(?:，([^，]+))?(?:，([^，]+))?$"
_EN = r'^(.+?), ([0-9]{4})([a-z]?), ("?)([^"]+?)"?, (<i>)?([^<]+?)(?:</i>)?(?:, ([^,]+))?(?:, ([0-9—-]+))?$'


def _part(pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract("raw", pattern, k), F.lit(""))


def _authors(text: Column, chinese: Column) -> Column:
    """Structs of surname and given name; a Han name without spaces has one character as its surname."""
    zh = F.transform(F.split(text, "、"), lambda a: F.struct(F.substring(a, 1, 1).alias("surname"), F.substr(a, F.lit(2)).alias("given")))
    en = F.transform(F.split(text, "; "), lambda a: F.struct(F.split_part(a, F.lit(", "), F.lit(1)).alias("surname"), F.split_part(a, F.lit(", "), F.lit(2)).alias("given")))
    return F.when(chinese, zh).otherwise(en)


def parse_references(lines: DataFrame) -> DataFrame:
    """(doc_id, ref_no, raw) -> the fields of a reference."""
    chinese = has_han(F.substring("raw", 1, 1))
    pick = lambda zh, en: F.when(chinese, _part(_ZH, zh)).otherwise(_part(_EN, en))
    names = pick(1, 1)
    return lines.select(
        "doc_id", "ref_no", F.when(chinese, F.lit("zh")).otherwise(F.lit("en")).alias("lang"), F.when(names.isNotNull(), _authors(names, chinese)).alias("authors"),
        pick(2, 2).cast("int").alias("year"), pick(3, 3).alias("suffix"), pick(4, 5).alias("title"),
        F.when(names.isNotNull(), F.when(chinese | (F.regexp_extract("raw", _EN, 4) == '"'), F.lit("article")).otherwise(F.lit("book"))).alias("kind"),
        pick(5, 7).alias("container"), pick(6, 8).alias("volume"), pick(7, 9).alias("pages"), "raw",
    )


def format_references(refs: DataFrame) -> DataFrame:
    """(doc_id, ref_no, line): fields in the order of the rules; absent ones are left out."""
    zh = F.concat_ws("，", F.array_join(F.transform("authors", lambda a: F.concat(a["surname"], F.coalesce(a["given"], F.lit("")))), "、"), F.concat(F.col("year").cast("string"), F.coalesce("suffix", F.lit(""))), "title", "container", "volume", "pages")
    title = F.when(F.col("kind") == "article", F.concat(F.lit('"'), F.col("title"), F.lit('"'))).otherwise(F.col("title"))
    container = F.when(F.col("kind") == "article", F.concat(F.lit("<i>"), F.col("container"), F.lit("</i>"))).otherwise(F.col("container"))
    en = F.concat_ws(", ", F.array_join(F.transform("authors", lambda a: F.concat_ws(", ", a["surname"], a["given"])), "; "), F.concat(F.col("year").cast("string"), F.coalesce("suffix", F.lit(""))), title, container, "volume", "pages")
    return refs.select("doc_id", "ref_no", F.when(F.col("lang") == "zh", zh).otherwise(en).alias("line"))
