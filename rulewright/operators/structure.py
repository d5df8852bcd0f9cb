"""From classified paragraphs to what the rules speak of: parts of paragraphs, references, citations.

All of it is ours, by wording and place; there are no labelled data to learn from.
A paragraph has one role; parts of it that other rules concern (the page range of
a reference, the Latin letters of any text) become rows of their own with the
same ``seq``.  References are the entries behind the heading of the list.
Citations are brackets that hold a year; whose they are is read from the bracket,
or from the words before it with the help of the document's own list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import has_han
from .lint import cited_name, document_authors
from .references import parse_references

_LIST_HEADING = r"^\s*(参考文献|[Rr]eferences|REFERENCES)\s*[:：]?\s*$"
_RANGE = r"([0-9]+\s*[-–−~～—]\s*[0-9]+)\s*页?\s*[。.]?\s*$"
_BRACKET = r"([^（）()。；;]{0,40})[（(]([^（）()]*[12][0-9]{3}[a-z]?[^（）()]*)[)）]"
_NAME = r"\p{Lu}[\p{L}'’-]+"
_ENGLISH_BEFORE = rf"({_NAME}(?:(?:, {_NAME})* (?:&|and) {_NAME}| et al\.)?)\s*$"
_YEAR = r"([12][0-9]{3}[a-z]?)"


def in_context(elements: DataFrame) -> DataFrame:
    """What hangs on the paragraphs before: author lines behind the title, entries behind the list's heading, the figure of a caption."""
    before = W.partitionBy("doc_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    own, text = F.col("role"), F.trim(F.coalesce("text", F.lit("")))
    plain = (F.col("part") == "body") & (own == "body")
    behind_list = F.coalesce(F.max((F.col("part") == "body") & text.rlike(_LIST_HEADING)).over(before), F.lit(False))
    last = F.last(F.when((F.col("part") == "body") & (own != "empty"), own), ignorenulls=True).over(before)
    entry = plain & behind_list & text.rlike(_YEAR)
    author = plain & (last == "title") & (F.length(text) <= 40) & ~text.rlike("[。.]$")
    return elements.withColumns({"_entry": entry, "_author": F.coalesce(author, F.lit(False))}).withColumns({
        "role": F.when(F.col("_entry"), F.lit("reference_entry")).when(F.col("_author"), F.lit("author_name")).otherwise(own),
        "parent_seq": F.when(own == "figure_caption", F.last(F.when(own == "figure", F.col("seq")), ignorenulls=True).over(before)).otherwise(F.col("parent_seq")),
        "confidence": F.when(F.col("_entry"), F.lit(0.9)).when(F.col("_author"), F.lit(0.8)).otherwise(F.col("confidence")),
    }).drop("_entry", "_author")


def marked_up() -> Column:
    """The text with italics as ``<i>``."""
    parts = F.transform("runs", lambda r: F.when(r["italic"], F.concat(F.lit("<i>"), r["text"], F.lit("</i>"))).otherwise(r["text"]))
    return F.replace(F.array_join(parts, ""), F.lit("</i><i>"), F.lit(""))


def references_of(elements: DataFrame) -> DataFrame:
    """The entries of every document's list as references, numbered in their order."""
    entries = elements.where("role = 'reference_entry'")
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("seq"))
    lines = entries.select("doc_id", number.alias("ref_no"), F.trim(marked_up()).alias("raw"))
    found = parse_references(lines)
    translated = (F.col("lang") == "zh") & F.col("raw").rlike("译")
    return found.select("doc_id", "ref_no", "lang", translated.alias("is_translation"), F.coalesce("authors", F.expr("cast(array() as array<struct<surname:string,given:string>>)")).alias("authors"), "year", "suffix", "title", "kind", "container", "volume", "pages", "raw")


def with_parts(elements: DataFrame) -> DataFrame:
    """Elements and, as rows of their own, the parts of them that further rules concern."""
    lines = elements.where("role = 'reference_entry'").select("doc_id", F.col("seq").alias("ref_no"), F.trim(marked_up()).alias("raw"))
    fields = parse_references(lines).where("lang <> 'zh' and authors is not null").select("doc_id", F.col("ref_no").alias("seq"), F.col("title").alias("_title"), F.col("container").alias("_container"), F.regexp_extract("raw", r"^(.+?), [0-9]{4}", 1).alias("_names"))
    rows = elements.join(fields, ["doc_id", "seq"], "left")
    first_note = F.row_number().over(W.partitionBy("doc_id", "part", "role").orderBy("seq")) == 1
    rows = rows.withColumn("_first_note", (F.col("role") == "ordinary_footnote_text") & first_note)
    role, text, runs = F.col("role"), F.col("text"), F.col("runs")
    foreign = (role == "reference_entry") & ~has_han(F.substring(F.trim(text), 1, 1))

    def part(holds: Column, name: str, words: Column = text, of: Column = runs, sure: Column = F.col("confidence")) -> Column:
        return F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(name).alias("role"), sure.alias("confidence"), words.alias("text"), of.alias("runs")))

    of_journal = F.filter(runs, lambda r: (F.length(F.trim(r["text"])) > 0) & F.contains(F.col("_container"), F.trim(r["text"])))
    parts = [
        F.struct(role.alias("role"), F.col("confidence").alias("confidence"), text.alias("text"), runs.alias("runs")),
        part(role == "title", "title_author_info_marker"),
        part(F.col("_first_note"), "ordinary_footnote_numbering"),
        part(text.rlike("[A-Za-z0-9]") & ~role.isin("unreadable", "empty", "hyperlink", "bookmark", "section"), "latin_letters_and_digits"),
        part((role == "reference_entry") & text.rlike(_RANGE), "reference_page_range", F.regexp_extract(text, _RANGE, 1)),
        part(foreign, "foreign_reference_entry_layout"),
        part(F.length("_names") > 0, "english_reference_authors", F.col("_names"), sure=F.lit(0.8)),
        part(F.length("_title") > 0, "english_reference_title", F.col("_title"), sure=F.lit(0.8)),
        part(F.length("_container") > 0, "english_reference_journal_name", F.col("_container"), of_journal, F.lit(0.8)),
    ]
    kept = [c for c in elements.columns if c not in ("role", "confidence", "text", "runs")]
    return rows.select(*kept, F.explode(F.array_compact(F.array(*parts))).alias("_p")).select(*[f"_p.{c}" if c not in kept else c for c in elements.columns])


def _names(text: Column) -> Column:
    """Single names from `张三、李四等`, `Smith & Jones`, `Wang et al.`."""
    bare = F.regexp_replace(F.trim(text), r"(\s*et al\.|等)\s*$", "")
    return F.filter(F.transform(F.split(bare, r"\s*(、|和|&|\band\b|，|,|；|;)\s*"), lambda n: F.trim(F.regexp_replace(n, r"(\s*et al\.|等)\s*$", ""))), lambda n: F.length(n) > 0)


def citations_of(elements: DataFrame, refs: DataFrame) -> DataFrame:
    """The citations in texts and notes of every document."""
    texts = elements.where("role in ('body', 'ordinary_footnote_text', 'abstract', 'table_note') and text is not null")
    brackets = texts.select("doc_id", "part", F.col("seq").alias("_seq"), F.posexplode(F.regexp_extract_all("text", F.lit(_BRACKET), 0)).alias("_k", "_found"))
    found = brackets.withColumns({"_before": F.trim(F.regexp_extract("_found", _BRACKET, 1)), "_inside": F.trim(F.regexp_extract("_found", _BRACKET, 2))})
    # the longest listed name on which the words before the bracket end
    listed = refs.where("size(authors) > 0").select("doc_id", cited_name(F.get("authors", F.lit(0))).alias("_name")).distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("_name")).alias("_listed"))
    found = found.join(listed, "doc_id", "left").join(document_authors(elements), "doc_id", "left")
    bare = F.regexp_replace("_before", "等$", "")
    ends = F.filter(F.coalesce("_listed", F.expr("cast(array() as array<string>)")), lambda n: F.endswith(bare, n))
    chinese = F.coalesce(F.array_max(F.transform(ends, lambda n: F.struct(F.length(n).alias("l"), n.alias("n"))))["n"], F.regexp_extract(bare, r"(\p{IsHan}{2,3})$", 1))
    english = F.regexp_extract("_before", _ENGLISH_BEFORE, 1)
    inside = F.regexp_replace("_inside", rf"[\s，,]*{_YEAR}.*$", "")
    groups = F.split("_inside", "[；;]")
    named = F.length(inside) > 0
    titled = F.col("_before").rlike(r"[》”\"]$")
    years = F.regexp_extract_all("_inside", F.lit(_YEAR), 1)
    in_bracket = F.flatten(F.transform(groups, lambda g: _names(F.regexp_replace(g, rf"[\s，,]*{_YEAR}.*$", ""))))
    before = F.when(F.length(english) > 0, _names(english)).when(F.length(chinese) > 0, F.array(chinese)).otherwise(F.expr("cast(array() as array<string>)"))
    found = found.withColumns({"authors": F.when(named, in_bracket).otherwise(before), "years": years, "_named": named, "_titled": titled, "_groups": F.size(groups)})
    han, latin = F.exists("authors", has_han), F.exists("authors", lambda a: ~has_han(a))
    own = F.coalesce(F.exists("authors", lambda a: F.contains(F.col("names"), a)), F.lit(False))
    form = F.when(~F.col("_named"), F.when(F.col("_titled"), "narrative_title").otherwise("narrative")).when(own, "self").when((F.col("_groups") > 1) | (F.size("years") > 1), "multiple").otherwise("parenthetical")
    raw = F.when(F.col("_named"), F.regexp_extract("_found", r"([（(].*)$", 1)).when(F.col("_titled"), F.regexp_extract("_found", r"([（(].*)$", 1)).otherwise(F.concat(F.when(F.length(english) > 0, english).otherwise(F.concat(chinese, F.regexp_extract("_before", "(等)$", 1))), F.regexp_extract("_found", r"([（(].*)$", 1)))
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("_seq", "_k"))
    pages = F.nullif(F.regexp_extract("_inside", r"([0-9]+(?:[-—–][0-9]+)?)\s*页", 1), F.lit(""))
    return found.select("doc_id", "part", number.alias("seq"), number.alias("cite_no"), form.alias("form"), F.when(han & latin, "mixed").when(latin, "en").otherwise("zh").alias("lang"), "authors", "years", pages.alias("pages"), raw.alias("raw"))


def manuscript(elements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(elements with parts, citations, references) of classified paragraphs: what ``lint`` takes."""
    rows = in_context(elements)
    refs = references_of(rows)
    return with_parts(rows), citations_of(rows, refs), refs
