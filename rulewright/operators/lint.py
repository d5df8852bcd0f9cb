"""Linting: rules applied to document elements, citations and references.

Rules are configuration: their requirements are read once on the driver and each
becomes one boolean expression, so that Catalyst sees constants.  Elements are
read once: rules that concern one row need no shuffle, and those that look at
other elements of the document share one exchange for their windows.  Citations
meet the list of references by equi-joins on document, name and year.

Interpretations are ours wherever the catalogue leaves the evaluation open.

Input columns
    elements   doc_id, part, seq, role, confidence, page_no, text,
               para struct<alignment, lead_spaces, num_restart, numbered, style_id>,
               runs array<struct<text, east_asia_font, ascii_font, hansi_font, size_pt, italic, field_kind>>,
               obj struct<kind, editor, color_mode>, parent_seq
    citations  doc_id, part, seq, cite_no, form, lang, authors array<string>, years array<string>, pages, raw
    refs       doc_id, ref_no, lang, is_translation, authors array<struct<surname, given>>, year, suffix,
               title, kind, container, volume, pages, raw

Output: findings (doc_id, seq, rule_id, target, ok) and, after ``verdicts``,
status and fixable.  ``seq`` is the element's, citation's or reference's number.
A condition that cannot be decided for lack of a value does not hold.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import has_han, hyphenated_range, initial_is_certain, ladder_step, size_points, surname_initial
from .policy import CONFIDENCE, FIXABLE, allowed
from .rulebits import RuleBits

ELEMENTS_DDL = (
    "doc_id long, part string, seq int, role string, confidence double, page_no int, text string, "
    "para struct<alignment:string,lead_spaces:int,num_restart:string,numbered:boolean,style_id:string>, "
    "runs array<struct<text:string,east_asia_font:string,ascii_font:string,hansi_font:string,size_pt:double,italic:boolean,field_kind:string>>, "
    "obj struct<kind:string,editor:string,color_mode:string>, parent_seq int"
)
CITATIONS_DDL = "doc_id long, part string, seq int, cite_no int, form string, lang string, authors array<string>, years array<string>, pages string, raw string"
REFS_DDL = "doc_id long, ref_no int, lang string, is_translation boolean, authors array<struct<surname:string,given:string>>, year int, suffix string, title string, kind string, container string, volume string, pages string, raw string"
#: Words that stay lower case in a title (ours: the catalogue gives no list).
SMALL_WORDS = ("a", "an", "the", "and", "or", "but", "nor", "of", "in", "on", "at", "to", "for", "from", "by", "with", "as", "vs")

Check = Callable[[dict], Column]


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _every_run(test: Callable[[Column], Column]) -> Column:
    """All runs that show text pass, and there is one."""
    shown = F.filter("runs", lambda r: F.length(F.trim(r["text"])) > 0)
    return _sure((F.size(shown) > 0) & F.forall(shown, lambda r: _sure(test(r))))


def _layout(need: dict) -> Column:
    """The entries that many layout rules share: fonts, sizes, alignment, indents, numbering, italics."""
    parts: list[Column] = []
    for entry, field in (("east_asia_font", "east_asia_font"), ("ascii_font", "ascii_font"), ("hansi_font", "hansi_font"), ("italic", "italic")):
        if entry in need:
            parts.append(_every_run(lambda r, e=entry, f=field: r[f] == F.lit(need[e])))
    sizes = need.get("font_size_allowed_cn") or ([need["font_size_cn"]] if "font_size_cn" in need else [])
    if sizes:
        parts.append(_every_run(lambda r: r["size_pt"].isin([size_points(s) for s in sizes])))
    for entry, field in (("alignment", "alignment"), ("leading_spaces_cn", "lead_spaces"), ("numbered", "numbered"), ("restart", "num_restart")):
        if entry in need:
            parts.append(_sure(F.col(f"para.{field}") == F.lit(need[entry])))
    whole = F.lit(True)
    for p in parts:
        whole = whole & p
    return whole


def _latin(need: dict) -> Column:
    latin = F.filter("runs", lambda r: r["text"].rlike("[A-Za-z0-9]"))
    return _sure(F.forall(latin, lambda r: _sure((r["ascii_font"] == need["ascii_font"]) & (r["hansi_font"] == need["hansi_font"]))))


def _number_pattern(sample: str) -> str:
    """What a sample number stands for: `1.` for any number with a point, `（一）` for any Chinese one in brackets."""
    parts = re.split(r"([0-9]+|[一二三四五六七八九十]+)", sample)
    return r"^\s*" + "".join(("[0-9]+" if p[0].isdigit() and p.isascii() else "[一二三四五六七八九十]+") if k % 2 else re.escape(p) for k, p in enumerate(parts) if p)


def _level() -> Column:
    """The level of a heading, null for other elements."""
    return F.when(F.col("role") == "heading_level_1", 1).when(F.col("role") == "heading_numbering", F.nullif(F.regexp_extract("para.style_id", r"([0-9]+)$", 1), F.lit("")).cast("int"))


def _numbering(need: dict) -> Column:
    """Each level has the form of its number, and no level is left out on the way down."""
    level, second = _level(), need["level_2"]
    right = F.when(level == 2, F.col("text").rlike(_number_pattern(second["prefix_pattern"])) & (F.col("para.lead_spaces") == second["leading_spaces_cn"]))
    for k, sample in enumerate(need["lower_levels"]["sequence"], 3):
        right = right.when(level == k, F.col("text").rlike(_number_pattern(sample)))
    return _sure(right.otherwise(F.lit(True)) & F.coalesce(level <= F.coalesce("_last_level", F.lit(0)) + 1, F.lit(True)))


#: Rules decided on one element.
ELEMENT_CHECKS: dict[str, Check] = {
    **{r: _layout for r in ("ER-MS-TITLE-001", "ER-MS-AUTHOR-001", "ER-MS-AUTHORINFO-001", "ER-MS-ABSTRACT-001", "ER-MS-HEADING1-001", "ER-MS-TABLE-NOTE-002", "ER-MS-FOOTNOTE-001", "ER-MS-FOOTNOTE-002", "ER-MS-FIGURE-001", "ER-MS-REF-LAYOUT-001", "ER-MS-REF-JOURNAL-001")},
    "ER-MS-AUTHORINFO-002": lambda need: _sure(~F.contains("text", F.lit(need["disallowed_term"]))),
    "ER-MS-EQUATION-001": lambda need: _sure(F.col("obj.editor").isin(need["allowed_editors"])),
    "ER-MS-EQUATION-002": lambda need: _sure(~F.startswith(F.trim("text"), F.lit(need["trigger_text"])) | (F.col("para.lead_spaces") == need["leading_spaces_cn"])),
    "ER-MS-FIGURE-002": lambda need: _sure(F.col("obj.color_mode") == need["color_mode"]),
    "ER-MS-LATIN-FONT-001": _latin,
    "ER-MS-REF-PAGERANGE-001": lambda need: ~hyphenated_range(F.col("text")),
    "ER-MS-REF-TITLECASE-001": lambda need: _sure(F.col("text").rlike(r"^[\s\"“]*\p{Lu}")),
    "ER-MS-REF-AUTHOR-001": lambda need: _sure(F.col("text").rlike(r"^\p{Lu}[\p{L}'-]+, (\p{Lu}\.[ -]?)+(,? (and|&) ((\p{Lu}\.[ -]?)+ ?\p{Lu}[\p{L}'-]+|\p{Lu}[\p{L}'-]+, (\p{Lu}\.[ -]?)+))*$")),
    "ER-REF-FOREIGN-LINE-001": lambda need: _sure(F.col("text").rlike(",") & ~F.col("text").rlike(r"\n")),
}


def _points() -> Column:
    return F.array_max(F.transform("runs", lambda r: r["size_pt"]))


#: Rules that look at other elements of the document, through the columns of ``_with_neighbours``.
NEIGHBOUR_CHECKS: dict[str, Check] = {
    "ER-MS-TITLE-002": lambda need: _sure(F.col("_noted") & F.contains("text", F.lit(need["marker"]))),
    "ER-MS-HEADING-HIERARCHY-001": _numbering,
    "ER-MS-TABLE-001": lambda need: _sure(_points() < F.col("_body")) & _layout({"east_asia_font": need["east_asia_font"]}),
    "ER-MS-TABLE-NOTE-001": lambda need: _sure(ladder_step(_points()) - ladder_step(F.col("_table")) == 1),
}


def _with_neighbours(elements: DataFrame, marker: str) -> DataFrame:
    """A footnote with the marker, least size of the body and of the own table, and level of the heading before.

    All windows are partitioned by the document, so one exchange serves them all.
    """
    document = W.partitionBy("doc_id")
    return elements.withColumns({
        "_noted": F.max((F.col("part") == "footnote") & F.startswith(F.trim("text"), F.lit(marker))).over(document),
        "_body": F.min(F.when(F.col("role") == "body", _points())).over(document),
        "_table": F.when(F.col("parent_seq").isNotNull(), F.min(F.when(F.col("role") == "table_text", _points())).over(W.partitionBy("doc_id", "parent_seq"))),
        "_last_level": F.last(_level(), ignorenulls=True).over(document.orderBy("seq").rowsBetween(W.unboundedPreceding, -1)),
    })


def _first_author() -> Column:
    return F.get("authors", F.lit(0))


def _is_zh() -> Column:
    return F.col("lang") == "zh"


def _year_list(need: dict) -> Column:
    """One author, years of form YYYY or YYYYx that the given sign divides."""
    return _sure((F.size(F.array_distinct("authors")) <= 1) & F.col("raw").rlike(rf"[0-9]{{4}}[a-z]?({need['year_separator']}[0-9]{{4}}[a-z]?)+"))


CITATION_CHECKS: dict[str, Check] = {
    "ER-CIT-GENERAL-001": lambda need: _sure((F.col("part") != "footnote") & (F.col("form") != "footnote")),
    "ER-CIT-GENERAL-002": lambda need: _sure((F.size("authors") > 0) & (F.size("years") > 0) & F.forall("years", lambda y: ~y.rlike(r"[0-9]{4}[-./年][0-9]{1,2}"))),
    "ER-CIT-NARRATIVE-001": lambda need: _sure(F.col("raw").rlike(r"[（(][0-9]{4}[a-z]?([，,:：][^（()）]*)?[)）]")),
    "ER-CIT-SELF-001": lambda need: _sure(F.length(F.trim(_first_author())) > 0) & F.coalesce(F.contains("_document_authors", _first_author()), F.lit(True)),
    "ER-CIT-TITLE-IN-SENTENCE-001": lambda need: _sure(F.col("raw").rlike(r"^[（(][0-9]{4}[a-z]?([，,:：] ?(第|pp?\.? ?)?[0-9—-]+页?)?[)）]$")),
    "ER-CIT-MULTI-AUTHORSOURCES-001": lambda need: _sure(F.size(F.split("raw", need["separator"])) >= F.size("years")),
    "ER-CIT-SAMEAUTHOR-MULTIYEAR-001": _year_list,
    "ER-CIT-TRANSLATION-001": lambda need: has_han(_first_author()) & F.coalesce(F.col("_translation_of_year") | ~F.col("_translation"), F.lit(True)),
    "ER-CIT-FOREIGN-ORIGINAL-001": lambda need: _sure((F.size("authors") > 0) & F.forall("authors", lambda a: ~has_han(a))),
    "ER-CIT-MIXEDLANG-001": lambda need: _sure(F.exists("authors", has_han) & F.exists("authors", lambda a: ~has_han(a))) & ~F.coalesce("_contradicts", F.lit(False)),
    "ER-CIT-EN-TWOAUTHORS-001": lambda need: _sure(F.col("raw").rlike(rf"\p{{L}} {need['author_connector']} \p{{L}}")),
    "ER-CIT-EN-MULTIAUTHORS-001": lambda need: _sure(F.contains("raw", F.lit(need["abbreviation"]))),
    "ER-CIT-ZH-TWOAUTHORS-001": lambda need: _sure(F.contains("raw", F.lit(need["author_connector"]))),
    "ER-CIT-ZH-MULTIAUTHORS-001": lambda need: _sure(F.contains("raw", F.lit(need["abbreviation"]))),
}

def citation_scope() -> dict[str, Column]:
    """Which citations a rule concerns, by their own fields and the number of authors that the list has for them."""
    several = F.coalesce("_listed_authors", F.size("authors")) >= 3
    return {
        "ER-CIT-GENERAL-001": F.lit(True),
        "ER-CIT-GENERAL-002": F.col("form") == "parenthetical",
        "ER-CIT-NARRATIVE-001": F.col("form") == "narrative",
        "ER-CIT-SELF-001": F.col("form") == "self",
        "ER-CIT-TITLE-IN-SENTENCE-001": F.col("form") == "narrative_title",
        "ER-CIT-MULTI-AUTHORSOURCES-001": (F.col("form") == "multiple") & (F.size(F.array_distinct("authors")) > 1),
        "ER-CIT-SAMEAUTHOR-MULTIYEAR-001": (F.col("form") == "multiple") & (F.size(F.array_distinct("authors")) <= 1),
        "ER-CIT-TRANSLATION-001": F.col("form") == "translation",
        "ER-CIT-FOREIGN-ORIGINAL-001": ~_is_zh() & (F.col("form") == "original"),
        "ER-CIT-MIXEDLANG-001": F.col("lang") == "mixed",
        "ER-CIT-EN-TWOAUTHORS-001": (F.col("lang") == "en") & (F.size("authors") == 2) & ~several & F.col("form").isin("narrative", "parenthetical"),
        "ER-CIT-EN-MULTIAUTHORS-001": (F.col("lang") == "en") & several & F.col("form").isin("narrative", "parenthetical"),
        "ER-CIT-ZH-TWOAUTHORS-001": _is_zh() & (F.size("authors") == 2) & ~several & F.col("form").isin("narrative", "parenthetical"),
        "ER-CIT-ZH-MULTIAUTHORS-001": _is_zh() & several & F.col("form").isin("narrative", "parenthetical"),
    }


def _field_order(need: dict) -> Column:
    """Each field that the entry has is found behind the end of the one before it."""
    author = F.get("authors", F.lit(0))["surname"]
    fields = F.filter(F.array(author, F.col("year").cast("string"), "title", "container", "volume", "pages"), lambda f: F.length(f) > 0)
    return _sure(F.aggregate(fields, F.lit(0), lambda end, f: F.when((end < 0) | (F.position(f, F.col("raw"), end + 1) == 0), -1).otherwise(F.position(f, F.col("raw"), end + 1) + F.length(f) - 1)) >= 0)


def _content_words(need: dict) -> Column:
    words = F.split(F.regexp_replace("title", r"[\"“”:,.?!]", ""), r"\s+")
    return _sure(F.forall(words, lambda w: (w == "") | F.lower(w).isin(*SMALL_WORDS) | w.rlike(r"^[^\p{L}]*\p{Lu}") | ~w.rlike(r"\p{L}")))


def _quoted() -> Column:
    return F.col("raw").rlike(r"[\"“]") & F.contains("raw", F.col("title")) & F.regexp_replace("raw", r"[“”]", '"').contains(F.concat(F.lit('"'), F.regexp_replace("title", r"[,.]$", "")))


REFERENCE_CHECKS: dict[str, Check] = {
    "ER-REF-ORDER-FIELDS-001": _field_order,
    "ER-REF-TRANSLATION-001": lambda need: _sure(has_han(F.get("authors", F.lit(0))["surname"]) & has_han(F.col("title")) & F.col("year").isNotNull()),
    "ER-REF-FOREIGN-AUTHOR-001": lambda need: _sure((F.size("authors") > 0) & F.forall("authors", lambda a: a["surname"].rlike(r"^\p{Lu}") & a["given"].rlike(r"^(\p{Lu}\.[ -]?)+$|^\p{Lu}\p{Ll}+")) & F.contains("raw", F.concat(F.get("authors", F.lit(0))["surname"], F.lit(",")))),
    "ER-REF-FOREIGN-TITLE-001": _content_words,
    "ER-REF-FOREIGN-ARTICLE-QUOTE-001": lambda need: _sure(F.when(F.col("kind") == "article", _quoted()).otherwise(~_quoted())),
    "ER-REF-FOREIGN-PUBLICATION-001": lambda need: _sure(F.when(F.col("kind") == "article", F.contains("raw", F.concat(F.lit("<i>"), F.col("container"), F.lit("</i>")))).otherwise(~F.contains("raw", F.concat(F.lit("<i>"), F.col("container"))))),
}


def reference_scope() -> dict[str, Column]:
    """Which references a rule concerns."""
    translated = F.coalesce("is_translation", F.lit(False))
    foreign = (F.col("lang") != "zh") & ~translated
    of_foreign = ("ER-REF-FOREIGN-AUTHOR-001", "ER-REF-FOREIGN-TITLE-001", "ER-REF-FOREIGN-ARTICLE-QUOTE-001", "ER-REF-FOREIGN-PUBLICATION-001")
    return {"ER-REF-ORDER-FIELDS-001": F.lit(True), "ER-REF-TRANSLATION-001": translated} | dict.fromkeys(of_foreign, foreign)


#: Rules that need several rows.
ACROSS = (
    *NEIGHBOUR_CHECKS, "ER-CIT-REF-FULLAUTHORS-001",
    "ER-REF-SORT-001", "ER-REF-SAMEYEAR-001", "ER-REF-LANGUAGE-GROUP-001", "ER-REF-CONTENT-FOOTNOTE-001",
)


def compiled(rules: DataFrame) -> dict[str, dict]:
    """rule id -> {target, severity, autofix, need}; a catalogue is small configuration."""
    rows = rules.select("id", "target", "severity", "autofix", F.to_json("requirement").alias("need")).collect()
    return {r["id"]: {"target": r["target"], "severity": r["severity"], "autofix": r["autofix"], "need": json.loads(r["need"] or "{}")} for r in rows}


def _explode(rows: DataFrame, seq: str, checks: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """One projection: (doc_id, seq, confidence, rule_id, target, ok) for every check in whose scope a row is."""
    one = lambda rule, target, scope, ok: F.when(_sure(scope), F.struct(F.lit(rule).alias("rule_id"), F.lit(target).alias("target"), ok.alias("ok")))
    if not checks:
        return rows.sparkSession.createDataFrame([], "doc_id long, seq int, confidence double, rule_id string, target string, ok boolean")
    confidence = F.col("confidence") if "confidence" in rows.columns else F.lit(1.0)
    found = F.explode(F.array_compact(F.array(*[one(*c) for c in checks]))).alias("_f")
    return rows.select("doc_id", F.col(seq).alias("seq"), confidence.alias("confidence"), found).select("doc_id", "seq", "confidence", "_f.*")


def lint_elements(elements: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """Findings of the manuscript rules, from one pass over the elements."""
    checks = ELEMENT_CHECKS | NEIGHBOUR_CHECKS
    due = [(r, rules[r]["target"], F.col("role") == rules[r]["target"], check(rules[r]["need"])) for r, check in checks.items() if r in rules]
    if any(r in rules for r in NEIGHBOUR_CHECKS):
        elements = _with_neighbours(elements, rules.get("ER-MS-TITLE-002", {"need": {"marker": "*"}})["need"]["marker"])
    return _explode(elements, "seq", due)


def _with_references(citations: DataFrame, refs: DataFrame, authors: DataFrame | None) -> DataFrame:
    """Citations with what the list of references and the document's authors say of them.

    _listed_authors       number of authors of the entry of this first author and year
    _contradicts          a part is in the list under the other kind of script
    _translation          the first author has a translated entry
    _translation_of_year  and one of this year
    _document_authors     the document's own authors
    """
    key = ["doc_id", "part", "seq", "cite_no"]
    chinese = _is_zh() | F.coalesce("is_translation", F.lit(False))
    entries = refs.select("doc_id", cited_name(F.get("authors", F.lit(0))).alias("_name"), F.col("year").cast("string").alias("_year"), F.size("authors").alias("_n"), chinese.alias("_zh"), F.coalesce("is_translation", F.lit(False)).alias("_is_translation"))
    listed = entries.groupBy("doc_id", "_name", "_year").agg(F.max("_n").alias("_n"), F.max("_zh").alias("_any_zh"), F.min("_zh").alias("_all_zh"), F.max("_is_translation").alias("_t_year"))
    translated = entries.where("_is_translation").select("doc_id", "_name", F.lit(True).alias("_t")).distinct()
    parts = citations.select(*key, "years", F.posexplode("authors").alias("_pos", "_author")).withColumns({"_name": F.lower("_author"), "_year": F.substring(F.coalesce(F.get("years", F.col("_pos")), F.get("years", F.lit(0))), 1, 4)})
    met = parts.join(listed, ["doc_id", "_name", "_year"], "left").join(translated, ["doc_id", "_name"], "left")
    first = F.col("_pos") == 0
    wrong = F.when(has_han(F.col("_author")), ~F.col("_any_zh")).otherwise(F.col("_all_zh"))
    known = met.groupBy(*key).agg(
        F.max(F.when(first, F.col("_n"))).alias("_listed_authors"), F.max(wrong).alias("_contradicts"),
        F.max(F.when(first, F.coalesce("_t", F.lit(False)))).alias("_translation"), F.max(F.when(first, F.coalesce("_t_year", F.lit(False)))).alias("_translation_of_year"),
    )
    out = citations.join(known, key, "left")
    return out.withColumn("_document_authors", F.lit(None).cast("string")) if authors is None else out.join(authors.select("doc_id", F.col("names").alias("_document_authors")), "doc_id", "left")


def document_authors(elements: DataFrame) -> DataFrame:
    """(doc_id, names): the texts of a document's author lines."""
    return elements.where("role = 'author_name'").groupBy("doc_id").agg(F.concat_ws(" ", F.sort_array(F.collect_list("text"))).alias("names"))


def lint_citations(citations: DataFrame, refs: DataFrame, rules: dict[str, dict], authors: DataFrame | None = None) -> DataFrame:
    """Findings of the citation rules; citations inside content footnotes are held to the same ones.

    A citation whose only home is a footnote (form `footnote`) breaks the first
    rule; one inside a footnote that says more has another form and its part is
    taken as text.  ``authors`` (doc_id, names) are those that a self-citation may name.
    """
    scope = citation_scope()
    citations = _with_references(citations, refs, authors)
    in_note = (F.col("part") == "footnote") & (F.col("form") != "footnote")
    stream = citations.withColumns({"_in_note": in_note, "part": F.when(in_note, F.lit("note_text")).otherwise(F.col("part"))})
    checks = [(r, rules[r]["target"], scope[r], check(rules[r]["need"])) for r, check in CITATION_CHECKS.items() if r in rules]
    if (rule := "ER-REF-CONTENT-FOOTNOTE-001") in rules:
        all_hold = F.lit(True)
        for _, _, concerned, ok in checks:
            all_hold = all_hold & (~_sure(concerned) | ok)
        checks = [*checks, (rule, rules[rule]["target"], F.col("_in_note"), all_hold)]
    found = _explode(stream, "seq", checks)
    if (rule := "ER-CIT-REF-FULLAUTHORS-001") in rules:
        short = citations.where(F.col("raw").rlike(r"et al\.|等")).select("doc_id", F.lower(_first_author()).alias("_name"), F.explode(F.transform("years", lambda y: F.substring(y, 1, 4))).alias("_year")).distinct()
        listed = refs.select("*", F.lower(F.get("authors", F.lit(0))["surname"]).alias("_surname"), F.col("year").cast("string").alias("_year"))
        met = listed.alias("r").join(short.alias("s"), (F.col("r.doc_id") == F.col("s.doc_id")) & (F.col("r._year") == F.col("s._year")) & F.startswith("_name", "_surname"), "left_semi")
        full = (F.size("authors") >= 3) & ~F.exists("authors", lambda a: F.concat_ws(" ", a["surname"], a["given"]).rlike("et al|等$"))
        found = found.unionByName(met.select("doc_id", F.col("ref_no").alias("seq"), F.lit(1.0).alias("confidence"), F.lit(rule).alias("rule_id"), F.lit(rules[rule]["target"]).alias("target"), _sure(full).alias("ok")))
    return found


def lint_references(refs: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """Findings of the rules for the list of references."""
    scope = reference_scope()
    checks = [(r, rules[r]["target"], scope[r], check(rules[r]["need"])) for r, check in REFERENCE_CHECKS.items() if r in rules]
    chinese = _is_zh() | F.coalesce("is_translation", F.lit(False))
    surname = F.get("authors", F.lit(0))["surname"]
    by_number = W.partitionBy("doc_id").orderBy("ref_no")
    same = W.partitionBy("doc_id", F.transform("authors", lambda a: F.concat_ws(",", a["surname"], a["given"])), "year").orderBy("ref_no")
    rows = refs.withColumns({"_group": F.when(chinese, 0).otherwise(1), "_initial": surname_initial(surname), "_certain": initial_is_certain(surname)})
    rows = rows.withColumns({
        "_last_group": F.lag("_group").over(by_number), "_last_initial": F.lag("_initial").over(by_number), "_last_certain": F.lag("_certain").over(by_number),
        "_twins": F.count("*").over(same.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), "_place": F.row_number().over(same),
    })
    if (rule := "ER-REF-LANGUAGE-GROUP-001") in rules:
        checks.append((rule, rules[rule]["target"], F.lit(True), F.coalesce(F.col("_group") >= F.col("_last_group"), F.lit(True))))
    if (rule := "ER-REF-SORT-001") in rules:
        checks.append((rule, rules[rule]["target"], F.lit(True), F.coalesce((F.col("_group") != F.col("_last_group")) | (F.col("_initial") >= F.col("_last_initial")), F.lit(True))))
    if (rule := "ER-REF-SAMEYEAR-001") in rules:
        checks.append((rule, rules[rule]["target"], F.col("_twins") > 1, _sure(F.col("suffix") == F.char(F.lit(96) + F.col("_place")))))
    doubtful = ~(F.col("_certain") & F.coalesce("_last_certain", F.lit(True)))
    out = _explode(rows.withColumn("confidence", F.when(doubtful, F.lit(0.0)).otherwise(F.lit(1.0))), "ref_no", checks)
    return out.withColumn("confidence", F.when(F.col("rule_id") == "ER-REF-SORT-001", F.col("confidence")).otherwise(F.lit(1.0)))


def lint(elements: DataFrame, citations: DataFrame, refs: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, seq, confidence, rule_id, target, ok): all findings of all rules."""
    known = compiled(rules)
    of_citations = lint_citations(citations, refs, known, document_authors(elements))
    return lint_elements(elements, known).unionByName(of_citations).unionByName(lint_references(refs, known))


def verdicts(found: DataFrame, rules: DataFrame, policy: DataFrame, documents: DataFrame | None = None, confidence: float = CONFIDENCE) -> DataFrame:
    """(doc_id, seq, rule_id, target, status, fixable), and for every document NOT_CHECKED for each rule that nothing in it met.

    Under ``policy`` (effective severity and fix of each rule).  ``documents``
    (doc_id) are those that were linted; by default those with findings.  A breach
    of order that hangs on a surname with two readings is for a person to judge.
    ``fixable`` is what ``fix`` would change: policy allows it and there is a remedy.
    """
    effective = {r["id"]: r for r in policy.select("id", "severity", "autofix").collect()}  # configuration
    known = {r["id"]: r["target"] for r in rules.select("id", "target").collect()}
    bits = RuleBits(known)
    keyed = found.where(F.col("rule_id").isin(list(known))).select("doc_id", "seq", "confidence", "rule_id", "ok")
    if documents is not None:  # each document is a row without a rule
        keyed = keyed.unionByName(documents.select("doc_id").distinct(), allowMissingColumns=True)
    # one exchange: each document's findings and the bitmap of the rules that they meet
    document = W.partitionBy("doc_id")
    rows = keyed.withColumns({f"_met{w}": F.bit_or(bits.word_of(F.col("rule_id"), w)).over(document) for w in range(bits.words)})
    rows = rows.withColumn("_first", F.row_number().over(document.orderBy("rule_id", "seq")) == 1).withColumn("_met", F.array(*[f"_met{w}" for w in range(bits.words)]))
    if documents is not None:
        rows = rows.withColumn("_listed", F.max(F.col("rule_id").isNull()).over(document)).where("_listed")
    of_rule = lambda values: F.element_at(F.create_map(*[F.lit(x) for r in known for x in (r, values(r))]), F.col("rule_id"))
    severity, autofix = of_rule(lambda r: effective[r]["severity"]), of_rule(lambda r: effective[r]["autofix"])
    doubtful = (F.col("rule_id") == "ER-REF-SORT-001") & (F.col("confidence") < confidence)
    status = F.when((severity == "manual_review") | (~F.col("ok") & doubtful), "MANUAL_REVIEW").when(F.col("ok"), "PASS").otherwise(F.upper(severity))
    fixable = F.coalesce(~F.col("ok") & F.col("rule_id").isin(*FIXABLE) & allowed(autofix, F.col("confidence"), confidence), F.lit(False))
    verdict = lambda seq, rule, target, state, may: F.struct(seq.alias("seq"), rule.alias("rule_id"), target.alias("target"), state.alias("status"), may.alias("fixable"))
    own = F.when(F.col("rule_id").isNotNull(), verdict(F.col("seq"), F.col("rule_id"), of_rule(known.get), status, fixable))
    unmet = [F.when(F.col("_first") & ~bits.holds(F.col("_met"), r), verdict(F.lit(None).cast("int"), F.lit(r), F.lit(known[r]), F.lit("NOT_CHECKED"), F.lit(False))) for r in bits.ids]
    return rows.select("doc_id", F.inline(F.array_compact(F.array(own, *unmet))))


def cited_name(author: Column) -> Column:
    """How a listed author is named in the text: Han names whole, others by surname."""
    return F.lower(F.when(has_han(author["surname"]), F.concat(author["surname"], F.coalesce(author["given"], F.lit("")))).otherwise(author["surname"]))


def uncited_and_unlisted(citations: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, kind, author, year): cited but not listed, and listed but not cited."""
    cited = citations.where("size(authors) > 0").select("doc_id", F.lower(_first_author()).alias("author"), F.explode("years").alias("year")).distinct()
    listed = refs.select("doc_id", cited_name(F.get("authors", F.lit(0))).alias("author"), F.concat(F.col("year").cast("string"), F.coalesce("suffix", F.lit(""))).alias("year")).distinct()
    keys = ["doc_id", "author", "year"]
    lost = cited.join(listed, keys, "left_anti").select("doc_id", F.lit("cited_not_listed").alias("kind"), "author", "year")
    return lost.unionByName(listed.join(cited, keys, "left_anti").select("doc_id", F.lit("listed_not_cited").alias("kind"), "author", "year"))
