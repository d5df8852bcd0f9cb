"""The shipped rule catalogue as plain rows.

Facts only: what a rule is about, what it demands, how grave a breach is and
whether it may be fixed.  Catalogues with evidence texts are read from files by
``rulewright.sources.catalogue``.
"""

from __future__ import annotations

from typing import Any

# The rule schema.
REQUIRED_FIELDS = ("id", "domain", "target", "normativity", "source", "requirement", "lint", "autofix")
ENUMS = {
    "domain": ("manuscript", "citation", "reference"),
    "normativity": ("mandatory", "recommended", "example_only"),
    "source_type": ("red_annotation", "explicit_instruction", "operational_summary", "example"),
    "lint_severity": ("error", "warning", "info", "manual_review"),
    "autofix": ("safe", "conditional", "never"),
}
#: Order of the files of a catalogue; other files are ignored.
RULE_FILES = ("manuscript.yaml", "citations.yaml", "references.yaml")

_NOTES, _GUIDE = "ER-MS-IMG-NOTES", "ER-REF-GUIDE"
_RED, _TOLD = "red_annotation", "explicit_instruction"

# Id, target, severity, autofix, requirement.  Manuscript rules come
# from annotations in the notes and are mandatory, but for those in _RECOMMENDED.
_MANUSCRIPT = (
    ("ER-MS-TITLE-001", "title", "error", "conditional", {"east_asia_font": "宋体", "font_size_allowed_cn": ["三号", "小三号"], "alignment": "center"}),
    ("ER-MS-TITLE-002", "title_author_info_marker", "error", "never", {"marker": "*", "mechanism": "footnote"}),
    ("ER-MS-AUTHOR-001", "author_name", "error", "conditional", {"east_asia_font": "宋体", "font_size_cn": "小四号", "alignment": "center"}),
    ("ER-MS-AUTHORINFO-001", "author_information_footnote", "warning", "conditional", {"east_asia_font": "宋体", "font_size_cn": "六号"}),
    ("ER-MS-AUTHORINFO-002", "contact_label", "error", "safe", {"preferred_term": "电子信箱", "disallowed_term": "电子邮箱"}),
    ("ER-MS-ABSTRACT-001", "abstract", "error", "conditional", {"east_asia_font": "仿宋", "font_size_cn": "五号"}),
    ("ER-MS-HEADING1-001", "heading_level_1", "error", "conditional", {"east_asia_font": "宋体", "font_size_cn": "四号", "alignment": "center"}),
    ("ER-MS-HEADING-HIERARCHY-001", "heading_numbering", "error", "conditional", {"level_2": {"prefix_pattern": "（一）", "leading_spaces_cn": 2}, "lower_levels": {"sequence": ["1.", "（1）"]}}),
    ("ER-MS-EQUATION-001", "equation", "manual_review", "never", {"allowed_editors": ["Word Equation", "MathType"]}),
    ("ER-MS-EQUATION-002", "equation_where_paragraph", "error", "conditional", {"trigger_text": "其中", "leading_spaces_cn": 2}),
    ("ER-MS-TABLE-001", "table_text", "warning", "conditional", {"east_asia_font": "仿宋", "font_size_relation_to_body": "smaller"}),
    ("ER-MS-TABLE-NOTE-001", "table_note", "error", "conditional", {"font_size_relation_to_table": "one_cn_size_smaller"}),
    ("ER-MS-TABLE-NOTE-002", "table_note", "warning", "conditional", {"east_asia_font": "宋体"}),
    ("ER-MS-FOOTNOTE-001", "ordinary_footnote_numbering", "error", "conditional", {"restart": "each_page"}),
    ("ER-MS-FOOTNOTE-002", "ordinary_footnote_text", "error", "conditional", {"leading_spaces_cn": 2, "east_asia_font": "宋体", "font_size_cn": "六号"}),
    ("ER-MS-FIGURE-001", "figure_caption", "error", "conditional", {"east_asia_font": "黑体", "font_size_cn": "小五号", "alignment": "center"}),
    ("ER-MS-FIGURE-002", "figure", "manual_review", "never", {"color_mode": "black_and_white"}),
    ("ER-MS-REF-LAYOUT-001", "reference_entry", "error", "conditional", {"east_asia_font": "宋体", "font_size_cn": "六号", "numbered": False, "leading_spaces_cn": 2}),
    ("ER-MS-LATIN-FONT-001", "latin_letters_and_digits", "error", "conditional", {"ascii_font": "Times New Roman", "hansi_font": "Times New Roman"}),
    ("ER-MS-REF-PAGERANGE-001", "reference_page_range", "error", "safe", {"separator": "—"}),
    ("ER-MS-REF-TITLECASE-001", "english_reference_title", "manual_review", "never", {"first_letter_uppercase": True}),
    ("ER-MS-REF-AUTHOR-001", "english_reference_authors", "manual_review", "never", {"surname_full": True, "given_names_initials": True, "author_position_sensitive": True}),
    ("ER-MS-REF-JOURNAL-001", "english_reference_journal_name", "error", "conditional", {"italic": True}),
)
_RECOMMENDED = ("ER-MS-AUTHORINFO-001", "ER-MS-TABLE-001", "ER-MS-TABLE-NOTE-002")

# Citation rules; the last five come from annotations in the notes.
_CITATIONS = (
    ("ER-CIT-GENERAL-001", "literature_citation", "error", "never", {"use_footnote_for_literature_reference": False, "placement": "inline_parenthetical"}),
    ("ER-CIT-GENERAL-002", "parenthetical_citation_fields", "error", "never", {"required": ["author", "year"], "conditional": ["page"], "year_month_included": False}),
    ("ER-CIT-NARRATIVE-001", "narrative_citation", "error", "conditional", {"when_author_in_sentence": "parenthetical_year_only"}),
    ("ER-CIT-SELF-001", "self_citation", "error", "never", {"author_name_required": True}),
    ("ER-CIT-TITLE-IN-SENTENCE-001", "narrative_citation_with_author_and_title", "error", "never", {"parenthetical_fields": ["year"], "conditional_fields": ["page"]}),
    ("ER-CIT-MULTI-AUTHORSOURCES-001", "multiple_sources_different_authors", "error", "conditional", {"separator": "；"}),
    ("ER-CIT-SAMEAUTHOR-MULTIYEAR-001", "multiple_sources_same_author", "error", "conditional", {"author_once": True, "year_separator": "，", "same_year_suffix_supported": True}),
    ("ER-CIT-TRANSLATION-001", "chinese_translation_citation", "error", "never", {"author_form": "chinese_translated_name", "year_basis": "chinese_translation_edition", "conditional_fields": ["page"]}),
    ("ER-CIT-FOREIGN-ORIGINAL-001", "foreign_original_citation", "error", "never", {"translate_author_name": False, "author_name_form": "surname_usually"}),
    ("ER-CIT-MIXEDLANG-001", "mixed_chinese_foreign_sources", "error", "never", {"preserve_language_specific_form": True}),
    ("ER-CIT-EN-TWOAUTHORS-001", "english_two_author_in_text", "error", "conditional", {"author_connector": "&"}),
    ("ER-CIT-EN-MULTIAUTHORS-001", "english_three_plus_author_in_text", "error", "conditional", {"abbreviation": "et al.", "minimum_authors": 3}),
    ("ER-CIT-ZH-TWOAUTHORS-001", "chinese_two_author_in_text", "error", "conditional", {"author_connector": "和"}),
    ("ER-CIT-ZH-MULTIAUTHORS-001", "chinese_three_plus_author_in_text", "error", "conditional", {"abbreviation": "等", "minimum_authors": 3}),
    ("ER-CIT-REF-FULLAUTHORS-001", "reference_corresponding_to_abbreviated_in_text_citation", "error", "never", {"list_all_authors_in_reference": True}),
)
_ANNOTATED_CITATIONS = 5

# Rules for the list of references, all told by the guide.
_REFERENCES = (
    ("ER-REF-ORDER-FIELDS-001", "reference_entry_field_order", "error", "never", {"field_order": ["authors", "year", "title", "publication_or_publisher", "volume_or_issue", "pages"]}),
    ("ER-REF-SORT-001", "reference_sort_order", "error", "conditional", {"primary_key": "author_surname_initial_latin"}),
    ("ER-REF-SAMEYEAR-001", "same_author_same_year", "error", "conditional", {"suffix_sequence": ["a", "b", "c"]}),
    ("ER-REF-TRANSLATION-001", "translated_reference", "error", "never", {"author_form": "chinese_translated_name", "year_basis": "cited_chinese_translation_edition", "title_language": "chinese", "translation_marker_optional": "中译本"}),
    ("ER-REF-FOREIGN-AUTHOR-001", "foreign_reference_author", "error", "never", {"surname_first": True, "comma_after_surname": True, "initials_require_period": True, "initial_capitalization": True}),
    ("ER-REF-FOREIGN-TITLE-001", "foreign_reference_title", "manual_review", "never", {"capitalization": "content_words_initial_uppercase"}),
    ("ER-REF-FOREIGN-ARTICLE-QUOTE-001", "foreign_article_title", "error", "conditional", {"article_quotes": "double", "book_quotes": "none"}),
    ("ER-REF-FOREIGN-PUBLICATION-001", "foreign_journal_or_publisher", "error", "conditional", {"journal_italic": True, "publisher_italic": False}),
    ("ER-REF-FOREIGN-LINE-001", "foreign_reference_entry_layout", "error", "conditional", {"single_continuous_paragraph": True, "field_separator": "comma"}),
    ("ER-REF-LANGUAGE-GROUP-001", "reference_language_grouping", "error", "conditional", {"group_order": ["chinese_including_translations", "foreign"], "sort_each_group_separately": True, "sort_key": "author_surname_initial_latin"}),
    ("ER-REF-CONTENT-FOOTNOTE-001", "literature_citation_inside_content_footnote", "error", "never", {"reuse_in_text_citation_rules": True}),
)

# Registers beside the rules.
#: id, topic, status, rule of side a, rule or source of side b, lint, autofix, rule that stays effective
CONFLICTS = (
    ("ER-CONFLICT-001", "english_reference_title_capitalization", "unresolved_overlap", "ER-MS-REF-TITLECASE-001", "ER-REF-FOREIGN-TITLE-001", None, "manual_review", "never", None),
    ("ER-CONFLICT-002", "english_reference_author_order_and_initial_position", "unresolved", "ER-MS-REF-AUTHOR-001", "ER-REF-FOREIGN-AUTHOR-001", None, "manual_review", "never", None),
    ("ER-CONFLICT-003", "page_range_separator_in_foreign_reference", "source_example_vs_explicit_annotation", "ER-MS-REF-PAGERANGE-001", None, "ER-REF-GUIDE", "info", "safe", "ER-MS-REF-PAGERANGE-001"),
)
_NOT_SPECIFIED, _ONLY_EXAMPLE = "not_specified_in_current_sources", "example_present_but_red_annotation_not_explicit"
#: topic and status, numbered from 1
_UNKNOWN_TOPICS = (
    ("body_chinese_font", _NOT_SPECIFIED),
    ("body_font_size", _NOT_SPECIFIED),
    ("page_margins", _NOT_SPECIFIED),
    ("body_line_spacing", _NOT_SPECIFIED),
    ("paragraph_spacing_before_after", _NOT_SPECIFIED),
    ("keyword_font_size", _NOT_SPECIFIED),
    ("table_caption_font", _NOT_SPECIFIED),
    ("table_border_style", _NOT_SPECIFIED),
    ("figure_caption_position", _NOT_SPECIFIED),
    ("reference_heading_font_size", _NOT_SPECIFIED),
    ("equation_number_font_and_continuity", _ONLY_EXAMPLE),
    ("ordinary_footnote_marker_must_be_circled_number", _ONLY_EXAMPLE),
    ("table_sequence_title_unit_position", _ONLY_EXAMPLE),
)
UNKNOWNS = tuple((f"ER-UNKNOWN-{k:03d}", topic, status) for k, (topic, status) in enumerate(_UNKNOWN_TOPICS, 1))
#: id, medium, special handling
SOURCES = (
    ("ER-MS-IMG-NOTES", "markdown", {"preserve_red_annotation_semantics": True, "do_not_silently_correct_examples": True}),
    ("ER-MS-DOCX", "docx", {}),
    ("ER-REF-GUIDE", "markdown", {}),
)


def _rule(domain: str, source: tuple[str, str], row: tuple) -> dict[str, Any]:
    rule_id, target, severity, autofix, requirement = row
    return {
        "id": rule_id,
        "domain": domain,
        "target": target,
        "normativity": "recommended" if rule_id in _RECOMMENDED else "mandatory",
        "source": {"source_id": source[0], "source_type": source[1]},
        "requirement": requirement,
        "lint": {"severity": severity},
        "autofix": autofix,
    }


def shipped_files() -> list[tuple[str, dict[str, Any]]]:
    """(file, content) in catalogue order, as a YAML reader would give them."""
    told = len(_CITATIONS) - _ANNOTATED_CITATIONS
    per_file = (
        [_rule("manuscript", (_NOTES, _RED), r) for r in _MANUSCRIPT],
        [_rule("citation", (_GUIDE, _TOLD) if k < told else (_NOTES, _RED), r) for k, r in enumerate(_CITATIONS)],
        [_rule("reference", (_GUIDE, _TOLD), r) for r in _REFERENCES],
    )
    return [(name, {"version": 1, "rules": rules}) for name, rules in zip(RULE_FILES, per_file, strict=True)]
