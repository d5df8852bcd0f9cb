"""The lint of the fixture manuscripts as one SQL statement: every rule written a second time.

Rows are given as constants; conditions are stated per rule, so a change of a
checker or of a requirement on one side only shows as a difference.
"""

from __future__ import annotations

from ..sources import fixtures


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]::VARCHAR[]"
    return "'" + str(value).replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    """``name(columns) AS (VALUES ...)`` for a WITH clause; document ids are BIGINT."""
    wide = [c.strip() == "doc_id" for c in columns.split(",")]
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(literal(v) + '::BIGINT' * w for v, w in zip(r, wide, strict=True)) + ')' for r in rows)})"


def _elements() -> str:
    flat, runs = [], []
    for doc, part, seq, role, confidence, _, text, (alignment, lead, restart, numbered, style), own, obj, parent in fixtures.elements():
        flat.append((doc, part, seq, role, confidence, text, alignment, lead, restart, numbered, style, obj and obj[1], obj and obj[2], parent))
        runs += [(doc, seq, *run[:6]) for run in own]
    return ", ".join([
        values("e", "doc_id, part, seq, role, confidence, text, alignment, lead, restart, numbered, style, editor, color, parent", flat),
        values("r", "doc_id, seq, shown, asian, latin, other, size, italic", runs),
    ])


def _citations() -> str:
    return values("c", "doc_id, part, seq, form, lang, authors, years, raw", [(x[0], x[1], x[2], x[4], x[5], x[6], x[7], x[9]) for x in fixtures.citations()])


def _references() -> str:
    rows = [(x[0], x[1], x[2], x[3], [a[0] for a in x[4]], [a[1] for a in x[4]], *x[5:10], x[10], x[11], x[12]) for x in fixtures.references()]
    return values("f", "doc_id, ref_no, lang, translated, surnames, givens, year, suffix, title, kind, container, volume, pages, raw", rows)


_OWN = "r.doc_id = e.doc_id AND r.seq = e.seq"


def _all(condition: str) -> str:
    """Every run that shows text meets the condition, and there is one."""
    return f"(EXISTS (SELECT 1 FROM r WHERE {_OWN} AND trim(shown) <> '') AND NOT EXISTS (SELECT 1 FROM r WHERE {_OWN} AND trim(shown) <> '' AND NOT coalesce({condition}, FALSE)))"


def _font(font: str, *points: float) -> str:
    return " AND ".join([_all(f"asian = '{font}'")] + ([_all(f"size IN ({', '.join(map(str, points))})")] if points else []))


_SIZE = f"(SELECT max(size) FROM r WHERE {_OWN})"
_LADDER = "list_position([42.0, 36.0, 26.0, 24.0, 22.0, 18.0, 16.0, 15.0, 14.0, 12.0, 10.5, 9.0, 7.5, 6.5, 5.5, 5.0], {})"
_LEAST = "(SELECT min(s) FROM (SELECT max(size) AS s FROM e o JOIN r q ON q.doc_id = o.doc_id AND q.seq = o.seq WHERE o.doc_id = e.doc_id AND {} GROUP BY o.seq))"
_BODY = _LEAST.format("o.role = 'body'")
_TABLE = _LEAST.format("o.role = 'table_text' AND o.parent = e.parent")
_CENTRED = "alignment = 'center'"

#: rule -> (role, condition)
ELEMENT_RULES = {
    "ER-MS-TITLE-001": ("title", f"{_font('宋体', 16.0, 15.0)} AND {_CENTRED}"),
    "ER-MS-TITLE-002": ("title_author_info_marker", "contains(text, '*') AND EXISTS (SELECT 1 FROM e n WHERE n.doc_id = e.doc_id AND n.part = 'footnote' AND starts_with(trim(n.text), '*'))"),
    "ER-MS-AUTHOR-001": ("author_name", f"{_font('宋体', 12.0)} AND {_CENTRED}"),
    "ER-MS-AUTHORINFO-001": ("author_information_footnote", _font("宋体", 7.5)),
    "ER-MS-AUTHORINFO-002": ("contact_label", "NOT contains(text, '电子邮箱')"),
    "ER-MS-ABSTRACT-001": ("abstract", _font("仿宋", 10.5)),
    "ER-MS-HEADING1-001": ("heading_level_1", f"{_font('宋体', 14.0)} AND {_CENTRED}"),
    "ER-MS-HEADING-HIERARCHY-001": ("heading_numbering", """EXISTS (SELECT 1 FROM h WHERE h.doc_id = e.doc_id AND h.seq = e.seq AND h.level <= coalesce(h.above, 0) + 1)
        AND CASE right(style, 1) WHEN '2' THEN regexp_matches(text, '^\\s*（[一二三四五六七八九十]+）') AND lead = 2 WHEN '3' THEN regexp_matches(text, '^\\s*[0-9]+\\.') WHEN '4' THEN regexp_matches(text, '^\\s*（[0-9]+）') ELSE TRUE END"""),
    "ER-MS-EQUATION-001": ("equation", "editor IN ('Word Equation', 'MathType')"),
    "ER-MS-EQUATION-002": ("equation_where_paragraph", "NOT starts_with(trim(text), '其中') OR lead = 2"),
    "ER-MS-TABLE-001": ("table_text", f"{_SIZE} < {_BODY} AND {_font('仿宋')}"),
    "ER-MS-TABLE-NOTE-001": ("table_note", f"{_LADDER.format(_SIZE)} - {_LADDER.format(_TABLE)} = 1"),
    "ER-MS-TABLE-NOTE-002": ("table_note", _font("宋体")),
    "ER-MS-FOOTNOTE-001": ("ordinary_footnote_numbering", "restart = 'each_page'"),
    "ER-MS-FOOTNOTE-002": ("ordinary_footnote_text", f"{_font('宋体', 7.5)} AND lead = 2"),
    "ER-MS-FIGURE-001": ("figure_caption", f"{_font('黑体', 9.0)} AND {_CENTRED}"),
    "ER-MS-FIGURE-002": ("figure", "color = 'black_and_white'"),
    "ER-MS-REF-LAYOUT-001": ("reference_entry", f"{_font('宋体', 7.5)} AND NOT numbered AND lead = 2"),
    "ER-MS-LATIN-FONT-001": ("latin_letters_and_digits", f"NOT EXISTS (SELECT 1 FROM r WHERE {_OWN} AND regexp_matches(shown, '[A-Za-z0-9]') AND NOT coalesce(latin = 'Times New Roman' AND other = 'Times New Roman', FALSE))"),
    "ER-MS-REF-PAGERANGE-001": ("reference_page_range", "NOT regexp_matches(text, '[0-9]\\s*[-–−~～]\\s*[0-9]')"),
    "ER-MS-REF-TITLECASE-001": ("english_reference_title", "regexp_matches(text, '^[\\s\"“]*\\p{Lu}')"),
    "ER-MS-REF-AUTHOR-001": ("english_reference_authors", "regexp_matches(text, '^\\p{Lu}[\\p{L}''-]+, (\\p{Lu}\\.[ -]?)+(,? (and|&) ((\\p{Lu}\\.[ -]?)+ ?\\p{Lu}[\\p{L}''-]+|\\p{Lu}[\\p{L}''-]+, (\\p{Lu}\\.[ -]?)+))*$')"),
    "ER-MS-REF-JOURNAL-001": ("english_reference_journal_name", _all("italic")),
    "ER-REF-FOREIGN-LINE-001": ("foreign_reference_entry_layout", "contains(text, ',') AND NOT contains(text, chr(10))"),
}

_HAN = "regexp_matches({}, '\\p{{Han}}')"
_ENTRY = "entries.doc_id = c.doc_id AND entries.name = lower(c.authors[{0}]) AND entries.year = left(coalesce(c.years[{0}], c.years[1]), 4)"
_MANY = f"coalesce((SELECT max(n) FROM entries WHERE {_ENTRY.format(1)}), len(authors)) >= 3"
_TOLD = "form IN ('narrative', 'parenthetical')"
_DISTINCT = "len(list_distinct(authors))"
_AUTHORS_HAN = "len(list_filter(authors, lambda a: regexp_matches(a, '\\p{Han}')))"

#: rule -> (target, scope, condition)
CITATION_RULES = {
    "ER-CIT-GENERAL-001": ("literature_citation", "TRUE", "form <> 'footnote'"),
    "ER-CIT-GENERAL-002": ("parenthetical_citation_fields", "form = 'parenthetical'", "len(authors) > 0 AND len(years) > 0 AND len(list_filter(years, lambda y: regexp_matches(y, '[0-9]{4}[-./年][0-9]{1,2}'))) = 0"),
    "ER-CIT-NARRATIVE-001": ("narrative_citation", "form = 'narrative'", "regexp_matches(raw, '[（(][0-9]{4}[a-z]?([，,:：][^（()）]*)?[)）]')"),
    "ER-CIT-SELF-001": ("self_citation", "form = 'self'", "trim(authors[1]) <> '' AND coalesce((SELECT bool_or(contains(e.text, c.authors[1])) FROM e WHERE e.doc_id = c.doc_id AND e.role = 'author_name'), TRUE)"),
    "ER-CIT-TITLE-IN-SENTENCE-001": ("narrative_citation_with_author_and_title", "form = 'narrative_title'", "regexp_matches(raw, '^[（(][0-9]{4}[a-z]?([，,:：] ?(第|pp?\\.? ?)?[0-9—-]+页?)?[)）]$')"),
    "ER-CIT-MULTI-AUTHORSOURCES-001": ("multiple_sources_different_authors", f"form = 'multiple' AND {_DISTINCT} > 1", "len(string_split(raw, '；')) >= len(years)"),
    "ER-CIT-SAMEAUTHOR-MULTIYEAR-001": ("multiple_sources_same_author", f"form = 'multiple' AND {_DISTINCT} <= 1", "regexp_matches(raw, '[0-9]{4}[a-z]?(，[0-9]{4}[a-z]?)+')"),
    "ER-CIT-TRANSLATION-001": ("chinese_translation_citation", "form = 'translation'", f"{_HAN.format('authors[1]')} AND (NOT EXISTS (SELECT 1 FROM entries WHERE translated AND entries.doc_id = c.doc_id AND name = lower(c.authors[1])) OR EXISTS (SELECT 1 FROM entries WHERE translated AND {_ENTRY.format(1)}))"),
    "ER-CIT-FOREIGN-ORIGINAL-001": ("foreign_original_citation", "lang <> 'zh' AND form = 'original'", f"len(authors) > 0 AND {_AUTHORS_HAN} = 0"),
    "ER-CIT-MIXEDLANG-001": ("mixed_chinese_foreign_sources", "lang = 'mixed'", f"{_AUTHORS_HAN} BETWEEN 1 AND len(authors) - 1 AND NOT EXISTS (SELECT 1 FROM misplaced WHERE misplaced.doc_id = c.doc_id AND misplaced.seq = c.seq)"),
    "ER-CIT-EN-TWOAUTHORS-001": ("english_two_author_in_text", f"lang = 'en' AND len(authors) = 2 AND NOT {_MANY} AND {_TOLD}", "regexp_matches(raw, '\\p{L} & \\p{L}')"),
    "ER-CIT-EN-MULTIAUTHORS-001": ("english_three_plus_author_in_text", f"lang = 'en' AND {_MANY} AND {_TOLD}", "contains(raw, 'et al.')"),
    "ER-CIT-ZH-TWOAUTHORS-001": ("chinese_two_author_in_text", f"lang = 'zh' AND len(authors) = 2 AND NOT {_MANY} AND {_TOLD}", "contains(raw, '和')"),
    "ER-CIT-ZH-MULTIAUTHORS-001": ("chinese_three_plus_author_in_text", f"lang = 'zh' AND {_MANY} AND {_TOLD}", "contains(raw, '等')"),
}

_QUOTED = "(regexp_matches(raw, '[\"“]') AND contains(raw, title) AND contains(regexp_replace(raw, '[“”]', '\"', 'g'), '\"' || regexp_replace(title, '[,.]$', '')))"
_FOREIGN = "lang <> 'zh' AND NOT translated"
_SMALL = "'a', 'an', 'the', 'and', 'or', 'but', 'nor', 'of', 'in', 'on', 'at', 'to', 'for', 'from', 'by', 'with', 'as', 'vs'"

#: rule -> (target, scope, condition)
REFERENCE_RULES = {
    # fields in order, wherever they stand: a pattern of all of them with anything between
    "ER-REF-ORDER-FIELDS-001": ("reference_entry_field_order", "TRUE", "raw LIKE '%' || array_to_string(list_filter([surnames[1], CAST(year AS VARCHAR), title, container, volume, pages], lambda x: x <> ''), '%') || '%'"),
    "ER-REF-TRANSLATION-001": ("translated_reference", "translated", f"{_HAN.format('surnames[1]')} AND {_HAN.format('title')} AND year IS NOT NULL"),
    "ER-REF-FOREIGN-AUTHOR-001": ("foreign_reference_author", _FOREIGN, "len(surnames) > 0 AND len(list_filter(surnames, lambda s: NOT regexp_matches(s, '^\\p{Lu}'))) = 0 AND len(list_filter(givens, lambda g: NOT regexp_matches(g, '^(\\p{Lu}\\.[ -]?)+$|^\\p{Lu}\\p{Ll}+'))) = 0 AND contains(raw, surnames[1] || ',')"),
    "ER-REF-FOREIGN-TITLE-001": ("foreign_reference_title", _FOREIGN, f"len(list_filter(regexp_split_to_array(regexp_replace(title, '[\"“”:,.?!]', '', 'g'), '\\s+'), lambda w: NOT (w = '' OR lower(w) IN ({_SMALL}) OR regexp_matches(w, '^[^\\p{{L}}]*\\p{{Lu}}') OR NOT regexp_matches(w, '\\p{{L}}')))) = 0"),
    "ER-REF-FOREIGN-ARTICLE-QUOTE-001": ("foreign_article_title", _FOREIGN, f"(kind = 'article') = {_QUOTED}"),
    "ER-REF-FOREIGN-PUBLICATION-001": ("foreign_journal_or_publisher", _FOREIGN, "CASE WHEN kind = 'article' THEN contains(raw, '<i>' || container || '</i>') ELSE NOT contains(raw, '<i>' || container) END"),
    "ER-REF-LANGUAGE-GROUP-001": ("reference_language_grouping", "TRUE", "coalesce(NOT zh OR zh_before, TRUE)"),
    "ER-REF-SORT-001": ("reference_sort_order", "TRUE", "coalesce(zh <> zh_before OR initial >= initial_before, TRUE)"),
    "ER-REF-SAMEYEAR-001": ("same_author_same_year", "twins > 1", "suffix = chr(CAST(96 + nth AS INTEGER))"),
}
#: Initials of the fixture's Chinese surnames as a reader knows them; of two of them a person decides.
_INITIALS = (("安", "A"), ("张", "Z"), ("李", "L"), ("斯密", "S"), ("王", "W"), ("单", "S"), ("丁", "D"))
_DOUBTFUL = "'单', '曾', '仇', '解', '区', '查', '尉迟', '覃', '翟'"


def found_sql() -> str:
    """CTEs that end in ``found`` (doc_id, seq, confidence, rule_id, target, ok)."""
    parts = [f"SELECT doc_id, seq, confidence, '{rule}' AS rule_id, role AS target, coalesce({ok}, FALSE) AS ok FROM e WHERE role = '{role}'" for rule, (role, ok) in ELEMENT_RULES.items()]
    cited = [f"SELECT doc_id, seq, part, form, '{rule}' AS rule_id, '{target}' AS target, coalesce({ok}, FALSE) AS ok FROM c WHERE coalesce({scope}, FALSE)" for rule, (target, scope, ok) in CITATION_RULES.items()]
    sure = "CASE WHEN certain AND coalesce(certain_before, TRUE) THEN 1.0 ELSE 0.0 END"
    listed = [f"SELECT doc_id, ref_no, {sure if 'SORT' in rule else '1.0'}, '{rule}', '{target}', coalesce({ok}, FALSE) FROM g WHERE coalesce({scope}, FALSE)" for rule, (target, scope, ok) in REFERENCE_RULES.items()]
    return f"""{_elements()}, {_citations()}, {_references()}, {values("initials", "surname, initial", _INITIALS)},
    levels AS (SELECT doc_id, seq, CASE role WHEN 'heading_level_1' THEN 1 WHEN 'heading_numbering' THEN TRY_CAST(regexp_extract(style, '([0-9]+)$', 1) AS INTEGER) END AS level FROM e),
    h AS (SELECT *, last_value(level IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM levels),
    entries AS (SELECT doc_id, lower(CASE WHEN {_HAN.format("surnames[1]")} THEN surnames[1] || coalesce(givens[1], '') ELSE surnames[1] END) AS name, CAST(year AS VARCHAR) AS year, len(surnames) AS n, lang = 'zh' OR translated AS zh, translated FROM f),
    named AS (SELECT doc_id, seq, unnest(authors) AS author, unnest(list_transform(authors, lambda a, i: left(coalesce(years[i], years[1]), 4))) AS year FROM c),
    misplaced AS (SELECT n.doc_id, n.seq FROM named n JOIN entries x ON x.doc_id = n.doc_id AND x.name = lower(n.author) AND x.year = n.year
        GROUP BY n.doc_id, n.seq, n.author, n.year HAVING CASE WHEN {_HAN.format("n.author")} THEN NOT bool_or(zh) ELSE bool_and(zh) END),
    g AS (SELECT *, lag(zh) OVER o AS zh_before, lag(initial) OVER o AS initial_before, lag(certain) OVER o AS certain_before,
        count(*) OVER (PARTITION BY doc_id, who, year) AS twins, row_number() OVER (PARTITION BY doc_id, who, year ORDER BY ref_no) AS nth
        FROM (SELECT f.*, lang = 'zh' OR translated AS zh, coalesce(i.initial, upper(left(surnames[1], 1))) AS initial, surnames[1] NOT IN ({_DOUBTFUL}) AS certain, array_to_string(surnames, '|') || '/' || array_to_string(givens, '|') AS who
            FROM f LEFT JOIN initials i ON i.surname = surnames[1]) WINDOW o AS (PARTITION BY doc_id ORDER BY ref_no)),
    cited AS ({" UNION ALL ".join(cited)}),
    found AS ({" UNION ALL ".join(parts)}
        UNION ALL SELECT doc_id, seq, 1.0, rule_id, target, ok FROM cited
        UNION ALL SELECT doc_id, seq, 1.0, 'ER-REF-CONTENT-FOOTNOTE-001', 'literature_citation_inside_content_footnote', bool_and(ok) FROM cited WHERE part = 'footnote' AND form <> 'footnote' GROUP BY doc_id, seq
        UNION ALL SELECT doc_id, ref_no, 1.0, 'ER-CIT-REF-FULLAUTHORS-001', 'reference_corresponding_to_abbreviated_in_text_citation', len(surnames) >= 3 AND len(list_filter(list_zip(surnames, givens), lambda a: regexp_matches(a[1] || ' ' || coalesce(a[2], ''), 'et al|等$'))) = 0
            FROM f WHERE EXISTS (SELECT 1 FROM c WHERE c.doc_id = f.doc_id AND regexp_matches(c.raw, 'et al\\.|等') AND starts_with(lower(c.authors[1]), lower(f.surnames[1])) AND list_contains(list_transform(c.years, lambda y: left(y, 4)), CAST(f.year AS VARCHAR)))
        UNION ALL {" UNION ALL ".join(listed)})"""
