"""Registered queries of the rule engine and their SQL twins.

Catalogue queries run over rows that both sides are given as constants; their
logic is written twice, once as DataFrame plans and once as SQL.  Which checks
are made on the driver's tables is ours to choose: the rule engine's parts are
generic, and these tables are where they meet volume.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hyphenated_range, surname_initial, with_em_dash
from ..operators import catalogue as ops
from ..operators import fix as fixes
from ..operators import lint as lints
from ..operators import report, structure
from ..operators.policy import FIXABLE
from ..operators.references import format_references, parse_references
from ..sources import catalogue, docx, fixtures
from ..sources.shipped import CONFLICTS, ENUMS, REQUIRED_FIELDS, SOURCES, UNKNOWNS, shipped_files
from . import lint_sql, validator
from .lint_sql import literal as _literal
from .lint_sql import values as _values

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rules_sql(files) -> str:
    rows = [(f, r, json.dumps(rule, ensure_ascii=False, separators=(",", ":"), sort_keys=True)) for f, (_, data) in enumerate(files) for r, rule in enumerate(data.get("rules", []))]
    return _values("raw", "file_ord, rule_ord, j", rows)


_FLAT = (
    _rules_sql(shipped_files())
    + """, rules AS (SELECT file_ord, rule_ord, j->>'$.id' AS id, j->>'$.domain' AS domain, j->>'$.target' AS target, j->>'$.normativity' AS normativity,
    j->>'$.source.source_id' AS source_id, j->>'$.source.source_type' AS source_type, j->>'$.lint.severity' AS severity, j->>'$.autofix' AS autofix, j->'$.requirement' AS requirement FROM raw)"""
)
_CONFLICTS_SQL = _values("conflicts", "conflict_id, topic, status, a_rule_id, b_rule_id, b_source_id, lint, autofix, effective_rule", CONFLICTS)

# ---- catalogue -------------------------------------------------------------------------------


@_query(f"WITH {_FLAT} SELECT file_ord, rule_ord, id, target, normativity, autofix FROM rules")
def list_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of the shipped catalogue."""
    return ops.list_rules(catalogue.shipped(spark))


@_query(f"WITH {_FLAT} SELECT file_ord, rule_ord, id || chr(9) || target || chr(9) || normativity || chr(9) || autofix AS line FROM rules")
def list_rule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.list_lines(catalogue.shipped(spark))


@_query(f"WITH {_FLAT} SELECT CAST(count(*) AS BIGINT) AS n_rules FROM rules")
def count_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.shipped(spark).agg(F.count("*").alias("n_rules"))


@_query(f"""WITH {_FLAT}, facets AS (
    SELECT 'domain' AS facet, domain AS value FROM rules UNION ALL SELECT 'normativity', normativity FROM rules UNION ALL SELECT 'severity', severity FROM rules
    UNION ALL SELECT 'autofix', autofix FROM rules UNION ALL SELECT 'source_type', source_type FROM rules)
    SELECT facet, value, count(*) AS n FROM facets GROUP BY 1, 2""")
def catalogue_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.profile(catalogue.shipped(spark))


@_query(f"WITH {_FLAT} SELECT rules.id, e.key AS name, CAST(e.value AS VARCHAR) AS value FROM rules, json_each(requirement) e")
def requirement_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.requirement_entries(catalogue.shipped(spark))


@_query(f"WITH {_FLAT} SELECT id, CAST(len(json_keys(requirement)) AS BIGINT) AS n FROM rules")
def checkable_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.checkable_questions(catalogue.shipped(spark))


def _shown(path: str) -> str:
    """How Python prints the value at a JSON path, in SQL."""
    return f"""CASE json_type(j, '{path}') WHEN 'VARCHAR' THEN CASE WHEN contains(j->>'{path}', '''') THEN '"' || (j->>'{path}') || '"' ELSE '''' || (j->>'{path}') || '''' END
        WHEN 'BOOLEAN' THEN CASE j->>'{path}' WHEN 'true' THEN 'True' ELSE 'False' END WHEN 'NULL' THEN 'None' ELSE coalesce(j->>'{path}', 'None') END"""


_CHECKS = (("domain", "$.domain", "domain"), ("normativity", "$.normativity", "normativity"), ("autofix", "$.autofix", "autofix"), ("source_type", "$.source.source_type", "source_type"), ("lint_severity", "$.lint.severity", "lint severity"))


def _errors_sql() -> str:
    parts = ["SELECT file_ord, rule_ord, 0 AS o, 'duplicate id' AS e FROM named WHERE nth > 1"]
    parts += [f"SELECT file_ord, rule_ord, {k}, 'missing required field {f}' FROM named WHERE NOT coalesce(list_contains(json_keys(j), '{f}'), FALSE)" for k, f in enumerate(REQUIRED_FIELDS, 1)]
    for k, (enum, path, word) in enumerate(_CHECKS, 100):
        allowed = ", ".join(map(_literal, ENUMS[enum]))
        parts.append(f"SELECT file_ord, rule_ord, {k}, 'invalid {word} ' || {_shown(path)} FROM named WHERE NOT (coalesce(json_type(j, '{path}') = 'VARCHAR', FALSE) AND coalesce(j->>'{path}' IN ({allowed}), FALSE))")
    return f"""WITH {_rules_sql(fixtures.faulty_files())}, labelled AS (
        SELECT *, CASE WHEN json_type(j, '$.id') IS NULL THEN '<missing-id>' WHEN json_type(j, '$.id') = 'NULL' THEN 'None' ELSE j->>'$.id' END AS label FROM raw),
    named AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY file_ord, rule_ord) AS nth FROM labelled),
    found AS ({' UNION ALL '.join(parts)})
    SELECT f.file_ord, f.rule_ord, CAST(row_number() OVER (PARTITION BY f.file_ord, f.rule_ord ORDER BY o) - 1 AS INTEGER) AS err_ord, label AS rule_id, label || ': ' || e AS message
    FROM found f JOIN named n USING (file_ord, rule_ord)"""


@_query(_errors_sql())
def validate_faulty_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error of a catalogue made to have all kinds of them."""
    return validator.rule_errors(catalogue.from_files(spark, fixtures.faulty_files()))


@_query(f"WITH {_FLAT} SELECT id AS message FROM rules WHERE FALSE")
def validate_shipped_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No errors."""
    return validator.rule_errors(catalogue.shipped(spark)).select("message")


@_query(f"WITH {_values('r', 'id', [('ER-MS-A-001',), ('ER-CIT-A-B-012',), ('ER-XX-A-001',), ('bad id',), ('ER-REF-A-01',), (None,)])} SELECT id, coalesce(regexp_full_match(id, 'ER-(MS|CIT|REF)(-[A-Z0-9]+)+-[0-9][0-9][0-9]'), FALSE) AS ok FROM r")
def id_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("ER-MS-A-001",), ("ER-CIT-A-B-012",), ("ER-XX-A-001",), ("bad id",), ("ER-REF-A-01",), (None,)]
    return spark.createDataFrame(rows, "id string").select("id", ops.id_follows_convention(F.col("id")).alias("ok"))


_PAIRS = [(n, s, a) for n in (*ENUMS["normativity"], None) for s in (*ENUMS["lint_severity"], None) for a in ENUMS["autofix"]]


@_query(f"""WITH {_values('p', 'normativity, severity, autofix', _PAIRS)} SELECT *, coalesce(CASE normativity WHEN 'mandatory' THEN severity IN ('error', 'manual_review') WHEN 'recommended' THEN severity IN ('warning', 'manual_review')
    WHEN 'example_only' THEN severity IN ('info', 'manual_review') AND autofix = 'never' ELSE severity = 'manual_review' AND normativity IS NOT NULL END, FALSE) AS usual FROM p""")
def severity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame(_PAIRS, "normativity string, severity string, autofix string")
    return pairs.select("*", ops.severity_is_usual(F.col("normativity"), F.col("severity"), F.col("autofix")).alias("usual"))


@_query(f"WITH {_FLAT} SELECT id, 'id' AS finding FROM rules WHERE NOT regexp_matches(id, '^ER-(MS|CIT|REF)(-[A-Z0-9]+)+-[0-9]{{3}}$')")
def governance_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.governance_findings(catalogue.shipped(spark))


@_query(f"""WITH {_FLAT}, {_CONFLICTS_SQL}, sides AS (SELECT conflict_id, a_rule_id AS rule_id, lint, autofix, effective_rule FROM conflicts UNION ALL SELECT conflict_id, b_rule_id, lint, autofix, effective_rule FROM conflicts)
    SELECT id, coalesce(s.lint, r.severity) AS severity, coalesce(s.autofix, r.autofix) AS autofix, conflict_id FROM rules r LEFT JOIN sides s ON s.rule_id = r.id AND s.rule_id IS DISTINCT FROM s.effective_rule""")
def effective_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.effective_policy(catalogue.shipped(spark), ops.conflicts(spark))


_SOURCES_SQL = _values("sources", "source_id", [s[:1] for s in SOURCES[:2]])


@_query(f"""WITH {_FLAT}, {_CONFLICTS_SQL}, {_SOURCES_SQL}, few AS (SELECT * FROM rules WHERE domain <> 'citation' AND id <> 'ER-REF-FOREIGN-TITLE-001')
    SELECT 'rule source' AS kind, id, source_id AS missing FROM few WHERE source_id NOT IN (SELECT source_id FROM sources)
    UNION ALL SELECT 'conflict source', conflict_id, b_source_id FROM conflicts WHERE b_source_id IS NOT NULL AND b_source_id NOT IN (SELECT source_id FROM sources)
    UNION ALL SELECT 'conflict rule', conflict_id, x FROM (SELECT conflict_id, unnest([a_rule_id, b_rule_id]) AS x FROM conflicts) WHERE x IS NOT NULL AND x NOT IN (SELECT id FROM few)""")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that break once a source and some rules are taken away."""
    few = catalogue.shipped(spark).where("domain <> 'citation' and id <> 'ER-REF-FOREIGN-TITLE-001'")
    return ops.dangling_references(few, ops.conflicts(spark), ops.sources(spark).where("source_id <> 'ER-REF-GUIDE'"))


_TOPICS = [("body_chinese_font", "abstract"), ("table_caption_font", "table_text"), ("no_such_topic", "title")]


@_query(f"WITH {_FLAT}, {_values('u', 'unknown_id, topic, status', UNKNOWNS)}, {_values('t', 'topic, target', _TOPICS)} SELECT r.id, u.unknown_id FROM rules r JOIN t USING (target) JOIN u USING (topic)")
def rules_without_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rules_without_basis(catalogue.shipped(spark), ops.unknowns(spark), spark.createDataFrame(_TOPICS, "topic string, target string"))


@_query(f"WITH {_values('u', 'unknown_id, topic, status', UNKNOWNS)} SELECT status, count(*) AS n FROM u GROUP BY 1")
def unknown_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.unknowns(spark).groupBy("status").agg(F.count("*").alias("n"))


_EVIDENCE = [("t1", "A", "example", "x"), ("t1", "A", "red_annotation", "y"), ("t1", "B", "operational_summary", "x"), ("t2", "A", "example", "x"), ("t2", "B", "example", "x"), ("t3", "A", "explicit_instruction", "x"), ("t3", "B", "explicit_instruction", "z"), ("t4", "B", "example", "q")]


@_query(f"""WITH {_values('e', 'topic, source_id, source_type, value', _EVIDENCE)} SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY topic, source_id
    ORDER BY list_position(['red_annotation', 'explicit_instruction', 'operational_summary', 'example'], source_type)) = 1""")
def strongest_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.strongest_evidence(spark.createDataFrame(_EVIDENCE, "topic string, source_id string, source_type string, value string"))


@_query(f"""WITH {_values('e', 'topic, source_id, source_type, value', _EVIDENCE)} SELECT topic, CASE WHEN count(DISTINCT source_id) = 1 THEN 'complementary' WHEN count(DISTINCT value) = 1 THEN 'overlap'
    WHEN bool_or(source_type = 'example') AND NOT bool_and(source_type = 'example') THEN 'example_vs_explicit' ELSE 'contradiction' END AS relation FROM e GROUP BY topic""")
def source_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.source_relation(spark.createDataFrame(_EVIDENCE, "topic string, source_id string, source_type string, value string"))


# ---- lint -------------------------------------------------------------------------------------

_ELEMENTS_SQL = _values("e", "doc_id, seq, role, confidence, text, lead", [(r[0], r[2], r[3], r[4], r[6], r[7][1]) for r in fixtures.elements()])


def _policy(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rules = catalogue.shipped(spark)
    return rules, ops.effective_policy(rules, ops.conflicts(spark))


_FOUND = lint_sql.found_sql()
_TEXT_RULES = ("ER-MS-AUTHORINFO-002", "ER-MS-REF-PAGERANGE-001", "ER-MS-EQUATION-002", "ER-MS-REF-TITLECASE-001")
_OF_TEXT = f"rule_id IN {_TEXT_RULES}"
_FIXABLE = f"{FIXABLE}"
#: Policy on a finding: what may be changed, and which of that has a remedy.
_MAY = f"(autofix = 'safe' AND coalesce(confidence > 0, TRUE) OR autofix = 'conditional' AND coalesce(confidence >= 0.9, FALSE)) AND rule_id IN {_FIXABLE}"
_POLICY_SQL = f"""{_CONFLICTS_SQL}, sides AS (SELECT a_rule_id AS rule_id, lint, autofix, effective_rule FROM conflicts UNION ALL SELECT b_rule_id, lint, autofix, effective_rule FROM conflicts),
    policy AS (SELECT id, coalesce(s.lint, r.severity) AS severity, coalesce(s.autofix, r.autofix) AS autofix, target FROM rules r LEFT JOIN sides s ON s.rule_id = r.id AND s.rule_id IS DISTINCT FROM s.effective_rule)"""
_VERDICTS = f"""WITH {_FOUND}, {_FLAT}, {_POLICY_SQL}, verdicts AS (
    SELECT d.doc_id, CAST(f.seq AS INTEGER) AS seq, p.id AS rule_id, p.target, CASE WHEN ok IS NULL THEN 'NOT_CHECKED' WHEN severity = 'manual_review' OR NOT ok AND p.id = 'ER-REF-SORT-001' AND confidence < 0.9 THEN 'MANUAL_REVIEW' WHEN ok THEN 'PASS' ELSE upper(severity) END AS status,
        coalesce(NOT ok AND {_MAY}, FALSE) AS fixable
    FROM (SELECT DISTINCT doc_id FROM e) d CROSS JOIN policy p LEFT JOIN found f ON f.doc_id = d.doc_id AND f.rule_id = p.id)"""


def _verdicts(spark: SparkSession) -> DataFrame:
    """Every rule on every document of the fixture."""
    rules, policy = _policy(spark)
    manuscript = fixtures.manuscript(spark)
    return lints.verdicts(lints.lint(*manuscript, rules), rules, policy, manuscript[0])


@_query(f"WITH {_FOUND} SELECT doc_id, CAST(seq AS INTEGER) AS seq, rule_id, target, ok FROM found WHERE {_OF_TEXT}")
def lint_text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on wording, over elements with the right and the wrong role."""
    found = lints.lint_elements(fixtures.manuscript(spark)[0], lints.compiled(catalogue.shipped(spark)))
    return found.where(F.col("rule_id").isin(list(_TEXT_RULES))).select("doc_id", "seq", "rule_id", "target", "ok")


@_query(f"{_VERDICTS} SELECT * FROM verdicts WHERE {_OF_TEXT}")
def verdicts_of_text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark).where(F.col("rule_id").isin(list(_TEXT_RULES)))


@_query(f"WITH {_FOUND} SELECT doc_id, CAST(seq AS INTEGER) AS seq, CAST(confidence AS DOUBLE) AS confidence, rule_id, target, ok FROM found")
def lint_manuscript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over the whole fixture."""
    return lints.lint(*fixtures.manuscript(spark), catalogue.shipped(spark))


@_query(f"{_VERDICTS} SELECT * FROM verdicts")
def verdicts_of_manuscript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every rule on every document, under the policy of open conflicts."""
    return _verdicts(spark)


@_query(f"WITH {_FOUND}, {_FLAT} SELECT d.doc_id, id AS rule_id, rules.target, 'NOT_CHECKED' AS status FROM (SELECT DISTINCT doc_id FROM e) d CROSS JOIN rules WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = d.doc_id AND f.rule_id = id AND f.rule_id IN {tuple(lint_sql.ELEMENT_RULES)})")
def not_checked_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that each manuscript leaves unchecked when only its elements are read."""
    rules, policy = _policy(spark)
    elements = fixtures.manuscript(spark)[0]
    found = lints.lint_elements(elements, lints.compiled(rules))
    return lints.verdicts(found, rules, policy, elements).where("status = 'NOT_CHECKED'").select("doc_id", "rule_id", "target", "status")


_REFS_SQL = _values("refs", "doc_id, ref_no, zh, name, who, year, suffix", [(r[0], r[1], r[2] == "zh" or r[3], ((r[4][0][0] + r[4][0][1]) if ord(r[4][0][0][0]) > 0x2FFF else r[4][0][0]).lower(), "|".join(",".join(a) for a in r[4]), r[5], r[6]) for r in fixtures.references()])
_CITES_SQL = _values("cites", "doc_id, name, year", [(c[0], c[6][0].lower(), y) for c in fixtures.citations() if c[6] for y in c[7]])


@_query(f"""WITH {_REFS_SQL}, {_CITES_SQL}, listed AS (SELECT DISTINCT doc_id, name, year || coalesce(suffix, '') AS year FROM refs), cited AS (SELECT DISTINCT * FROM cites)
    SELECT doc_id, 'cited_not_listed' AS kind, name AS author, year FROM (SELECT * FROM cited EXCEPT SELECT * FROM listed)
    UNION ALL SELECT doc_id, 'listed_not_cited', name, year FROM (SELECT * FROM listed EXCEPT SELECT * FROM cited)""")
def citation_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, citations, refs = fixtures.manuscript(spark)
    return lints.uncited_and_unlisted(citations, refs)


@_query(f"""WITH {_REFS_SQL}, w AS (SELECT *, count(*) OVER (PARTITION BY doc_id, who, year) AS twins, row_number() OVER (PARTITION BY doc_id, who, year ORDER BY ref_no) AS nth,
    lag(zh) OVER (PARTITION BY doc_id ORDER BY ref_no) AS before FROM refs)
    SELECT doc_id, CAST(ref_no AS INTEGER) AS seq, 'ER-REF-SAMEYEAR-001' AS rule_id, coalesce(suffix = chr(CAST(96 + nth AS INTEGER)), FALSE) AS ok FROM w WHERE twins > 1
    UNION ALL SELECT doc_id, CAST(ref_no AS INTEGER), 'ER-REF-LANGUAGE-GROUP-001', NOT (zh AND coalesce(NOT before, FALSE)) FROM w""")
def reference_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lints.lint_references(fixtures.manuscript(spark)[2], lints.compiled(catalogue.shipped(spark)))
    return found.where("rule_id in ('ER-REF-SAMEYEAR-001', 'ER-REF-LANGUAGE-GROUP-001')").select("doc_id", "seq", "rule_id", "ok")


_SURNAMES = [(s, i) for s, i in zip("安白陈邓范高韩江孔李马倪欧潘钱任孙唐王徐杨张单曾仇", "ABCDFGHJKLMNOPQRSTWXYZSZQ", strict=True)] + [("smith", "S"), ("尉迟", "Y")]


@_query(f"WITH {_values('s', 'surname, initial', _SURNAMES)} SELECT surname, initial FROM s")
def surname_initials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([s[:1] for s in _SURNAMES], "surname string").select("surname", surname_initial(F.col("surname")).alias("initial"))


_FIXED = "regexp_replace(regexp_replace(text, '([0-9]) *[-–−~～] *([0-9])', '\\1—\\2', 'g'), '([0-9]) *[-–−~～] *([0-9])', '\\1—\\2', 'g')"


@_query(f"""WITH {_ELEMENTS_SQL} SELECT doc_id, CAST(seq AS INTEGER) AS seq, CASE role WHEN 'contact_label' THEN replace(text, '电子邮箱', '电子信箱') WHEN 'reference_page_range' THEN CASE WHEN confidence > 0 THEN {_FIXED} ELSE text END ELSE text END AS text FROM e""")
def fix_manuscript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixes.fix(fixtures.manuscript(spark)[0], lints.compiled(catalogue.shipped(spark))).select("doc_id", "seq", "text")


@_query(f"""WITH {_FOUND}, {_FLAT} SELECT doc_id, CAST(seq AS INTEGER) AS seq, rule_id, upper(severity) AS was, 'PASS' AS now FROM found JOIN rules ON id = rule_id WHERE NOT ok AND {_MAY}""")
def relint_after_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second lint says of elements that were fixed: each breach that may be changed and has a remedy is gone, nothing else moved."""
    rules, policy = _policy(spark)
    known = lints.compiled(rules)
    before = fixtures.manuscript(spark)[0]
    after = fixes.fix(before, known).drop("fixed_rules")
    first, second = (lints.verdicts(lints.lint_elements(e, known), rules, policy, before) for e in (before, after))
    return fixes.relint_changes(first, second)


@_query(f"{_VERDICTS} SELECT rule_id, status, count(*) AS n, CAST(count(*) FILTER (fixable) AS BIGINT) AS fixable FROM verdicts GROUP BY 1, 2")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(_verdicts(spark))


_LINES = [(1, 1, "张三、李四，1990a，论乙，经济学刊，1，1—9"), (1, 2, 'Smith, J.; Jones, K., 1999, "Growth and Trade", <i>Econ Rev</i>, 2, 3—8'), (1, 3, "Doe, A., 2001, On Trade, Some Press"), (1, 4, "no reference at all"), (2, 1, "王五，2020，论戊，某出版社")]
_LINES_SQL = _values("lines", "doc_id, ref_no, raw", _LINES)


@_query(f"""WITH {_LINES_SQL} SELECT doc_id, CAST(ref_no AS INTEGER) AS ref_no, raw AS line FROM lines WHERE regexp_matches(raw, '[0-9]{{4}}')""")
def reference_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are parsed and written again come out as they were."""
    lines = spark.createDataFrame(_LINES, "doc_id long, ref_no int, raw string")
    return format_references(parse_references(lines).where("year is not null"))


@_query(f"""WITH {_LINES_SQL} SELECT doc_id, CAST(ref_no AS INTEGER) AS ref_no, TRY_CAST(nullif(regexp_extract(raw, '[，,] ?([0-9]{{4}})', 1), '') AS INTEGER) AS year,
    CASE WHEN regexp_matches(raw, '，') THEN string_split(raw, '，')[3] WHEN contains(raw, '"') THEN string_split(raw, '"')[2] WHEN regexp_matches(raw, '[0-9]{{4}}') THEN string_split(raw, ', ')[4] END AS title FROM lines""")
def parsed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_references(spark.createDataFrame(_LINES, "doc_id long, ref_no int, raw string")).select("doc_id", "ref_no", "year", "title")


# ---- files ------------------------------------------------------------------------------------


def _word(spark: SparkSession) -> DataFrame:
    """The paragraphs of the fixture's Word file, with their roles."""
    files = spark.createDataFrame([(1, bytearray(fixtures.word_file()))], "doc_id long, content binary")
    return structure.in_context(docx.classify(docx.parsed(files)))


_WORD_SQL = _values("w", "seq, part, role, text", [(k, part, role, "".join(t for t, _ in runs)) for k, (part, _, runs, role) in enumerate(fixtures.WORD_PARAGRAPHS)])


@_query(f"WITH {_WORD_SQL} SELECT CAST(seq AS INTEGER) AS seq, part, role, text FROM w")
def word_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of a Word file in their order, with the roles that style, wording and place give them."""
    return _word(spark).select("seq", "part", "role", "text")


@_query(f"WITH {_values('p', 'role, text', fixtures.WORD_PARTS)}, {_WORD_SQL} SELECT role, text FROM p UNION ALL SELECT 'foreign_reference_entry_layout', text FROM w WHERE role = 'reference_entry' AND ascii(text) < 128 UNION ALL SELECT 'latin_letters_and_digits', text FROM w WHERE regexp_matches(text, '[A-Za-z0-9]')")
def word_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of paragraphs that rules of their own concern."""
    rows = structure.with_parts(_word(spark)).select("doc_id", "seq", "role", "text")
    return rows.join(_word(spark).select("doc_id", "seq", "role"), ["doc_id", "seq", "role"], "left_anti").select("role", "text")


@_query(f"WITH {_values('c', 'form, authors, years, lang', fixtures.WORD_CITATIONS)} SELECT * FROM c")
def word_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations in the texts of a Word file."""
    rows = _word(spark)
    found = structure.citations_of(rows, structure.references_of(rows))
    return found.select("form", F.array_join("authors", "|").alias("authors"), F.array_join("years", "|").alias("years"), "lang")


@_query(f"WITH {_values('r', 'ref_no, lang, surnames, year, title, pages', fixtures.WORD_REFERENCES)} SELECT CAST(ref_no AS INTEGER) AS ref_no, lang, surnames, CAST(year AS INTEGER) AS year, title, pages FROM r")
def word_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of references of a Word file."""
    found = structure.references_of(_word(spark))
    return found.select("ref_no", "lang", F.array_join(F.transform("authors", lambda a: a["surname"]), "|").alias("surnames"), "year", "title", "pages")


@_query(f"WITH {_WORD_SQL} SELECT CAST(seq AS INTEGER) AS seq, CASE role WHEN 'contact_label' THEN replace(text, '电子邮箱', '电子信箱') WHEN 'reference_entry' THEN regexp_replace(text, '([0-9])-([0-9]+)$', '\\1—\\2') ELSE text END AS text FROM w")
def fixed_word_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Word file with the fixes of texts, read again: words and page ranges change across runs, nothing else does."""
    rules = lints.compiled(catalogue.shipped(spark))
    changed = fixes.fix(structure.with_parts(_word(spark)).withColumn("_was", F.col("text")), rules).where("_was <> text").select("seq", "_was", "text").collect()  # one file's
    edits: dict[int, list[tuple[str, str]]] = {}
    for r in sorted(changed):
        edits.setdefault(r["seq"], []).append((r["_was"], r["text"]))
    again = spark.createDataFrame([(1, bytearray(docx.write_docx(fixtures.word_file(), edits)))], "doc_id long, content binary")
    return docx.parsed(again).select("seq", "text")


_YAML_ROWS = [(0, 0, "2020-01-01", "True", "p. 3", "in these words", False), (0, 1, "7", "t", None, None, False), (0, 2, None, None, None, None, False), (2, 0, "7", "u", None, None, False), (2, 1, "7.0", "v", None, None, True)]


@_query(f"WITH {_values('y', 'file_ord, rule_ord, id, target, locator, evidence, duplicate', _YAML_ROWS)} SELECT CAST(file_ord AS INTEGER) AS file_ord, CAST(rule_ord AS INTEGER) AS rule_ord, id, target, locator, evidence, duplicate FROM y")
def yaml_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules out of YAML texts: order over files, a file without rules, values as they print, evidence, equal ids."""
    files = [(name, catalogue.read_yaml(text.encode(), name)) for name, text in fixtures.YAML_FILES]
    found = validator.with_duplicate_flag(catalogue.from_files(spark, files))
    return found.select("file_ord", "rule_ord", "id", "target", "locator", "evidence", "duplicate")


# ---- the same parts at volume ------------------------------------------------------------------


@_query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders), f AS (
    SELECT o_orderkey AS key, 0 AS o, 'duplicate o_custkey' AS error FROM o WHERE nth > 1
    UNION ALL SELECT o_orderkey, 1, 'missing o_orderdate' FROM o WHERE o_orderdate IS NULL
    UNION ALL SELECT o_orderkey, 2, 'invalid o_orderstatus ' || coalesce(o_orderstatus, 'None') FROM o WHERE coalesce(o_orderstatus <> 'F', TRUE))
    SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY o) - 1 AS INTEGER) AS err_ord, error FROM f""")
def order_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered errors: first order of each customer only, a date, status F."""
    return validator.table_errors(_read(spark, sf_dir, "orders"), "o_orderkey", ("o_orderdate",), {"o_orderstatus": ("F",)}, ("o_custkey",), ("o_orderkey",))


@_query("""SELECT error, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN coalesce(l_returnflag NOT IN ('A', 'N'), TRUE) THEN 'invalid l_returnflag ' || coalesce(l_returnflag, 'None') END,
    CASE WHEN coalesce(l_linestatus NOT IN ('O'), TRUE) THEN 'invalid l_linestatus ' || coalesce(l_linestatus, 'None') END], lambda x: x IS NOT NULL)) AS error FROM lineitem) GROUP BY 1""")
def lineitem_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of breaches over the largest table: row checks, then one aggregate."""
    return validator.error_summary(validator.table_errors(_read(spark, sf_dir, "lineitem"), "l_orderkey", enums={"l_returnflag": ("A", "N"), "l_linestatus": ("O",)}))


@_query("""WITH f AS (SELECT event_id AS key, 0 AS o, 'invalid event_type ' || coalesce(event_type, 'None') AS error FROM events WHERE coalesce(event_type NOT IN ('click', 'purchase', 'signup', 'view'), TRUE)
    UNION ALL SELECT event_id, 1, 'missing k' FROM events WHERE json_extract_string(props, '$.k') IS NULL UNION ALL SELECT event_id, 2, 'missing z' FROM events WHERE json_extract_string(props, '$.z') IS NULL)
    SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY o) - 1 AS INTEGER) AS err_ord, error FROM f""")
def event_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enum and nested fields of a JSON column."""
    return validator.table_errors(_read(spark, sf_dir, "events"), "event_id", enums={"event_type": ("click", "purchase", "signup", "view")}, nested={"k": ("props", "$.k"), "z": ("props", "$.z")})


@_query("""WITH p AS (SELECT doc_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS seq, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL))
    SELECT doc_id, seq, regexp_replace(regexp_replace(text, '([0-9])\\s*[-–−~～]\\s*([0-9])', '\\1—\\2', 'g'), '([0-9])\\s*[-–−~～]\\s*([0-9])', '\\1—\\2', 'g') AS text FROM p WHERE regexp_matches(text, '[0-9]\\s*[-–−~～]\\s*[0-9]')""")
def document_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of all documents with a hyphenated range, and what the fixer would write had they that role.

    On this data such strings are telephone numbers: the linter asks for the role first.
    """
    paragraphs = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    return paragraphs.where(hyphenated_range(F.col("text"))).select("doc_id", "seq", with_em_dash(F.col("text")).alias("text"))
