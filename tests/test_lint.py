import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from rulewright.functions.text import hyphenated_range, surname_initial, with_em_dash
from rulewright.operators import catalogue as ops
from rulewright.operators import fix, lint, report, structure
from rulewright.operators.policy import FIXABLE
from rulewright.sources import catalogue, docx, fixtures
from rulewright.streaming import validate

#: Elements, citations and references that pass and that fail, by rule.
EXPECTED = {
    "ER-MS-TITLE-001": ({0, 50}, {1}), "ER-MS-TITLE-002": ({2}, {3}), "ER-MS-AUTHOR-001": ({4}, {5}), "ER-MS-AUTHORINFO-001": ({6}, {7}), "ER-MS-AUTHORINFO-002": ({8}, {9}),
    "ER-MS-ABSTRACT-001": ({11}, {12}), "ER-MS-HEADING1-001": ({13}, {14}), "ER-MS-HEADING-HIERARCHY-001": ({15, 17, 62}, {16, 61}), "ER-MS-EQUATION-001": ({18}, {19}), "ER-MS-EQUATION-002": ({20}, {21}),
    "ER-MS-TABLE-001": ({22}, {23, 63}), "ER-MS-TABLE-NOTE-001": ({24}, {25}), "ER-MS-TABLE-NOTE-002": ({24}, {25}), "ER-MS-FOOTNOTE-001": ({26}, {27}), "ER-MS-FOOTNOTE-002": ({28}, {29}),
    "ER-MS-FIGURE-001": ({30}, {31}), "ER-MS-FIGURE-002": ({32}, {33}), "ER-MS-REF-LAYOUT-001": ({34}, {35}), "ER-MS-LATIN-FONT-001": ({36}, {37}), "ER-MS-REF-PAGERANGE-001": ({38}, {39, 47}),
    "ER-MS-REF-TITLECASE-001": ({41}, {42}), "ER-MS-REF-AUTHOR-001": ({43}, {44}), "ER-MS-REF-JOURNAL-001": ({45}, {46}),
    "ER-CIT-GENERAL-001": (set(range(29)) - {2}, {2}), "ER-CIT-GENERAL-002": ({0}, {1, 28}), "ER-CIT-NARRATIVE-001": ({3, *range(19, 28)}, {4}), "ER-CIT-SELF-001": ({5, 35}, {6, 31}), "ER-CIT-TITLE-IN-SENTENCE-001": ({7}, {8}),
    "ER-CIT-MULTI-AUTHORSOURCES-001": ({9}, {10}), "ER-CIT-SAMEAUTHOR-MULTIYEAR-001": ({11}, {12}), "ER-CIT-TRANSLATION-001": ({13}, {14, 32}), "ER-CIT-FOREIGN-ORIGINAL-001": ({15}, {16}), "ER-CIT-MIXEDLANG-001": ({17}, {18, 33}),
    "ER-CIT-EN-TWOAUTHORS-001": ({19}, {20}), "ER-CIT-EN-MULTIAUTHORS-001": ({21}, {22}), "ER-CIT-ZH-TWOAUTHORS-001": ({23}, {24}), "ER-CIT-ZH-MULTIAUTHORS-001": ({30}, {26, 34}), "ER-CIT-REF-FULLAUTHORS-001": ({10, 12}, {11}),
    "ER-REF-ORDER-FIELDS-001": (set(range(1, 12)) - {4}, {4}), "ER-REF-SORT-001": (set(range(1, 12)) - {4, 8}, {2, 4, 8}), "ER-REF-SAMEYEAR-001": ({2}, {3}), "ER-REF-TRANSLATION-001": ({5}, {6}), "ER-REF-FOREIGN-AUTHOR-001": ({7, 10}, {8}),
    "ER-REF-FOREIGN-TITLE-001": ({7, 10}, {8}), "ER-REF-FOREIGN-ARTICLE-QUOTE-001": ({7, 10}, {8}), "ER-REF-FOREIGN-PUBLICATION-001": ({7, 10}, {8}), "ER-REF-FOREIGN-LINE-001": ({48}, {49}),
    "ER-REF-LANGUAGE-GROUP-001": (set(range(1, 11)) - {9}, {9, 11}), "ER-REF-CONTENT-FOOTNOTE-001": ({27}, {28}),
}


@pytest.fixture(scope="module")
def rules(spark):
    return catalogue.shipped(spark)


@pytest.fixture(scope="module")
def found(spark, rules):
    return lint.lint(*fixtures.manuscript(spark), rules).collect()


def test_every_rule_has_a_checker(rules):
    done = {*lint.ELEMENT_CHECKS, *lint.CITATION_CHECKS, *lint.REFERENCE_CHECKS, *lint.ACROSS}
    assert done == {r.id for r in rules.collect()} == EXPECTED.keys()


@pytest.mark.parametrize("rule_id", EXPECTED)
def test_rule(found, rule_id):
    passed, failed = EXPECTED[rule_id]
    got = {(r.doc_id, r.seq): r.ok for r in found if r.rule_id == rule_id}
    assert {s for (_, s), ok in got.items() if not ok} == failed
    assert passed <= {s for (_, s), ok in got.items() if ok}


def test_other_roles_have_no_findings(found):
    assert not [r for r in found if r.seq in (10, 40) and r.rule_id.startswith("ER-MS")]


def test_verdicts(spark, rules, found):
    frame = spark.createDataFrame(found)
    policy = ops.effective_policy(rules, ops.conflicts(spark))
    out = {(r.doc_id, r.seq, r.rule_id): r for r in lint.verdicts(frame, rules, policy).collect()}
    assert {r.status for r in out.values()} <= set(report.STATUSES)
    assert out[1, 9, "ER-MS-AUTHORINFO-002"].status == "ERROR" and out[1, 9, "ER-MS-AUTHORINFO-002"].fixable
    assert out[1, 7, "ER-MS-AUTHORINFO-001"].status == "WARNING" and out[1, 0, "ER-MS-TITLE-001"].status == "PASS"
    assert out[1, 42, "ER-MS-REF-TITLECASE-001"].status == "MANUAL_REVIEW" and not out[1, 42, "ER-MS-REF-TITLECASE-001"].fixable
    assert out[2, 2, "ER-REF-SORT-001"].status == "MANUAL_REVIEW"  # hangs on a surname with two readings
    assert out[1, 4, "ER-REF-SORT-001"].status == "ERROR"
    few = frame.where("rule_id <> 'ER-MS-FIGURE-002'")
    left = lint.verdicts(few, rules, policy).where("status = 'NOT_CHECKED'").collect()
    assert [r.rule_id for r in left if r.doc_id == 1] == ["ER-MS-FIGURE-002"]
    assert {r.doc_id for r in left if r.rule_id == "ER-MS-ABSTRACT-001"} == {2, 3}  # one document's abstract is no other's
    assert {r.status for r in lint.verdicts(frame, rules, policy, spark.range(9, 10).toDF("doc_id")).collect()} == {"NOT_CHECKED"}


def test_what_is_called_fixable_is_fixed(spark, rules, found):
    known, policy = lint.compiled(rules), ops.effective_policy(rules, ops.conflicts(spark))
    called = {(r.seq, r.rule_id) for r in lint.verdicts(spark.createDataFrame(found), rules, policy).where("fixable").collect()}
    done = {(r.seq, x) for r in fix.fix(fixtures.manuscript(spark)[0], known).collect() for x in r.fixed_rules}
    assert called == done and len(done) == 15 and (47, "ER-MS-REF-PAGERANGE-001") not in done
    assert {x for _, x in done} == set(FIXABLE) and set(fix.TEXT_FIXES) | set(fix.LAYOUT_FIXES) == set(FIXABLE) <= set(lint.ELEMENT_CHECKS)


def test_elements_are_read_once_and_moved_once(spark, rules):
    plan = lint.lint_elements(fixtures.manuscript(spark)[0], lint.compiled(rules))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Scan") == 1 and "Join" not in plan


def test_rules_are_joined_without_moving_elements(spark, rules):
    plan = lint.lint_elements(fixtures.manuscript(spark)[0], {k: v for k, v in lint.compiled(rules).items() if k not in lint.ACROSS})
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_fixes_are_gated_and_idempotent(spark, rules):
    known = lint.compiled(rules)
    elements = fixtures.manuscript(spark)[0]
    once = fix.fix(elements, known)
    texts = {r.seq: r.text for r in once.collect()}
    assert texts[9] == "电子信箱：a@b" and texts[39] == "1—2—3"
    assert texts[10] == "电子邮箱：a@b" and texts[40] == "tel 555-0199" and texts[47] == "3-4"  # wrong role, or no confidence
    assert fix.fix(once.drop("fixed_rules"), known).where("size(fixed_rules) > 0").count() == 0
    policy = ops.effective_policy(rules, ops.conflicts(spark))
    before, after = (lint.verdicts(lint.lint_elements(e, known), rules, policy) for e in (elements, once))
    changes = {(r.seq, r.was, r.now) for r in fix.relint_changes(before, after).collect()}
    assert {(9, "ERROR", "PASS"), (39, "ERROR", "PASS"), (1, "ERROR", "PASS"), (7, "WARNING", "PASS")} <= changes
    assert len(changes) == 15 and {c[2] for c in changes} == {"PASS"}


def test_originals_are_never_overwritten(spark, tmp_path):
    elements = fixtures.manuscript(spark)[0]
    fix.write_fixed(elements, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exist"):
        fix.write_fixed(elements, str(tmp_path / "out"))


def test_reports(spark, rules, found, tmp_path):
    verdicts = lint.verdicts(spark.createDataFrame(found), rules, ops.effective_policy(rules, ops.conflicts(spark)))
    report.write_audit_json(verdicts, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == verdicts.count()
    assert report.markdown(verdicts).count("\n| ER-") == report.summary(verdicts).count()
    review = report.manual_review(verdicts)
    assert review.where("status = 'MANUAL_REVIEW'").count() > 5
    report.write_manual_review(verdicts, str(tmp_path / "review"))
    assert spark.read.text(str(tmp_path / "review")).count() == review.count()


def test_text_functions(spark):
    rows = spark.createDataFrame([("1-2-3",), ("555 - 0199",), ("a-b",), (None,)], "t string").select(hyphenated_range(F.col("t")).alias("h"), with_em_dash(F.col("t")).alias("f")).collect()
    assert [(r.h, r.f) for r in rows] == [(True, "1—2—3"), (True, "555—0199"), (False, "a-b"), (False, None)]
    names = spark.createDataFrame([("曾",), ("张",), ("尉迟",), ("smith",), ("区",)], "s string").select(surname_initial(F.col("s")).alias("i")).collect()
    assert [r.i for r in names] == ["Z", "Z", "Y", "S", "O"]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCUMENT = f"""<w:document {W}><w:body>
<w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:t>题目</w:t></w:r></w:p>
<w:p><w:pPr><w:ind w:firstLineChars="200"/></w:pPr><w:r><w:rPr><w:i/></w:rPr><w:t>电子邮箱：a&amp;b</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>格</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
<w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> ADDIN ref </w:instrText></w:r><w:r><w:t>（张三，1990）</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p>
<w:sectPr><w:footnotePr><w:numRestart w:val="eachPage"/></w:footnotePr></w:sectPr></w:body></w:document>"""
STYLES = f"""<w:styles {W}><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:eastAsia="宋体" w:ascii="Times New Roman"/><w:sz w:val="21"/></w:rPr></w:rPrDefault></w:docDefaults>
<w:style w:styleId="Base"><w:pPr><w:jc w:val="center"/></w:pPr><w:rPr><w:sz w:val="32"/></w:rPr></w:style><w:style w:styleId="Title"><w:basedOn w:val="Base"/></w:style></w:styles>"""
NOTES = f'<w:footnotes {W}><w:footnote><w:p><w:r><w:t>* 作者</w:t></w:r></w:p></w:footnote></w:footnotes>'


@pytest.fixture
def word_file(tmp_path):
    path = tmp_path / "a.docx"
    with zipfile.ZipFile(path, "w") as z:
        for name, text in (("word/document.xml", DOCUMENT), ("word/styles.xml", STYLES), ("word/footnotes.xml", NOTES), ("custom.bin", "as it is")):
            z.writestr(name, text)
    (tmp_path / "b.docx").write_bytes(b"no zip file")
    return path


def test_word_files(spark, word_file):
    elements = docx.classify(docx.read_docx(spark, str(word_file.parent)))
    rows = elements.orderBy("seq").collect()
    assert sum(r.role == "unreadable" for r in rows) == 1
    by_role = {r.role: r for r in rows}
    title = by_role["title"]
    assert (title.para.alignment, title.runs[0].size_pt, title.runs[0].east_asia_font, title.confidence) == ("center", 16.0, "宋体", 0.95)
    assert by_role["contact_label"].para.lead_spaces == 2 and by_role["contact_label"].runs[0].italic
    assert by_role["table_text"].part == "table" and by_role["author_information_footnote"].para.num_restart == "each_page"
    assert [x.runs[0].field_kind for x in rows if x.text == "（张三，1990）"] == ["ADDIN"]


def test_color_modes_of_figures(spark, tmp_path):
    png = lambda kind: b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + b"\0" * 8 + b"\x08" + bytes([kind]) + b"\0" * 9
    jpeg = lambda n: b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x0b\x08\0\x01\0\x01" + bytes([n]) + b"\0" * 9
    assert [docx.color_mode(x) for x in (png(0), png(2), png(4), png(6), jpeg(1), jpeg(3), b"", b"GIF89a", b"\xff\xd8")] == ["black_and_white", "color", "black_and_white", "color", "black_and_white", "color", None, None, None]
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    figure = lambda k: f'<w:p><w:r><w:drawing><b xmlns:r="{rel}" r:embed="r{k}"/></w:drawing></w:r></w:p>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{figure(1)}{figure(2)}{figure(3)}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Type="{rel}/image" Target="media/{k}"/>' for k in (1, 2)) + "</Relationships>")
        z.writestr("word/media/1", png(0))
        z.writestr("word/media/2", jpeg(3))
    rows = docx.classify(docx.read_docx(spark, str(tmp_path))).orderBy("seq").collect()
    assert [r.obj.color_mode for r in rows] == ["black_and_white", "color", None] and {r.role for r in rows} == {"figure"}


def test_links_bookmarks_sections_and_captions(spark, tmp_path):
    drawing = "<w:p><w:r><w:drawing/></w:r></w:p>"
    link = '<w:p><w:bookmarkStart w:name="here"/><w:r><w:t>see </w:t></w:r><w:hyperlink><w:r><w:t>this</w:t></w:r></w:hyperlink></w:p>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{drawing}<w:p><w:r><w:t>图1 题</w:t></w:r></w:p>{link}<w:p><w:pPr><w:sectPr/></w:pPr></w:p><w:sectPr/></w:body></w:document>")
    rows = structure.in_context(docx.classify(docx.read_docx(spark, str(tmp_path)))).orderBy("seq").collect()
    assert [(r.role, r.parent_seq) for r in rows if r.role in ("figure", "figure_caption")] == [("figure", None), ("figure_caption", 0)]
    assert [(r.seq, r.role, r.text, r.parent_seq) for r in rows if r.seq >= 4] == [(4, "hyperlink", "this", 2), (5, "bookmark", "here", 2), (6, "section", None, 3), (7, "section", None, None)]
    assert rows[2].text == "see this"


def test_word_files_are_changed_in_place(word_file):
    before = word_file.read_bytes()
    after = zipfile.ZipFile(io.BytesIO(docx.write_docx(before, {1: [("电子邮箱：a&b", "电子信箱：a&b")]})))
    assert after.read("word/document.xml").decode() == DOCUMENT.replace("邮箱", "信箱")
    assert after.read("custom.bin") == b"as it is" and word_file.read_bytes() == before


def test_safe_fixes_reach_word_files(spark, rules, word_file):
    out = {r.path.rsplit("/", 1)[1]: r for r in docx.fixed_files(spark, str(word_file.parent), lint.compiled(rules)).collect()}
    assert not out["b.docx"].changed and bytes(out["b.docx"].content) == b"no zip file"
    changed = zipfile.ZipFile(io.BytesIO(bytes(out["a.docx"].content)))
    assert changed.read("word/document.xml").decode() == DOCUMENT.replace("邮箱", "信箱")


def word(path, paragraphs, notes=()):
    """A Word file of paragraphs, each a list of (text, italic) runs or a (style, runs) pair."""
    def p(content):
        style, runs = content if isinstance(content, tuple) else (None, content)
        props = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f"<w:p>{props}" + "".join(f"<w:r><w:rPr>{'<w:i/>' if i else ''}</w:rPr><w:t>{t}</w:t></w:r>" for t, i in runs) + "</w:p>"

    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{''.join(map(p, paragraphs))}</w:body></w:document>")
        z.writestr("word/footnotes.xml", f"<w:footnotes {W}>{''.join(f'<w:footnote>{p(n)}</w:footnote>' for n in notes)}</w:footnotes>")


@pytest.fixture
def paper(tmp_path):
    folder = tmp_path / "papers"
    folder.mkdir()
    word(folder / "paper.docx", [
        ("Title", [("贸易与增长*", False)]), [("李四", False)], [("内容提要：本文研究贸易。", False)],
        [("张三（1990）指出这一点，后来王五等（2020）也有讨论（Smith &amp; Jones，1999；李四，2001）。Wang et al. (2013) 不同意（赵六，2005）。", False)],
        [("参考文献", False)],
        [("张三，1990，论乙，经济学刊，1，1", False), ("-9", False)], [("王五、赵一、钱二，2020，论戊，经济学刊，2，3—8", False)],
        [('Smith, J., 1999, "Growth and Trade", ', False), ("Econ Rev", True), (", 2, 3-8", False)], [('Wang, B.; Li, C.; Xu, D., 2013, "of Trees", Econ Rev, 2, 3—8', False)],
    ], [[("* 作者信息", False)], [("正文注一", False)]])
    return folder


def test_all_roles_come_from_word_files(spark, rules, paper):
    elements, citations, refs = structure.manuscript(docx.classify(docx.read_docx(spark, str(paper))))
    roles = {}
    for r in elements.collect():
        roles.setdefault(r.role, []).append(r)
    assert [r.text for r in roles["author_name"]] == ["李四"] and len(roles["reference_entry"]) == 4 and len(roles["title_author_info_marker"]) == 1
    assert [r.text for r in roles["reference_page_range"]] == ["1-9", "3—8", "3-8", "3—8"] and len(roles["foreign_reference_entry_layout"]) == 2
    assert [r.text for r in roles["english_reference_title"]] == ["Growth and Trade", "of Trees"] and [x.text for r in roles["english_reference_journal_name"] for x in r.runs] == ["Econ Rev"]
    assert [r.text for r in roles["english_reference_authors"]] == ["Smith, J.", "Wang, B.; Li, C.; Xu, D."] and len(roles["ordinary_footnote_numbering"]) == 1 and roles["latin_letters_and_digits"]
    cited = {(r.form, tuple(r.authors), tuple(r.years), r.lang) for r in citations.collect()}
    assert cited == {("narrative", ("张三",), ("1990",), "zh"), ("narrative", ("王五",), ("2020",), "zh"), ("self", ("Smith", "Jones", "李四"), ("1999", "2001"), "mixed"), ("narrative", ("Wang",), ("2013",), "en"), ("parenthetical", ("赵六",), ("2005",), "zh")}
    assert [(r.ref_no, r.year, len(r.authors), r.lang) for r in refs.orderBy("ref_no").collect()] == [(1, 1990, 1, "zh"), (2, 2020, 3, "zh"), (3, 1999, 1, "en"), (4, 2013, 3, "en")]
    found = {(r.rule_id, r.ok) for r in lint.lint(elements, citations, refs, rules).collect()}
    assert {("ER-CIT-ZH-MULTIAUTHORS-001", True), ("ER-CIT-EN-MULTIAUTHORS-001", True), ("ER-MS-REF-PAGERANGE-001", False), ("ER-MS-REF-JOURNAL-001", False), ("ER-MS-REF-TITLECASE-001", False), ("ER-MS-TITLE-002", True), ("ER-REF-LANGUAGE-GROUP-001", True), ("ER-CIT-REF-FULLAUTHORS-001", True)} <= found
    lost = {(r.kind, r.author) for r in lint.uncited_and_unlisted(citations, refs).collect()}
    assert ("cited_not_listed", "赵六") in lost and not any(a == "张三" for _, a in lost)


def test_page_ranges_are_fixed_across_runs(spark, rules, paper):
    before = zipfile.ZipFile(io.BytesIO((paper / "paper.docx").read_bytes())).read("word/document.xml").decode()
    row = docx.fixed_files(spark, str(paper), lint.compiled(rules)).first()
    after = zipfile.ZipFile(io.BytesIO(bytes(row.content))).read("word/document.xml").decode()
    assert after == before.replace("<w:t>-9<", "<w:t>—9<").replace(", 2, 3-8", ", 2, 3—8") and row.changed


def test_findings_are_written_into_a_copy(spark, rules, paper):
    elements, citations, refs = structure.manuscript(docx.classify(docx.read_docx(spark, str(paper))))
    known = lint.lint(elements, citations, refs, rules)
    verdicts = lint.verdicts(known, rules, ops.effective_policy(rules, ops.conflicts(spark)))
    row = docx.marked_files(spark, str(paper), verdicts).first()
    old, new = (zipfile.ZipFile(io.BytesIO(c)).read("word/document.xml").decode() for c in ((paper / "paper.docx").read_bytes(), bytes(row.content)))
    notes = re.findall(r'<w:r><w:rPr><w:color w:val="FF0000"/></w:rPr><w:t xml:space="preserve">[^<]*</w:t></w:r>', new)
    assert len(notes) > 4 and any("ERROR ER-MS-REF-PAGERANGE-001" in n for n in notes)
    for n in notes:
        new = new.replace(n, "", 1)
    assert new == old


def test_edits_move_only_what_differs():
    assert docx._edited(["ab", "cd", "ef"], "bcde", "bXe") == ["ab", "X", "ef"]
    assert docx._edited(["1", "-", "2 1-2"], "1-2", "1—2") == ["1", "-", "2 1—2"] and docx._edited(["a"], "x", "y") == ["a"]
    assert docx._edited(["ab"], "ab", "abc") == ["abc"] and docx._edited(["ab", "c"], "abc", "c") == ["", "c"]


def test_streams_give_the_errors_of_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", '{"k": 1}'), (2, None, "{}"), (3, "z", None)], "id long, kind string, props string")
    rows.write.parquet(str(tmp_path / "in"))
    checks = {"required": ("kind",), "enums": {"kind": ("a",)}, "nested": {"k": ("props", "$.k")}}
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    validate.write_errors(validate.stream_errors(stream, "id", **checks), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    from rulewright.plans.validator import table_errors

    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(table_errors(rows, "id", **checks).collect())
