"""Synthetic inputs of our own: a faulty catalogue, and manuscripts to lint.

They exercise the engine; they are no samples of what a correct paper looks like.
"""

from __future__ import annotations

import copy
import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

from ..operators.lint import CITATIONS_DDL, ELEMENTS_DDL, REFS_DDL

_GOOD = {"id": "ER-MS-X-001", "domain": "manuscript", "target": "t", "normativity": "mandatory", "source": {"source_id": "S", "source_type": "example"}, "requirement": {"a": 1}, "lint": {"severity": "error"}, "autofix": "safe"}


def rule(drop: tuple[str, ...] = (), **changes) -> dict:
    """A valid rule but for the changes."""
    out = copy.deepcopy(_GOOD) | changes
    for name in drop:
        del out[name]
    return out


def faulty_files() -> list[tuple[str, dict]]:
    """A catalogue with every reportable kind of fault, over two files."""
    first = [
        {},
        rule(("id",)),
        rule(id=None),
        rule(id="ER-MS-B-001"),
        rule(id="ER-MS-B-001"),
        rule(id="ER-MS-B-001"),
        rule(("source",), id="ER-MS-C-001"),
        rule(id="ER-MS-D-001", source={}),
        rule(id="ER-MS-E-001", domain=True),
        rule(id="ER-MS-F-001", domain="it's"),
        rule(id="ER-MS-G-001", normativity="unknown"),
        rule(id="ER-MS-H-001", extra=1),
        rule(id="ER-MS-I-001", lint={"severity": "fatal"}, autofix=None),
    ]
    return [("manuscript.yaml", {"rules": first}), ("citations.yaml", {}), ("references.yaml", {"rules": [rule(id="ER-MS-D-001"), rule(id="bad id")]})]


def _run(text: str = "字", font: str = "宋体", size: float = 7.5, latin: str = "Times New Roman", italic: bool = False, field: str | None = None) -> tuple:
    return (text, font, latin, latin, size, italic, field)


def _element(seq: int, role: str, text: str = "字", part: str = "body", confidence: float = 0.95, align: str | None = None, lead: int = 0, restart: str | None = None, numbered: bool = False, style: str | None = None, runs: list[tuple] | None = None, obj: tuple | None = None, parent: int | None = None, doc: int = 1) -> tuple:
    return (doc, part, seq, role, confidence, 1, text, (align, lead, restart, numbered, style), [_run(text)] if runs is None else runs, obj, parent)


def elements() -> list[tuple]:
    """For each element rule one element that passes and one that fails, and some whose role no rule has."""
    r = lambda font, size, **k: [_run("字", font, size, **k)]
    rows = [
        _element(0, "title", align="center", runs=r("宋体", 16.0)), _element(1, "title", align="left", runs=r("宋体", 16.0)),
        _element(2, "title_author_info_marker", "题目*"), _element(3, "title_author_info_marker", "题目"),
        _element(4, "author_name", "李四", align="center", runs=r("宋体", 12.0)), _element(5, "author_name", "张三", align="center", runs=r("宋体", 14.0)),
        _element(6, "author_information_footnote", "* 作者", part="footnote"), _element(7, "author_information_footnote", "某校", part="footnote", runs=r("黑体", 7.5)),
        _element(8, "contact_label", "电子信箱：a@b"), _element(9, "contact_label", "电子邮箱：a@b"), _element(10, "body", "电子邮箱：a@b", runs=r("宋体", 10.5)),
        _element(11, "abstract", runs=r("仿宋", 10.5)), _element(12, "abstract", runs=r("宋体", 10.5)),
        _element(13, "heading_level_1", align="center", runs=r("宋体", 14.0)), _element(14, "heading_level_1", align=None, runs=r("宋体", 14.0)),
        _element(15, "heading_numbering", "（一）题", lead=2, style="heading2"), _element(16, "heading_numbering", "1. 题", lead=2, style="heading2"), _element(17, "heading_numbering", "1. 题", style="heading3"),
        _element(18, "equation", obj=("equation", "MathType", None)), _element(19, "equation", obj=("equation", "image", None)),
        _element(20, "equation_where_paragraph", "其中，x", lead=2), _element(21, "equation_where_paragraph", "其中，x"),
        _element(22, "table_text", parent=1, runs=r("仿宋", 9.0)), _element(23, "table_text", parent=2, runs=r("仿宋", 12.0)),
        _element(24, "table_note", parent=1, runs=r("宋体", 7.5)), _element(25, "table_note", parent=2, runs=r("黑体", 12.0)),
        _element(26, "ordinary_footnote_numbering", restart="each_page"), _element(27, "ordinary_footnote_numbering", restart="continuous"),
        _element(28, "ordinary_footnote_text", lead=2, part="footnote"), _element(29, "ordinary_footnote_text", lead=0, part="footnote"),
        _element(30, "figure_caption", align="center", runs=r("黑体", 9.0)), _element(31, "figure_caption", align="center", runs=r("黑体", 10.5)),
        _element(32, "figure", obj=("figure", None, "black_and_white")), _element(33, "figure", obj=("figure", None, "rgb")),
        _element(34, "reference_entry", lead=2), _element(35, "reference_entry", lead=2, numbered=True),
        _element(36, "latin_letters_and_digits", "abc 1"), _element(37, "latin_letters_and_digits", "abc 1", runs=[_run("abc", latin="Arial")]),
        _element(38, "reference_page_range", "第15—25页"), _element(39, "reference_page_range", "1-2-3"), _element(40, "body", "tel 555-0199", runs=r("宋体", 10.5)),
        _element(41, "english_reference_title", "Growth and Trade"), _element(42, "english_reference_title", "growth and Trade"),
        _element(43, "english_reference_authors", "Smith, J. A. and K. Jones"), _element(44, "english_reference_authors", "John Smith"),
        _element(45, "english_reference_journal_name", runs=[_run("Journal", italic=True)]), _element(46, "english_reference_journal_name", runs=[_run("Journal")]),
        _element(47, "reference_page_range", "3-4", confidence=0.0), _element(48, "foreign_reference_entry_layout", "Smith, J., 2001, Title"), _element(49, "foreign_reference_entry_layout", "Smith J. 2001"),
        _element(50, "title", part="footnote", text="* 注", doc=2, align="center", runs=r("宋体", 15.0)),
        _element(60, "heading_level_1", doc=3, align="center", runs=r("宋体", 14.0)), _element(61, "heading_numbering", "1. 题", style="heading3", doc=3), _element(62, "heading_numbering", "（1）题", style="heading4", doc=3),
        _element(63, "table_text", doc=3, parent=63, runs=r("仿宋", 7.5)),
    ]
    return rows


def citations() -> list[tuple]:
    """(doc_id, part, seq, cite_no, form, lang, authors, years, pages, raw)"""
    c = lambda seq, form, lang, authors, years, raw, part="body", doc=1: (doc, part, seq, seq, form, lang, authors, years, None, raw)
    return [
        c(0, "parenthetical", "zh", ["张三"], ["1990"], "（张三，1990）"), c(1, "parenthetical", "zh", [], ["1990"], "（1990）"), c(2, "footnote", "zh", ["张三"], ["1990"], "张三，1990", "footnote"),
        c(3, "narrative", "zh", ["张三"], ["1990"], "张三（1990）"), c(4, "narrative", "zh", ["张三"], ["1990"], "张三（张三，1990）"),
        c(5, "self", "zh", ["李四"], ["2001"], "（李四，2001）"), c(6, "self", "zh", [], ["2001"], "（拙作，2001）"),
        c(7, "narrative_title", "zh", ["李四"], ["2001"], "（2001，第3页）"), c(8, "narrative_title", "zh", ["李四"], ["2001"], "（李四，2001）"),
        c(9, "multiple", "zh", ["张三", "李四"], ["1990", "2001"], "（张三，1990；李四，2001）"), c(10, "multiple", "zh", ["张三", "李四"], ["1990", "2001"], "（张三，1990、李四，2001）"),
        c(11, "multiple", "zh", ["张三"], ["1987", "1988a", "1988b"], "张三（1987，1988a，1988b）"), c(12, "multiple", "zh", ["张三"], ["1987", "1988"], "张三（1987、1988）"),
        c(13, "translation", "zh", ["斯密"], ["1972"], "（斯密，1972）"), c(14, "translation", "zh", ["Smith"], ["1972"], "（Smith，1972）"),
        c(15, "original", "en", ["Smith"], ["1999"], "（Smith，1999）"), c(16, "original", "en", ["史密斯"], ["1999"], "（史密斯，1999）"),
        c(17, "mixed", "mixed", ["张三", "Smith"], ["1990", "1999"], "（张三，1990；Smith，1999）"), c(18, "mixed", "mixed", ["张三", "史密斯"], ["1990", "1999"], "（张三，1990；史密斯，1999）"),
        c(19, "narrative", "en", ["Smith", "Jones"], ["2001"], "Smith & Jones (2001)"), c(20, "narrative", "en", ["Smith", "Jones"], ["2001"], "Smith and Jones (2001)"),
        c(21, "narrative", "en", ["Wang"], ["2013"], "Wang et al. (2013)"), c(22, "narrative", "en", ["Wang", "Li", "Xu"], ["2013"], "Wang, Li & Xu (2013)"),
        c(23, "narrative", "zh", ["张三", "李四"], ["2020"], "张三和李四（2020）"), c(24, "narrative", "zh", ["张三", "李四"], ["2020"], "张三、李四（2020）"),
        c(25, "narrative", "zh", ["张三"], ["2020"], "张三等（2020）"), c(26, "narrative", "zh", ["张三", "李四", "王五"], ["2020"], "张三、李四、王五（2020）"),
        c(27, "narrative", "zh", ["张三"], ["1990"], "张三（1990）", "footnote"), c(28, "parenthetical", "zh", [], ["1990"], "（1990）", "footnote"),
        c(30, "narrative", "zh", ["张三"], ["2020"], "张三等（2020）", doc=3), c(31, "self", "zh", ["王五"], ["2001"], "（王五，2001）"), c(32, "translation", "zh", ["斯密"], ["1973"], "（斯密，1973）"),
        c(33, "mixed", "mixed", ["张三", "Smith"], ["1990", "1972"], "（张三，1990；Smith，1972）"), c(34, "narrative", "zh", ["张三"], ["2020"], "张三（2020）", doc=3), c(35, "self", "zh", ["王五"], ["2001"], "（王五，2001）", doc=3),
    ]


def references() -> list[tuple]:
    """(doc_id, ref_no, lang, is_translation, authors, year, suffix, title, kind, container, volume, pages, raw)"""
    z = lambda no, authors, year, title, raw, suffix=None, translation=False, doc=1: (doc, no, "zh", translation, authors, year, suffix, title, "article", "经济学刊", "1", "1—9", raw)
    f = lambda no, authors, year, title, kind, container, raw, doc=1: (doc, no, "en", False, authors, year, None, title, kind, container, "2", "3—8", raw)
    return [
        z(1, [("安", "一")], 1999, "论甲", "安一，1999，论甲，经济学刊，1，1—9"),
        z(2, [("张", "三")], 1990, "论乙", "张三，1990，论乙，经济学刊，1，1—9", "a"),
        z(3, [("张", "三")], 1990, "论丙", "张三，1990，论丙，经济学刊，1，1—9", "c"),
        z(4, [("李", "四")], 2001, "论丁", "李四，论丁，2001，经济学刊，1，1—9"),
        z(5, [("斯密", "")], 1972, "国富论", "斯密，1972，国富论，经济学刊，1，1—9", translation=True),
        z(6, [("Smith", "A.")], 1972, "国富论", "Smith，1972，国富论，经济学刊，1，1—9", translation=True),
        f(7, [("Smith", "J.")], 1999, "Growth and Trade", "article", "Econ Rev", 'Smith, J., 1999, "Growth and Trade", <i>Econ Rev</i>, 2, 3—8'),
        f(8, [("jones", "K")], 2001, "growth and trade", "book", "Some Press", 'jones K, 2001, "growth and trade", <i>Some Press</i>, 2, 3—8'),
        z(9, [("王", "五")], 2020, "论戊", "王五，2020，论戊，经济学刊，1，1—9"),
        f(10, [("Wang", "B."), ("Li", "C."), ("Xu", "D.")], 2013, "Of Trees", "article", "Econ Rev", 'Wang, B., C. Li and D. Xu, 2013, "Of Trees", <i>Econ Rev</i>, 2, 3—8'),
        z(11, [("张", "三等")], 2020, "论己", "张三等，2020，论己，经济学刊，1，1—9"),
        z(12, [("张", "三"), ("李", "四"), ("王", "五")], 2020, "论壬", "张三、李四、王五，2020，论壬，经济学刊，1，1—9", doc=3),
        z(1, [("单", "一")], 2000, "论庚", "单一，2000，论庚，经济学刊，1，1—9", doc=2),
        z(2, [("丁", "二")], 2000, "论辛", "丁二，2000，论辛，经济学刊，1，1—9", doc=2),
    ]


def manuscript(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Elements, citations and references as DataFrames."""
    return spark.createDataFrame(elements(), ELEMENTS_DDL), spark.createDataFrame(citations(), CITATIONS_DDL), spark.createDataFrame(references(), REFS_DDL)


#: A paper as Word paragraphs: (part, style, (text, italic) runs, the role it has).
WORD_PARAGRAPHS = (
    ("body", "Title", (("贸易与增长*", False),), "title"),
    ("body", None, (("李四", False),), "author_name"),
    ("body", None, (("内容提要：本文研究贸易 <1978-2018>。", False),), "abstract"),
    ("body", "Heading1", (("一、引言", False),), "heading_level_1"),
    ("body", None, (("张三（1990）指出这一点，后来王五等（2020）也有讨论（Smith & Jones，1999；李四，2001）。Wang et al. (2013) 不同意（赵六，2005）。", False),), "body"),
    ("body", "Heading2", (("（一）背景", False),), "heading_numbering"),
    ("body", None, (("电子邮", False), ("箱：a@b", True)), "contact_label"),
    ("body", None, (("其中，x是价格", False),), "equation_where_paragraph"),
    ("body", None, (("图1 走势", False),), "figure_caption"),
    ("body", None, (("注：数据来自年鉴", False),), "table_note"),
    ("table", None, (("12", False),), "table_text"),
    ("body", None, (), "empty"),
    ("body", None, (("参考文献", False),), "body"),
    ("body", None, (("张三，1990，论乙，经济学刊，1，1", False), ("-9", False)), "reference_entry"),
    ("body", None, (("王五、赵一、钱二，2020，论戊，经济学刊，2，3—8", False),), "reference_entry"),
    ("body", None, (('Smith, J., 1999, "Growth and Trade", ', False), ("Econ Rev", True), (", 2, 3-8", False)), "reference_entry"),
    ("body", None, (('Wang, B.; Li, C.; Xu, D., 2013, "of Trees", Econ Rev, 2, 3—8', False),), "reference_entry"),
    ("footnote", None, (("* 作者信息", False),), "author_information_footnote"),
    ("footnote", None, (("正文注一", False),), "ordinary_footnote_text"),
)
#: What is found in it: (form, authors, years, language).
WORD_CITATIONS = (("narrative", "张三", "1990", "zh"), ("narrative", "王五", "2020", "zh"), ("self", "Smith|Jones|李四", "1999|2001", "mixed"), ("narrative", "Wang", "2013", "en"), ("parenthetical", "赵六", "2005", "zh"))
#: (number, language, surnames, year, title, pages)
WORD_REFERENCES = ((1, "zh", "张", 1990, "论乙", "1-9"), (2, "zh", "王|赵|钱", 2020, "论戊", "3—8"), (3, "en", "Smith", 1999, "Growth and Trade", "3-8"), (4, "en", "Wang|Li|Xu", 2013, "of Trees", "3—8"))
#: (role, text) of what becomes a row beside its paragraph.
WORD_PARTS = (
    ("title_author_info_marker", "贸易与增长*"), ("ordinary_footnote_numbering", "正文注一"), ("reference_page_range", "1-9"), ("reference_page_range", "3—8"), ("reference_page_range", "3-8"), ("reference_page_range", "3—8"),
    ("english_reference_title", "Growth and Trade"), ("english_reference_title", "of Trees"), ("english_reference_authors", "Smith, J."), ("english_reference_authors", "Wang, B.; Li, C.; Xu, D."),
    ("english_reference_journal_name", "Econ Rev"), ("english_reference_journal_name", "Econ Rev"),
)


def word_file() -> bytes:
    """The paper as a Word file."""
    names = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'

    def paragraph(style: str | None, runs: tuple) -> str:
        props = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f"<w:p>{props}{''.join(f'<w:r><w:rPr>{"<w:i/>" * i}</w:rPr><w:t>{escape(t)}</w:t></w:r>' for t, i in runs)}</w:p>"

    body = "".join(f"<w:tbl><w:tr><w:tc>{paragraph(s, r)}</w:tc></w:tr></w:tbl>" if part == "table" else paragraph(s, r) for part, s, r, _ in WORD_PARAGRAPHS if part != "footnote")
    notes = "".join(f"<w:footnote>{paragraph(s, r)}</w:footnote>" for part, s, r, _ in WORD_PARAGRAPHS if part == "footnote")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {names}><w:body>{body}</w:body></w:document>")
        z.writestr("word/footnotes.xml", f"<w:footnotes {names}>{notes}</w:footnotes>")
    return out.getvalue()


#: A small catalogue as YAML texts, with values that YAML reads as dates, numbers and truths.
YAML_FILES = (
    ("manuscript.yaml", "version: 1\nrules:\n- {id: 2020-01-01, target: yes, domain: manuscript, normativity: mandatory, autofix: never, source: {source_id: S, locator: p. 3, evidence: in these words}, lint: {severity: error}, requirement: {a: 1}}\n- {id: 7, target: t}\n- {}\n"),
    ("citations.yaml", "version: 1\n"),
    ("references.yaml", "rules:\n- {id: '7', target: u, source: {source_id: T}}\n- {id: 7.0, target: v}\n"),
)
