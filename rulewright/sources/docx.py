"""Word files as elements.

``read_docx`` lists the parts of a document read-only: body paragraphs, table
cells, foot- and endnotes, with alignment, indents, runs, fonts, sizes, fields
and numbering.  Run properties fall back to those of the paragraph style, its
ancestors, and the document defaults.  ``write_docx`` writes a new file in which
the changed characters are replaced where they stand, across runs if need be;
everything else, fields and equations included, is copied byte for byte.

A file that is no readable Word file gives one element of role ``unreadable``.
"""

from __future__ import annotations

import difflib
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship
from ..operators.fix import fix
from ..operators.lint import ELEMENTS_DDL
from ..operators.structure import in_context, with_parts

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
_PARTS = {"word/document.xml": "body", "word/footnotes.xml": "footnote", "word/endnotes.xml": "endnote"}
_RUN_FIELDS = ("east_asia_font", "ascii_font", "hansi_font", "size_pt", "italic")


def _value(node, name: str, attribute: str = "val"):
    found = node.find(f"{_W}{name}") if node is not None else None
    return None if found is None else found.get(f"{_W}{attribute}", "1" if attribute == "val" else None)


def _run_properties(node) -> dict:
    if node is None:
        return {}
    fonts = node.find(f"{_W}rFonts")
    out = {k: fonts.get(f"{_W}{a}") for k, a in (("east_asia_font", "eastAsia"), ("ascii_font", "ascii"), ("hansi_font", "hAnsi"))} if fonts is not None else {}
    size, italic = _value(node, "sz"), _value(node, "i")
    out |= {"size_pt": int(size) / 2 if size and size.isdigit() else None, "italic": None if italic is None else italic not in ("0", "false", "off")}
    return {k: v for k, v in out.items() if v is not None}


def _styles(archive: zipfile.ZipFile) -> tuple[dict, dict]:
    """Defaults, and style id -> (properties with those of its ancestors, alignment)."""
    if "word/styles.xml" not in archive.namelist():
        return {}, {}
    root = ElementTree.fromstring(archive.read("word/styles.xml"))
    defaults = _run_properties(root.find(f"{_W}docDefaults/{_W}rPrDefault/{_W}rPr"))
    raw = {s.get(f"{_W}styleId"): s for s in root.iter(f"{_W}style")}

    def resolve(style_id: str | None, depth: int = 0) -> dict:
        if style_id not in raw or depth > 20:
            return {}
        style = raw[style_id]
        own = _run_properties(style.find(f"{_W}rPr"))
        alignment = _value(style.find(f"{_W}pPr"), "jc")
        return resolve(_value(style, "basedOn"), depth + 1) | own | ({"alignment": alignment} if alignment else {})

    return defaults, {s: resolve(s) for s in raw}


def color_mode(image: bytes) -> str | None:
    """What an image file can hold by its header: `black_and_white` for one channel of grey, else `color`; null if unknown."""
    if image[:8] == b"\x89PNG\r\n\x1a\n" and len(image) > 25:
        return "black_and_white" if image[25] in (0, 4) else "color"
    at = 2
    while image[:2] == b"\xff\xd8" and at + 9 < len(image) and image[at] == 0xFF:
        kind, size = image[at + 1], int.from_bytes(image[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # the frame's header names its components
            return "black_and_white" if image[at + 9] == 1 else "color"
        at += 2 + size
    return None


def _images(archive: zipfile.ZipFile) -> dict[str, str | None]:
    """relation id -> colour mode of the image it names."""
    if "word/_rels/document.xml.rels" not in archive.namelist():
        return {}
    listed = ElementTree.fromstring(archive.read("word/_rels/document.xml.rels"))
    files = {r.get("Id"): f"word/{r.get('Target')}" for r in listed if str(r.get("Type")).endswith("/image")}
    return {k: color_mode(archive.read(f)) for k, f in files.items() if f in archive.namelist()}


def _paragraph(node, defaults: dict, styles: dict, numbering: str | None, images: dict[str, str | None]) -> dict:
    props = node.find(f"{_W}pPr")
    style_id = _value(props, "pStyle")
    style = styles.get(style_id, {})
    runs, text, field_kind = [], "", None
    for run in node.iter(f"{_W}r"):
        mark = run.find(f"{_W}fldChar")
        if mark is not None:
            field_kind = None if mark.get(f"{_W}fldCharType") == "end" else field_kind or "field"
        code = run.find(f"{_W}instrText")
        if code is not None and code.text:
            field_kind = code.text.split()[0] if code.text.split() else "field"
        piece = "".join("\t" if t.tag == f"{_W}tab" else t.text or "" for t in run if t.tag in (f"{_W}t", f"{_W}tab"))
        if piece:
            own = defaults | style | _run_properties(run.find(f"{_W}rPr"))
            runs.append({"text": piece} | {k: own.get(k) for k in _RUN_FIELDS} | {"field_kind": field_kind})
            text += piece
    indent = props.find(f"{_W}ind") if props is not None else None
    chars = indent.get(f"{_W}firstLineChars") if indent is not None else None
    wide = len(text) - len(text.lstrip("　"))
    lead = int(chars) // 100 if chars and chars.lstrip("-").isdigit() else wide or (len(text) - len(text.lstrip(" "))) // 2
    para = {"alignment": _value(props, "jc") or style.get("alignment"), "lead_spaces": lead, "num_restart": numbering, "numbered": props is not None and props.find(f"{_W}numPr") is not None, "style_id": style_id}
    obj = None
    if any(True for _ in node.iter(f"{_M}oMath")):
        obj = {"kind": "equation", "editor": "Word Equation", "color_mode": None}
    elif any(True for _ in node.iter(f"{_W}object")):
        blob = ElementTree.tostring(node, encoding="unicode")
        obj = {"kind": "object", "editor": "MathType" if "Equation.DSMT" in blob or "MathType" in blob else None, "color_mode": None}
    elif any(True for _ in node.iter(f"{_W}drawing")):
        modes = {images.get(v) for x in node.iter() for k, v in x.attrib.items() if k.endswith("}embed")}
        obj = {"kind": "figure", "editor": None, "color_mode": modes.pop() if len(modes) == 1 else "color" if "color" in modes else None}
    return {"text": text, "para": para, "runs": runs, "obj": obj}


def elements_of(content: bytes, doc_id: int) -> list[dict]:
    """The elements of one file: paragraphs in document order, whose ``role`` is left to the classifier, then the
    hyperlinks, bookmarks and sections, whose ``parent_seq`` is the paragraph they stand in."""
    blank = {"doc_id": doc_id, "confidence": None, "page_no": None, "parent_seq": None}
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        (defaults, styles), images = _styles(archive), _images(archive)
        roots = {part: ElementTree.fromstring(archive.read(name)) for name, part in _PARTS.items() if name in archive.namelist()}
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, EOFError):
        return [blank | {"part": "file", "seq": 0, "role": "unreadable", "text": None, "para": None, "runs": [], "obj": None}]
    out: list[dict] = []
    marks: list[dict] = []
    for part, root in roots.items():
        restart = next((n.get(f"{_W}val") for n in roots["body"].iter(f"{_W}numRestart")), None) if "body" in roots else None
        restart = {"eachPage": "each_page", "eachSect": "each_section"}.get(restart, restart) if part == "footnote" else None
        in_table = {p: k for k, t in enumerate(root.iter(f"{_W}tbl"), 1) for p in t.iter(f"{_W}p")}
        first_of: dict[int, int] = {}
        for node in root.iter(f"{_W}p"):
            seq = len(out)
            table = in_table.get(node)
            parent = first_of.setdefault(table, seq) if table else None
            out.append(blank | {"part": "table" if table else part, "seq": seq, "role": None, "parent_seq": parent} | _paragraph(node, defaults, styles, restart, images))
            marks += [blank | {"part": kind, "role": kind, "text": text, "parent_seq": seq, "para": None, "runs": [], "obj": None} for kind, text in _marks(node)]
        marks += [blank | {"part": "section", "role": "section", "text": None, "parent_seq": None, "para": None, "runs": [], "obj": None} for _ in root.findall(f"{_W}body/{_W}sectPr")]
    return out + [m | {"seq": len(out) + k} for k, m in enumerate(marks)]


def _marks(node) -> Iterator[tuple[str, str | None]]:
    """(kind, text) of what a paragraph holds besides its text: hyperlinks, bookmarks, the end of a section."""
    for link in node.iter(f"{_W}hyperlink"):
        yield "hyperlink", "".join(t.text or "" for t in link.iter(f"{_W}t"))
    for mark in node.iter(f"{_W}bookmarkStart"):
        yield "bookmark", mark.get(f"{_W}name")
    for _ in node.iter(f"{_W}sectPr"):
        yield "section", None


def parsed(files: DataFrame) -> DataFrame:
    """The elements of files (doc_id, content)."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc_id, content in zip(frame["doc_id"], frame["content"], strict=True):
                yield pd.DataFrame(elements_of(content, doc_id), columns=[c.split()[0] for c in re.split(r", (?=\w+ )", ELEMENTS_DDL)])

    ship(files.sparkSession)
    return files.select("doc_id", "content").mapInPandas(parse, ELEMENTS_DDL)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Elements of all files below a path; ``doc_id`` is a hash of the file's path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return parsed(files.select(F.xxhash64("path").alias("doc_id"), "content"))


#: (role, confidence, condition); the first that holds is taken.  Style names are the surest sign, wording comes next.
def _role_rules() -> list[tuple[str, float, Column]]:
    style, text, part = F.lower(F.coalesce("para.style_id", F.lit(""))), F.trim(F.coalesce("text", F.lit(""))), F.col("part")
    return [
        *[(kind, 1.0, F.coalesce(F.col("role") == kind, F.lit(False))) for kind in ("unreadable", "hyperlink", "bookmark", "section")],
        ("ordinary_footnote_text", 0.95, part.isin("footnote", "endnote") & ~text.startswith("*")),
        ("author_information_footnote", 0.9, part.isin("footnote", "endnote")),
        ("table_text", 0.95, part == "table"),
        ("equation", 0.95, F.coalesce(F.col("obj.kind") == "equation", F.lit(False))),
        ("figure", 0.9, F.coalesce(F.col("obj.kind") == "figure", F.lit(False))),
        ("title", 0.95, style.isin("title", "标题")),
        ("heading_level_1", 0.95, style.isin("heading1", "1")),
        ("heading_numbering", 0.95, style.rlike("^(heading)?[2-4]$")),
        ("abstract", 0.9, text.rlike("^(内容提要|摘要)[:：]?")),
        ("contact_label", 0.9, text.rlike("电子(信箱|邮箱)[:：]")),
        ("table_note", 0.85, text.rlike("^(注|资料来源)[:：]")),
        ("figure_caption", 0.85, text.rlike("^图 ?[0-9]+")),
        ("equation_where_paragraph", 0.85, text.startswith("其中")),
        ("body", 0.5, F.length(text) > 0),
    ]


def classify(elements: DataFrame) -> DataFrame:
    """Roles and confidence by style and wording (ours; there are no labelled data to learn from)."""
    role, sure = F.lit("empty"), F.lit(1.0)
    for name, confidence, holds in reversed(_role_rules()):
        role = F.when(holds, F.lit(name)).otherwise(role)
        sure = F.when(holds, F.lit(confidence)).otherwise(sure)
    return elements.withColumns({"role": role, "confidence": sure})


@dataclass
class _Place:
    """Where a paragraph stands in the bytes of its part: its text nodes, its end (none if it is empty), and the prefix of its tags."""

    prefix: bytes
    texts: list[tuple[int, int, str]] = field(default_factory=list)
    end: int | None = None


def _places(data: bytes) -> list[_Place]:
    """The paragraphs of a part in document order."""
    word = _W.strip("{}")
    paragraphs: list[_Place] = []
    within: list[_Place] = []
    node: dict = {}
    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True

    def begin(name: str, _: dict) -> None:
        at = parser.CurrentByteIndex
        if name == f"{word}}}p":
            tag = re.match(rb"<([^\s/>]*)p[\s/>]", data[at : at + 80])
            within.append(_Place(tag[1] if tag else b""))
            paragraphs.append(within[-1])
        elif name == f"{word}}}t":
            node.update(at=data.index(b">", at) + 1, text="")

    def characters(text: str) -> None:
        if node:
            node["text"] += text

    def end(name: str) -> None:
        at = parser.CurrentByteIndex
        if name == f"{word}}}p":
            place = within.pop()
            place.end = at if data[at : at + 2] == b"</" else None
        elif name == f"{word}}}t":
            if node["text"]:
                for place in within:
                    place.texts.append((node["at"], at, node["text"]))
            node.clear()

    parser.StartElementHandler, parser.CharacterDataHandler, parser.EndElementHandler = begin, characters, end
    parser.Parse(data, True)
    return paragraphs


def _escaped(text: str) -> bytes:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").encode("utf-8")


def _rewritten(content: bytes, edit: Callable[[int, _Place], dict[tuple[int, int], bytes]]) -> bytes:
    """A copy of a file in which ``edit`` of (seq, paragraph) says what comes in the place of which bytes."""
    source, target = zipfile.ZipFile(io.BytesIO(content)), io.BytesIO()
    seq, edited = 0, {}
    for name in (n for n in _PARTS if n in source.namelist()):
        data = source.read(name)
        put: dict[tuple[int, int], bytes] = {}
        for place in _places(data):
            put |= edit(seq, place)
            seq += 1
        for (a, b), now in sorted(put.items(), reverse=True):
            data = data[:a] + now + data[b:]
        edited[name] = data
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for item in source.infolist():
            out.writestr(item, edited[item.filename] if item.filename in edited else source.read(item.filename))
    return target.getvalue()


def _edited(texts: list[str], old: str, new: str) -> list[str]:
    """The text nodes of a paragraph after its last ``old`` has become ``new``; only differing characters move."""
    at = "".join(texts).rfind(old)
    if at < 0:
        return texts
    for kind, i, j, k, m in reversed(difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes()):
        if kind == "equal":
            continue
        begin, end, put, out = at + i, at + j, new[k:m], []
        first = 0
        for text in texts:
            a, b = max(0, min(len(text), begin - first)), max(0, min(len(text), end - first))
            here = first <= begin < first + len(text) or (begin == first + len(text) and text is texts[-1])
            out.append(text[:a] + put + text[b:] if here else text[:a] + text[b:])
            put = "" if here else put
            first += len(text)
        texts = out
    return texts


def write_docx(content: bytes, changes: dict[int, list[tuple[str, str]]]) -> bytes:
    """A new file in which (old, new) words of paragraphs, named by ``seq``, are exchanged; all other bytes of all parts stay."""

    def edit(seq: int, place: _Place) -> dict[tuple[int, int], bytes]:
        was = now = [t for _, _, t in place.texts]
        for old, new in changes.get(seq, []):
            now = _edited(now, old, new)
        return {(a, b): _escaped(n) for (a, b, _), w, n in zip(place.texts, was, now, strict=True) if n != w}

    return _rewritten(content, edit)


def mark_docx(content: bytes, notes: dict[int, list[str]]) -> bytes:
    """A new file in which each note stands in red at the end of its paragraph; all other bytes stay."""

    def edit(seq: int, place: _Place) -> dict[tuple[int, int], bytes]:
        if seq not in notes or place.end is None:
            return {}
        w = place.prefix
        text = _escaped(" " + " ".join(f"[{n}]" for n in notes[seq]))
        run = b"<%br><%brPr><%bcolor %bval=\"FF0000\"/></%brPr><%bt xml:space=\"preserve\">%b</%bt></%br>" % (w, w, w, w or b"w:", w, w, text, w, w)
        return {(place.end, place.end): run}

    return _rewritten(content, edit)


def marked_files(spark: SparkSession, path: str, verdicts: DataFrame) -> DataFrame:
    """(path, content): all Word files below a path, with what ``verdicts`` holds against a paragraph written behind it.

    ``verdicts`` (doc_id, seq, rule_id, status) are of elements; findings on the
    list of references and on citations have numbers of their own and stay in the reports.
    """
    ship(spark)
    bad = verdicts.where("seq is not null and status in ('ERROR', 'WARNING', 'MANUAL_REVIEW') and rule_id like 'ER-MS%'")
    notes = bad.groupBy("doc_id", "seq").agg(F.sort_array(F.collect_set(F.concat_ws(" ", "status", "rule_id"))).alias("notes")).groupBy("doc_id").agg(F.collect_list(F.struct("seq", "notes")).alias("all"))

    @F.pandas_udf("binary")
    def marked(content: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([mark_docx(c, {int(x["seq"]): list(x["notes"]) for x in f}) if len(f) else c for c, f in zip(content, found, strict=True)])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select(F.xxhash64("path").alias("doc_id"), "path", "content")
    none = F.expr("cast(array() as array<struct<seq:int,notes:array<string>>>)")
    return files.join(notes, "doc_id", "left").select("path", marked("content", F.coalesce("all", none)).alias("content"))


def fixed_files(spark: SparkSession, path: str, rules: dict[str, dict]) -> DataFrame:
    """(path, content, changed): all Word files below a path with the fixes of texts applied.

    Nothing is written: the caller stores ``content`` under a new name.  Fixes of
    layout stay in the elements; a text that holds a tab is left to a person.
    """
    elements = with_parts(in_context(classify(read_docx(spark, path)))).withColumn("_was", F.col("text"))
    fixed = fix(elements, rules).where("_was <> text")
    changes = fixed.groupBy("doc_id").agg(F.collect_set(F.struct("seq", "_was", "text")).alias("changes"))

    @F.pandas_udf("binary")
    def rewritten(content: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for data, rows in zip(content, found, strict=True):
            by_seq: dict[int, list[tuple[str, str]]] = {}
            for x in sorted(rows, key=lambda x: (x["seq"], x["_was"])) if rows is not None else []:
                by_seq.setdefault(int(x["seq"]), []).append((x["_was"], x["text"]))
            out.append(write_docx(data, by_seq) if by_seq else data)
        return pd.Series(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select(F.xxhash64("path").alias("doc_id"), "path", "content")
    joined = files.join(changes, "doc_id", "left")
    return joined.select("path", rewritten("content", F.coalesce("changes", F.expr("cast(array() as array<struct<seq:int,_was:string,text:string>>)"))).alias("content"), F.col("changes").isNotNull().alias("changed"))
