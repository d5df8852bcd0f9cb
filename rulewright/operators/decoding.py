"""Roles of lines, decoded as a sequence, with a confidence for each.

A document is its lines that show text.  Roles follow each other with weights
(a reference follows a reference, an author line a title), and a line speaks for
roles by its wording.  All weights are whole bits: a weight of k makes what it
stands for 2**k times as likely.  They are ours, there are no labelled data.

* the roles are the labelling of greatest total weight (Viterbi); of several, the one whose last
  role comes first in the list of roles, then the role before it, and so on back;
* the confidence of a line is the share of all labellings, by likelihood, in
  which it has this role (forward-backward); it feeds what policy lets a fix do.

Both are array aggregates over the lines of one row: no row is exchanged, no
Python runs.  Results are appended in chunks, so their cost does not grow with the
square of a document's lines.  Powers of two are exact and every step is scaled by its sum, so a
long document neither overflows nor vanishes.

Special cases: documents without a line that shows text, null ones too, give no
rows; rows that repeat a doc_id are decoded on their own; ``seq`` is the line's number, empty lines counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import fold, once, step

#: Targets of rules that lines of a plain text can be.
ROLES = ("title", "author_name", "abstract", "heading_level_1", "body", "contact_label", "table_note", "reference_entry")
_S = len(ROLES)

#: What a line shows: a pattern over its trimmed text, in the syntax that Java and RE2 share.
SIGNS = {
    "closed": r"[.!?。！？;；:：]$",
    "short": r"^.{1,60}$",
    "long": r"^.{161}",
    "numbered": r"^([0-9]+[.)、] |[一二三四五六七八九十]+、|#+ )",
    "abstract": r"^(内容提要|摘要|Abstract|ABSTRACT|Summary)",
    "contact": r"(@[A-Za-z0-9-]+[.][A-Za-z]|电子(信箱|邮箱)|[0-9][0-9 ()-]{7,}[0-9])",
    "note": r"^(注|资料来源|Notes?|Source|Licen[cs]ed|Released|Copyright|©)",
    "year": r"[(（, ](1[89]|20)[0-9]{2}[a-z]?[)）., ，。]",
    "initials": r"^[A-ZÀ-Þ][A-Za-zÀ-ÿ'-]+, ([A-ZÀ-Þ][.][ -]?)+",
    "pages": r"[0-9]+ ?[-–—~～] ?[0-9]+ ?页?[.。]?$",
}
#: Bits by which a sign speaks for (or against) the roles, in their order.
SIGN_BITS = {
    "closed": (-4, -4, 1, -4, 3, 0, 1, 2),
    "short": (2, 3, -3, 3, 0, 2, 2, 0),
    "long": (-6, -9, 3, -9, 3, -2, -1, 0),
    "numbered": (-1, -3, -3, 7, 0, -2, -2, 2),
    "abstract": (-4, -6, 12, -4, 0, -4, -4, -4),
    "contact": (-4, -2, -2, -4, 0, 6, 0, -3),
    "note": (-2, -4, -2, -2, 0, 0, 9, -2),
    "year": (-2, -4, 0, -2, 0, -1, 1, 4),
    "initials": (-2, 2, -4, -3, 0, -1, -2, 6),
    "pages": (-3, -5, -2, -3, 0, -1, -1, 5),
}
#: Bits of a role for the first line, and of each next role behind each role.
FIRST_BITS = (3, -6, 1, 0, 2, -2, -1, -4)
NEXT_BITS = (
    (-3, 4, 2, 1, 2, 1, -2, -6),
    (-9, 1, 3, 1, 1, 2, -1, -6),
    (-9, -6, 0, 3, 2, 0, -2, -6),
    (-9, -7, -6, -2, 4, -1, -2, -2),
    (-9, -8, -7, 0, 4, -1, -1, -3),
    (-9, -4, 0, 1, 3, 2, -1, -4),
    (-9, -7, -6, 0, 3, -1, 1, -3),
    (-9, -9, -9, -4, -4, -3, -2, 5),
)


def _ints(values: tuple[int, ...]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _powers(values: tuple[int, ...]) -> Column:
    return F.array(*[F.lit(2.0**v) for v in values])


def line_bits(line: Column) -> Column:
    """Of a trimmed line, the bits by which it speaks for each role."""
    shown = F.array(*[line.rlike(pattern) for pattern in SIGNS.values()])
    signs = F.array(*[_ints(bits) for bits in SIGN_BITS.values()])
    return once(shown, lambda seen: F.aggregate(F.filter(signs, lambda _, k: F.get(seen, k)), _ints((0,) * _S), lambda a, bits: F.zip_with(a, bits, lambda x, y: x + y)))


def best_labels(bits: Column) -> Column:
    """Role numbers of the heaviest labelling of array<array<long>>."""
    into = F.array(*[_ints(tuple(NEXT_BITS[i][j] for i in range(_S))) for j in range(_S)])

    def forward(weights: Column, own: Column) -> Column:
        best = lambda r: F.struct(F.array_max(r).alias("v"), (F.array_position(r, F.array_max(r)) - 1).cast("int").alias("k"))
        reach = F.transform(into, lambda w: once(F.zip_with(weights, w, lambda a, b: a + b), best))
        return once(reach, lambda r: step(F.zip_with(r, own, lambda x, b: x["v"] + b), F.transform(r, lambda x: x["k"])))

    def back(weights: Column, pointers: Column) -> Column:
        # pointers lead from the second, third ... line to the one before it
        last = (F.array_position(weights, F.array_max(weights)) - 1).cast("int")
        return fold(F.reverse(pointers), last, "int", "int", lambda at, p: step(F.get(p, at), at), lambda first, path: F.concat(F.array(first), F.reverse(path)))

    start = F.zip_with(_ints(FIRST_BITS), F.get(bits, F.lit(0)), lambda a, b: a + b)
    return fold(_rest(bits), start, "array<bigint>", "array<int>", forward, back)


def _rest(rows: Column) -> Column:
    return F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))


def _scaled(weights: Column) -> Column:
    return once(weights, lambda w: once(F.aggregate(w, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(w, lambda x: x / total)))


def _sums(state: Column, rows: list[Column]) -> Column:
    return F.transform(F.array(*rows), lambda w: F.aggregate(F.zip_with(state, w, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x))


def posteriors(likely: Column) -> Column:
    """Of each line, the share of each role over all labellings, from array<array<double>> of likelihoods."""
    into = [_powers(tuple(NEXT_BITS[i][j] for i in range(_S))) for j in range(_S)]
    out_of = [_powers(NEXT_BITS[i]) for i in range(_S)]
    times = lambda a, b: F.zip_with(a, b, lambda x, y: x * y)
    every = lambda last, out: F.concat(out, F.array(last))
    doubles = "array<double>"
    start = _scaled(times(_powers(FIRST_BITS), F.get(likely, F.lit(0))))
    ahead = fold(_rest(likely), start, doubles, doubles, lambda s, own: step(_scaled(times(_scaled(_sums(s, into)), own)), s), every)
    # what comes behind a line, without the line's own weight
    behind = fold(F.reverse(_rest(likely)), F.array(*[F.lit(1.0)] * _S), doubles, doubles, lambda s, own: step(once(times(s, own), lambda c: _scaled(_sums(c, out_of))), s), every)
    return F.zip_with(ahead, F.reverse(behind), lambda a, b: _scaled(times(a, b)))


def document_lines(documents: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, lines): the lines that show text, trimmed, with their numbers."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x, k: F.struct(k.alias("seq"), F.regexp_replace(x, r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", "").alias("text")))
    return documents.select("doc_id", F.filter(lines, lambda x: x["text"] != "").alias("lines"))


def decode(documents: DataFrame, text: str = "text", keep_empty: bool = False) -> DataFrame:
    """(doc_id, seq, text, role, confidence) of every line that shows text; ``keep_empty``: documents without one give a row of nulls."""
    rows = document_lines(documents, text)
    rows = (rows if keep_empty else rows.where(F.size("lines") > 0)).withColumn("bits", F.transform("lines", lambda x: line_bits(x["text"])))
    rows = rows.withColumn("likely", F.transform("bits", lambda b: F.transform(b, lambda k: F.pow(F.lit(2.0), k.cast("double")))))
    rows = rows.withColumns({"labels": best_labels(F.col("bits")), "shares": posteriors(F.col("likely"))})
    names = F.array(*[F.lit(r) for r in ROLES])
    label = lambda k: F.get("labels", k)
    found = F.transform("lines", lambda x, k: F.struct(x["seq"].alias("seq"), x["text"].alias("text"), F.get(names, label(k)).alias("role"), F.get(F.get("shares", k), label(k)).alias("confidence")))
    # outer, and empty ones dropped afterwards: else the decoder is copied into a filter on the size of its result
    out = rows.select("doc_id", F.inline_outer(found))
    return out if keep_empty else out.where("role is not null")
