import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from rulewright.functions.folds import CHUNK
from rulewright.operators import bitmaps, decoding
from rulewright.operators.lint import compiled
from rulewright.operators.rulebits import RuleBits
from rulewright.sources import catalogue

LINES = ["A title here", "Smith, J.", "Abstract: of it", "1. Intro", "A long body sentence. " * 12, "mail me@x.org", "Note: x", 'Smith, J., 1999, "On x", J, 1, 3-9.', "short", "Licensed under X.", "## head", "  ", "电子邮箱：a"]


def bits(line):
    shown = [decoding.SIGN_BITS[s] for s, p in decoding.SIGNS.items() if re.search(p, line)]
    return [sum(x) for x in zip(*shown, strict=True)] if shown else [0] * len(decoding.ROLES)


def every_labelling(lines):
    """Roles and confidences by going through all labellings."""
    own = [bits(x) for x in lines]
    best, total, share = None, 0.0, [[0.0] * len(decoding.ROLES) for _ in lines]
    for labels in itertools.product(range(len(decoding.ROLES)), repeat=len(lines)):
        weight = decoding.FIRST_BITS[labels[0]] + sum(decoding.NEXT_BITS[a][b] for a, b in zip(labels, labels[1:])) + sum(b[k] for b, k in zip(own, labels, strict=True))
        best = min(best or (1e9,), (-weight, labels[::-1]))
        total += 2.0**weight
        for t, k in enumerate(labels):
            share[t][k] += 2.0**weight
    return [(decoding.ROLES[k], share[t][k] / total) for t, k in enumerate(best[1][::-1])]


def recursion(lines):
    """Roles by plain Viterbi, for texts that are too long to go through all labellings."""
    n, back = range(len(decoding.ROLES)), []
    weights = [a + b for a, b in zip(decoding.FIRST_BITS, bits(lines[0]), strict=True)]
    for line in lines[1:]:
        reach = [max((weights[i] + decoding.NEXT_BITS[i][j], -i) for i in n) for j in n]
        back.append([-r[1] for r in reach])
        weights = [r[0] + b for r, b in zip(reach, bits(line), strict=True)]
    at = max(n, key=lambda i: (weights[i], -i))
    path = [at]
    for pointers in reversed(back):
        at = pointers[at]
        path.append(at)
    return [decoding.ROLES[k] for k in reversed(path)]


def by_document(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (str(r.doc_id), r.seq)):
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_roles_are_the_best_labelling(spark):
    rng = random.Random(4)
    docs = [(k, "\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 5)))) for k in range(40)] + [(100, None), (101, ""), (102, "\n \n"), (None, "short\n\nA title here")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'r' as role", "1 as seq", "0 as lines", "2 as bits", "3 as labels")
    got = by_document(decoding.decode(frame))
    for doc_id, text in docs:
        lines = [(k, x.strip()) for k, x in enumerate((text or "").split("\n")) if x.strip()]
        found = got.get(doc_id, [])
        assert [(r.seq, r.text) for r in found] == lines
        if lines:
            want = every_labelling([x for _, x in lines])
            assert [r.role for r in found] == [w[0] for w in want]
            assert [r.confidence for r in found] == pytest.approx([w[1] for w in want], abs=1e-12)
    assert decoding.decode(frame.limit(0)).count() == 0
    empty = decoding.decode(frame, keep_empty=True).where("role is null")
    assert {r.doc_id for r in empty.collect()} == {k for k, t in docs if not (t or "").strip()}


def test_long_documents_are_decoded_in_chunks(spark):
    rng = random.Random(9)
    texts = {n: [rng.choice([x.strip() for x in LINES if x.strip()]) for _ in range(n)] for n in (1, 2, CHUNK, CHUNK + 1, CHUNK + 2, 3000)}
    got = by_document(decoding.decode(spark.createDataFrame([(n, "\n".join(t)) for n, t in texts.items()], "doc_id long, text string")))
    for n, lines in texts.items():
        assert [r.role for r in got[n]] == recursion(lines)
        assert all(0 < r.confidence <= 1 for r in got[n])


def test_decoding_runs_no_python_and_no_exchange(spark):
    frame = decoding.decode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), keep_empty=True)
    plan = lambda f: f._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan(frame))
    found, _ = bitmaps.document_bitmaps(bitmaps.wording_parts(frame), compiled(catalogue.shipped(spark)), bitmaps.WORDING)
    moved = re.findall(r"Exchange hashpartitioning", plan(found))
    assert len(moved) == 1 and not re.search("Python|Arrow|Join", plan(found))
    columns = re.search(r"HashAggregate\(keys=\[doc_id[^\]]*\], functions=\[([^\n]*)\]\)", plan(found)).group(1)
    assert "text" not in columns and "bit_or" in columns


def test_rule_bits():
    ids = [f"R-{k:03d}" for k in range(130)]
    bits_of = RuleBits(reversed(ids))
    assert bits_of.words == 3 and bits_of.ids == tuple(ids) and bits_of.at["R-065"] == 65
    assert bits_of.value(["R-000", "R-002"]) == 5 and bits_of.value(["R-063"]) == -(2**63) and bits_of.value(["R-064"]) == 0 and bits_of.value(["R-064"], 1) == 1
    assert bits_of.all() == -1 and bits_of.all(2) == 3 and RuleBits([]).words == 1


def test_bitmaps_of_elements(spark):
    rules = {f"X-{k:03d}": {"target": "none", "need": {}} for k in range(70)} | {
        "ER-MS-AUTHORINFO-002": {"target": "contact_label", "need": {"disallowed_term": "电子邮箱"}},
        "ER-REF-FOREIGN-LINE-001": {"target": "foreign_reference_entry_layout", "need": {}},
    }
    rows = [(1, "contact_label", "电子邮箱：a"), (1, "contact_label", "电子信箱：a"), (1, "body", "电子邮箱：a"), (2, "foreign_reference_entry_layout", "Smith, J."), (3, None, None), (None, "contact_label", "x")]
    elements = spark.createDataFrame(rows, "doc_id long, role string, text string")
    found, of = bitmaps.document_bitmaps(elements, rules)
    got = {r.doc_id: r for r in found.select("doc_id", "n_elements", of.names(F.col("broken")).alias("broken"), of.names(F.col("kept")).alias("kept"), F.size(of.names(F.col("unmet"))).alias("unmet")).collect()}
    contact, line = "ER-MS-AUTHORINFO-002", "ER-REF-FOREIGN-LINE-001"
    assert (got[1].n_elements, got[1].broken, got[1].kept, got[1].unmet) == (3, [contact], [contact], 71)
    assert (got[2].broken, got[2].kept, got[2].unmet) == ([], [line], 71)
    assert (got[3].broken, got[3].kept, got[3].unmet) == ([], [], 72) and got[None].kept == [contact]
    counts = {r.rule_id: tuple(r)[1:] for r in bitmaps.rule_coverage(found, of).collect()}
    assert counts[contact] == (1, 2, 2) and counts[line] == (0, 1, 3) and counts["X-000"] == (0, 0, 4) and len(counts) == 72
    states = {(r.doc_id, r.rule_id): r.state for r in bitmaps.verdict_of(found, of).collect()}
    assert states[1, contact] == "BROKEN" and states[2, line] == "PASS" and states[3, line] == "NOT_CHECKED" and len(states) == 4 * 72
    halves = [bitmaps.document_bitmaps(elements.where(c), rules)[0] for c in ("text like '%信箱%' or role = 'body'", "not (text like '%信箱%' or role = 'body') or text is null")]
    again = bitmaps.merge_bitmaps(halves[0].unionByName(halves[1]), of)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, found.collect()))
    assert bitmaps.rule_coverage(found.limit(0), of).where("broken + kept + unmet > 0").count() == 0


def test_parts_of_references(spark):
    rows = [(1, 0, 'Smith, J., 1999, "On x", J, 1, 3-9.', "reference_entry"), (1, 1, "张三，1999，论甲，刊，1，3—9页", "reference_entry"), (1, 2, 'Smith, J., 1999, "On x", 3-9', "body")]
    got = {(r.seq, r.role): r.text for r in bitmaps.wording_parts(spark.createDataFrame(rows, "doc_id long, seq int, text string, role string")).collect()}
    assert got[0, "reference_page_range"] == "3-9" and got[0, "english_reference_title"] == "On x" and got[0, "english_reference_authors"] == "Smith, J." and (0, "foreign_reference_entry_layout") in got
    assert got[1, "reference_page_range"] == "3—9" and len([k for k in got if k[0] == 1]) == 2 and len([k for k in got if k[0] == 2]) == 1
