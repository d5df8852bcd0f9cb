import random
import re

import pytest
from pyspark.sql import functions as F

from rulewright.operators import markup

BITS = ["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<ul>", "<li>", "</ul>", "</li>", "<table>", "<tr>", "<td>", "</td>", "</table>", "<br>", "<img src='a'/>", "text", " ", "<!-- c <p> -->", "<script>x='</p>'</script>", "<", "< p", "a < b", "</>", "<!DOCTYPE html>", "<style>p{}</style>", "<SCRIPT>", "<figure>", "<figcaption>", "</figure>", "Note: n"]


def plain(html):
    """(node, last, parent, kind, depth, text) by a stack of Python's own."""
    out, stack = [], []
    parts = re.findall(markup.TOKEN.replace(r"\z", r"\Z"), html or "")

    def pop(size, last):
        while len(stack) > size:
            out[stack.pop()[1]][1] = last

    for i, t in enumerate(parts):
        tag = re.match(markup.TAG, t)
        kind = tag[1].lower() if tag else ""
        parent = lambda: stack[-1][2] if stack else None
        if kind and t.startswith("</"):
            if at := [k for k, e in enumerate(stack) if e[0] == kind]:
                pop(at[-1], i - 1)
        elif kind:
            for new, ends, bars in markup.IMPLIED:
                if kind in new:
                    a, b = (max([k for k, e in enumerate(stack) if e[0] in names], default=-1) for names in (ends, bars))
                    if a > b:
                        pop(a, i - 1)
            leaf = kind in markup.VOID or t.endswith("/>") or re.match(markup.RAW, t)
            out.append([i, i, parent(), kind, len(stack), None])
            if not leaf:
                stack.append((kind, len(out) - 1, i))
        elif not re.match("<[!?]", t) and re.search(r"[^\x09-\x0D\x20]", t):
            out.append([i, i, parent(), markup.TEXT, len(stack), t])
    pop(0, len(parts) - 1)
    return sorted(map(tuple, out))


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(1)
    made = [(k, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 60)))) for k in range(150)]
    return [*made, (1000, None), (1001, ""), (1002, " \n"), (1003, "".join(rng.choice(BITS[:20]) for _ in range(3000))), (1004, "<p><b>a<br><p>b</b><li>c<li>d")]


@pytest.fixture(scope="module")
def nodes(spark, pages):
    return markup.page_nodes(spark.createDataFrame(pages, "page_id long, html string").selectExpr("*", "0 as node", "'k' as kind")).cache()


def test_nodes_are_those_of_a_plain_parser(spark, pages, nodes):
    got = {}
    for r in nodes.collect():
        got.setdefault(r.page_id, []).append(tuple(r)[1:])
    for page, html in pages:
        assert sorted(got.get(page, [])) == plain(html)
    plan = markup.page_nodes(spark.createDataFrame(pages[:1], "page_id long, html string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "Filter (size" not in plan


def test_containment_is_that_of_all_pairs(pages, nodes):
    inner, outer = nodes.where("kind = '#text'"), nodes.where("kind in ('div', 'p', 'table')")
    got = markup.containment(inner, outer).collect()
    want, innermost = set(), {}
    for page, html in pages:
        found = plain(html)
        for a in found:
            if a[3] == markup.TEXT:
                around = [b for b in found if b[3] in ("div", "p", "table") and b[0] < a[0] <= b[1]]
                want |= {(page, a[0], b[0]) for b in around}
                innermost[page, a[0]] = max((b[0], b[3]) for b in around) if around else (None, None)
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert {(r.page_id, r.node): (r.around, r.region) for r in markup.nearest(nodes, F.col('kind') == '#text', F.col('kind').isin('div', 'p', 'table')).collect()} == innermost
    plan = markup.containment(inner, outer)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_blocks_cover_an_interval_once(spark):
    rng = random.Random(2)
    spans = [(a, a + rng.randint(0, 3000)) for a in (rng.randint(1, 5000) for _ in range(200))] + [(1, 1), (1, 2**29)]
    frame = spark.createDataFrame(spans, "a long, b long")
    for r in frame.select("a", "b", markup.covering_blocks(frame.a, frame.b).alias("blocks")).collect():
        assert sum(1 << x.level for x in r.blocks) == r.b - r.a + 1 and all(sum(y.level == x.level for y in r.blocks) <= 2 for x in r.blocks)
        if r.b < 10_000:
            assert sorted(p for x in r.blocks for p in range(x.block << x.level, (x.block + 1) << x.level)) == list(range(r.a, r.b + 1))


def test_notes_and_captions(spark):
    html = "<table><tr><td>1</td></tr><tr><td>Note: in it</td></tr></table><p>Note: outside</p><figure><img src='x'><figcaption>Fig. 1 <b>bold</b></figcaption></figure><figcaption>alone</figcaption>资料来源：表外<table><td><p>资料来源：表内"
    found = markup.notes_and_captions(markup.page_nodes(spark.createDataFrame([(1, html)], "page_id long, html string")))
    assert sorted((r.role, r.text) for r in found.collect()) == [("figure_caption", "Fig. 1"), ("figure_caption", "bold"), ("table_note", "Note: in it"), ("table_note", "资料来源：表内")]
