"""Nested structure of marked-up pages, and joins by containment.

A page is a stream of tokens: tags, texts, comments.  A stack automaton over the
stream, one array fold of a row, gives every element and every text that shows something an
interval: from its own token to the last one inside it.  One node lies in another exactly if its
interval does.  Our automaton knows what pages need most, not all of the
standard: elements without content, raw text of scripts and styles, ends that
are left out (a paragraph ends where a block begins, an item where the next one
does, also cells and rows), end tags of nothing (ignored), and open ends at the end of the page.

``containment`` finds for nodes the nodes around them without comparing those of a page with
each other.  An interval is cut into the fewest aligned blocks of 1, 2, 4 ...
tokens, at most two of each size, and a place lies in one block of each size: both meet by
an equi-join, once for every pair, and a page of any size is dealt by its blocks.

Special cases: null and empty pages give no nodes; rows that repeat a page_id give
the nodes of each, so keys should be unique where nodes are joined; ``node`` counts all
tokens of the page from 0; parents of top nodes are null, their depth is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.folds import fold, once, step

#: Tokens, in the syntax that Java and RE2 share: comments, raw elements, tags and declarations, texts, stray brackets.
TOKEN = r"(?is)(<!--.*?(?:-->|\z)|<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)|</?[a-z][^>]*>|<[!?][^>]*>|[^<]+|<)"
TAG = r"(?is)^</?([a-z][a-z0-9:-]*)"
RAW = r"(?is)^<(script|style)\b"
# Elements that have no content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
# Elements before which an open paragraph ends.
BLOCKS = (
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "figcaption", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre",
    "section", "table", "ul",
)
#: (elements that begin, open ones that end then, ones beyond which nothing ends).
IMPLIED = (
    (BLOCKS, ("p",), ("html", "table", "td", "th", "caption", "button", "object")),
    (("li",), ("li",), ("ul", "ol")),
    (("dt", "dd"), ("dt", "dd"), ("dl",)),
    (("td", "th"), ("td", "th"), ("tr", "table")),
    (("tr",), ("tr",), ("table",)),
    (("option",), ("option",), ("select",)),
    (("body",), ("head",), ("html",)),
)
TEXT = "#text"
_NODE = "struct<node:int,parent:int,kind:string,depth:int>"
_EVENT = f"struct<made:{_NODE},ended:array<int>>"
#: Sizes of blocks are powers of two up to this one: pages of up to 2**30 tokens.
LEVELS = 30


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _by_kind(kind: Column, part: int) -> Column:
    out = F.expr("cast(array() as array<string>)")
    for row in IMPLIED:
        out = F.when(kind.isin(*row[0]), _strings(row[part])).otherwise(out)
    return out


def tokens(html: Column) -> Column:
    """array<struct<at, kind, op, text, ends, bars>>: what each token does; op is open, leaf, close, or null for what is passed over."""

    def token(t: Column, at: Column) -> Column:
        bracket = t.startswith("<")
        kind = F.when(bracket, F.lower(F.regexp_extract(t, TAG, 1))).otherwise("")
        return once(F.struct(kind.alias("kind"), bracket.alias("bracket")), lambda k: of_kind(t, at, k["kind"], k["bracket"]))

    def of_kind(t: Column, at: Column, kind: Column, bracket: Column) -> Column:
        tag, end = kind != "", bracket & t.startswith("</")
        leaf = kind.isin(*VOID) | t.endswith("/>") | (kind.isin("script", "style") & t.rlike(RAW))
        shown = F.when(bracket, ~t.rlike(r"^<[!?]")).otherwise(t.rlike(r"[^\x09-\x0D\x20]"))
        op = F.when(tag & end, "close").when(tag & leaf, "leaf").when(tag, "open").when(shown, "leaf")
        return F.struct(at.alias("at"), F.when(tag, kind).otherwise(TEXT).alias("kind"), op.alias("op"), F.when(tag, F.lit(None)).otherwise(t).alias("text"), F.when(tag & ~end, _by_kind(kind, 1)).alias("ends"), F.when(tag & ~end, _by_kind(kind, 2)).alias("bars"))

    return F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKEN), F.lit(1)), token)


def _last(stack: Column, holds) -> Column:
    """Number (from 1) of the last entry that holds, 0 if none does."""
    return F.coalesce(F.array_max(F.transform(stack, lambda e, k: F.when(holds(e), k + 1).otherwise(0))), F.lit(0))


def _automaton(stack: Column, token: Column) -> Column:
    """One step: the open elements behind the token, and what it made and ended."""
    size = F.size(stack)
    implied = once(_last(stack, lambda e: F.array_contains(token["ends"], e["kind"])), lambda n: F.when(n > _last(stack, lambda e: F.array_contains(token["bars"], e["kind"])), n - 1).otherwise(size))
    same = once(_last(stack, lambda e: e["kind"] == token["kind"]), lambda n: F.when(n > 0, n - 1).otherwise(size))
    stay = F.when(token["op"] == "close", same).when(F.size(token["ends"]) > 0, implied).otherwise(size)

    def after(k: Column) -> Column:
        left = F.slice(stack, F.lit(1), k)
        ended = F.transform(F.slice(stack, k + 1, size - k), lambda e: e["node"])
        parent = F.when(k > 0, F.get(left, k - 1)["node"])
        made = F.when(token["op"].isin("open", "leaf"), F.struct(token["at"].alias("node"), parent.alias("parent"), token["kind"].alias("kind"), k.alias("depth")))
        own = F.struct(token["at"].alias("node"), token["kind"].alias("kind"))
        ended = F.when(token["op"] == "leaf", F.concat(ended, F.array(token["at"]))).otherwise(ended)
        return step(F.when(token["op"] == "open", F.concat(left, F.array(own))).otherwise(left), F.struct(made.alias("made"), ended.alias("ended")))

    return once(stay, after)


def page_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, node, last, parent, kind, depth, text) of every element and text."""
    rows = pages.select(key, tokens(F.col(html)).alias("_tokens"))

    def intervals(stack: Column, events: Column) -> Column:
        made = F.filter(F.transform(events, lambda e: e["made"]), lambda m: m.isNotNull())
        # a node's interval ends before the token that ends it, a leaf's with its own, an open one's with the page
        ends = F.flatten(F.transform(events, lambda e, k: F.transform(e["ended"], lambda n: F.struct(n.alias("node"), F.greatest(n, k - 1).alias("last")))))
        open_ends = F.transform(stack, lambda e: F.struct(e["node"].alias("node"), (F.size(events) - 1).alias("last")))
        # each node ends once, so both lists have the same nodes in the same order
        return F.zip_with(made, F.sort_array(F.concat(ends, open_ends)), lambda m, e: F.struct(m["node"].alias("node"), e["last"].alias("last"), m["parent"].alias("parent"), m["kind"].alias("kind"), m["depth"].alias("depth")))

    stack = F.expr("cast(array() as array<struct<node:int,kind:string>>)")
    nodes = fold(F.col("_tokens"), stack, "array<struct<node:int,kind:string>>", _EVENT, _automaton, intervals)
    # a second projection, so that the tokens are there when texts are looked up
    found = rows.select(key, "_tokens", nodes.alias("_nodes")).select(key, F.transform("_nodes", lambda n: n.withField("text", F.when(n["kind"] == TEXT, F.get(F.col("_tokens"), n["node"])["text"]))).alias("_nodes"))
    # outer, and pages without nodes dropped afterwards: else the automaton is copied into a filter on the size of its result
    return found.select(key, F.inline_outer("_nodes")).where("node is not null")


def covering_blocks(low: Column, high: Column) -> Column:
    """The fewest aligned blocks (level, block) that make up the places from ``low`` to ``high``: at most two of each level."""

    def halve(acc: Column, level: Column) -> Column:
        # an odd end cannot be part of a block of twice the size
        a, b = acc["a"], acc["b"]
        open_, odd = a < b, lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 1
        block = lambda x: F.struct(level.alias("level"), x.alias("block"))
        taken = F.array_compact(F.array(F.when(open_ & odd(a), block(a)), F.when(open_ & odd(b), block(b - 1))))
        up = lambda x, more: F.when(open_, F.shiftright(F.when(odd(x), x + more).otherwise(x), 1)).otherwise(x)
        return F.struct(up(a, 1).alias("a"), up(b, -1).alias("b"), F.concat(acc["blocks"], taken).alias("blocks"))

    start = F.struct(low.cast("long").alias("a"), (high.cast("long") + 1).alias("b"), F.expr("cast(array() as array<struct<level:int,block:bigint>>)").alias("blocks"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, halve, lambda acc: acc["blocks"])


def blocks_of(place: Column) -> Column:
    """The blocks (level, block) that a place lies in, but for the first of each size: no cover of places from 1 on has those."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", place.cast("long"), k).alias("block"))), lambda b: b["block"] > 0)


def containment(inner: DataFrame, outer: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, node, around): every node of ``inner`` with each node of ``outer`` that it lies in, itself excepted."""
    places = inner.select(key, "node", F.inline_outer(blocks_of(F.col("node"))))
    spans = outer.where("last > node").select(F.col(key).alias("_key"), F.col("node").alias("around"), F.inline_outer(covering_blocks(F.col("node") + 1, F.col("last"))).alias("_level", "_block"))
    same = (F.col(key) == F.col("_key")) & (F.col("level") == F.col("_level")) & (F.col("block") == F.col("_block"))
    return places.join(spans, same).select(key, "node", "around")


def nearest(nodes: DataFrame, inner: Column, outer: Column, key: str = "page_id") -> DataFrame:
    """The nodes that ``inner`` says, with (around, region): the innermost node around them that ``outer`` says, and its kind; null where there is none.

    Of nested intervals the innermost begins last, so of the spans that share a block with a place only
    the last one counts: a window over the block finds it, and the nodes are read once.
    """
    inner, outer = F.coalesce(inner, F.lit(False)), F.coalesce(outer, F.lit(False)) & (F.col("last") > F.col("node"))
    others = [c for c in nodes.columns if c not in (key, "node")]
    at = "struct<level:int,block:bigint,span:struct<around:int,region:string>>"
    none = F.expr(f"cast(array() as array<{at}>)")
    places = F.transform(blocks_of(F.col("node")), lambda b: F.struct(b["level"], b["block"], F.lit(None).cast("struct<around:int,region:string>").alias("span")))
    own = F.struct(F.col("node").alias("around"), F.col("kind").alias("region"))
    spans = F.transform(covering_blocks(F.col("node") + 1, F.col("last")), lambda b: F.struct(b["level"], b["block"], own.alias("span")))
    rows = nodes.where(inner | outer).select(key, "node", F.struct(*others).alias("_row"), inner.alias("_inner"), F.explode_outer(F.concat(F.when(inner, places).otherwise(none), F.when(outer, spans).otherwise(none)).cast(f"array<{at}>")).alias("_at"))
    met = rows.withColumn("_in", F.max("_at.span").over(W.partitionBy(key, "_at.level", "_at.block"))).where("_inner and _at.span is null")
    found = met.groupBy(key, "node").agg(F.any_value("_row").alias("_row"), F.max("_in").alias("_in"))
    return found.select(key, "node", *[f"_row.{c}" for c in others], "_in.around", "_in.region")


def notes_and_captions(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, node, role, around, text): notes inside tables and captions of figures, by what their texts lie in."""
    text = nodes.where(F.col("kind") == TEXT)
    trimmed = F.trim(F.regexp_replace("text", r"\s+", " "))
    notes = text.where(trimmed.rlike(r"^(注|资料来源|Notes?|Source)\s*[:：]"))
    captions = nearest(nodes, F.col("kind") == TEXT, F.col("kind") == "figcaption", key).where("around is not null").select(key, "node")
    found = []
    for rows, kind, role in ((notes, "table", "table_note"), (captions, "figure", "figure_caption")):
        asked = nodes.join(rows.select(key, "node", F.lit(True).alias("_asked")), [key, "node"], "left")
        around = nearest(asked, F.col("_asked"), F.col("kind") == kind, key).where("around is not null")
        found.append(around.select(key, "node", F.lit(role).alias("role"), "around", trimmed.alias("text")))
    return found[0].unionByName(found[1])
