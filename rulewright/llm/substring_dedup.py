"""Removal of repeated passages by relative Lempel-Ziv parsing over anchored blocks.

The reference of a document is what documents with smaller ids say for the first
time: of each ``WINDOW``-word window its first occurrence, by document, then
place.  A window stands there once, so the longest factor that starts at a place
is unique: it follows one source document for as long as the next window's first
occurrence is the next place of that document.  ``factors`` parses greedily by
these longest matches; each factor is a substring of its source, and those of at
least ``WINDOW`` words are the duplicate spans.  The windows that straddle the
end of a factor belong to the next one (or to none), so spans overlap by up to
``WINDOW - 1`` words where both sides are repeated.

To find first occurrences, each window is filed under its *anchor*, the
``ANCHOR``-word run of least hash inside it (the left one of equals).  The windows
of one anchor are neighbours, so a document is a sequence of blocks, and since an
anchor depends on the window's own words alone, a window can occur elsewhere only
in a block of the same anchor.

1. ``_all_blocks`` lists anchor, content, document and place of every block.
   Contents and windows are compared by 128-bit BLAKE2b digests of their words.
2. Blocks are indexed by anchor.  Where all blocks of an anchor are equal, the
   first of them is the reference of all its windows.
3. Where they differ - at the boundaries of factors - each distinct block is
   taken apart once, by the first document that has it, its windows are looked
   up one by one, and their first occurrences go to all equal blocks as runs.
4. Each document's runs are parsed and its words cut where its text lies.

Index entries are minima, aggregated before they are joined, so a passage that
a third of all documents share is no hot spot, and no pair of documents is ever
formed.

Special cases: a null text has no words; texts shorter than a window keep all
words; equal documents are removed whole but for the first; repeats inside one
document stay; rows that repeat an id are versions of one document, each judged
on its own text; rows with a null id match nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, binary_column, map_arrow, own_id, prepare, stored, window_hashes

WINDOW = 50
ANCHOR = 25
#: A place is a word's number in its text, below the version (31 bits of the text's hash).
_VERSION_BITS = 32
_PLACE = (1 << _VERSION_BITS) - 1


def anchors(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the anchor-length runs, and for each window the place of its least one."""
    grams = window_hashes(h, anchor)
    span = window - anchor + 1
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    return grams, np.arange(len(view)) + np.concatenate([view[k : k + 65536].argmin(axis=1) for k in range(0, len(view), 65536)])


def blocks(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(anchor hash, anchor place, first window, number of windows) of each block of a text."""
    if len(h) < window:
        empty = np.empty(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty
    grams, at = anchors(h, window, anchor)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return grams[at[first]], at[first], first, np.diff(first, append=len(at))


class _Runs:
    """Digests of runs of words: of those from ``a`` up to ``b``, joined by one space."""

    def __init__(self, words: list[bytes]):
        self.joined = b" ".join(words)
        self.at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)]).tolist()

    def digest(self, a: int, b: int) -> bytes:
        return hashlib.blake2b(self.joined[self.at[a] : self.at[b] - 1], digest_size=16).digest()


def version(text: Column) -> Column:
    """Tells apart the texts of rows that repeat an id."""
    return F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit((1 << 31) - 1))


def _all_blocks(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, content, doc_id, place, n) of every block of (doc_id, version, text)."""
    schema = pa.schema([("anchor", pa.int64()), ("content", pa.binary()), ("doc_id", pa.int64()), ("place", pa.int64()), ("n", pa.int32())])

    def each(batch: pa.RecordBatch, hashes: WordHashes) -> dict:
        found: list[list] = [[np.empty(0, np.int64)], [], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]]
        for doc, kind, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_column(batch, "text"), strict=True):
            words = text.split() if text else []
            key, _, first, n = blocks(hashes.of(words), window, anchor)
            if len(first):
                runs = _Runs(words)
                found[0].append(key.view(np.int64))
                found[1] += [runs.digest(a, a + k - 1 + window) for a, k in zip(first.tolist(), n.tolist(), strict=True)]
                found[2].append(np.full(len(first), doc))
                found[3].append(first + (kind << _VERSION_BITS))
                found[4].append(n.astype(np.int32))
        return {name: pa.array(part, pa.binary()) if name == "content" else np.concatenate(part) for name, part in zip(schema.names, found, strict=True)}

    return map_arrow(docs.select("doc_id", "version", "text"), each, schema, "anchor long, content binary, doc_id long, place long, n int", WordHashes)


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """(anchor, content, k, word_digest, doc_id, place): the windows, by number, of the blocks that are listed beside each text."""
    schema = pa.schema([("anchor", pa.int64()), ("content", pa.binary()), ("k", pa.int32()), ("window", pa.binary()), ("doc_id", pa.int64()), ("place", pa.int64())])

    def each(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in schema.names}
        for doc, text, todo in zip(batch.column(0).to_pylist(), binary_column(batch, "text"), batch.column(2).to_pylist(), strict=True):
            runs = _Runs(text.split())
            for item in todo:
                first = item["place"] & _PLACE
                for k in range(item["n"]):
                    for name, value in zip(schema.names, (item["anchor"], item["content"], k, runs.digest(first + k, first + k + window), doc, item["place"] + k), strict=True):
                        out[name].append(value)
        return out

    return map_arrow(texts, each, schema, "anchor long, content binary, k int, window binary, doc_id long, place long")


def _first() -> Column:
    """The first occurrence: smallest document, then place."""
    return F.min(F.struct(F.col("doc_id").alias("source"), F.col("place").alias("at"))).alias("lead")


def first_occurrences(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, place, n, source, at): runs of windows whose first occurrences are consecutive in a smaller document ``source``.

    ``docs`` is (doc_id long not null, version, text).  Every window of a
    document that starts in a smaller one lies in exactly one run.
    """
    index = stored(_all_blocks(docs, window, anchor), "blocks")
    several = index.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("anchor")
    # stored, so that both sides of a join are plain exchanges, which Spark splits where an anchor is frequent
    met = stored(index.join(stored(several, "several"), "anchor"), "met")
    per_anchor = met.groupBy("anchor").agg(_first(), (F.min("content") == F.max("content")).alias("equal"))
    shared = stored(met.join(stored(per_anchor, "anchors"), "anchor"), "shared")
    whole = shared.where("equal and lead.source < doc_id").select("doc_id", "place", "n", "lead.source", "lead.at")

    mixed = shared.where("not equal").drop("lead", "equal")
    contents = stored(mixed.groupBy("anchor", "content").agg(_first(), F.min("n").alias("n")), "contents")
    todo = contents.select(F.col("lead.source").alias("doc_id"), F.col("lead.at").alias("place"), "anchor", "content", "n").withColumn("version", F.shiftright("place", _VERSION_BITS))
    todo = todo.groupBy("doc_id", "version").agg(F.collect_list(F.struct("anchor", "content", "place", "n")).alias("todo"))
    texts = docs.join(todo.hint("shuffle_hash"), ["doc_id", "version"]).dropDuplicates(["doc_id", "version"]) if _repeats(docs) else docs.join(todo.hint("shuffle_hash"), ["doc_id", "version"])
    single = stored(_windows(texts.select("doc_id", "text", "todo"), window), "windows")
    starts = stored(single.groupBy("window").agg(_first()), "starts")
    found = single.select("anchor", "content", "k", "window").join(starts, "window").groupBy("anchor", "content").agg(F.sort_array(F.collect_list(F.struct("k", "lead.source", "lead.at"))).alias("w"))  # at most WINDOW entries
    heads = "filter(transform(w, (e, i) -> struct(e.k, e.source, e.at, i = 0 or get(w, i - 1).source <> e.source or get(w, i - 1).at <> e.at - 1 as head)), e -> e.head)"
    runs = found.select("anchor", "content", F.expr(heads).alias("h"), F.expr("size(w)").alias("all"))
    runs = runs.select("anchor", "content", F.expr("transform(h, (e, i) -> struct(e.k, coalesce(get(h, i + 1).k, all) - e.k as n, e.source, e.at))").alias("runs"))
    again = mixed.select("anchor", "content", "doc_id", "place").join(stored(runs, "runs"), ["anchor", "content"]).select("doc_id", "place", F.explode("runs").alias("r"))
    again = again.where("r.source < doc_id").select("doc_id", (F.col("place") + F.col("r.k")).alias("place"), "r.n", "r.source", "r.at")
    return whole.unionByName(again)


def _repeats(docs: DataFrame) -> bool:
    """Whether an id stands in several rows; its equal texts would else be taken apart more than once."""
    return not docs.groupBy("doc_id").count().where("count > 1").isEmpty()


Run = tuple[int, int, int, int]


def factors(runs: list[Run], window: int = WINDOW) -> list[Run]:
    """Greedy parse of (first window, number, source, place there): (start word, end word, source, place there) of each factor.

    A factor is as long as it can be: it goes on while the next window's first
    occurrence is the next place of the same source.
    """
    out: list[list[int]] = []
    for first, n, source, at in sorted(set(runs)):
        if out and source == out[-1][2] and first == out[-1][1] and at - out[-1][3] == first - out[-1][0]:
            out[-1][1] += n
        else:
            out.append([first, first + n, source, at])
    return [(first, end - 1 + window, source, at) for first, end, source, at in out]


def kept_words(words: list, spans: list[Run]) -> list:
    """The words outside all spans."""
    out, at = [], 0
    for start, end, *_ in sorted(spans):
        if start > at:
            out += words[at:start]
        at = max(at, end)
    return out + words[at:]


def _with_runs(docs: DataFrame, window: int, anchor: int, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``_rw_runs``: the runs of each row's text; rows are ordered by ``key``."""
    known = docs.select(F.col(key).cast("long").alias("doc_id"), version(F.col("text")).alias("version"), "text").where("doc_id is not null")
    runs = first_occurrences(known, window, anchor).withColumn("version", F.shiftright("place", _VERSION_BITS))
    first = F.col("place").bitwiseAND(F.lit(_PLACE)).alias("first")
    per_doc = runs.groupBy(F.col("doc_id").alias("_rw_id"), F.col("version").alias("_rw_version")).agg(F.collect_list(F.struct(first, "n", "source", "at")).alias("_rw_runs"))
    own = (docs[key].cast("long") == F.col("_rw_id")) & (version(docs["text"]) == F.col("_rw_version"))
    return docs.join(per_doc.hint("shuffle_hash"), own, "left").drop("_rw_id", "_rw_version")


def _runs_of(value) -> list[Run]:
    return [(r["first"], r["n"], r["source"], r["at"]) for r in value] if value is not None else []


def parse_documents(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_sha256) of every row.

    Spans are (start, end, source, at): these words are those from word ``at`` of ``source`` on.
    """
    prepare(docs.sparkSession)
    rows = _with_runs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window, anchor).select("doc_id", "text", "_rw_runs")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.int64()), ("at", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept_sha256", pa.string())])

    def each(batch: pa.RecordBatch) -> dict:
        out = {n: [] for n in schema.names}
        for doc, text, runs in zip(batch.column(0).to_pylist(), binary_column(batch, "text"), batch.column(2).to_pylist(), strict=True):
            words = text.split() if text else []
            spans = factors(_runs_of(runs), window)
            kept = kept_words(words, spans)
            listed = [{"start": s, "end": e, "source": o, "at": a & _PLACE} for s, e, o, a in spans]
            for name, value in zip(schema.names, (doc, len(words), len(words) - len(kept), listed, hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                out[name].append(value)
        return out

    return map_arrow(rows, each, schema, "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int,source:long,at:long>>, kept_sha256 string")


def remove_duplicates(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The documents without their repeated passages; texts without any stay as they are, byte for byte.

    Rows without an id come after all others, by a hash of their texts.
    """
    prepare(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(text, runs):
        return text.combine(runs, lambda t, r: " ".join(x.decode() for x in kept_words(t.encode().split(), factors(_runs_of(r), window))))

    keyed = docs.withColumn("_rw_key", F.coalesce(F.col("doc_id").cast("long"), own_id("text")))
    rows = _with_runs(keyed, window, anchor, "_rw_key")
    none = F.expr("cast(array() as array<struct<first:bigint,n:int,source:bigint,at:bigint>>)")
    kept = F.when(F.col("_rw_runs").isNull(), F.col("text")).otherwise(clean(F.coalesce("text", F.lit("")), F.coalesce("_rw_runs", none)))
    return rows.withColumn("text", kept).select(*docs.columns)
