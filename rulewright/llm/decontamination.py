"""Benchmark decontamination by a prefix-filtered join of word shingles.

A record is a window of ``width`` consecutive words of an item (an item of fewer
words is one record).  Its set are its shingles of ``SHINGLE`` words, each at its
place.  A record occurs at a place of a document if the item-sized window that
starts there has at least ``least`` of the record's shingles at their places; with
``least`` 1, the default, it is the same words.

1. Shingles of records are counted over all documents.  Tasks hold a bit table
   of bounded size and emit sums of what passes it.
2. Each record orders its shingles by these counts, rarest first.  Of ``s``
   shingles ``ceil(least * s)`` must be met, so one of the first
   ``s - ceil(least * s) + 1`` must be: these prefixes are the index.  A record
   with too few shingles that occur anywhere is dropped (length bound).
3. Texts are read a second time.  Where a shingle passes the bit table of the index,
   its place and the words around it become a row; these rows meet the index by an
   equi-join.  A shingle's place in the record says where the window must start;
   it has to lie within the document (positional bound).
4. The window's words are compared with the record's.

The index and the rows that meet it are stored tables, so Spark broadcasts the
index below its own bound and beyond it splits a hot shingle.  No text is moved.
Documents with the same set of records share one list of items.

Special cases: null and word-less texts have no words, are never hit, and hit
nothing; repeated items count under each of their ids; an item without id hits words, but is in no list;
rows that repeat a doc_id are each judged on their own text, rows with a null
id too; with no documents or no items nothing is hit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import HashFilter, WordHashes, binary_column, hash_filter, map_arrow, mix64, prepare, stored, window_hashes

#: Fixed by the contract: a word is a run of these bytes, with A-Z in lower case.
WINDOW = 10
SHINGLE = 5
#: Rows of one Arrow batch of hits.
HIT_ROWS = 4096

_SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_RECORD_DDL = "item_id string, record string, n int, k int, hashes array<long>"
_HIT_DDL = "doc_id long, version long, n_words long, h long, pos int, before int, context string"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_SPACED).split() if text else []


def version(text: Column) -> Column:
    """Tells apart the texts of rows that repeat an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words; runs of different lengths are told apart."""
    return mix64(window_hashes(h, k) + np.uint64(k))


def records(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item_id, record, n, k, hashes): every window of every item with its shingles' hashes, by place."""
    schema = pa.schema([("item_id", pa.string()), ("record", pa.string()), ("n", pa.int32()), ("k", pa.int32()), ("hashes", pa.list_(pa.int64()))])

    def each(batch: pa.RecordBatch, hashes: WordHashes):
        for item, text in zip(batch.column(0).to_pylist(), binary_column(batch, "text"), strict=True):
            words = words_of(text)
            if not words:
                continue
            n, k = min(width, len(words)), min(SHINGLE, width, len(words))
            h = shingle_hashes(hashes.of(words), k).view(np.int64)
            for at in range(0, len(words) - n + 1, HIT_ROWS):
                places = range(at, min(at + HIT_ROWS, len(words) - n + 1))
                size = len(places)
                yield {
                    "item_id": pa.array([item] * size, pa.string()), "record": [b" ".join(words[p : p + n]).decode() for p in places], "n": np.full(size, n, np.int32), "k": np.full(size, k, np.int32),
                    "hashes": [h[p : p + n - k + 1] for p in places],
                }

    return map_arrow(items.select(F.col("item_id").cast("string"), "text"), each, schema, _RECORD_DDL, WordHashes)


def shingle_counts(docs: DataFrame, wanted: HashFilter, widths: list[int]) -> DataFrame:
    """(h, n): how often shingles that pass the filter stand in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def each(batch: pa.RecordBatch, state: tuple) -> dict:
        hashes, passes = state
        found = [np.empty(0, np.uint64)]
        for text in binary_column(batch, "text"):
            own = hashes.of(words_of(text))
            for k in widths:
                h = shingle_hashes(own, k)
                found.append(h[passes(h)])
        h, n = np.unique(np.concatenate(found), return_counts=True)
        return {"h": h.view(np.int64), "n": n.astype(np.int64)}

    partial = map_arrow(docs.select("text"), each, schema, "h long, n long", lambda: (WordHashes(), shared.value))
    return partial.groupBy("h").agg(F.sum("n").alias("n"))


def required(size: Column, least: float) -> Column:
    """How many of ``size`` shingles must be met; the slack keeps products such as 0.8 * 5 whole."""
    return F.greatest(F.lit(1), F.ceil(size * least - 1e-9)).cast("int")


def prefix_index(found: DataFrame, counts: DataFrame, least: float = 1.0) -> DataFrame:
    """(h, offset, record, n, k): the shingles of each record, rarest first, of which one must be met."""
    parts = found.select("record", "n", "k", F.posexplode("hashes").alias("offset", "h"))
    often = counts.withColumnRenamed("n", "often")
    ranked = parts.join(often, "h", "left").groupBy("record", "n", "k").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "h", "offset"))).alias("s"))
    must = required(F.size("s"), least)
    ranked = ranked.where(F.size(F.filter("s", lambda x: x["often"] > 0)) >= must)
    rare = F.slice("s", F.lit(1), F.size("s") - must + 1)
    return ranked.select("record", "n", "k", F.explode(F.filter(rare, lambda x: x["often"] > 0)).alias("x")).select("x.h", "x.offset", "record", "n", "k")


def hits(docs: DataFrame, wanted: HashFilter, widths: list[int], width: int = WINDOW) -> DataFrame:
    """One row per document (``h`` null), and one for each place where a shingle passes the filter, with the words around it."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    schema = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("n_words", pa.int64()), ("h", pa.int64()), ("pos", pa.int32()), ("before", pa.int32()), ("context", pa.string())])

    def each(batch: pa.RecordBatch, state: tuple):
        hashes, passes = state
        rows: list[tuple] = []
        for doc, kind, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_column(batch, "text"), strict=True):
            words = words_of(text)
            key = (doc, kind, len(words))
            rows.append((*key, None, None, None, None))
            own = hashes.of(words)
            for k in widths:
                h = shingle_hashes(own, k)
                for pos in np.flatnonzero(passes(h)).tolist():
                    start = max(0, pos - (width - k))
                    rows.append((*key, h[pos].view(np.int64).item(), pos, pos - start, b" ".join(words[start : pos + width]).decode()))
                    if len(rows) >= HIT_ROWS:
                        yield dict(zip(schema.names, zip(*rows, strict=True), strict=True))
                        rows = []
        if rows:
            yield dict(zip(schema.names, zip(*rows, strict=True), strict=True))

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), version(F.col("text")).alias("version"), "text"), each, schema, _HIT_DDL, lambda: (WordHashes(), shared.value))


def occurrences(near: DataFrame, index: DataFrame, least: float = 1.0) -> DataFrame:
    """(doc_id, version, start, n, record): what is left of the rows that meet the index once their words are compared."""
    met = near.alias("a").join(index.alias("i"), F.col("a.h") == F.col("i.h"))
    start = F.col("pos") - F.col("offset")
    met = met.where((start >= 0) & (start + F.col("i.n") <= F.col("n_words")))
    window = F.slice(F.split("context", " ", -1), F.col("before") - F.col("offset") + 1, F.col("i.n"))
    met = met.select("doc_id", "version", start.alias("start"), F.col("i.n").alias("n"), "k", "record", window.alias("window"))
    if least >= 1:
        same = F.array_join("window", " ") == F.col("record")
    else:
        at = F.expr("size(filter(sequence(0, n - k), o -> slice(window, o + 1, k) = slice(split(record, ' ', -1), o + 1, k)))")
        same = at >= required(F.col("n") - F.col("k") + 1, least)
    return met.where(same).select("doc_id", "version", "start", "n", "record").distinct()


def judge(docs: DataFrame, items: DataFrame, width: int = WINDOW, least: float = 1.0) -> DataFrame:
    """(doc_id, version, n_words, n_hit, spans, items) of every row of ``docs``.

    ``spans`` are the merged (start, end) of hit words, ``items`` the ids, as
    strings in their order, of the items with an occurring window.
    """
    prepare(docs.sparkSession)
    listed = stored(records(items, width), "records")
    distinct = stored(listed.dropDuplicates(["record"]).drop("item_id"), "distinct")
    widths = sorted(r["k"] for r in distinct.select("k").distinct().collect())  # SHINGLE of them at most
    wanted = hash_filter(stored(distinct.select(F.explode("hashes").alias("h")).distinct(), "shingles"))
    counts = stored(shingle_counts(docs, wanted, widths), "counts")
    index = stored(prefix_index(distinct, counts, least), "index")
    rows = stored(hits(docs, hash_filter(index), widths, width), "hits")
    found = stored(occurrences(rows.where("h is not null"), index, least), "occurrences")

    key = ["doc_id", "version"]
    # islands of overlapping or touching windows, by the furthest end before each start
    spots = found.select(*key, "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    along = W.partitionBy(*key).orderBy("start", "end")
    head = F.coalesce(F.col("start") > F.max("end").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(True)).cast("int")
    islands = spots.withColumn("head", head).withColumn("island", F.sum("head").over(along)).groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = islands.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    keys = found.select(*key, F.md5("record").alias("key")).groupBy(*key).agg(F.sort_array(F.collect_set("key")).alias("keys"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.version") == F.col("b.version"))
    per_doc = spans.alias("a").join(keys.alias("b"), same).select("a.doc_id", "a.version", "spans", "keys", F.sha2(F.array_join("keys", ""), 256).alias("kind"))
    per_doc = stored(per_doc, "hit-documents")
    # documents with the same records share one list of items
    kinds = per_doc.select("kind", "keys").dropDuplicates(["kind"]).select("kind", F.explode("keys").alias("key"))
    of_key = stored(listed.where("item_id is not null").select(F.md5("record").alias("key"), "item_id").distinct(), "items")
    lists = stored(kinds.join(of_key, "key").groupBy("kind").agg(F.sort_array(F.collect_set("item_id")).alias("items")), "lists")
    per_doc = per_doc.join(lists, "kind", "left").select("doc_id", "version", "spans", "items").alias("p")
    own = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.version") == F.col("p.version"))
    none = "cast(array() as array<{}>)".format
    spans = F.coalesce("spans", F.expr(none("struct<start:int,end:int>")))
    out = rows.where("h is null").alias("d").join(per_doc, own, "left").select("d.doc_id", "d.version", "n_words", spans.alias("spans"), F.coalesce("items", F.expr(none("string"))).alias("items"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return out.select("doc_id", "version", "n_words", hit.alias("n_hit"), "spans", "items")


def document_digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest of every document."""
    return judge(docs, items).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, width: int = WINDOW, least: float = 1.0) -> DataFrame:
    """The documents without a word of a benchmark window, all columns as they were."""
    found = judge(docs, items, width, least).where("n_hit > 0").select(F.col("doc_id").alias("_rw_id"), F.col("version").alias("_rw_version")).distinct()
    own = docs["doc_id"].cast("long").eqNullSafe(F.col("_rw_id")) & (version(docs["text"]) == F.col("_rw_version"))
    return docs.join(stored(found, "contaminated"), own, "left_anti")
