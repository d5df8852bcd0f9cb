"""Byte-level BPE encoding and decoding by overlapping chunks.

1. A long text is cut into chunks that overlap; each is a row of its own, so the
   chunks of one text lie on many tasks.
2. Each chunk is pre-tokenised by the split pattern from its own first character,
   whatever stands before it, so its first boundaries may be wrong.
3. Neighbours are stitched where they resynchronise: at the first place in their
   overlap which both have as a boundary.  The pattern never looks behind, so a
   boundary that is true for the left chunk makes all later ones of the right
   chunk true; by induction from the start of the text every meeting place is
   true.  The left chunk's last ``LOOK_AHEAD`` characters are not asked, since the
   pattern looks so far ahead.
4. Where an overlap holds no common boundary (one unbroken run), the chunks are
   joined and pre-tokenised again from the last true boundary, each time twice as
   many, until they meet the next one.
5. The pieces between meeting places are encoded, again as rows of their own, and
   the ids of one text are put together.  Decoding concatenates the raw bytes.

The pattern runs in a library whose Unicode tables are newer than the encoder's.
The encoder itself is asked for its letters, digits and white space, and characters on which the
two differ are replaced by stand-ins of the encoder's class before the split.

A text of one chunk is encoded where it is: only long texts are moved.  All of a
text's chunks meet in one task for the stitch, which a row of the input bounds.

Results for special cases: a null text counts as empty; an empty text has no
ids; strings that look like special tokens are ordinary text; repeated rows and
ids, null ids too, are encoded row by row.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, prepare, stored, text_column

#: Characters in a chunk, and those that it shares with the next.
CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 512
#: Characters beyond a pre-token's end on which the pattern's choice may hang: the rest of a contraction.
LOOK_AHEAD = 2

_loaded: dict[str, Codec] = {}


class Splitter:
    """Pre-token boundaries as the encoder draws them."""

    def __init__(self, pattern: str = public_tokenizers.PATTERN):
        self.pattern = regex.compile(pattern)
        every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
        kinds = {"a": r"\p{L}", "1": r"\p{N}", " ": r"\s"}
        theirs = {stand_in: set(_encoder_sees(kind, every)) for stand_in, kind in kinds.items()}
        ours = {stand_in: set(regex.findall(kind, every)) for stand_in, kind in kinds.items()}
        differ = set().union(*(theirs[k] ^ ours[k] for k in kinds))
        self.stand_ins = {ord(c): next((k for k in kinds if c in theirs[k]), "!") for c in differ}

    def starts(self, text: str, offset: int = 0) -> list[int]:
        """Where the pre-tokens of a text begin."""
        if not text.isascii():
            text = text.translate(self.stand_ins)
        return [offset + m.start() for m in self.pattern.finditer(text)]


def _encoder_sees(kind: str, text: str) -> str:
    """The characters of a text that the encoder's own pattern engine counts as ``kind``."""
    probe = tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return bytes(probe.encode_ordinary(text)).decode()


class Codec:
    """Ranks of one vocabulary with its encoder, its table of bytes and, once a long text needs it, its splitter."""

    def __init__(self, path: str, special: dict[str, int] | None = None):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special or {})
        self.bytes_of = [b""] * (max([*ranks.values(), *(special or {}).values()]) + 1)
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        for piece, rank in (special or {}).items():
            self.bytes_of[rank] = piece.encode()
        self._splitter: Splitter | None = None

    @property
    def splitter(self) -> Splitter:
        if self._splitter is None:
            self._splitter = Splitter()
        return self._splitter

    def encode(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
        """Ids of one whole text in this process, by the same chunks and pieces."""
        ids: list[int] = []
        for piece in pieces(text, self.splitter, chunk, overlap) if len(text) > chunk + overlap else [text]:
            ids += self.encoding.encode_ordinary(piece)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """Raw bytes of the ids, in order."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec(vocabulary: str) -> Codec:
    """The codec of a rank file, read once in each worker."""
    if vocabulary not in _loaded:
        _loaded[vocabulary] = Codec(public_tokenizers.path(vocabulary))
    return _loaded[vocabulary]


def chunks_of(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """(start, characters) of the overlapping chunks; the last one runs to the end."""
    last = max(0, -(-(len(text) - overlap) // chunk) - 1)
    return [(k * chunk, text[k * chunk : k * chunk + chunk + overlap] if k < last else text[k * chunk :]) for k in range(last + 1)]


def seams(splitter: Splitter, begin: int, text: str, chunk: int, overlap: int) -> list[int]:
    """The boundaries of a chunk where it can meet a neighbour: those of its two overlaps.

    None right behind white space: there a piece would end, and before an end the
    pattern takes white space as one that it parts before a word.
    """
    found = splitter.starts(text, begin)
    return [s for s in found if s > begin and (s < begin + overlap or s >= begin + chunk) and not text[s - begin - 1].isspace()]


def stitch(chunks: list[tuple[int, str]], seen: list[list[int]], splitter: Splitter) -> list[str]:
    """Pieces of a text from its chunks and what each saw as boundaries in its overlaps."""
    out: list[str] = []
    true, k, most = 0, 0, 1  # the last true boundary, the last chunk that is joined to it, and how many to join next
    begin, held, known = 0, chunks[0][1], seen[0]  # characters from ``begin`` on, and their boundaries
    while k + 1 < len(chunks):
        trusted = begin + len(held) - LOOK_AHEAD
        right = set(seen[k + 1])
        meet = next((b for b in known if chunks[k + 1][0] <= b <= trusted and b in right), None)
        if meet is None:
            held = held[true - begin :]
            begin = true
            parts = [held]
            for _ in range(min(most, len(chunks) - 1 - k)):
                k += 1
                start, text = chunks[k]
                parts.append(text[begin + sum(map(len, parts)) - start :])
            held = "".join(parts)
            known = seams(splitter, begin, held, chunks[k][0] - begin, 0)
            most *= 2
        else:
            out.append(held[true - begin : meet - begin])
            true, k, most = meet, k + 1, 1
            begin, held = chunks[k]
            known = seen[k]
    return [*out, held[true - begin :]]


def pieces(text: str, splitter: Splitter, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
    """The stitched pieces of a text; their concatenation is the text."""
    cut = chunks_of(text, chunk, overlap)
    return stitch(cut, [seams(splitter, at, t, chunk, overlap) for at, t in cut], splitter)


Finish = Callable[[Codec, list[int]], tuple]


def _rows(count: itertools.count, vocabulary: str, batch: pa.RecordBatch, finish: Finish, chunk: int, overlap: int) -> list[tuple]:
    """Results of short texts, and the chunks of long ones under a number of their row."""
    c, rows = codec(vocabulary), []
    for key, text in zip(batch.column(0).to_pylist(), text_column(batch, "text"), strict=True):
        text, row = text or "", next(count)
        if len(text) <= chunk + overlap:
            rows.append((row, key, None, None, *finish(c, c.encoding.encode_ordinary(text))))
        else:
            rows += [(row, key, at, part, *[None] * len(finish(c, []))) for at, part in chunks_of(text, chunk, overlap)]
    return rows


def _table(rows: list[tuple], schema: pa.Schema) -> dict:
    return {f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)}


def _encoded(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, finish: Finish, fields: list[tuple[str, pa.DataType, str]], chunk: int, overlap: int) -> DataFrame:
    """(id, fields) of every row: what ``finish`` makes of its ids."""
    prepare(docs.sparkSession)
    spark, field = docs.sparkSession, docs.schema[id_col]
    kind = field.dataType.simpleString()
    arrow = spark.createDataFrame([], f"id {kind}").toArrow().schema.field("id").type
    head = [("row", pa.int64()), ("id", arrow)]
    result = [(n, t) for n, t, _ in fields]
    result_ddl = ", ".join(f"{n} {d}" for n, _, d in fields)

    first = pa.schema([*head, ("start", pa.int64()), ("chunk", pa.string()), *result])
    begin = map_arrow(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), lambda batch, count: _table(_rows(count, vocabulary, batch, finish, chunk, overlap), first),
        first, f"row long, id {kind}, start long, chunk string, {result_ddl}", lambda: itertools.count(TaskContext.get().partitionId() << 40),
    )
    begun = stored(begin, "chunks")
    names = [n for n, _, _ in fields]
    short = begun.where("chunk is null").select("id", *names)

    def look(batch: pa.RecordBatch) -> dict:
        splitter = codec(vocabulary).splitter
        found = [seams(splitter, s, t, chunk, overlap) for s, t in zip(batch.column(2).to_pylist(), text_column(batch, "chunk"), strict=True)]
        return {n: batch.column(k) for k, n in enumerate(("row", "id", "start", "chunk"))} | {"seen": pa.array(found, pa.list_(pa.int64()))}

    seen_schema = pa.schema([*head, ("start", pa.int64()), ("chunk", pa.string()), ("seen", pa.list_(pa.int64()))])
    long = begun.where("chunk is not null").select("row", "id", "start", "chunk").repartition("row", "start")
    seen = map_arrow(long, look, seen_schema, f"row long, id {kind}, start long, chunk string, seen array<bigint>")

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("start")
        cut = list(zip(table.column("start").to_pylist(), table.column("chunk").to_pylist(), strict=True))
        texts = stitch(cut, table.column("seen").to_pylist(), codec(vocabulary).splitter)
        n = len(texts)
        return pa.table({"row": pa.array([table.column("row")[0].as_py()] * n, pa.int64()), "id": pa.array([table.column("id")[0].as_py()] * n, arrow), "piece": pa.array(range(n), pa.int32()), "text": pa.array(texts, pa.string())})

    stitched = seen.groupBy("row").applyInArrow(join, f"row long, id {kind}, piece int, text string").repartition("row", "piece")

    def ids_of(batch: pa.RecordBatch) -> dict:
        c = codec(vocabulary)
        return {n: batch.column(k) for k, n in enumerate(("row", "id", "piece"))} | {"ids": pa.array([c.encoding.encode_ordinary(t) for t in text_column(batch, "text")], pa.list_(pa.int32()))}

    ids_schema = pa.schema([*head, ("piece", pa.int32()), ("ids", pa.list_(pa.int32()))])
    parts = map_arrow(stitched, ids_of, ids_schema, f"row long, id {kind}, piece int, ids array<int>")

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")
        ids = list(itertools.chain.from_iterable(table.column("ids").to_pylist()))
        return pa.table(_table([(table.column("id")[0].as_py(), *finish(codec(vocabulary), ids))], pa.schema([("id", arrow), *result])))

    whole = parts.groupBy("row").applyInArrow(gather, f"id {kind}, {result_ddl}")
    return short.unionByName(whole).withColumnRenamed("id", id_col)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(id, ids array<int>): the token ids of every whole text."""
    return _encoded(docs, id_col, text_col, vocabulary, lambda c, ids: (ids,), [("ids", pa.list_(pa.int32()), "array<int>")], chunk, overlap)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, bytes binary): the concatenated raw bytes of every row's ids (null ids: empty)."""
    prepare(encoded.sparkSession)

    def each(batch: pa.RecordBatch) -> dict:
        c = codec(vocabulary)
        return {"id": batch.column(0), "bytes": pa.array([c.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())}

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_arrow(encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), each, None, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def _digests(c: Codec, ids: list[int]) -> tuple:
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()


def round_trip(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Digests of the ids and of the decoded bytes, made where the ids are so that these are never moved."""
    fields = [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    return _encoded(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", "text", vocabulary, _digests, fields, chunk, overlap)
