"""Best-fit packing of token sequences by exact-complement hashing.

1. ``cut_pieces`` tokenises every document (ids, then the separator id) and cuts
   only those longer than a sequence; the remainder comes first, so that all
   later pieces are full.
2. ``plan_bins`` sees nothing but the number of pieces of each length, at most
   ``capacity`` numbers however large the corpus is.  Going down the lengths, it
   fills the gap of the longest piece left *exactly*: with one piece, with a
   pair, or with a triple whose length sum is the gap, found in indexes of
   single and pair sums and consumed as often as availability allows.  What
   remains goes by best fit (smallest gap that holds the piece).
3. ``pack`` hands out places by interval look-up.  A length may hold a third of all
   pieces, so pieces are numbered where they are made: each task counts its own
   pieces of each length, and sums over the tasks before it make the numbers
   global.  No piece is sorted, and none is moved for its number.

Special cases: a null text counts as empty and yields a piece with only the
separator; equal lengths are numbered in the order in which they lie in the
table; repeated rows and ids, null ids too, are pieces of their own; an empty
table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from tokenizers import Tokenizer

from .bpe_codec import Codec
from .common import map_arrow, prepare, stored, text_column

SEQUENCE_TOKENS = 2048
SEPARATOR = 0
#: Below this code point both tokenizer libraries agree on what letters and digits are; above it the one asked for is used itself.
_PLAIN_BELOW = "̀"

_loaded: dict[str, IdSource] = {}


class IdSource:
    """Token ids as the ``tokenizers`` library gives them, by its faster twin where both agree."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = set(added)
        self.twin = Codec(public_tokenizers.path(vocabulary.replace(".json", ".tiktoken")), added)

    def ids(self, text: str) -> list[int]:
        if text.isascii() or max(text) < _PLAIN_BELOW:
            if any(s in text for s in self.special):
                return self.twin.encoding.encode(text, allowed_special=self.special)
            return self.twin.encode(text)
        return self.library.encode(text, add_special_tokens=False).ids


def id_source(vocabulary: str) -> IdSource:
    if vocabulary not in _loaded:
        _loaded[vocabulary] = IdSource(vocabulary)
    return _loaded[vocabulary]


def cut_pieces(docs: DataFrame, capacity: int = SEQUENCE_TOKENS, vocabulary: str = "byte_bpe_50k.json", separator: int = SEPARATOR, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document; one narrow stage."""
    return _cut(docs, capacity, vocabulary, separator, keep_ids).drop("_task", "_nth")


def _counters() -> tuple[int, Counter]:
    return TaskContext.get().partitionId(), Counter()


def _cut(docs: DataFrame, capacity: int, vocabulary: str, separator: int, keep_ids: bool) -> DataFrame:
    """The pieces, each with its task and its number among the task's pieces of its length."""
    prepare(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("_task", pa.int64()), ("_nth", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * keep_ids)

    def each(batch: pa.RecordBatch, state: tuple[int, Counter]) -> dict:
        task, seen = state
        source = id_source(vocabulary)
        rows, kept = [], []
        for doc, text in zip(batch.column(0).to_pylist(), text_column(batch, "text"), strict=True):
            ids = np.array([*source.ids(text or ""), separator], "<u4")
            first = len(ids) % capacity or capacity
            for k, end in enumerate(range(first, len(ids) + 1, capacity)):
                start = max(0, end - (first if k == 0 else capacity))
                part = ids[start:end]
                rows.append((doc, k, start, len(part), zlib.crc32(part.tobytes()), task, seen[len(part)]))
                seen[len(part)] += 1
                if keep_ids:
                    kept.append(part.astype(np.int32))
        out = {name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(fields)}
        if keep_ids:
            ends = np.cumsum([0, *map(len, kept)]).astype(np.int32)
            out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept)))
        return out

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, _task long, _nth long" + ", ids array<int>" * keep_ids
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), each, schema, ddl, _counters)


@dataclass(frozen=True)
class Fill:
    """``bins`` sequences that all hold pieces of these lengths, in this order."""

    lengths: tuple[int, ...]
    bins: int


def plan_bins(counts: dict[int, int], capacity: int = SEQUENCE_TOKENS) -> list[Fill]:
    """How many sequences of which contents use up all pieces.

    ``counts`` maps a length (1..capacity) to its number of pieces.  The work and
    the result depend on the number of distinct lengths only.
    """
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    fills: list[Fill] = []

    def consume(parts: list[int]) -> None:
        lengths, times = np.unique(parts, return_counts=True)
        bins = int((have[lengths] // times).min())
        have[lengths] -= bins * times
        fills.append(Fill(tuple(sorted(parts, reverse=True)), bins))

    def enough(parts: list[int]) -> bool:
        lengths, times = np.unique(parts, return_counts=True)
        return bool((have[lengths] >= times).all())

    def pair(total: int, beside: int) -> list[int] | None:
        """Two available lengths of this sum, found in the index of single lengths."""
        if total < 2:
            return None
        a = np.arange(total // 2, 0, -1)
        for x in a[(have[a] > 0) & (have[total - a] > 0)]:
            if enough([beside, int(x), int(total - x)]):
                return [int(x), int(total - x)]
        return None

    for top in range(capacity, 0, -1):
        failed = False
        while have[top] > 0 and not failed:
            gap = capacity - top
            if gap == 0:
                consume([top])
            elif have[gap] > 0 and enough([top, gap]):
                consume([top, gap])
            elif two := pair(gap, top):
                consume([top, *two])
            else:
                failed = True
                present = np.flatnonzero(have[:gap])
                sums = _pair_sums(present, gap)
                for x in present[::-1]:
                    rest = gap - int(x)
                    if rest >= 2 and sums[rest]:
                        two = pair(rest, top)
                        if two and enough([top, int(x), *two]):
                            consume([top, int(x), *two])
                            failed = False
                            break
    return fills + _best_fit(have, capacity)


def _pair_sums(present: np.ndarray, limit: int) -> np.ndarray:
    """Which sums up to ``limit`` two of these lengths have: the index of pair sums."""
    found = np.zeros(limit + 1, bool)
    marks = np.zeros(limit + 1, bool)
    marks[present] = True
    for x in present:
        found[x:] |= marks[: limit + 1 - x]
    return found


def _best_fit(have: np.ndarray, capacity: int) -> list[Fill]:
    """Best fit, longest first, over classes of equal sequences instead of single ones."""
    open_by_gap: dict[int, list[Fill]] = defaultdict(list)
    gaps = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        left = int(have[length])
        while left:
            fits = np.flatnonzero(gaps[length:])
            if len(fits):
                gap = length + int(fits[0])
                old = open_by_gap[gap].pop()
                bins = min(left, old.bins)
                if bins < old.bins:
                    open_by_gap[gap].append(Fill(old.lengths, old.bins - bins))
                gaps[gap] = bool(open_by_gap[gap])
                new, left = Fill((*old.lengths, length), bins), left - bins
            else:
                each = min(capacity // length, left)
                bins = left // each
                new, left = Fill((length,) * each, bins), left - bins * each
            gap = capacity - sum(new.lengths)
            open_by_gap[gap].append(new)
            gaps[gap] = gap > 0
    return [f for fs in open_by_gap.values() for f in fs]


def places(fills: list[Fill]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces a bin, first sequence, offset) for each interval of ranks."""
    rows, used, sequence = [], defaultdict(int), 0
    for fill in fills:
        offset = 0
        for length in dict.fromkeys(fill.lengths):
            times = fill.lengths.count(length)
            first = used[length]
            used[length] = first + times * fill.bins
            rows.append((length, first, used[length], times, sequence, offset))
            offset += times * length
        sequence += fill.bins
    return rows


def pack(numbered: DataFrame, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """Give each row of a stored table of pieces its ``sequence_id`` and ``offset``.

    ``numbered`` has ``length`` and, of each piece, ``_task`` and ``_nth``: its
    number, without gaps, among those of one task and length.  What reaches the
    driver is one count per length, and what is broadcast is the list of
    intervals: both bounded by ``capacity``, not by the data.  The counts of tasks
    are a table; Spark broadcasts it below the session's bound.
    """
    spark = numbered.sparkSession
    sizes = stored(numbered.groupBy("length", "_task").agg(F.count("*").alias("_n")), "sizes")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(places(plan_bins(counts, capacity)), "length long, _first long, _end long, _times long, _seq long, _off long")
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy("length").orderBy("_task")) - F.col("_n")).drop("_n")
    ranked = numbered.join(stored(before, "numbers"), ["length", "_task"]).withColumn("_rank", F.col("_before") + F.col("_nth"))
    within = F.col("_rank") - F.col("_first")
    placed = ranked.alias("p").join(F.broadcast(plan.alias("q")), (F.col("p.length") == F.col("q.length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
    return placed.select(
        *[F.col(f"p.{c}") for c in numbered.columns if c not in ("_task", "_nth")],
        (F.col("_seq") + F.floor(within / F.col("_times"))).cast("long").alias("sequence_id"),
        (F.col("_off") + within % F.col("_times") * F.col("p.length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = SEQUENCE_TOKENS, vocabulary: str = "byte_bpe_50k.json", keep_ids: bool = False) -> DataFrame:
    """Cut, store, plan and place; ``keep_ids`` adds each piece's token ids."""
    return pack(stored(_cut(docs, capacity, vocabulary, SEPARATOR, keep_ids), "pieces"), capacity)
