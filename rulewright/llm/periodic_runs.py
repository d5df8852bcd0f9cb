"""Periodic runs of words by branching tandem repeats in a suffix tree.

A run is a longest stretch of consecutive words in which words ``q`` apart are
the same, ``q`` being its least period, of at least ``LEAST_WORDS`` words and two periods.
For every text, in the task that has it:

1. The suffix tree of its words: suffixes in order by doubled prefixes (only those
   that still tie are sorted again), lengths of common prefixes, and from these
   the inner nodes as intervals of the order, each with its largest child.
2. Stoye and Gusfield's search: at each node of depth ``d`` the leaves outside
   the largest child are listed, so a leaf is listed for O(log n) nodes.  A listed
   leaf ``i`` and the leaf ``i + d`` (or ``i - d``) below the same node, which go on
   with different words, are a branching tandem repeat.
3. A branching repeat is the last one of its run.  Rotating it to the left as long
   as words allow gives the run; repeats that rotate to the same run are merged,
   of which the least period stays.

A run repeats ``LEAST_WORDS - q`` and at least ``q`` words at distance ``q``, so half of ``LEAST_WORDS``
words stand twice in the text.  Texts in which no such window of words
stands twice have no run and get no tree.

Memory and time are of one text: some 200 bytes and 3 microseconds a word.
No rows are exchanged.

Special cases: a null text has no words and no run; rows are judged one by one,
so equal rows give equal results and a null id is an id like others; ends of
runs may overlap, and a word may be in several runs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, binary_column, map_arrow, prepare, window_hashes

#: Fixed by the contract.
LEAST_WORDS = 12
#: Leaves that are listed at once.
LISTED = 1 << 20
#: Bytes of texts whose results make one batch.
BATCH_BYTES = 1 << 22

Run = tuple[int, int, int]
Words = Callable[[int | None, bytes | None], list[bytes]]


def plain_words(doc_id: int | None, text: bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text."""
    return text.split() if text else []


def suffix_order(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the suffixes of non-negative numbers; the end sorts before all."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    first = np.flatnonzero(np.diff(s[order], prepend=-1))
    size = np.diff(first, append=n)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, size)  # the first place of all that tie
    tied = order[np.repeat(size > 1, size)]
    length = 1
    while len(tied):
        ahead = tied + length
        key = rank[tied] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        o = np.argsort(key, kind="stable")
        tied, key = tied[o], key[o]
        group, index = rank[tied], np.arange(len(tied))
        start = np.maximum.accumulate(np.where(np.diff(group, prepend=-1) != 0, index, 0))
        new = np.diff(key, prepend=-1) != 0
        inner = np.maximum.accumulate(np.where(new, index, 0))
        order[group + index - start] = tied
        rank[tied] = group + inner - start
        tied = tied[~(new & np.append(new[1:], True))]
        length *= 2
    return order, rank


def common_prefixes(s: np.ndarray, order: np.ndarray, rank: np.ndarray) -> list[int]:
    """Of each suffix, in order, the length that it shares with the one before it."""
    words, before = [*s.tolist(), -1], order.tolist()
    out, h = [0] * len(s), 0
    for i, r in enumerate(rank.tolist()):
        if r:
            j = before[r - 1]
            while words[i + h] == words[j + h]:
                h += 1
            out[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return out


def inner_nodes(shared: list[int]) -> np.ndarray:
    """Inner nodes but the root: rows of depth, first and last leaf, first and last leaf of the largest child."""
    out: list[list[int]] = []
    stack = [[0, 0, 0, -1, -1]]
    for r in range(1, len(shared) + 1):
        depth = shared[r] if r < len(shared) else 0
        top = stack[-1]
        if depth > top[0]:
            stack.append([depth, r - 1, 0, r - 1, r - 1])
            continue
        while depth < top[0]:
            stack.pop()
            top[2] = r - 1
            out.append(top)
            up = stack[-1]
            if up[0] < depth:
                up = [depth, top[1], 0, top[1], r - 1]
                stack.append(up)
            elif up[0] and r - 1 - top[1] > up[4] - up[3]:
                up[3], up[4] = top[1], r - 1
            top = up
    return np.array(out, np.int64).reshape(-1, 5)


def branching_repeats(s: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every branching tandem repeat that may end a run of ``least`` words."""
    n = len(s)
    order, rank = suffix_order(s)
    nodes = inner_nodes(common_prefixes(s, order, rank))
    if not len(nodes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.append(s, -1)
    left = nodes[:, 3] - nodes[:, 1]
    listed = left + nodes[:, 2] - nodes[:, 4]
    upto = np.cumsum(listed)
    starts, periods, a = [], [], 0
    while a < len(nodes):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + LISTED, side="right")))
        node = np.repeat(np.arange(a, b), listed[a:b])
        k = np.arange(len(node)) - np.repeat(upto[a:b] - listed[a:b] - (upto[a - 1] if a else 0), listed[a:b])
        leaf = np.where(k < left[node], nodes[node, 1] + k, nodes[node, 4] + 1 + k - left[node])
        i, d = order[leaf], nodes[node, 0]
        low, high = nodes[node, 1], nodes[node, 2]
        for start, other in ((i, i + d), (i - d, i - d)):
            inside = (other >= 0) & (other < n)
            at = rank[np.clip(other, 0, n - 1)]
            inside &= (at >= low) & (at <= high)
            p, q = start[inside], d[inside]
            branches = ends[p + q] != ends[p + 2 * q]
            starts.append(p[branches])
            periods.append(q[branches])
        a = b
    start, period = np.concatenate(starts), np.concatenate(periods)
    # short ones must rotate far enough to the left
    ok = np.ones(len(start), bool)
    for t in range(1, least - 1):
        todo = np.flatnonzero(ok & (2 * period + t <= least))
        p, q = start[todo] - t, period[todo]
        ok[todo] = (p >= 0) & (s[np.maximum(p, 0)] == s[np.maximum(p, 0) + q])
    both = np.unique(start[ok] * (n + 1) + period[ok])
    return both // (n + 1), both % (n + 1)


def rotated(s: np.ndarray, start: int, period: int) -> int:
    """Where the run begins that the repeat at ``start`` ends."""
    step = 64
    while start:
        a = max(0, start - step)
        differ = np.flatnonzero(s[a:start] != s[a + period : start + period])
        if len(differ):
            return a + int(differ[-1]) + 1
        start, step = a, step * 2
    return 0


def runs_of(s: np.ndarray, least: int = LEAST_WORDS) -> list[Run]:
    """(start, length, period) of every run of numbers, by start, then period."""
    if len(s) < least:
        return []
    start, period = branching_repeats(s, least)
    found: dict[int, list[tuple[int, int]]] = {}
    for k in np.lexsort((period, start + 2 * period)).tolist():
        p, q = int(start[k]), int(period[k])
        known = found.setdefault(p + 2 * q, [])
        # a repeat inside a run of a divisor of its period is that run
        if not any(q % shorter == 0 and begin <= p for begin, shorter in known):
            known.append((rotated(s, p, q), q))
    return sorted((begin, end - begin, q) for end, several in found.items() for begin, q in several)


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal ones alike."""
    table: dict[bytes, int] = {}
    return np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, len(words))


def word_runs(words: list[bytes], hashes: WordHashes, least: int = LEAST_WORDS) -> list[Run]:
    """The runs of a text, which gets a tree only if some window of half of ``least`` words stands twice."""
    if len(words) < least:
        return []
    windows = np.sort(window_hashes(hashes.of(words), least // 2))
    return runs_of(numbered(words), least) if (windows[1:] == windows[:-1]).any() else []


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those of any run behind its first period."""
    out, at = [], 0
    for a, b in sorted((start + q, start + length) for start, length, q in runs):
        out += words[at : max(at, a)]
        at = max(at, b)
    return out + words[at:]


def _longest(runs: list[Run]) -> Run | None:
    return min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None


def document_runs(docs: DataFrame, words: Words = plain_words) -> DataFrame:
    """(doc_id, n_words, runs, start, length, period, exponent_milli, collapsed) of every row.

    ``words`` makes the words of a row from its id and its text; ``start`` to
    ``exponent_milli`` are those of the longest run, null without any.
    """
    prepare(docs.sparkSession)
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    numbers = [(c, pa.int64()) for c in ("start", "length", "period", "exponent_milli")]
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", run), *numbers, ("collapsed", pa.string())])

    def columns(rows: list[tuple]) -> dict:
        return {name: pa.array(part, field.type) for name, part, field in zip(schema.names, zip(*rows, strict=True), schema, strict=True)}

    def each(batch: pa.RecordBatch, hashes: WordHashes):
        rows, size = [], 0
        for doc, text in zip(batch.column(0).to_pylist(), binary_column(batch, "text"), strict=True):
            own = words(doc, text)
            runs = word_runs(own, hashes)
            best = _longest(runs)
            longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            listed = [{"start": s, "length": n, "period": q} for s, n, q in runs]
            rows.append((doc, len(own), listed, *longest, b" ".join(collapsed(own, runs)).decode()))
            size += len(text or b"")
            if size >= BATCH_BYTES:
                yield columns(rows)
                rows, size = [], 0
        if rows:
            yield columns(rows)

    ddl = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, start long, length long, period long, exponent_milli long, collapsed string"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), each, schema, ddl, WordHashes)


def run_digests(docs: DataFrame, words: Words = plain_words) -> DataFrame:
    """The digest of every document: its runs, its longest one, and its collapsed text."""
    found = document_runs(docs, words)
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    listed = F.array_join(F.transform("runs", line), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", "exponent_milli", F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def collapse_documents(docs: DataFrame) -> DataFrame:
    """The documents with every run cut down to its first period; texts without runs stay as they are, byte for byte."""
    prepare(docs.sparkSession)

    def clean(text: str, hashes: WordHashes) -> str:
        words = text.encode().split()
        runs = word_runs(words, hashes)
        return b" ".join(collapsed(words, runs)).decode() if runs else text

    @F.pandas_udf("string")
    def cut(texts):
        hashes = WordHashes()
        return texts.map(lambda t: clean(t, hashes), na_action="ignore")

    return docs.withColumn("text", cut("text")).select(*docs.columns)

