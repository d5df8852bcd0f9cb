"""Audit of how sources differ: exact vocabularies, an automaton's counts, sparse postings.

A term is a run of letters or of other characters outside ASCII, A-Z in lower
case.  Each language keeps the terms that stand in at least ``LEAST_DOCUMENTS``
of its documents (rows).  Every source of a language, and the language itself,
gives a kept term a smoothed share ``p`` in whole billionths, and two of them
differ in it by ``f = floor((p - q)**2 / q)``.

1. First pass: document frequencies of every term of every language, summed in
   tasks before they are exchanged.
2. Second pass: an automaton of kept terms, each between two delimiters, runs
   over every text with delimiters for all that is no term.  It holds the
   ``AUTOMATON_TERMS`` kept terms of most documents that have at most ``AUTOMATON_BYTES``
   bytes, a bounded part of any vocabulary.  Only if there are further kept terms,
   the words that the automaton passed over are counted by name, after a
   bit table of bounded size; those of them that are kept join the rest.
3. Postings are (term, source, count) with counts above 0.  What a pair of sources
   adds up to is put together from them: a term of both costs one value for the
   pair; a term of one of them meets the other's share of an absent term, the same
   for all such terms, so it is enough to know how many terms have which count; terms of neither are counted only.
4. Pairs are ranked within a source; terms against their language, 200 a source.

Shares and values are whole numbers, so nothing depends on the order of rows.

Special cases: null texts, languages and sources are empty strings; a source
without any term is a group like others; repeated rows and rows that share an id are
documents of their own; a language without kept terms gives pairs of value 0 and no terms;
an empty table gives no rows; ties are ranked by item, as UTF-8.
"""

from __future__ import annotations

from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import HashFilter, WordHashes, binary_column, hash_filter, map_arrow, prepare, release, stored

#: Fixed by the contract.
LEAST_DOCUMENTS = 3
UNIT = 1_000_000_000
MOST_RANKS = 200
#: Bounds of the automaton: some 10 MB in a worker, which much of a text's words pass in the processor's cache.
AUTOMATON_TERMS = 20_000
AUTOMATON_BYTES = 40
#: Bytes of texts whose words are counted at once, and counts that a task holds before it hands them on.
CHUNK_BYTES = 1 << 24
HELD = 1_000_000
#: Pairs of postings that are evaluated at once.
PAIRS = 1 << 20

_SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("id", pa.int32()), ("term", pa.string()), ("n", pa.int64())])
_COUNTS_DDL = "lang string, source string, id int, term string, n long"


def _plain(docs: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(empty("lang"), empty("source"), "text")


def _tally(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each occurs, or the sums of ``n``."""
    order = None if n is None else np.argsort(keys, kind="stable")
    keys = np.sort(keys) if n is None else keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.empty(0, np.int64)
    if n is None:
        return keys[first], np.diff(first, append=len(keys))
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n


class Counts:
    """Counts of (group, word) that a task holds: words by number in one part, by name in the other."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.start()

    def start(self) -> None:
        self.numbered = (np.empty(0, np.int64), np.empty(0, np.int64))  # group << 32 | number
        self.named: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.size = 0

    def group(self, lang: str, source: str) -> int:
        return self.groups.setdefault((lang, source), len(self.groups))

    def add_numbers(self, keys: np.ndarray) -> None:
        keys, n = _tally(keys)
        self.numbered = _tally(np.concatenate([self.numbered[0], keys]), np.concatenate([self.numbered[1], n.astype(np.int64)]))

    def add_names(self, group: np.ndarray, words: pa.Array) -> None:
        """One for each word of the group beside it."""
        self._merge([(group, words, None)])

    def _merge(self, parts: list) -> None:
        words = pa.concat_arrays([w for _, w, _ in parts]).dictionary_encode()
        size = max(1, len(words.dictionary))
        keys = np.concatenate([g for g, _, _ in parts]).astype(np.int64) * size + words.indices.to_numpy()
        keys, n = _tally(keys, None if parts[0][2] is None else np.concatenate([n for _, _, n in parts]))
        self.named.append((keys // size, words.dictionary.take(pa.array(keys % size)), n.astype(np.int64)))
        self.size = sum(len(g) for g, _, _ in self.named)

    def full(self) -> bool:
        if self.size > HELD and len(self.named) > 1:
            parts, self.named = self.named, []
            self._merge(parts)
        return self.size + len(self.numbered[0]) > HELD

    def hand_on(self):
        """What is held, as batches; nothing is held then."""
        langs, sources = ([k[j] for k in self.groups] for j in (0, 1))

        def batch(group: np.ndarray, numbers: np.ndarray, words: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            at = pa.array(group)
            names = [pa.array(x, pa.string()).take(at) for x in (langs, sources)]
            return pa.RecordBatch.from_arrays([*names, pa.array(numbers.astype(np.int32)), words, pa.array(n)], schema=_COUNTS)

        for at in range(0, len(self.numbered[0]), 1 << 16):
            keys, n = (x[at : at + (1 << 16)] for x in self.numbered)
            yield batch(keys >> 32, keys & 0xFFFFFFFF, pa.array([""]).take(pa.array(np.zeros(len(keys), np.int64))), n)
        if self.named:
            parts, self.named = self.named, []
            self._merge(parts)
            group, words, n = self.named[0]
            for at in range(0, len(group), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield batch(group[part], np.full(len(group[part]), -1), words[part], n[part])
        self.start()


def _chunks(batches, names: tuple[str, ...]):
    """Lists of (names..., bytes of a text in lower case, with spaces for all that is no term), of some ``CHUNK_BYTES`` each."""
    rows, size = [], 0
    for batch in batches:
        keys = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]
        for k, text in enumerate(binary_column(batch, "text")):
            rows.append((*(c[k] for c in keys), text.translate(_SPACED) if text else b""))
            size += len(rows[-1][-1])
            if size >= CHUNK_BYTES or len(rows) >= 1 << 16:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _words(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """(number of the text, word) of every word."""
    split = pc.ascii_split_whitespace(pa.array([t.strip() for t in texts], pa.string()))
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    words = split.flatten()
    shown = pc.greater(pc.binary_length(words), 0)
    return owner[shown.to_numpy(zero_copy_only=False)], words.filter(shown)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, n): in how many documents of its language each term stands."""

    def run(batches):
        held = Counts()
        for rows in _chunks(batches, ("lang",)):
            owner, words = _words([r[-1] for r in rows])
            if len(owner):
                words = words.dictionary_encode()
                size = len(words.dictionary)
                once, _ = _tally(owner * size + words.indices.to_numpy())
                lang = np.fromiter((held.group(r[0], "") for r in rows), np.int64, len(rows))
                held.add_names(lang[once // size], words.dictionary.take(pa.array(once % size)))
            if held.full():
                yield from held.hand_on()
        yield from held.hand_on()
        release()

    return _plain(docs).select("lang", "text").mapInArrow(run, _COUNTS_DDL).groupBy("lang", "term").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The bounded part of the kept terms that an automaton finds, and a bit table of those beyond it."""

    def __init__(self, terms: list[str], rest: HashFilter | None):
        self.terms, self.rest = terms, rest

    def automaton(self) -> ahocorasick.Automaton:
        """Over bytes, each as the character of its number, so that places are those of bytes."""
        out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, term in enumerate(self.terms):
            out.add_word(f" {term} ".encode().decode("latin-1"), k)
        out.make_automaton()
        return out


def kept_vocabulary(kept: DataFrame, most: int, longest: int) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of (lang, term, n), and a stored table (lang, id, term) of the automaton's terms by language."""
    every = stored(kept.groupBy("term").agg(F.sum("n").alias("n")), "terms")
    short = every.where(F.octet_length("term") <= longest)
    head = stored(short.orderBy(F.desc("n"), "term").limit(most), "head")
    terms = sorted((r["term"] for r in head.select("term").collect()), key=str.encode)  # AUTOMATON_TERMS of AUTOMATON_BYTES at most
    number = F.row_number().over(W.orderBy(F.col("term").cast("binary"))) - 1  # of so many rows
    numbers = stored(head.select("term", number.alias("id")), "numbers")
    rest = every.join(numbers, "term", "left_anti").select("term")
    hashed = lambda batch: {"h": np.fromiter(map(xxhash.xxh64_intdigest, binary_column(batch, "term")), np.uint64, batch.num_rows).view(np.int64)}
    rest = stored(map_arrow(rest, hashed, pa.schema([("h", pa.int64())]), "h long"), "beyond")
    vocabulary = Vocabulary(terms, None if rest.isEmpty() else hash_filter(rest))
    return vocabulary, stored(kept.select("lang", "term").join(numbers, "term").select("lang", "id", "term"), "found-terms")


def _passed_over(text: bytes, ends: np.ndarray) -> list[bytes]:
    """The words of a text, which begins and ends with a space, that end at none of ``ends``."""
    space = np.frombuffer(text, np.uint8) == 32
    stops = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    if len(stops) == len(ends):
        return []
    begins = np.flatnonzero(~space[1:] & space[:-1]) + 1
    missed = ~np.isin(stops, ends, assume_unique=True, kind="sort")
    return [text[a:b] for a, b in zip(begins[missed].tolist(), stops[missed].tolist(), strict=True)]


def occurrences(docs: DataFrame, kept: DataFrame, most: int = AUTOMATON_TERMS, longest: int = AUTOMATON_BYTES) -> DataFrame:
    """(lang, source, term, n): how often each kept term of its language stands in the texts of a source, where it does."""
    vocabulary, numbers = kept_vocabulary(kept, most, longest)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        automaton, rest, hashes = shared.value.automaton(), shared.value.rest, WordHashes()
        held = Counts()
        for rows in _chunks(batches, ("lang", "source")):
            numbered, owners, others = [np.empty(0, np.int64)], [], []
            for lang, source, text in rows:
                text = b" " + text + b" "
                group = held.group(lang, source)
                pairs = np.fromiter(chain.from_iterable(automaton.iter(text.decode("latin-1"))), np.int64) if len(automaton) else numbered[0]
                numbered.append((group << 32) + pairs[1::2])
                if rest is not None:
                    words = _passed_over(text, pairs[::2])
                    others += words
                    owners.append(np.full(len(words), group))
            held.add_numbers(np.concatenate(numbered))
            if others:
                words, owner = pa.array(others, pa.string()).dictionary_encode(), np.concatenate(owners)
                may = rest(hashes.of(words.dictionary.cast(pa.binary()).to_pylist()))[words.indices.to_numpy()]
                held.add_names(owner[may], words.filter(pa.array(may)).dictionary_decode())
            if held.full():
                yield from held.hand_on()
        yield from held.hand_on()
        release()

    counted = stored(_plain(docs).mapInArrow(run, _COUNTS_DDL).groupBy("lang", "source", "id", "term").agg(F.sum("n").alias("n")), "counted")
    found = counted.where("id >= 0").drop("term").join(numbers, ["lang", "id"]).select("lang", "source", "term", "n")
    return found if vocabulary.rest is None else found.unionByName(counted.where("id < 0").drop("id").join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n"))


def share(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + size)), exactly: in whole longs while they hold it, else in decimals."""
    below = F.greatest(total + size, F.lit(1))
    wide = (n.cast("decimal(20,0)") + 1).cast("decimal(28,0)") * F.lit(UNIT).cast("decimal(10,0)")
    exact = F.call_function("div", wide, below.cast("decimal(28,0)")).cast("long")
    return F.when(n < 9_000_000_000, F.call_function("div", (n + 1) * F.lit(UNIT).cast("long"), below)).otherwise(exact) + 1


def difference(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q): the square stays below 2**63, as shares are at most UNIT + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _pairs_of_terms(batches):
    """(lang, a, b, value) sums over the lists of a batch, in blocks of ``PAIRS`` pairs."""
    for batch in batches:
        lists = batch.column(1)
        m = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        source, lang = flat.field("source").dictionary_encode(), batch.column(0).dictionary_encode()
        at, tongue = source.indices.to_numpy().astype(np.int64), np.repeat(lang.indices.to_numpy().astype(np.int64), m)
        p, zero = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("p", "p0"))
        size, first, n = np.repeat(m, m), np.repeat(np.cumsum(m) - m, m), len(source.dictionary)
        upto = np.cumsum(size)
        keys, values, a = np.empty(0, np.int64), np.empty(0, np.int64), 0
        while a < len(at):
            done = upto[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(upto, done + PAIRS, side="right")))
            one = np.repeat(np.arange(a, b), size[a:b])
            other = first[one] + np.arange(len(one)) - (upto[one] - size[one] - done)
            one, other = one[one != other], other[one != other]
            value = _f(p[one], p[other]) - _f(p[one], zero[other]) - _f(zero[one], p[other]) + _f(zero[one], zero[other])
            more = _tally((tongue[one] * n + at[one]) * n + at[other], value)
            keys, values = _tally(np.concatenate([keys, more[0]]), np.concatenate([values, more[1]]))
            a = b
        names = source.dictionary
        yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(keys // (n * n) if n else keys)), names.take(pa.array(keys // max(n, 1) % max(n, 1))), names.take(pa.array(keys % max(n, 1))), pa.array(values)], ["lang", "a", "b", "value"])


def term_differences(entries: DataFrame, ranks: int) -> DataFrame:
    """Of (lang, term, q, source, p): the terms that a source has more often than its language, the first ``ranks`` of each source."""
    value = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    return value.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= ranks)


def pair_differences(terms: DataFrame, shares: DataFrame, groups: DataFrame) -> DataFrame:
    """Every source against every other one of its language, over all kept terms.

    The rows of (source, source) are the result itself; no table has a row for each term of each pair.
    """
    lists = terms.where("size(entries) > 1").select("lang", "entries")
    both = stored(lists.mapInArrow(_pairs_of_terms, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "both")
    # against an absent term all terms of one share are alike
    zeros = groups.select("lang", F.col("p0").alias("zero")).distinct()
    k = F.col("k").cast("decimal(20,0)")
    absent = shares.join(zeros, "lang").groupBy("lang", "source", "zero").agg(F.sum(k * difference(F.col("p"), F.col("zero"))).alias("here"), F.sum(k * difference(F.col("zero"), F.col("p"))).alias("there"), F.sum("k").alias("terms"))
    absent = stored(absent, "absent")
    a, b = groups.alias("a"), groups.alias("b")
    pairs = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source"))).select("a.lang", "a.source", F.col("b.source").alias("item"), F.col("a.v").alias("v"), F.col("a.p0").alias("zero_a"), F.col("b.p0").alias("zero_b"))

    def side(prefix: str, owner: str, zero: str, value: str, out: DataFrame) -> DataFrame:
        of = absent.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), F.col("zero").alias("_z"), F.col(value).alias(f"{prefix}_value"), F.col("terms").alias(f"{prefix}_terms"))
        return out.join(of, (F.col("lang") == F.col("_l")) & (F.col(owner) == F.col("_s")) & (F.col(zero) == F.col("_z")), "left").drop("_l", "_s", "_z")

    pairs = side("b", "item", "zero_a", "there", side("a", "source", "zero_b", "here", pairs))
    pairs = pairs.join(both.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value"), ["lang", "source", "item"], "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,0)")
    neither = (F.col("v") - none("a_terms") - none("b_terms")).cast("decimal(20,0)") * F.coalesce(difference(F.col("zero_a"), F.col("zero_b")), F.lit(0))
    total = none("value") + none("a_value") + none("b_value") + F.when(F.col("v") > 0, neither).otherwise(F.lit(0))
    out = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", total.cast("long").alias("value"))
    return out.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame, ranks: int = MOST_RANKS, most: int = AUTOMATON_TERMS, longest: int = AUTOMATON_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources, and terms of sources."""
    prepare(docs.sparkSession)
    kept = stored(document_frequencies(docs).where(F.col("n") >= LEAST_DOCUMENTS), "kept")
    counts = stored(occurrences(docs, kept, most, longest), "postings")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    sizes = stored(kept.groupBy("lang").agg(F.count("*").alias("v")), "sizes")
    by_count = stored(counts.groupBy("lang", "source", "n").agg(F.count("*").alias("k")), "counts")  # how many terms a source has how often
    of_source = by_count.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("k")).alias("total"))
    groups = _plain(docs).select("lang", "source").distinct().join(of_source, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", zero("total").alias("total"), zero("v").alias("v"))
    groups = stored(groups.withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("v"))), "groups")
    own = lambda rows: rows.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
    terms = own(counts).groupBy("lang", "term").agg(F.sum("n").alias("n"), F.collect_list(F.struct("source", "p", "p0")).alias("entries"))  # an entry for each source of the language
    terms = stored(terms, "term-lists")
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v"))
    entries = terms.join(of_lang, "lang").select("lang", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("q"), F.inline("entries"))
    return pair_differences(terms, own(by_count), groups).unionByName(term_differences(entries, ranks))
