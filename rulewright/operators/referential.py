"""Referential checks with Bloom filters on both sides: rows whose key the other side lacks.

The exact way is an anti-join, which moves the rows of both sides.  Filters of bits keep home what need not go:

* a row whose key is not in the filter of the other side's keys has no partner,
  for certain: it is a fault at once and is not moved;
* of the other side, only keys in the filter of the rows that are left can
  matter: those alone are moved.

What is left meets in an exact anti-join, so a key that a filter lets through by chance costs
a row in an exchange and never changes the result.  A filter is an aggregate: every
key sets ``HASHES`` bits, words of 64 bits are combined by ``bit_or`` in tasks and then over all,
and one row with the array of words becomes a scalar subquery of the scan.  Its size follows the
number of keys up to ``MOST_BITS`` (512 kB); beyond that more keys pass.

``faults`` asks for keys only, of integers, in both directions.  There a set of keys is words of 64 bits (``key_words``): the
key's upper part names the word, aggregates before the exchange combine words by ``bit_or``.  Dense keys
take a 64th of the rows, sparse ones a row each as before.  Words are written once and filtered by Bloom filters of both
sides; those of both sides meet in one join, which gives what each side lacks.  Beyond ``TASK_ROWS`` words
a side both are dealt by word to as many tasks as that takes: no word comes twice, so none is hot, and a task
gets no more of them the larger the tables are.

Special cases: a null key refers to nothing and is no fault; keys compare by value, so repeated
partners are one; with an empty other side every key is a fault; all columns of the rows pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import shared_folder

HASHES = 2
BITS_PER_KEY = 16
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 22
#: Words of a side that one task sorts and compares.
TASK_ROWS = 1_000_000


def filter_bits(keys: int) -> int:
    """The size of a filter: a power of two with some ``BITS_PER_KEY`` bits a key, within bounds."""
    bits = LEAST_BITS
    while bits < MOST_BITS and bits < keys * BITS_PER_KEY:
        bits *= 2
    return bits


def _place(key: Column, bits: int, k: int) -> Column:
    return F.xxhash64(F.lit(k), key).bitwiseAND(F.lit(bits - 1))


def bloom(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """One row with the filter of a column, an array of ``bits / 64`` words."""
    places = keys.where(F.col(column).isNotNull()).select(F.explode(F.array(*[_place(F.col(column), bits, k) for k in range(HASHES)])).alias("place"))
    words = places.groupBy(F.shiftright("place", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("word"))
    every = keys.sparkSession.range(bits // 64).withColumnRenamed("id", "at").join(words, "at", "left")
    listed = F.sort_array(F.collect_list(F.struct("at", F.coalesce("word", F.lit(0).cast("long")).alias("word"))))
    return every.agg(F.transform(listed, lambda x: x["word"]).alias("words"))


def may_contain(words: Column, key: Column, bits: int) -> Column:
    """Whether all bits of a key are set in a filter; false for null."""
    hit = lambda p: F.call_function("shiftright", F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    # a subquery may not stand inside an array function, so each place is an expression of its own
    return key.isNotNull() & reduce(lambda a, k: a & hit(_place(key, bits, k)), range(HASHES), F.lit(True))


def _dealt(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Rows dealt by key to tasks of some ``TASK_ROWS``, if ``most`` rows are too many for one."""
    return rows.repartition(-(-most // TASK_ROWS), key) if most > TASK_ROWS else rows


def missing(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """The rows whose key is not null and not among the other side's keys."""
    kind = rows.schema[key].dataType
    partners = others.select(F.col(other_key).cast(kind).alias("_rw_partner")).where("_rw_partner is not null")
    bits = filter_bits(partners.count())
    known = bloom(partners, "_rw_partner", bits).scalar()
    asked = rows.where(F.col(key).isNotNull())
    passes = may_contain(known, F.col(key), bits)
    certain, left = asked.where(~passes), asked.where(passes)
    # the keys that are left ask for partners; their filter is bounded as well
    mine = filter_bits(asked.count())
    wanted = bloom(left.select(key), key, mine).scalar()
    near = partners.where(may_contain(wanted, F.col("_rw_partner"), mine)).distinct()
    return certain.unionByName(left.join(near, F.col(key) == F.col("_rw_partner"), "left_anti"))


def key_words(rows: DataFrame, key: str) -> DataFrame:
    """(at, bits) of the distinct keys of a column: ``bits`` has those from 64 * at on."""
    keys = rows.select(F.col(key).cast("long").alias("key")).where("key is not null")
    return keys.groupBy(F.expr("shiftright(key, 6)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(key & 63 as int)))").alias("bits"))


def _written(words: DataFrame) -> DataFrame:
    out = shared_folder(words.sparkSession, "keys")
    words.write.parquet(out)
    return words.sparkSession.read.schema(words.schema).parquet(out)


def faults(relations: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(relation, fault, key) of (name, children, key, parents, key): keys of children without a parent, and of parents that no child names."""
    out = []
    for name, children, child, parents, parent in relations:
        sides = [_written(key_words(children, child)), _written(key_words(parents, parent))]
        counts = [side.count() for side in sides]
        bits = [filter_bits(n) for n in counts]
        filters = [bloom(side, "at", n) for side, n in zip(sides, bits, strict=True)]
        passes = [may_contain(filters[1 - k].scalar(), F.col("at"), bits[1 - k]) for k in range(2)]
        # words that the other side lacks for certain hold faults only; the others meet
        alone = [side.where(~passed) for side, passed in zip(sides, passes, strict=True)]
        left = [_dealt(side.where(passed), "at", max(counts)) for side, passed in zip(sides, passes, strict=True)]
        both = left[0].withColumnRenamed("bits", "mine").join(left[1].withColumnRenamed("bits", "theirs"), "at", "full")
        mine, theirs = (F.coalesce(c, F.lit(0).cast("long")) for c in ("mine", "theirs"))
        met = both.select("at", mine.bitwiseAND(F.bitwise_not(theirs)).alias("dangling"), theirs.bitwiseAND(F.bitwise_not(mine)).alias("unreferenced"))
        none = F.lit(0).cast("long")
        lone = alone[0].select("at", F.col("bits").alias("dangling"), none.alias("unreferenced")).unionByName(alone[1].select("at", none.alias("dangling"), F.col("bits").alias("unreferenced")))
        kinds = F.explode(F.array(*[F.struct(F.lit(fault).alias("fault"), F.col(fault).alias("bits")) for fault in ("dangling", "unreferenced")])).alias("x")
        found = lone.unionByName(met).select("at", kinds).where("x.bits != 0")
        places = F.explode(F.expr("filter(sequence(0, 63), i -> shiftright(x.bits, i) & 1L = 1L)")).alias("place")
        keys = found.select("at", "x.fault", places).select("fault", F.expr("shiftleft(at, 6) | place").alias("key"))
        out.append(keys.select(F.lit(name).alias("relation"), "fault", "key"))
    return reduce(DataFrame.unionByName, out)
