import random
import re

import pytest
from pyspark.sql import functions as F

from rulewright.operators import referential


def test_missing_is_the_anti_join(spark):
    rng = random.Random(6)
    children = [(k, rng.choice([None, rng.randint(0, 400)]), f"c{k}") for k in range(900)]
    for parents in ([], [3, 3, None], [rng.randint(0, 300) for _ in range(500)], list(range(401))):
        kids = spark.createDataFrame(children, "id int, ref long, ref_name string")
        known = spark.createDataFrame([(p,) for p in parents], "key int")
        got = sorted(tuple(r) for r in referential.missing(kids, "ref", known, "key").collect())
        assert got == sorted(c for c in children if c[1] is not None and c[1] not in set(parents))


@pytest.mark.parametrize("most", [64, 1 << 22])
def test_a_full_filter_changes_no_rows(spark, monkeypatch, most):
    """With 64 bits for 300 keys nearly all pass."""
    monkeypatch.setattr(referential, "LEAST_BITS", 64)
    monkeypatch.setattr(referential, "MOST_BITS", most)
    kids = spark.range(0, 600).selectExpr("cast(id as string) as ref")
    known = spark.range(0, 1200, 4).selectExpr("cast(id as string) as key")
    assert {int(r.ref) for r in referential.missing(kids, "ref", known, "key").collect()} == {k for k in range(600) if k % 4}


def test_filters_have_no_misses_and_few_false_hits(spark):
    keys = spark.range(0, 5000).selectExpr("id * 7919 as key")
    bits = referential.filter_bits(5000)
    words = referential.bloom(keys, "key", bits)
    assert bits == 1 << 17 and len(words.first().words) == bits // 64
    inside = spark.range(0, 20000).select((F.col("id") * 7919).alias("key")).select(referential.may_contain(words.scalar(), F.col("key"), bits).alias("hit"), (F.col("key") < 5000 * 7919).alias("own"))
    counts = {(r.own, r.hit): r["count"] for r in inside.groupBy("own", "hit").count().collect()}
    assert counts[True, True] == 5000 and (True, False) not in counts and counts[False, True] < 600
    assert referential.filter_bits(0) == referential.LEAST_BITS and referential.filter_bits(10**9) == referential.MOST_BITS
    assert spark.range(1).select(referential.may_contain(words.scalar(), F.lit(None).cast("long"), bits)).first()[0] is False


def test_rows_are_filtered_before_they_are_moved(spark, tmp_path):
    spark.range(0, 1000).selectExpr("id as ref", "'x' as pad").write.parquet(str(tmp_path / "kids"))
    spark.range(0, 1000, 3).selectExpr("id as key").write.parquet(str(tmp_path / "known"))
    plan = referential.missing(spark.read.parquet(str(tmp_path / "kids")), "ref", spark.read.parquet(str(tmp_path / "known")), "key")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    # the rows that are compared come from a filter that asks a bit table, and so do their partners
    joined = next(k for k, x in enumerate(lines) if "Join LeftAnti" in x)
    assert re.search(r"Filter [^\n]*scalar-subquery", lines[joined + 1]) and "ref#" in lines[joined + 1]
    assert any(re.search(r"Filter [^\n]*scalar-subquery", x) and "key#" in x for x in lines[joined + 2 :])


def test_faults_of_both_sides(spark):
    kids = spark.createDataFrame([(1,), (1,), (7,), (None,)], "ref int")
    known = spark.createDataFrame([(1,), (2,), (2,)], "key long")
    got = sorted(map(tuple, referential.faults([("r", kids, "ref", known, "key")]).collect()))
    assert got == [("r", "dangling", 7), ("r", "unreferenced", 2)]


def test_faults_of_keys_of_all_sizes(spark):
    rng = random.Random(9)
    pool = [-(2**63), 2**63 - 1, -1, 0, 63, 64, -64, -65, *(rng.randint(-300, 300) for _ in range(200)), *(rng.randint(-(2**62), 2**62) for _ in range(200))]
    kids, known = ([rng.choice([None, *pool]) for _ in range(300)] for _ in range(2))
    frames = [spark.createDataFrame([(k,) for k in side], "key long") for side in (kids, known)]
    a, b = ({k for k in side if k is not None} for side in (kids, known))
    want = sorted([("r", "dangling", k) for k in a - b] + [("r", "unreferenced", k) for k in b - a])
    assert sorted(map(tuple, referential.faults([("r", frames[0], "key", frames[1], "key")]).collect())) == want
    empty = spark.createDataFrame([], "key long")
    assert sorted(r.key for r in referential.faults([("r", empty, "key", frames[1], "key")]).collect()) == sorted(b)


def test_dense_keys_meet_as_few_rows(spark, monkeypatch):
    """What meets and what a task sorts follows the words, and tasks get no more for larger tables."""
    kids, known = spark.range(0, 64_000), spark.range(640, 64_640)
    assert referential.key_words(kids, "id").count() == 1000
    want = sorted([("r", "dangling", k) for k in range(640)] + [("r", "unreferenced", k) for k in range(64_000, 64_640)])
    monkeypatch.setattr(referential, "TASK_ROWS", 100)
    found = referential.faults([("r", kids, "id", known, "id")])
    assert sorted(map(tuple, found.collect())) == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [at#") == 2
