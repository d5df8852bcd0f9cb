import random

import pytest

from rulewright.streaming import repeats
from rulewright.streaming.repeats import settled, stream_repeats

DDL = "event_id long, ts timestamp, user_id long"


def test_settled_rows():
    assert settled([(5, 1), (3, 2), (9, 3)], None, 5) == ([1], [(9, 3)], 5)
    assert settled([(5, 1), (3, 2)], 0, 5) == ([2, 1], [], 5) and settled([(5, 1), (3, 2)], 0, 5, 2) == ([1], [], 5)
    assert settled([(9, 1)], None, 5) == ([], [(9, 1)], None) and settled([], None, 5) == ([], [], None)


@pytest.fixture
def feed(spark, tmp_path):
    """Writes micro-batches as files, runs the stream over what is there, and gives the errors so far."""
    from datetime import datetime, timezone

    def rows(batch):
        return [(i, datetime.fromtimestamp(t, timezone.utc) if t is not None else None, u) for i, t, u in batch]

    def write(batch, number):
        spark.createDataFrame(rows(batch), DDL).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{number:03d}"))

    def run(**kw):
        stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        errors = stream_repeats(stream, "event_id", ("user_id",), "ts", "10 seconds", **kw)
        errors.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema("key long, error string").parquet(str(tmp_path / "out")).collect())

    return write, run


def batch_repeats(rows, until):
    """Keys of rows up to a time that are not the first of their user by time, then key."""
    first, out = set(), []
    for t, i, u in sorted((t, i, u) for i, t, u in rows if t is not None and t <= until):
        if u in first:
            out.append((i, "duplicate user_id"))
        first.add(u)
    return sorted(out)


def test_stream_equals_batch_over_batches_and_a_restart(feed):
    write, run = feed
    rng = random.Random(3)
    rows = [(k, 1000 + 2 * k + rng.randint(-4, 4), rng.choice([1, 2, 3, None, *range(10, 40)])) for k in range(60)]
    for n in range(3):
        write(rows[20 * n : 20 * n + 20], n)
    first = run()
    assert first == batch_repeats(rows, max(t for _, t, _ in rows) - 10) and 10 < len(first)
    # it goes on from its checkpoint; one row is too late, one has no time
    more = [(100, 1130, 1), (101, 1005, 2), (102, None, 3), (103, 1131, 77)]
    write(more, 3)
    end = [(200, 5000, 999)]
    write(end, 4)
    assert run() == batch_repeats([*rows, more[0], more[3], *end], 4990)


def test_identities_are_forgotten_after_the_horizon(feed):
    write, run = feed
    for n, batch in enumerate([[(1, 1000, 7)], [(2, 1020, 7)], [(3, 2000, 8)], [(4, 2100, 7)], [(5, 2110, 7)], [(6, 9000, 9)]]):
        write(batch, n)
    assert run(horizon_ms=500_000) == [(2, "duplicate user_id"), (5, "duplicate user_id")]


def plain_settled(waiting, last, watermark, horizon):
    found = []
    for time, key in sorted(w for w in waiting if w[0] <= watermark):
        if last is not None and (horizon is None or time - last <= horizon):
            found.append(key)
        last = time
    return found, sorted(w for w in waiting if w[0] > watermark), last


@pytest.mark.parametrize("horizon", [None, 7])
def test_many_identities_are_judged_as_each_by_itself(horizon):
    rng = random.Random(8)
    watermark, state, want, kept = 0, None, {}, None
    for batch in range(6):
        late, watermark = watermark, watermark + rng.randint(0, 20)
        new = [(rng.choice("abcdefgh"), rng.randint(late + 1, late + 40), 1000 * batch + k) for k in range(30)]
        rows = repeats._table([n for n, _, _ in new], [t for _, t, _ in new], [k for _, _, k in new])
        found, kept = repeats.settled_rows(rows if state is None else repeats.pa.concat_tables([repeats._unpacked(state), rows]), watermark, horizon)
        expected = []
        for n in "abcdefgh":
            waiting, last = want.get(n, ([], None))
            more, waiting, last = plain_settled(waiting + [(t, k) for m, t, k in new if m == n], last, watermark, horizon)
            expected += more
            want[n] = (waiting, last)
        assert sorted(found.tolist()) == sorted(expected)
        state = repeats._packed(kept)
    waits = sorted((r["name"], r["time"], r["key"]) for r in kept.to_pylist() if not r["judged"])
    assert waits == sorted((n, t, k) for n, (w, _) in want.items() for t, k in w)
    if horizon is None:
        assert {r["name"]: r["time"] for r in kept.to_pylist() if r["judged"]} == {n: last for n, (_, last) in want.items() if last is not None}


def test_identities_share_calls_and_state(feed, spark, tmp_path):
    """A thousand identities in four buckets: the state has four entries, the errors are those of a batch."""
    write, _ = feed
    rows = [(k, 1000 + k // 20, k % 1000) for k in range(3000)]
    write([*rows, (9000, 9000, 5000)], 0)
    stream = spark.readStream.schema(DDL).parquet(str(tmp_path / "in" / "*"))
    query = stream_repeats(stream, "event_id", ("user_id",), "ts", "10 seconds", buckets=4).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 4
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == batch_repeats(rows, 8990)


def test_a_row_at_the_watermark_is_judged(feed):
    """Its identity has no other row that would wake it."""
    write, run = feed
    write([(1, 1000, 1), (2, 2000, 1), (3, 2010, 2)], 0)
    assert run() == [(2, "duplicate user_id")]
    write([(4, 2500, 3), (5, 2500, 3), (6, 2510, 4)], 1)
    assert run() == [(2, "duplicate user_id"), (5, "duplicate user_id")]
