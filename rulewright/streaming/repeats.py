"""Repeated identities on streams: the check that a batch makes with a sort, here with state.

Rows come in any order, up to ``delay`` late.  A row is judged once the watermark has passed its
time, when nothing before it can come any more: of its identity the first row by time, then key, is
right, all others are repeats, as in ``plans.validator.table_errors``.  State of an identity is
what waits for the watermark and its last judged row.  With ``horizon_ms`` a row
that comes later than that behind the row before it is a first one again, whatever the batches
were, and the identity is dropped when its bucket is met again, or when all of the bucket are as old;
without it, as many identities are kept as there are.

Calls of a function and entries of a state cost far more than rows, so identities share them: by a
hash they are dealt to ``buckets``, whose state is one table of rows.  All identities of a bucket are judged
at once by one sort.  They are compared by value, the hash decides nothing else.  A batch writes the buckets that
it meets as a whole, so streams of many small batches over many identities want more of them; a checkpoint keeps its number.

Rows behind the watermark are dropped by the engine and judged by nobody; rows that wait when the
stream stops are judged when it goes on from its checkpoint.  A null part of an identity is a value like others; rows
without a time are never judged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BUCKETS = 1024

_STATE = "rows binary"
#: What a bucket keeps: rows that wait, and of each identity the last one that was judged.
_ROWS = pa.schema([("name", pa.string()), ("judged", pa.bool_()), ("time", pa.int64()), ("key", pa.int64())])


def settled(waiting: list[tuple[int, int]], last: int | None, watermark: int, horizon_ms: int | None = None) -> tuple[list[int], list[tuple[int, int]], int | None]:
    """(keys of repeats, what still waits, time of the last judged row) of one identity once the watermark stands there."""
    rows = _table([""] * len(waiting), [t for t, _ in waiting], [k for _, k in waiting])
    if last is not None:
        rows = pa.concat_tables([rows, pa.table([[""], [True], [last], [0]], schema=_ROWS)])
    repeats, rest = settled_rows(rows, watermark, horizon_ms, forget=False)
    waits, judged = [], last
    for r in rest.to_pylist():
        if r["judged"]:
            judged = r["time"]
        else:
            waits.append((r["time"], r["key"]))
    return repeats.tolist(), waits, judged


def settled_rows(rows: pa.Table, watermark: int, horizon_ms: int | None = None, forget: bool = True) -> tuple[np.ndarray, pa.Table]:
    """(keys of repeats, rows to keep) of many identities once the watermark stands there; ``forget`` drops those beyond the horizon."""
    name = rows["name"].combine_chunks().dictionary_encode().indices.to_numpy()
    judged, time, key = (rows[c].to_numpy() for c in ("judged", "time", "key"))
    order = np.lexsort((key, time, ~judged, name))
    name, judged, time, key = name[order], judged[order], time[order], key[order]
    # of an identity the judged row comes first, then those that are due, then those that wait
    due = judged | (time <= watermark)
    follows = np.zeros(len(order), dtype=bool)
    follows[1:] = name[1:] == name[:-1]
    repeat = due & ~judged & follows
    if horizon_ms is not None:
        repeat[1:] &= time[1:] - time[:-1] <= horizon_ms
    last = due.copy()
    last[:-1] &= ~(follows[1:] & due[1:])
    if horizon_ms is not None and forget:
        last &= time + horizon_ms >= watermark
    kept = last | ~due
    rest = rows.take(pa.array(order[kept]))
    return key[repeat], rest.set_column(1, _ROWS.field("judged"), pa.array(last[kept]))


def _table(names: Iterable[str], times: Iterable[int], keys: Iterable[int]) -> pa.Table:
    names = pa.array(names, pa.string())
    return pa.table([names, pa.array(np.zeros(len(names), dtype=bool)), pa.array(times, pa.int64()), pa.array(keys, pa.int64())], schema=_ROWS)


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    rows = rows.set_column(0, "name", rows["name"].combine_chunks().dictionary_encode())
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(state: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(state))).read_all().cast(_ROWS)


def stream_repeats(rows: DataFrame, key: str, unique: tuple[str, ...], event_time: str, delay: str, horizon_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(key, error) for every row of a stream that repeats an identity of an earlier one."""
    error = f"duplicate {','.join(unique)}"

    def judge(_: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        met = [_unpacked(state.get[0])] if state.exists else []
        for frame in frames:
            met.append(_table(frame["_name"], frame["_ms"].astype("int64"), frame["_key"].astype("int64")))
        watermark = state.getCurrentWatermarkMs()
        found, rest = settled_rows(pa.concat_tables(met), watermark, horizon_ms)
        if rest.num_rows:
            state.update((_packed(rest),))
            judged, time = rest["judged"].to_numpy(), rest["time"].to_numpy()
            if not judged.all():
                # a timeout comes when the watermark is beyond it, a row is due when it is reached
                state.setTimeoutTimestamp(max(int(time[~judged].min()) - 1, watermark, 1))
            elif horizon_ms is not None:
                state.setTimeoutTimestamp(max(int(time.max()) + horizon_ms, watermark + 1))
        elif state.exists:
            state.remove()
        if len(found):
            yield pd.DataFrame({"key": found, "error": error})

    timed = rows.where(F.col(event_time).isNotNull()).withColumn("_time", F.col(event_time).cast("timestamp")).withWatermark("_time", delay)
    name = F.to_json(F.struct(*[F.struct(F.col(c).alias("v")).alias(f"u{k}") for k, c in enumerate(unique)]))
    keyed = timed.select(name.alias("_name"), "_time", F.unix_millis("_time").alias("_ms"), F.col(key).cast("long").alias("_key"))
    groups = keyed.withColumn("_bucket", F.pmod(F.xxhash64("_name"), F.lit(buckets))).groupBy("_bucket")
    return groups.applyInPandasWithState(judge, "key long, error string", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
