"""Shared plumbing of the training-data operators.

Nothing outside this subpackage imports it.  Three concerns live here:

* ``prepare(spark)`` sends this package to the executors;
* ``stored(df, name)`` cuts lineage by writing a table below the folder named by
  ``spark.checkpoint.dir`` and reading it back.  The files are shared, so the
  loss of an executor never costs more than the running stage.  While a table is
  written, Arrow batches are small; the session's setting is put back after it.
  Elsewhere Spark bounds a batch in bytes, and ``map_arrow`` works through it in
  slices of few rows, so very long texts fit a worker;
* small vectorised hash helpers used by several operators.
"""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship

#: Rows that are worked on at once: 256 texts of the longest kind (about 120 kB) stay near 30 MB.
BATCH_ROWS = 256
#: Entries that a worker's memo of words keeps before it starts afresh.
MEMO_ENTRIES = 100_000
#: Longer keys are computed each time instead of being kept.
MEMO_KEY_CHARS = 48

#: A filter of hashes never takes more bits than this (2 MB), however many hashes there are.
MOST_FILTER_BITS = 1 << 24

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_written: dict[str, list[str]] = {}
_batches = threading.Lock()
_small: dict[str, tuple[int, str]] = {}
_scratch: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def prepare(spark: SparkSession) -> None:
    """Make the package importable on executors (idempotent)."""
    ship(spark)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one only where it is unset (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            shared = current.get()
        else:
            shared = "file://" + tempfile.mkdtemp(prefix="rulewright-")
            sc.setCheckpointDir(shared)
    return shared.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``sweep`` will remove."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    inside = _scratch.get()
    if inside is not None:
        inside.append(path)
    return path


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``BATCH_ROWS`` inside; the last of several that overlap puts the setting back."""
    key, session = "spark.sql.execution.arrow.maxRecordsPerBatch", str(spark._jsparkSession.sessionUUID())
    with _batches:
        inside, before = _small.get(session, (0, spark.conf.get(key)))
        _small[session] = (inside + 1, before)
        spark.conf.set(key, str(BATCH_ROWS if int(before) <= 0 else min(BATCH_ROWS, int(before))))
    try:
        yield
    finally:
        with _batches:
            inside, before = _small.pop(session)
            if inside > 1:
                _small[session] = (inside - 1, before)
            else:
                spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Ids that are given to rows without one of their own begin here; ids of documents are smaller.
OWN_IDS = 1 << 62


def own_id(*columns) -> Column:
    """An id beyond those of documents that belongs to the values of these columns."""
    return F.xxhash64(*columns).bitwiseAND(F.lit(OWN_IDS - 1)).bitwiseOR(F.lit(OWN_IDS))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession) -> int:
    """Remove the intermediate tables of this application; call it once their results are written elsewhere."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


class Scratch:
    """Within this context, the intermediate tables that it makes itself can be removed; others are left alone."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self._before = _scratch.set(self.paths)
        return self

    def __exit__(self, *_) -> None:
        _scratch.reset(self._before)

    def sweep(self, keep: str) -> None:
        """Remove all but one of them."""
        all_written = _written.get(self.spark.sparkContext.applicationId, [])
        for path in [p for p in self.paths if p != keep]:
            _delete(self.spark, path)
            self.paths.remove(path)
            if path in all_written:
                all_written.remove(path)


def lower_words(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of UTF-8 bytes after lower-casing A-Z only."""
    return text.translate(_LOWER).split()


class WordHashes(dict):
    """word -> 64-bit hash, kept for repeated words within bounds."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= MEMO_KEY_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (wraps modulo 2**64)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class HashFilter:
    """A bit table of 64-bit hashes: never a no for one of them; sometimes a yes for others."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        slot = h.astype(np.uint64) & self.mask
        return (self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def hash_filter(hashes: DataFrame, column: str = "h") -> HashFilter:
    """The filter of a stored column of long hashes.

    It is put together by Spark; the driver gets at most ``MOST_FILTER_BITS`` bits.
    With more hashes than bits it lets more pass, and what it lets pass is
    always joined exactly, so its size is a matter of cost only.
    """
    bits, n = 1 << 12, hashes.count()
    while bits < MOST_FILTER_BITS and bits < 16 * n:
        bits <<= 2
    slot = hashes.select(F.col(column).bitwiseAND(F.lit(bits - 1)).alias("slot"))
    table = slot.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"))
    words = np.zeros(bits // 64, np.uint64)
    for r in table.collect():
        words[r["at"]] = r["bits"] & 0xFFFFFFFFFFFFFFFF
    return HashFilter(words)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes; position-sensitive.

    Runs double in length while the width allows, so the cost is log2(width) passes.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    have, cover, part = None, 0, mix64(h)
    size, rest = 1, width
    while True:
        if rest & 1:
            m = len(h) - cover - size + 1
            have = part[:m] if have is None else mix64(have[:m] * np.uint64(0xA24BAED4963EE407) + part[cover : cover + m])
            cover += size
        rest >>= 1
        if not rest:
            return have
        part = mix64(part[:-size] * np.uint64(0x9FB21C651E98DF25) + part[size:])
        size *= 2


def release() -> None:
    """Give freed memory back to the system: a pool of idle workers shares an executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def text_column(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def map_arrow(df: DataFrame, each: Callable[[pa.RecordBatch], dict], schema: pa.Schema, ddl: str, setup=None) -> DataFrame:
    """``mapInArrow`` of a function that turns a slice of a batch into columns, or into several sets of them; ``setup`` runs once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                made = each(part, state) if setup else each(part)
                for columns in [made] if isinstance(made, dict) else made:
                    yield pa.RecordBatch.from_pydict(columns, schema=schema)
                    del columns
        state = batch = part = None
        release()

    return df.mapInArrow(run, ddl)
