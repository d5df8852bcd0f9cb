"""Toxicity scores by FTRL-proximal logistic regression over hashed features.

Features are the words of a text (A-Z lower-cased, punctuation stripped from
their ends), each also by its stems (its first bytes, so that inflected forms
share a coordinate), their neighbours as bigrams, and skip-grams that leave out
one word, hashed into ``2 ** BITS`` coordinates and taken as present or absent.
Training runs over a bounded sample of labelled rows (``TRAIN_ROWS``, those of
smallest hash) as a stream in one task: per-coordinate learning rates, L1 and L2
proximal steps, most coordinates end at exactly zero.  The few non-zero weights
are broadcast and every whole text is scored where it is.

Rows of the held-out fold (crc32 of the id modulo 3 is 1) are never trained on;
label, language, source and id are no features.

Special cases: a null or empty text has only the intercept; several labels of
one document are all trained on; null labels and labels of unknown documents are
ignored; without labelled rows all scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MEMO_ENTRIES, binary_column, map_arrow, mix64, prepare, stored

BITS = 20
#: Labelled rows that are trained on: all of them up to this bound.
TRAIN_ROWS = 16_384
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.1
#: Bytes of the stems that stand beside a longer word.
STEMS = (4, 5, 6)
TOXIC_AT = 0.7
_STRIP = b".,;:!?\"'()[]{}*#%&$<>|-_/\\"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class _Tokens(dict):
    """word -> row of a table with the hashes of the bare word and of its stems.

    It is emptied between two texts only: the rows of one text stay valid until
    all are read, so a text of more distinct words than the bound outgrows it.
    """

    def __init__(self):
        super().__init__()
        self.table = np.zeros((1024, 1 + len(STEMS)), np.uint64)

    def __missing__(self, word: bytes) -> int:
        row = len(self)
        if row == len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        bare = word.strip(_STRIP) or word
        self.table[row] = [xxhash.xxh64_intdigest(bare), *(xxhash.xxh64_intdigest(bare[:k], seed=k) if len(bare) > k else 0 for k in STEMS)]
        self[word] = row
        return row

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) + len(words) > MEMO_ENTRIES:  # before the first row of this text is handed out
            self.clear()
            self.table = self.table[:1024].copy()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.table[rows]  # which may have grown meanwhile


def features(text: bytes | None, tokens: _Tokens) -> np.ndarray:
    """Coordinates of unigrams, stems, bigrams and skip-grams, with repeats."""
    rows = tokens.of(text.translate(_LOWER).split() if text else [])
    shift = np.uint64(64 - BITS)
    step = np.uint64(0xC2B2AE3D27D4EB4F)
    h = mix64(rows[:, 0])
    stems = rows[:, 1:].ravel()
    grams = [h, mix64(stems[stems != 0]), mix64(h[:-1] * step + h[1:]), mix64(h[:-2] * (step ^ np.uint64(2)) + h[2:])]
    return np.concatenate([g >> shift for g in grams]).astype(np.int64)


class Ftrl:
    """FTRL-proximal with per-coordinate rates; coordinate 2**BITS is the intercept (no L1)."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.l1 = np.full(size + 1, L1)
        self.l1[size] = 0.0

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1[at], 0.0, -(z - np.sign(z) * self.l1[at]) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def held_out(doc_id: Column) -> Column:
    """The fold by id; a null id is in none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> dict[int, float]:
    """Non-zero weights by coordinate, at most 2**BITS + 1 of them."""
    prepare(docs.sparkSession)
    known = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(~held_out(F.col("doc_id")))
    ids = docs.select(F.col("doc_id").cast("long").alias("_rw_id"))
    known = known.join(ids, F.col("doc_id") == F.col("_rw_id"), "left_semi")  # labels of unknown documents take no place
    order = F.xxhash64("doc_id", F.lit(17))
    sample = stored(known.orderBy(order, "doc_id", "toxic").limit(rows), "sample")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id")  # at most `rows` of 12 bytes

    def vectors(batch: pa.RecordBatch, tokens: _Tokens) -> dict:
        found = [np.unique(features(t, tokens)).astype(np.int32).tobytes() for t in binary_column(batch, "text")]
        return {"doc_id": batch.column(0), "toxic": batch.column(1), "features": found}

    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("features", pa.binary())])
    made = stored(map_arrow(texts.select("doc_id", "toxic", "text"), vectors, schema, "doc_id long, toxic int, features binary", _Tokens), "features")
    # epochs are made after the exchange, which moves every row once
    stream = made.repartition(1).select("*", F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch")).sortWithinPartitions("epoch", F.xxhash64("doc_id", "epoch"), "doc_id", "toxic")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl(1 << BITS)
        for batch in batches:
            for label, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at = np.append(np.frombuffer(x, np.int32), 1 << BITS).astype(np.int64)
                model.learn(at, label)
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_pydict({"at": at, "weight": w[at]})

    return {r["at"]: r["weight"] for r in stream.mapInArrow(learn, "at long, weight double").collect()}


def score(docs: DataFrame, weights: dict[int, float]) -> DataFrame:
    """(doc_id, score): a narrow stage; the weights are broadcast (8 MB at most)."""
    prepare(docs.sparkSession)
    dense = np.zeros(1 << BITS)
    for at, w in weights.items():
        if at < 1 << BITS:
            dense[at] = w
    sparse_at = np.flatnonzero(dense).astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((sparse_at, dense[sparse_at], weights.get(1 << BITS, 0.0)))

    def load() -> tuple:
        at, w, intercept = shared.value
        full = np.zeros(1 << BITS)
        full[at] = w
        return full, full != 0, intercept, _Tokens()

    def each(batch: pa.RecordBatch, state: tuple) -> dict:
        full, there, intercept, tokens = state
        out = []
        for text in binary_column(batch, "text"):
            at = features(text, tokens)
            total = intercept + float(full[np.unique(at[there[at]])].sum())
            out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
        return {"doc_id": batch.column(0), "score": np.array(out)}

    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), each, schema, "doc_id long, score double", load)


def judged_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))
