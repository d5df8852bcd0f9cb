"""Exact token counts at every prefix by dynamic programming.

The model is a BPE over pieces with the space written as U+2581 and one such
mark put in front of a text.  No piece has this mark after another character, and
none joins Latin letters to anything else (both are checked when the model is
read), so no merge crosses such a place: a text falls into independent *units*
(marks, then a run of Latin letters or of other characters).

Inside a unit the programme keeps, for every prefix, the last token of its
encoding and its token count.  The last token of a prefix is the one token
``t`` that ends there and that stays as it is after the last token ``p`` of the
prefix in front of it, which holds when encoding ``p + t`` gives just ``p, t``.
Then count(prefix) = count(prefix without t) + 1.  Characters outside the
vocabulary fall back to their UTF-8 bytes and take no part in merges.

The table of a corpus keeps, beside each document, by how much the count changes
with each character: one signed byte a character, which is the count of *every*
prefix once summed up.  Token counts, limits, truncation ("longest prefix of at
most k tokens") and budgets are look-ups in that table; nothing is encoded again
and no text is read again.

Special cases: null counts as empty; an empty text has 0 tokens and one prefix,
the empty one; repeated rows and ids, null ids too, are counted row by row.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO_KEY_CHARS, binary_column, map_arrow, prepare, stored, text_column

MARK = "▁"
#: Production limit on a document's tokens.
TOKEN_LIMIT = 4096
#: Units whose steps a worker keeps (about 100 MB) before it starts afresh.
MEMO_ENTRIES = 600_000
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_UNIT = re.compile(f"{MARK}*[{_LATIN}]+|{MARK}*[^{MARK}{_LATIN}]+|{MARK}+")
_loaded: dict[str, PrefixCounter] = {}


class PrefixCounter:
    """The dynamic programme over one model, with a bounded memo of units."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.longest = max(map(len, self.score))
        if any(len(_UNIT.findall(p)) > 1 for p in self.score) or model.normalize(" a  ½ ") != MARK + " a  ½ ".replace(" ", MARK):
            raise ValueError("units are independent only where no piece spans two of them and text isn't normalised")
        self.stays: dict[tuple[str, str], bool] = {}
        self.steps = _Steps(self)

    def merge(self, text: str) -> list[str]:
        """Encode a short string: join the best-scored neighbours, the left one first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, before: str, token: str) -> bool:
        key = (before, token)
        known = self.stays.get(key)
        if known is None:
            if len(self.stays) >= MEMO_ENTRIES:
                self.stays.clear()
            known = self.stays[key] = self.merge(before + token) == [before, token]
        return known

    def prefixes(self, unit: str) -> list[int]:
        """Token count of each prefix of a unit, from the empty one to the whole."""
        counts, last = [0], [""]
        score, longest, stays = self.score, self.longest, self.stays
        for end in range(1, len(unit) + 1):
            for start in range(max(0, end - longest), end):
                token = unit[start:end]
                if token not in score:
                    continue
                before = last[start]
                if not start or not before:
                    break
                known = stays.get((before, token))
                if self.compatible(before, token) if known is None else known:
                    break
            else:  # no token ends here: the character's bytes
                counts.append(counts[end - 1] + len(unit[end - 1].encode("utf-8", "surrogatepass")))
                last.append("")
                continue
            counts.append(counts[start] + 1)
            last.append(token)
        return counts

    def units(self, text: str) -> list[str]:
        return _UNIT.findall(MARK + text.replace(" ", MARK)) if text else []

    def text_steps(self, text: str) -> bytes:
        """By how much the count changes with each character of a text, as signed bytes."""
        steps = b"".join(map(self.steps.__getitem__, self.units(text)))
        if not steps:
            return steps
        own = np.frombuffer(steps, np.int8)[1:].copy()
        own[0] += np.frombuffer(steps, np.int8)[0]  # the mark in front is no character of the text
        return own.tobytes()

    def table(self, text: str) -> np.ndarray:
        """Counts of every prefix of a text, in code points; entry k is that of text[:k]."""
        return counts_of(self.text_steps(text))


class _Steps(dict):
    """unit -> the steps of its prefix counts, kept for short units within bounds."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, unit: str) -> bytes:
        counts = self.counter.prefixes(unit)
        # an array of signed bytes refuses a step beyond 127; the longest piece has 64 bytes
        steps = array("b", [b - a for a, b in zip(counts, counts[1:], strict=False)]).tobytes()
        if len(unit) <= MEMO_KEY_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[unit] = steps
        return steps


def counts_of(steps: bytes) -> np.ndarray:
    """Token counts of all prefixes, from the empty one to the whole, from stored steps."""
    out = np.zeros(len(steps) + 1, np.int32)
    np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int32, out=out[1:])
    return out


def longest_fit(steps: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens, from stored steps (-1 for a negative budget)."""
    fits = np.flatnonzero(counts_of(steps) <= budget)
    return int(fits[-1]) if len(fits) else -1


def counter(model: str) -> PrefixCounter:
    """The counter of a model file, made once in each worker."""
    if model not in _loaded:
        _loaded[model] = PrefixCounter(public_tokenizers.path(model))
    return _loaded[model]


def prefix_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """(id, n_bytes long, steps binary): the exact token count of every prefix of every text, one byte a character.

    One narrow stage.  Write it once; all look-ups below read it instead of the texts.
    """
    prepare(docs.sparkSession)

    def each(batch: pa.RecordBatch) -> dict:
        c = counter(model)
        texts = [t or "" for t in text_column(batch, "text")]
        return {"id": batch.column(0), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "steps": pa.array([c.text_steps(t) for t in texts], pa.binary())}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), each, None, f"id {kind}, n_bytes long, steps binary").withColumnRenamed("id", id_col)


def prefix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """(id, counts array<int>): the same table with the counts summed up."""

    def each(batch: pa.RecordBatch) -> dict:
        counts = [counts_of(s or b"") for s in binary_column(batch, "steps")]
        ends = np.cumsum([0, *map(len, counts)]).astype(np.int32)
        return {"id": batch.column(0), "counts": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(counts)))}

    table = prefix_table(docs, id_col, text_col, model)
    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(table.select(F.col(id_col).alias("id"), "steps"), each, None, f"id {kind}, counts array<int>").withColumnRenamed("id", id_col)


def truncate(docs: DataFrame, counts: DataFrame, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts cut to their longest prefix of at most ``budget`` tokens, by look-up in stored counts."""
    fits = counts.select(id_col, F.expr(f"array_max(filter(transform(counts, (c, i) -> if(c <= {int(budget)}, i, -1)), x -> x >= 0))").alias("_rw_fit"))
    return docs.join(fits, id_col).withColumn(text_col, F.substring(F.col(text_col), F.lit(1), F.col("_rw_fit"))).drop("_rw_fit")


def look_up(table: DataFrame, limit: int = TOKEN_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars) from a prefix table: no text, no model, no encoder."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fit_chars", pa.int64())])

    def each(batch: pa.RecordBatch) -> dict:
        steps = binary_column(batch, "steps")
        total = [int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps]
        over = [n > limit for n in total]
        return {"doc_id": batch.column(0), "n_bytes": batch.column(1), "n_tokens": total, "over_limit": over, "fit_chars": [longest_fit(s, limit) if o else len(s) for s, o in zip(steps, over, strict=True)]}

    return map_arrow(table.select(F.col("doc_id").cast("long"), "n_bytes", "steps"), each, schema, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def document_counts(docs: DataFrame, limit: int = TOKEN_LIMIT, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Token counts of whole documents and the prefix that meets the limit, looked up in their stored prefix table."""
    return look_up(stored(prefix_table(docs.select("doc_id", "text"), model=model), "prefixes"), limit)
