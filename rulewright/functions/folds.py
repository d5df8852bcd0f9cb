"""Folds over long arrays inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Outputs that are gathered before they are appended to those of earlier chunks.
CHUNK = 128


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def step(state: Column, output: Column) -> Column:
    return F.struct(state.alias("s"), output.alias("o"))


def fold(rows: Column, state: Column, state_type: str, out_type: str, each: Callable[[Column, Column], Column], use: Callable[[Column, Column], Column]) -> Column:
    """``each`` makes a ``step`` of (state, row), row by row; ``use`` gets the last state and all outputs.

    Outputs are gathered in chunks, so that appending one copies at most a chunk, or one reference for
    each chunk: the cost does not grow with the square of the rows.
    """
    none = F.expr(f"cast(array() as array<{out_type}>)")
    chunks = F.when(F.size(rows) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK).cast("int")), lambda c: F.slice(rows, c * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.array())
    start = step(state.cast(state_type), F.expr(f"cast(array() as array<array<{out_type}>>)"))

    def one(acc: Column, row: Column) -> Column:
        return once(each(acc["s"], row), lambda r: step(r["s"], F.concat(acc["o"], F.array(r["o"]))))

    def chunk(acc: Column, part: Column) -> Column:
        return F.aggregate(part, step(acc["s"], none), one, lambda r: step(r["s"], F.concat(acc["o"], F.array(r["o"]))))

    return F.aggregate(chunks, start, chunk, lambda r: once(F.flatten(r["o"]), lambda out: use(r["s"], out)))
