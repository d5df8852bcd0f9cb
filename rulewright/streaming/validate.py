"""Row checks on streams: stateless, so no watermark and no state is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.validator import table_errors


def stream_errors(rows: DataFrame, key: str, required: tuple[str, ...] = (), enums: dict[str, tuple[str, ...]] | None = None, nested: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """The errors of ``table_errors`` for a streaming table; repeated identities need state (``repeats.py``) or a batch."""
    return table_errors(rows, key, required, enums, nested=nested)


def write_errors(errors: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append errors to Parquet, exactly once, for all input that is there."""
    return errors.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
