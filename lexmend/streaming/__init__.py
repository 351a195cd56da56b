"""Repair of streams: every operator here is a map over rows, so streams need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexmend.config import DEFAULT, TextFixerConfig
from lexmend.operators.repair import fix_column


def fix_stream(stream: DataFrame, column: str = "text", config: TextFixerConfig = DEFAULT) -> DataFrame:
    """The stream with repaired texts."""
    if not stream.isStreaming:
        raise ValueError("not a stream; use fix_column")
    return fix_column(stream, column, config=config)


def start_fixed(stream: DataFrame, path: str, checkpoint: str, column: str = "text", config: TextFixerConfig = DEFAULT, kind: str = "parquet", **trigger) -> StreamingQuery:
    """Starts writing the repaired stream to files, exactly once by the checkpoint."""
    return fix_stream(stream, column, config).writeStream.format(kind).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)
