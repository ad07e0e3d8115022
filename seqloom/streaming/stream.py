"""Sketches of streams: each row is handled alone, so no state and no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators.sketch import Sketch


def sketch_stream(sequences: DataFrame, sketch: Sketch) -> DataFrame:
    """The rows of ``sketch`` for a streaming DataFrame with ``seq_id, seq``."""
    if not sequences.isStreaming:
        raise ValueError("not a stream; use Sketch.run")
    return sketch.run(sequences, strategy="arrow")


def write_available(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there now as Parquet, exactly once, and ends."""
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
