"""Verdicts over a stream of documents. A document is judged in its own row, so a stream needs no state for it; tallies over
event time are windowed aggregates behind a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arborq.operators.process import process


def process_stream(
    stream: DataFrame,
    sink: Callable[[DataFrame, int], None],
    *,
    validating: bool = False,
    id_col: str = "doc_id",
    source_col: str = "source",
    checkpoint: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Starts a query that gives ``sink`` the verdicts of each micro-batch, with its number for exactly-once writes."""
    verdicts = process(stream, validating=validating, id_col=id_col, source_col=source_col)
    writer = verdicts.writeStream.foreachBatch(sink)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def verdict_counts(
    stream: DataFrame,
    time_col: str,
    *,
    width: str = "5 minutes",
    late: str = "10 minutes",
    validating: bool = False,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """``(begin, verdict, n)`` by windows of event time; rows later than ``late`` behind the newest are left out of windows that
    are closed. Works on tables too, where nothing is late."""
    rows = process(stream, validating=validating, id_col=id_col, source_col=source_col, keep=[time_col]).withWatermark(time_col, late)
    counts = rows.groupBy(F.window(time_col, width).alias("w"), "verdict").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("begin"), "verdict", "n")
